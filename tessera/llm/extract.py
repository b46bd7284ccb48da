"""Main text of web pages: boosted trees judge every element, and a decoding over the tree
settles the judgements so that what lies inside a dropped element is dropped too.

No labels come with pages, so the trees learn from pages of known main text that are made
here: layouts of common sites, with semantic or plain elements, their usual attribute names,
and filling of random words. The model is the same for every input.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosting
from tessera.llm.dom import FEATURES, Page, node_features

#: Made training pages.
TRAIN_PAGES = 900
#: Elements judged at once.
NODES = 20_000


# --- training pages ----------------------------------------------------------------------

class _Maker:
    """Random pages; text that belongs to the article carries a mark in front of each word."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int, main: bool = False, stops: bool = True) -> str:
        r, out = self.r, []
        for _ in range(r.randint(lo, hi)):
            w = "".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randint(1, 9)))
            if stops and r.random() < 0.12:
                w += r.choice(".,;")
            out.append(self.MARK + w if main else w)
        return " ".join(out)

    def attrs(self, *names: str, p: float = 0.85) -> str:
        r = self.r
        if r.random() > p:
            return ""
        value = r.choice(names)
        if r.random() < 0.3:
            value = r.choice(("site-{}", "{}-wrap", "{}__inner", "js-{}", "{}Box", "{} clearfix", "page-{}", "{}-1")).format(value)
        return f' {r.choice(("class", "class", "class", "id"))}="{value}"'

    def el(self, tags: str, names: tuple[str, ...], inside: str) -> str:
        tag = self.r.choice(tags.split())
        plain = tag in ("div", "section", "ul", "p", "span")
        return f"<{tag}{self.attrs(*names, p=0.97 if plain else 0.4)}>{inside}</{tag}>"

    def veil(self, p: float) -> str:
        """Hides an element, now and then."""
        r = self.r
        return r.choice((" hidden", ' aria-hidden="true"', ' style="display:none"', ' style="visibility: hidden"')) if r.random() < p else ""

    def inline(self) -> str:
        """Something within a line that is not of the article."""
        tag, names = self.r.choice((("span", ("ad", "ads", "sponsored", "promo", "advert")), ("span", ("share", "social", "share-line")),
                                    ("a", ("ad", "share", "promo", "sponsor")), ("x-box", ("ad", "promo")), ("span", ("comment-count", "newsletter", "subscribe"))))
        return f"<{tag}{self.attrs(*names, p=1)}>{self.words(1, 12, stops=False)}</{tag}>"

    def within(self, lo: int, hi: int) -> str:
        """A line of the article with inline elements, some of which say what they are for."""
        r, out = self.r, [self.words(lo, hi, True)]
        while r.random() < 0.3:
            kind = r.random()
            if kind < 0.45:
                out.append(self.inline())
            elif kind < 0.75:
                out.append(f"<span{self.attrs('text', 'entry', 'main-term', 'story', 'content-part', p=.9)}>{self.words(1, 8, True)}</span>")
            else:
                out.append(f"{r.choice(('<b>', '<math>', '<svg><text>', '<object>'))}{self.words(1, 6, True)}")
                out[-1] += {"<b>": "</b>", "<ma": "</math>", "<sv": "</text></svg>", "<ob": "</object>"}[out[-1][:3]]
            out.append(self.words(1, 20, True))
        return " ".join(out)

    def links(self, lo: int, hi: int) -> str:
        items = "".join(f'<li><a href="#">{self.words(1, 4, stops=self.r.random() < .2)}</a></li>' for _ in range(self.r.randint(lo, hi)))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("<li>", "").replace("</li>", " ")

    def nav(self) -> str:
        return self.el("nav nav div ul", ("nav", "menu", "navbar", "navigation", "breadcrumb", "main-menu"), self.links(2, 9))

    def head(self) -> str:
        inside = self.r.choice((f"<h1>{self.words(1, 5)}</h1>", f"<p>{self.words(1, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>'))
        return self.el("header header div", ("header", "masthead", "banner", "top", "branding"), inside + (self.nav() if self.r.random() < .5 else ""))

    def foot(self) -> str:
        inside = f"&copy; {self.words(2, 25)}"
        inside = f"<p>{inside}</p>" if self.r.random() < 0.5 else inside
        return self.el("footer footer div", ("footer", "site-footer", "bottom", "copyright"), inside + (self.links(2, 6) if self.r.random() < .3 else ""))

    def ad(self) -> str:
        text = self.words(2, 40)
        return self.el("div div aside section p", ("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot"),
                       self.r.choice((text, f"<p>{text}</p>", f'<a href="#">{text}</a>')))

    def side(self) -> str:
        inside = "".join(self.r.choice((lambda: f"<h3>{self.words(1, 4)}</h3>{self.links(2, 6)}", lambda: f"<p>{self.words(5, 60)}</p>",
                                        lambda: f"<div>{self.words(5, 40)}</div>"))() for _ in range(self.r.randint(1, 3)))
        return self.el("aside aside div section", ("sidebar", "side", "widget", "related", "rail", "popular", "recommended"), inside)

    def notice(self) -> str:
        text = self.words(4, 40) + self.r.choice(("", "<button>ok</button>"))
        if self.r.random() < 0.1:
            return f"<noscript>{text}</noscript>"
        if self.r.random() < 0.15:
            return f"<div{self.attrs('cookie', 'popup', 'modal', 'menu', 'overlay', 'toast', p=.8)}{self.veil(1)}>{text}</div>"
        return self.el("div div section aside", ("cookie-notice", "consent", "notice", "alert", "popup", "gdpr", "cookie-banner"),
                       self.r.choice((text, f"<p>{text}</p>")))

    def form(self) -> str:
        return self.el("form form div", ("search", "newsletter", "subscribe", "login", "contact-form", "signup"),
                       f"<p>{self.words(1, 20)}</p><label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>")

    def comments(self) -> str:
        one = lambda: self.el("li div article", ("comment", "comment-body", "reply", "comment"), f"<p>{self.words(3, 80)}</p>")
        return self.el("section div div ol", ("comments", "comment-list", "discussion", "responses", "reader-comments"),
                       f"<h2>{self.words(1, 3)}</h2>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 6))))

    def share(self) -> str:
        return self.el("div ul", ("share", "social", "sharing", "tags"), self.links(2, 5))

    def boiler(self) -> str:
        return self.r.choice((self.ad, self.ad, self.side, self.notice, self.form, self.share, self.nav))()

    def body(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = f"<h1>{self.words(1, 12, True)}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        for _ in range(r.choice((1, 1, 2, 3, 5, 9))):
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{r.choice(('', '<b>'))}{self.within(1, r.choice((8, 60, 200)))}{r.choice(('', '<br>'))}{r.choice(('</p>', '</p>', ''))}")
            elif kind < 0.76:
                out.append(f"<h2>{self.words(1, 8, True)}</h2>")
            elif kind < 0.84:
                items = "".join(f"<li>{self.words(1, 25, True)}</li>" for _ in range(r.randint(1, 6)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.words(4, 50, True)}</p></blockquote>")
            elif kind < 0.91:
                cells = "".join(f"<td>{self.words(1, 6, True)}</td>" for _ in range(3))
                out.append(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")
            elif kind < 0.94:
                out.append(f"<pre>{self.words(3, 30, True)}</pre>")
            else:
                out.append(f"<div>{self.words(5, 80, True)}</div>")
            if r.random() < 0.08:
                out.append(self.boiler())
        if r.random() < 0.1:
            deep = r.randint(1, 8)
            out = ["<div>" * deep, *out, "</div>" * deep]
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.body()
        kind = r.random()
        names = ("article", "content", "post", "entry-content", "main", "story-body", "post-content", "article-body", "text")
        if kind < 0.45:
            main = f"<article{self.attrs(*names, p=.3)}{self.veil(.04)}>{body}</article>"
        elif kind < 0.6:
            main = f"<main{self.attrs(*names, p=.3)}{self.veil(.04)}>{body}</main>"
        elif kind < 0.94:
            main = f"<div{self.attrs(*names, p=.92)}{self.veil(.04)}>{body}</div>"
        else:
            main = body
        if r.random() < 0.3:
            main = f"<div{self.attrs('content', 'main', 'page', 'wrapper', 'container', 'layout')}{self.veil(.04)}>{main}{self.side() if r.random() < .4 else ''}</div>"
        before = [f() for f, p in ((self.head, .4), (self.nav, .6), (self.notice, .25), (self.ad, .4), (self.form, .15), (self.side, .15)) if r.random() < p]
        after = [f() for f, p in ((self.share, .15), (self.comments, .35), (self.side, .25), (self.ad, .2), (self.form, .15), (self.notice, .1), (self.nav, .1)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        return "<html><body>" + "".join(before) + main + "".join(after) + (self.foot() if r.random() < .7 else "") + "</body></html>"


def training_rows(pages: int = TRAIN_PAGES, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of made pages: an element is kept if text of the article
    lies in it."""
    maker, xs, ys = _Maker(seed), [], []
    for _ in range(pages):
        page = Page(maker.page())
        keep = np.zeros(len(page.parent), bool)
        for node, text, _ in page.runs:
            keep[node] |= maker.MARK in text
        for i in range(len(keep) - 1, 0, -1):
            keep[page.parent[i]] |= keep[i]
        some = np.zeros(len(keep), bool)
        some[[node for node, t, _ in page.runs if not t.isspace()]] = True
        for i in range(len(some) - 1, 0, -1):
            some[page.parent[i]] |= some[i]
        some[0] = False  # the root is kept in any case
        clean = Page.__new__(Page)
        clean.__dict__.update(page.__dict__)
        clean.runs = [(n, t.replace(maker.MARK, ""), k) for n, t, k in page.runs]
        xs.append(node_features([clean])[some])
        ys.append(keep[some])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@lru_cache(maxsize=1)
def model() -> boosting.Trees:
    """The trees, trained once per process."""
    return boosting.fit(*training_rows())


# --- decoding ----------------------------------------------------------------------------

def decode(parent: list[int], margin: np.ndarray) -> np.ndarray:
    """Which elements are kept: the most likely choice among those where the root is kept and no
    element is kept inside a dropped one. From the leaves up, an element's margin takes on those
    of the subtrees worth keeping; from the root down, an element stays if its parent does and
    that sum is positive. Ties are dropped."""
    gain = margin.copy()
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = gain > 0
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] &= keep[parent[i]]
    return keep


def texts(pages: list[Page], trees: boosting.Trees) -> list[str]:
    """Main text of each page: the text of kept elements, blocks joined by one space. Only the trees
    judge: a hidden element is one with that feature."""
    if not pages:
        return []
    margins = trees.margin(node_features(pages))
    out, at = [], 0
    for p in pages:
        m = margins[at:at + len(p.parent)].copy()
        at += len(p.parent)
        # an element without text of its own or below it must not sway its parents
        some = np.zeros(len(m), bool)
        some[[node for node, t, _ in p.runs if not t.isspace()]] = True
        for i in range(len(m) - 1, 0, -1):
            some[p.parent[i]] |= some[i]
        m[~some] = 0.0
        out.append(p.text(decode(p.parent, m)))
    return out


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns and ``text``, the main text of every row's whole html.

    Null and empty html, and pages without an article, give an empty text. Broken markup is read
    as far as it goes: open elements end with their parents, stray ends are passed over. Repeated
    rows and null ids stay; an empty table gives an empty result; ``keep`` must not name a column
    ``text``.
    """
    if "text" in {c.lower() for c in keep}:
        raise ValueError("kept columns clash with text")
    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for b in parts:
            out, some, n = [], [], 0
            for t in b.column(b.num_columns - 1):
                some.append(Page(t.as_py()))
                n += len(some[-1].parent)
                if n >= NODES:
                    out += texts(some, trees)
                    some, n = [], 0
            out += texts(some, trees)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], [*b.schema.names[:-1], "text"])

    given = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}text string")


__all__ = ["FEATURES", "decode", "main_text", "model", "texts", "training_rows"]
