"""A small HTML reader for main-text extraction: elements, their attributes, and the runs of
text between block borders, with their features."""

from __future__ import annotations

import html
import re

import numpy as np

# Fixed values from the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe template noframes".split())
BLOCK = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
            "search section select summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - set("body html button noscript select option optgroup li dd dt td th tr tbody thead tfoot caption legend summary".split())
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "tr": {"table", "tbody", "thead", "tfoot"}, "tbody": {"table"}, "option": {"select", "optgroup"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|"
                    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Parts of class, id, role and label values that tell what an element is for.
KINDS = [
    "article content post entry story body text main blog prose",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead banner top logo branding hero",
    "footer foot bottom copyright legal colophon contentinfo",
    "sidebar side aside rail widget complementary related recommended popular trending more",
    "ad ads advert advertisement advertising sponsor sponsored promo promoted promotion adsense dfp",
    "cookie cookies consent notice notification alert gdpr popup modal overlay dialog toast warning message disclaimer",
    "comment comments reply replies discussion respond disqus reader response responses feedback",
    "form search login signup signin register subscribe newsletter input contact",
    "share sharing social follow tags tag meta byline author date",
    "hidden sr screen none invisible",
]
_KIND = {w: i for i, line in enumerate(KINDS) for w in line.split()}
TAGS = ["article main section div", "p blockquote pre dl dd dt", "h1 h2 h3 h4 h5 h6 hgroup", "nav menu", "header", "footer address",
        "aside", "form fieldset input button label legend search select option",  "ul ol", "li", "table tbody thead tr td th caption",
        "figure figcaption details summary", "body html", "noscript", "span a b i em strong font small"]
_TAG = {w: i for i, line in enumerate(TAGS) for w in line.split()}


class Page:
    """Elements of a page in page order, 0 the root, and its text.

    Elements are block elements, and inline ones that say what they are for or are hidden; other
    inline elements belong to the element around them. ``parent``, ``tag``, ``kinds`` (bits of
    ``KINDS``), ``hidden`` per element; ``runs`` are (element, text with its white space, characters
    within links); ``ends`` are the runs after which a block ends.
    """

    def __init__(self, source: str | None):
        self.parent, self.tag, self.kinds, self.hidden = [-1], ["html"], [0], [False]
        self.runs: list[tuple[int, str, int]] = []
        self.ends: list[int] = []
        self._read(source or "")

    def text(self, keep) -> str:
        """The runs of kept elements: white space inside a block is one space, as are its ends."""
        blocks, line, end = [], [], iter([*self.ends, len(self.runs)])
        stop = next(end)
        for i, (node, text, _) in enumerate(self.runs):
            while i >= stop:
                blocks.append("".join(line))
                line, stop = [], next(end, len(self.runs))
            if keep[node]:
                line.append(text)
        return " ".join(" ".join([*blocks, "".join(line)]).split())

    def _add(self, tag: str, parent: int, kinds: int, hidden: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # tag, element it is or lies in
        line: list[str] = []
        linked, in_link = 0, 0

        def end_part():
            nonlocal linked
            text = "".join(line)
            if text:
                self.runs.append((stack[-1][1], text, min(linked, len(text))))
            line.clear()
            linked = 0

        def end_run():
            end_part()
            if self.runs and (not self.ends or self.ends[-1] != len(self.runs)):
                self.ends.append(len(self.runs))

        def add(text: str):
            nonlocal linked
            if text:
                text = html.unescape(text) if "&" in text else text
                line.append(text)
                linked += len(text) if in_link else 0

        def pop_to(depth: int):
            nonlocal in_link
            while len(stack) > depth:
                tag, node = stack[-1]
                if tag in BLOCK:
                    end_run()
                elif node != stack[-2][1]:
                    end_part()
                stack.pop()
                in_link -= tag == "a"

        at = 0
        while True:
            m = _TOKEN.search(s, at)
            if not m:
                add(s[at:])
                break
            add(s[at:m.start()])
            at = m.end()
            shut, tag = m.group(1), m.group(2)
            if shut:
                shut = shut.lower()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == shut:
                        pop_to(i)
                        break
                else:
                    if shut in ("p", "br"):
                        line.append(" ")
                if shut in BLOCK:
                    end_run()
            elif tag:
                tag, attrs = tag.lower(), m.group(3)
                if tag in RAW:
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(s, at)
                    at = close.end() if close else (len(s) if not attrs.rstrip().endswith("/") else at)
                    line.append(" " if tag == "textarea" else "")
                    continue
                if tag in ("html", "body", "head", "frameset"):
                    end_run()
                    if tag == "body" and self.tag[0] == "html":
                        self.tag[0] = "body"
                        self.kinds[0] = self._kinds(attrs)[0]
                    continue
                if tag in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            pop_to(i)
                            break
                        if stack[i][0] in BLOCK:
                            break
                if tag in SIBLINGS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in FENCES.get(tag, ()):
                            break
                        if stack[i][0] in SIBLINGS[tag]:
                            pop_to(i)
                            break
                if tag in BLOCK:
                    end_run()
                    kinds, hidden = self._kinds(attrs)
                    node = self._add(tag, stack[-1][1], kinds, hidden or tag == "dialog" and " open" not in f" {attrs.lower()}")
                    if tag != "hr":
                        stack.append((tag, node))
                elif tag in VOID:
                    line.append(" " if tag == "br" else "")
                elif not attrs.rstrip().endswith("/"):
                    if tag == "a" and in_link:
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i][0] == "a":
                                pop_to(i)
                                break
                            if stack[i][0] in BLOCK:
                                break
                    kinds, hidden = self._kinds(attrs)
                    node = stack[-1][1]
                    if kinds or hidden:
                        end_part()
                        node = self._add(tag, node, kinds, hidden)
                    stack.append((tag, node))
                    in_link += tag == "a"
            elif m.group().startswith("<![CDATA["):
                line.append(" ")
        end_run()

    def _kinds(self, attrs: str) -> tuple[int, bool]:
        bits, hidden = 0, False
        if attrs and not attrs.isspace():
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-component"):
                    for w in _PART.findall(value):
                        if w.lower() in _KIND:
                            bits |= 1 << _KIND[w.lower()]
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                        name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                    hidden = True
        return bits, hidden


FEATURES = 3 * len(KINDS) + 3 * len(TAGS) + 20


def node_features(pages: list[Page]) -> np.ndarray:
    """One row per element of all pages, page after page: attribute parts and tags of its
    own, of what lies around it and of what lies inside, size and density of its subtree, depth,
    and how it stands among its siblings."""
    rows: list[list] = [[] for _ in range(16)]
    for page in pages:
        parent, n = page.parent, len(page.parent)
        #: attribute parts, and the tag above them, as bits
        marked = [k | (1 << len(KINDS) + _TAG[t] if t in _TAG else 0) for k, t in zip(page.kinds, page.tag, strict=True)]
        own, linked, runs, stops = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text, in_links in page.runs:
            size_ = len(text.strip())
            if not size_:
                continue
            own[node] += size_
            linked[node] += min(in_links, size_)
            runs[node] += 1
            stops[node] += text.count(".") + text.count(",")
        text, size, paragraphs = own[:], [1] * n, [int(t == "p") for t in page.tag]
        inside, biggest = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            size[p] += size[i]
            runs[p] += runs[i]
            stops[p] += stops[i]
            paragraphs[p] += paragraphs[i]
            inside[p] |= inside[i] | (marked[i] if text[i] else 0)
            biggest[p] = max(biggest[p], text[i])
        depth, place, many, around = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = many[p]
            many[p] += 1
            around[i] = around[p] | marked[p] if p else around[p]
        up = [max(p, 0) for p in parent]
        for col, values in zip(rows, (
                marked, around, inside, text, own, linked, size, runs, stops, depth, place, many, paragraphs, page.hidden,
                [(max(1, text[p]), many[p], text[i] >= biggest[p]) for i, p in enumerate(up)],
                [(max(1, text[0]), i / n) for i in range(n)]), strict=True):
            col += values
    marked, around, inside = (np.array(c, np.int64) for c in rows[:3])
    text, own, linked, size, runs, stops, depth, place, many, paragraphs, hidden = (np.array(c, np.float32) for c in rows[3:14])
    above, beside, most = np.array(rows[14], np.float32).reshape(-1, 3).T
    whole, where = np.array(rows[15], np.float32).reshape(-1, 2).T
    bits = 1 << np.arange(len(KINDS) + len(TAGS))
    some = np.maximum(1, text)
    return np.concatenate([
        *((m[:, None] & bits != 0).astype(np.float32) for m in (marked, around, inside)),
        np.stack([np.log1p(text), np.log1p(own), text / whole, text / above, linked / some, np.log1p(size), text / size,
                  np.log1p(runs), text / np.maximum(1, runs), stops / some * 100, depth, place, beside,
                  place / np.maximum(1, beside), many, np.log1p(paragraphs), paragraphs / size, most, where, hidden], axis=1),
    ], axis=1)
