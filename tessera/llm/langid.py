"""Language identification in two steps: the language family first, then one-versus-one
linear support vector machines between the languages of that family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Training documents per language that are read and whose features reach the driver at most.
SAMPLE_PER_LANGUAGE = 250
#: Languages learned at most, those with the most training rows.
MAX_LANGUAGES = 64
#: Hashed features.
DIM = 1 << 12
#: Bytes of text that are featurised at once.
BLOCK = 1 << 19

# Families of common languages by ISO 639-1 code. Languages not listed join
# the family of the listed language whose training texts are most alike.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg sr hr bs sl mk pl cs sk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_OTHER = re.compile(r"[\W\d_]+")
# Word characters of regular expressions that are numbers, not letters (Unicode category L): ½ ² ①.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha())
_BLANKS = dict.fromkeys(map(ord, _NUMBERS), " ")


def normalise(text: str | None) -> bytes:
    """Letters of a whole text in lower case, words between single blanks; empty if it has none."""
    text = text or ""
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = text.translate(_BLANKS)
    line = _OTHER.sub(" ", text.lower()).strip()
    return f" {line} ".encode("utf-8", "surrogatepass") if line else b""


def features(data: np.ndarray) -> np.ndarray:
    """Feature numbers of the byte bigrams and trigrams that end at each place from the third."""
    a, b, c = (data[i:len(data) - 2 + i].astype(np.uint32) for i in range(3))
    tri = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    two = (b * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)) >> np.uint32(20)
    return np.stack([tri & np.uint32(DIM // 2 - 1), (two & np.uint32(DIM // 2 - 1)) + np.uint32(DIM // 2)])


def vector(text: bytes) -> np.ndarray:
    """Mean feature vector of a normalised text, read in blocks."""
    total = np.zeros(DIM)
    data = np.frombuffer(text, np.uint8)
    for i in range(0, max(0, len(data) - 2), BLOCK):
        total += np.bincount(features(data[i:i + BLOCK + 2]).ravel(), minlength=DIM)
    return total / max(1.0, total.sum())


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Linear support vector machine (squared hinge, balanced classes), y of -1 and 1:
    weights and constant, by accelerated gradient steps."""
    a, y = np.c_[x, np.ones(len(x))].astype(np.float32), y.astype(np.float32)
    n_pos = max(1, int((y > 0).sum()))
    share = np.where(y > 0, 0.5 / n_pos, 0.5 / max(1, len(y) - n_pos)) * cost
    step = 1 / (1 + 2 * (share * (a * a).sum(1)).sum())
    w = np.zeros(a.shape[1])
    ahead, t = w, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ ahead))
        nxt = ahead - step * (ahead * 1e-3 - 2 * a.T @ (share * y * slack))
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = nxt + (t - 1) / t1 * (nxt - w), nxt, t1
    return w


@dataclass(frozen=True)
class LanguageModel:
    """``families``: languages of each; ``columns``: what each weight column separates, (family,)
    against the rest or (family, language, language); ``weights``: DIM + 1 rows."""

    families: tuple[tuple[str, ...], ...]
    columns: tuple[tuple[int, ...], ...]
    weights: np.ndarray


def _families(langs: list[str], centres: dict[str, np.ndarray]) -> tuple[tuple[str, ...], ...]:
    groups: dict[str, list[str]] = {}
    listed = [x for x in langs if x.lower()[:2] in FAMILY_OF and len(x.split("-")[0]) == 2]
    for x in listed:
        groups.setdefault(FAMILY_OF[x.lower()[:2]], []).append(x)
    unit = {x: v / (np.linalg.norm(v) + 1e-12) for x, v in centres.items()}
    for x in langs:
        if x not in listed:
            near = max(listed, key=lambda k: (float(unit[k] @ unit[x]), k), default=None)
            groups.setdefault(FAMILY_OF[near.lower()[:2]] if near else "unlisted", []).append(x)
    return tuple(tuple(sorted(v)) for _, v in sorted(groups.items()))


def learn(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``sample`` documents of each of the ``MAX_LANGUAGES`` most frequent languages,
    chosen by a hash of the id among rows with a language, an id and ``usable``; whole texts are
    read, mean vectors reach the driver (16 KB each).

    Ids are chosen, not rows: of rows that repeat an id and a language the one whose text has the
    smallest hash is learned. Null texts and texts without a letter teach nothing; an empty table
    gives a model that predicts ``und``.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(usable) if usable is not None else rows
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("d"))
    sizes = {r["lang"]: r["d"] for r in sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    # some times the sample by their hash first, so that no language's ids meet in one task
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 8 * (sample + 10) / max(1, d)))) for x, d in sizes.items()], F.lit(0.0))
    some = ids.filter(F.pmod("h", F.lit(1 << 20)) <= share * (1 << 20)).filter(share > 0).distinct()
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("id", "lang")
    some = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    some = some.join(F.broadcast(chosen), ["id", "lang"])  # MAX_LANGUAGES x sample ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[int, str]] = {}  # of each chosen id the text with the smallest hash
        for b in parts:
            for text, lang, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if text:
                    h = xxhash.xxh64_intdigest(text) >> 1
                    if (lang, i) not in best or h < best[lang, i][0]:
                        best[lang, i] = h, text
        found = [(lang, i, h, vector(x).astype("<f4").tobytes()) for (lang, i), (h, t) in best.items() if (x := normalise(t))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            list(zip(*found, strict=True)) or [[]] * 4, (pa.string(), key, pa.int64(), pa.binary()), strict=True)], ["lang", "id", "h", "v"])

    kind = rows.schema[id_col].dataType
    key = to_arrow_type(kind)
    got = some.select("text", "lang", "id").mapInArrow(run, f"lang string, id {kind.simpleString()}, h long, v binary")
    got = got.groupBy("lang", "id").agg(F.min_by("v", "h").alias("v")).collect()
    got.sort(key=lambda r: (r["lang"], r["id"]))
    langs = sorted({r["lang"] for r in got})
    x = np.array([np.frombuffer(r["v"], "<f4") for r in got], float).reshape(-1, DIM) if got else np.zeros((0, DIM))
    y = np.array([langs.index(r["lang"]) for r in got], int)
    families = _families(langs, {name: x[y == i].mean(0) for i, name in enumerate(langs)})
    scale = 1 / (np.sqrt((x * x).sum(1).mean()) + 1e-12) if len(x) else 1.0
    home = {name: f for f, names in enumerate(families) for name in names}
    fam = np.array([home[langs[i]] for i in y], int)
    columns, weights = [], []
    for f in range(len(families) if len(families) > 1 else 0):
        columns.append((f,))
        weights.append(fit_svm(x * scale, np.where(fam == f, 1.0, -1.0)))
    for f, names in enumerate(families):
        for i, j in combinations(range(len(names)), 2):
            a, b = (y == langs.index(names[k]) for k in (i, j))
            columns.append((f, i, j))
            weights.append(fit_svm(x[a | b] * scale, np.where(a[a | b], 1.0, -1.0)))
    w = np.array(weights).T if weights else np.zeros((DIM + 1, 0))
    w[:-1] *= scale
    return LanguageModel(families, tuple(columns), w.astype(np.float32))


def _margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Decision values of every text, one row each: means of the weights of its features."""
    out = np.zeros((len(texts), weights.shape[1]))
    flat = np.ascontiguousarray(weights[:-1].T)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        if j == i + 1 and size > BLOCK:
            out[i] = vector(texts[i]) @ weights[:-1]
        else:
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            starts = np.cumsum([0, *map(len, texts[i:j])])
            if len(data) > 2:
                f = features(data)
                width = np.maximum(np.diff(starts) - 2, 0)  # places that lie within one text
                inside = np.repeat(starts[:-1], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                some = np.flatnonzero(width)
                at = (np.cumsum(width) - width)[some]
                for k, w in enumerate(flat):
                    both = w[f[0]] + w[f[1]]
                    if len(some):
                        out[i + some, k] = np.add.reduceat(both[inside], at) / (2 * width[some])
        i = j
    return out + weights[-1]


def decide(margins: np.ndarray, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each row: the family with the largest margin, then most votes of
    the pairs within it, ties to the larger margins."""
    at = {c: k for k, c in enumerate(model.columns)}
    n, many = len(margins), len(model.families)
    squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
    best, sure = np.zeros(n, int), np.ones(n)
    if many > 1:
        m = margins[:, [at[(f,)] for f in range(many)]]
        best = m.argmax(1)
        top = np.sort(m, axis=1)
        sure = squash((top[:, -1] - top[:, -2]) / 2)
    langs, score = np.full(n, "", object), np.zeros(n)
    for f, names in enumerate(model.families):
        rows = np.flatnonzero(best == f)
        votes, sums, least = (np.zeros((len(rows), len(names))) for _ in range(3))
        least += 1.0
        for i, j in combinations(range(len(names)), 2):
            m = margins[rows, at[(f, i, j)]]
            for k, sign in ((i, 1.0), (j, -1.0)):
                votes[:, k] += sign * m > 0
                sums[:, k] += np.tanh(sign * m)
                least[:, k] = np.minimum(least[:, k], squash(sign * m))
        pick = (votes + sums / (2 * len(names) + 1)).argmax(1) if len(names) else np.zeros(0, int)
        langs[rows] = np.array(names, object)[pick]
        score[rows] = sure[rows] * least[np.arange(len(rows)), pick]
    return langs.tolist(), score


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every whole text. Null and texts
    without a letter are ``und`` with score 0, as is all text where nothing was learned. Repeated rows
    and null ids stay as they are; an empty table gives an empty result; ``keep`` must not name a
    column like the results."""
    if {c.lower() for c in keep} & {"lang_pred", "score"}:
        raise ValueError("kept columns clash with lang_pred and score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # (DIM + 1) x pairs and families

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in parts:
            col = pc.fill_null(b.column(b.num_columns - 1), "")
            langs, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            some = [(i, t) for i, t in enumerate(normalise(x.as_py()) for x in col) if t] if m.families else []
            if some:
                got, sure = decide(_margins([t for _, t in some], m.weights), m)
                for (i, _), lang, s in zip(some, got, sure, strict=True):
                    langs[i], score[i] = lang, s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(score)],
                                             [*b.schema.names[:-1], "lang_pred", "score"])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}lang_pred string, score double")


def keep_known(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", languages: list[str] | None = None, least: float = 0.25) -> DataFrame:
    """``docs`` without the rows whose language is ``und``, not in ``languages`` (all learned ones
    if None) or scored under ``least``; all columns stay."""
    model = learn(docs, usable, id_col, text_col, lang_col)
    names = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    ok = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    ok = ok & F.col("lang_pred").isin(languages) if languages is not None else ok
    return predict(given, model, ["row"], "t").filter(ok).select(*[F.col(f"row.`{c}`") for c in names])
