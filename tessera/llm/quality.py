"""Quality scores by compression: zstandard dictionaries of good and of bad text, and a
calibrated score of the normalised difference of the compressed sizes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled documents per class that may reach the driver: two thirds make the dictionary,
#: one third the calibration.
SAMPLE_PER_CLASS = 1200
#: Pieces taken at even distances over the whole text of a training document at most: what one
#: document may bring to the driver (24 KB), so that long texts do not outweigh the others.
PIECES_PER_SAMPLE = 24
#: Bytes compressed at a time, so that the dictionary counts everywhere in a long text.
PIECE = 1024
DICT_BYTES = 1 << 16
LEVEL = 3


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries and the calibration. Without both classes it gives the constant ``prior``."""

    prior: float
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        made = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                 write_content_size=False, write_dict_id=False))
        self.good, self.bad = made

    def features(self, text: str | None) -> list[float]:
        """Differences of the compressed sizes over the whole text, by size with both
        dictionaries and by raw size, the least of a piece, and the size left by raw size."""
        n = with_good = with_bad = 0
        least = 1.0
        good, bad = self.good.compress, self.bad.compress
        for p in pieces(text):
            g, b = len(good(p)), len(bad(p))
            n += len(p)
            with_good += g
            with_bad += b
            least = min(least, (b - g) / (len(p) + 16))
        if not n:
            return [0.0, 0.0, 0.0, 0.0]
        return [(with_bad - with_good) / (with_bad + with_good), (with_bad - with_good) / (n + 16), least, with_good / (n + 16)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples for training are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b" "


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps: a weight for each feature and the constant."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6]) * weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ w * 1e-1
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * 1e-1
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / sd), float(w[-1] - (w[:-1] / sd) @ mean))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_PER_CLASS,
          pieces_each: int = PIECES_PER_SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled documents a class, chosen by a hash of the id, and at most
    ``pieces_each`` pieces of 1 KB of each.

    ``usable`` is a condition on the label table's id. Ids labelled 0 and 1 at once, null
    labels and labels other than 0 and 1 are left out. Class shares come from all usable labels.
    Of documents that repeat a chosen id the one whose text has the smallest hash is learned; null
    and empty texts teach nothing. Without both classes the model is the share of good labels.
    """
    lab = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    lab = lab.filter(usable) if usable is not None else lab
    lab = lab.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y1"))
    lab = lab.filter("y = y1").select("id", "y")
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    if len(counts) < 2:
        return QualityModel(prior)
    # some times the sample by their hash first, so that no class meets in one task
    lab = lab.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(7)))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, 4 * (sample + 20) / counts[1]))).otherwise(F.lit(min(1.0, 4 * (sample + 20) / counts[0])))
    order = Window.partitionBy("y").orderBy("h", "id")
    few = lab.filter(F.pmod("h", F.lit(1 << 20)) <= share * (1 << 20))
    chosen = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("id", "y", "k")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 x sample

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, str]] = {}  # of each chosen id the text with the smallest hash
        for b in parts:
            for text, y, k in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if text:
                    h = xxhash.xxh64_intdigest(text) >> 1
                    if (y, k) not in best or h < best[y, k][0]:
                        best[y, k] = h, text
        out = []
        for (y, k), (h, text) in best.items():
            p = pieces(text)
            out.append((p if len(p) <= pieces_each else [p[int(i)] for i in np.linspace(0, len(p) - 1, pieces_each)], y, k, h))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*out, strict=True)) or [[]] * 4, (pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["p", "y", "k", "h"])

    rows = some.select("text", "y", "k").mapInArrow(cut, "p array<binary>, y int, k int, h long")
    rows = rows.groupBy("y", "k").agg(F.min_by("p", "h").alias("p")).collect()
    rows.sort(key=lambda r: (r["y"], r["k"]))
    by = {y: [r for r in rows if r["y"] == y and r["p"]] for y in (0, 1)}
    train = {y: [bytes(p) for r in by[y] if r["k"] % 3 for p in r["p"]] for y in by}
    if not all(train.values()):
        return QualityModel(prior)
    good, bad = _dictionary(train[1]), _dictionary(train[0])
    tools = Compressors(good, bad)
    hold = [r for y in by for r in by[y] if not r["k"] % 3]
    if len({r["y"] for r in hold}) < 2:
        hold = by[0] + by[1]
    x = np.array([tools.features(b"".join(map(bytes, r["p"])).decode("utf-8", "replace")) for r in hold])
    y = np.array([r["y"] for r in hold], float)
    share = {c: counts[c] / total / max(1, int((y == c).sum())) * len(y) for c in (0, 1)}
    return QualityModel(prior, good, bad, _calibrate(x, y, np.where(y == 1, share[1], share[0])))


def score(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher is better) of every whole text. A null or
    empty text gets the share of good labels. Repeated rows and null ids stay as they are; an empty
    table gives an empty result; ``keep`` must not name a column ``score``."""
    if "score" in {c.lower() for c in keep}:
        raise ValueError("kept columns clash with score")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        tools = Compressors(m.good, m.bad) if m.weights else None
        for b in parts:
            texts, out = b.column(b.num_columns - 1), np.full(b.num_rows, m.prior)
            if tools:
                for i, t in enumerate(texts):
                    text = t.as_py()
                    if text:
                        z = float(np.dot(m.weights[:-1], tools.features(text)) + m.weights[-1])
                        out[i] = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "score"])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}, score double" if schema else "score double")


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
              text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score under ``least``; all columns stay. Empty texts have
    the prior score and so stay while good labels prevail."""
    model = learn(docs, labels, usable, id_col, text_col)
    names = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    return score(given, model, ["row"], "t").filter(F.col("score") >= least).select(*[F.col(f"row.`{c}`") for c in names])
