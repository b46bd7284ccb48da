"""SimHash near-duplicates: fingerprints, and links within a few bits found by a
hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hot_keys, new_path, private, save
from tessera.llm.components import connected_components
from tessera.llm.files import by_key, of_key

SEED = 42
#: Children below one index node.
FANOUT = 8
#: Queries that descend the index together.
QUERY_BLOCK = 512
#: A bucket with more distinct fingerprints than this is split by further bit blocks.
BUCKET_LIMIT = 4096
#: Buckets are gathered to about this many fingerprints for one index.
INDEX_ROWS = 100_000
#: Shingles whose bits are summed at once.
SHINGLE_BLOCK = 1 << 17

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, length: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``length``-word shingle of a whole text, repeats included.
    A-Z are lower-cased, words are separated by ASCII white space; a text of fewer words is
    one shingle; without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= length:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    spans = zip(begins[:len(words) - length + 1].tolist(), ends[length - 1:].tolist(), strict=True)
    return np.fromiter((h(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - length + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half the hashes; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLE_BLOCK):
        part = hashes[i:i + SHINGLE_BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3,
                 key: list[Column] | None = None) -> DataFrame:
    """(id, fp) and the ``key`` columns: the 64-bit fingerprint of every row's whole text as a
    signed long."""
    key = key or []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fps = np.array([majority(shingle_hashes(t.as_py(), length)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fps)), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *key)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[2:])
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp long" + (f", {schema}" if schema else ""))


# --- the index ---------------------------------------------------------------------------

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Fingerprints in Gray order under a hierarchy of bit patterns.

    Neighbours in Gray order share most bits, so each node of up to ``FANOUT`` children holds
    the bits on which all fingerprints below it agree; a child keeps only the bits that its
    parent does not hold yet. A search adds the differing bits level by level and drops a
    whole group once the sum passes the bound; at a leaf the sum is the Hamming distance.
    """

    def __init__(self, words: np.ndarray):
        """``words`` must be in Gray order."""
        bits, mask = words, np.full(len(words), FULL)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(bits) > 1:
            heads = np.arange(0, len(bits), FANOUT)
            first = np.repeat(bits[heads], np.diff(np.append(heads, len(bits))))
            up_mask = np.bitwise_and.reduceat(mask, heads) & ~np.bitwise_or.reduceat(bits ^ first, heads)
            above = np.repeat(up_mask, np.diff(np.append(heads, len(bits))))
            self.levels.append((bits, mask & ~above))
            bits, mask = bits[heads] & up_mask, up_mask
        self.levels.append((bits, mask))
        self.words = words

    def search(self, queries: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, word number) of all pairs within ``bound`` bits."""
        who = np.arange(len(queries))
        bits, mask = self.levels[-1]
        node = np.zeros(len(queries), np.int64)
        if not len(bits):
            return who[:0], node[:0]
        total = np.bitwise_count((queries ^ bits[0]) & mask[0]).astype(np.int64)
        keep = total <= bound
        who, node, total = who[keep], node[keep], total[keep]
        for bits, mask in reversed(self.levels[:-1]):
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            who, total = np.repeat(who, FANOUT), np.repeat(total, FANOUT)
            inside = child < len(bits)
            who, total, node = who[inside], total[inside], child[inside]
            total = total + np.bitwise_count((queries[who] ^ bits[node]) & mask[node])
            keep = total <= bound
            who, node, total = who[keep], node[keep], total[keep]
        return who, node


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; ``label`` holds the smallest member of each class."""
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def linked(words: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (word, root word) of the classes that distances up to ``bound`` make
    of distinct ``words``."""
    words = words[np.argsort(gray_rank(words), kind="stable")]
    index, label = GrayIndex(words), np.arange(len(words))
    for i in range(0, len(words), QUERY_BLOCK):
        who, node = index.search(words[i:i + QUERY_BLOCK], bound)
        who = who + i
        later = node > who
        _union(label, who[later], node[later])
    moved = np.flatnonzero(label != np.arange(len(words)))
    return words[moved], words[label[moved]]


# --- dealing out -------------------------------------------------------------------------

def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits, int), n)]


def _mask(bits) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def block_masks(bound: int) -> list[tuple[int, list[int]]]:
    """Bit masks of which any two words within ``bound`` bits agree on at least one: two of
    ``bound + 2`` blocks. With each, masks that split the bits outside it: one of
    ``bound + 1`` blocks, of which such words agree on at least one too."""
    parts = _blocks(list(range(64)), bound + 2)
    out = []
    for i, j in combinations(range(len(parts)), 2):
        rest = [b for k, p in enumerate(parts) if k not in (i, j) for b in p]
        out.append((_mask(parts[i] + parts[j]), [_mask(p) for p in _blocks(rest, bound + 1)]))
    return out


def fingerprint_links(fps: DataFrame, bound: int) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints ``fp`` within ``bound`` bits.

    Each fingerprint goes to one bucket per mask; a bucket with more than ``BUCKET_LIMIT`` is
    split by further bits, so it holds at most the words that differ in the bits left. Tasks
    gather whole buckets and search each gathering with one Gray-order index.
    """
    if not 0 <= bound <= 8:
        raise ValueError("bound must be from 0 to 8")
    masks = block_masks(bound)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(masks)
    ])).alias("b")).select("fp", "b.t", "b.key")
    hot = hot_keys(keyed, ["t", "key"], BUCKET_LIMIT, "hot-buckets")
    wide = keyed.join(hot, ["t", "key"], "left")
    fine = F.coalesce(*[F.when(F.col("t") == i, F.array(*[
        F.struct(F.lit(k + 1).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("sub")) for k, m in enumerate(parts)
    ])) for i, (_, parts) in enumerate(masks)])
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("sub")))
    dealt = wide.select("fp", "t", "key", F.explode(F.when(F.col("n_rows").isNull(), whole).otherwise(fine)).alias("s"))
    dealt = dealt.select("fp", "t", "key", "s.part", "s.sub")
    where = ["t", "key", "part", "sub"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush(cols):
            words = np.concatenate([c[0] for c in cols])
            keys = np.concatenate([c[1] for c in cols])
            same = np.flatnonzero((keys[1:] == keys[:-1]).all(axis=1))
            company = np.zeros(len(words), bool)  # a bucket's only word has no partner there
            company[same] = company[same + 1] = True
            u, v = linked(np.unique(words[company]), bound)
            return pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(_signed(v))], ["u", "v"])

        for b in parts:
            words = b.column(0).to_numpy().view(np.uint64)
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(1, 5)], axis=1)
            held.append((words, keys))
            n += len(words)
            if n < INDEX_ROWS:
                continue
            words, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))  # the last bucket may go on
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush([(words[:cut], keys[:cut])])
            held, n = [(words[cut:], keys[cut:])], len(words) - cut
        if n:
            yield flush(held)

    return dealt.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "u long, v long")


def fingerprint_roots(fps: DataFrame, bound: int) -> DataFrame:
    """(fp, root) of distinct fingerprints ``fp``: the smallest one connected with each."""
    roots = connected_components(fingerprint_links(fps.select("fp"), bound))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(fps["fp"], F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3,
                       bound: int = 2) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id among rows whose fingerprints are connected by links of
    at most ``bound`` differing bits.

    Null and empty texts have fingerprint zero and link like any other. A null id keeps its
    row and takes no part in the smallest id; repeated rows are returned each. Other columns
    of ``docs`` are not used; an empty table gives an empty result.
    """
    fps = save(fingerprints(docs, id_col, text_col, length), "fingerprints")
    reps = save(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    placed = save(reps.join(fingerprint_roots(reps, bound), "fp"), "fingerprint-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = save(placed.join(least, "root").select("fp", "component_id"), "fingerprint-classes")
    out = fps.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3,
                         bound: int = 2, stored: bool = False) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate class: that with the smallest id.

    Rows are told apart by their file and their place in it, so repeated ids with other texts, null
    ids (which come after all others) and repeated rows are rows like any other; null and empty
    texts are one class with what lies within ``bound`` bits of zero. All columns stay as they are.
    An empty table gives an empty result.

    No text is shuffled: only ids, fingerprints and keys are, and the task that reads a file keeps
    the rows listed for it. ``stored`` says that ``docs`` is a table as read from Parquet files;
    other tables are written first.
    """
    docs = docs if stored else save(docs, "near-dedup-docs")
    spot = docs.metadataColumn("_metadata")
    file, place = spot.getField("file_path"), spot.getField("row_index")
    key = [file.alias("path"), place.alias("place")]
    fps = save(fingerprints(docs, id_col, text_col, length, key), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "path", "place")
    reps = save(fps.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    kept = reps.join(fingerprint_roots(reps, bound), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.xxhash64("first.path").alias("file"), "first.path", "first.place")
    return keep_places(docs, file, place, by_key(kept, "file", new_path(docs.sparkSession, "kept-places")))


def keep_places(docs: DataFrame, file: Column, place: Column, kept: str) -> DataFrame:
    """The rows of ``docs`` whose place is listed for their file in the table ``kept``."""
    names = docs.columns
    extra = private(names, "path", "file", "place")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: dict[str, np.ndarray] = {}
        for b in parts:
            paths, files, places = b.columns[-3:]
            paths = paths.dictionary_encode()
            keep = np.zeros(b.num_rows, bool)
            for i, path in enumerate(paths.dictionary.to_pylist()):
                here = np.flatnonzero(paths.indices.to_numpy() == i)
                if path not in listed:
                    table = of_key(kept, "file", files[int(here[0])].as_py())
                    rows = table.filter(pc.equal(table["path"], path))["place"].to_numpy() if table else np.empty(0, np.int64)
                    listed = {path: rows}  # rows come file by file
                keep[here] = np.isin(places.to_numpy()[here], listed[path])
            out = pa.RecordBatch.from_arrays(b.columns[:-3], b.schema.names[:-3])
            yield out.filter(pa.array(keep))

    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(n) for c, n in zip((file, F.xxhash64(file), place), extra, strict=True)])
    return keyed.mapInArrow(run, docs.schema)
