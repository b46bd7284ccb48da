"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Both token sequences of a text cover the same bytes. Every token points to its farthest-right
overlapping token; doubling the pointers brings each to the last token of its component, whose
end is an end of both sequences. A component is a group of the alignment, and the two tokens
that end it are a link.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import private, save
from tessera.llm.tokens import _byte_letters, vocabulary_path

#: Bytes of text aligned at once; a longer text is cut between words.
BLOCK = 1 << 20
#: Chunks of text whose ids a Python worker keeps, in each of two generations.
CACHE_CHUNKS = 200_000
#: Pairs of ids whose counts are broadcast, most frequent first: 13 bytes each.
HOT_PAIRS = 2_000_000
#: Pairs counted in a Python worker before they are passed on.
COUNT_ROWS = 4_000_000

# Text in which chunks of white space and a word can be encoded one by one: no white space but
# blank, tab and line feed, none of the characters that some library takes for white space.
_ODD = re.compile("[^\t\n\x20-\x7e¡-ɏ]")


class BothTokenizers:
    """Ids of a text by the byte-level BPE file (A) and the SentencePiece model (B).

    Neither merges across a border between a word and following white space, so plain texts are
    encoded chunk by chunk and chunks met before are looked up. ``exact=True`` (tests) and texts
    with other characters go whole through both libraries.
    """

    def __init__(self, path_a: str, path_b: str, exact: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.exact = exact
        letter = {c: b for b, c in _byte_letters().items()}
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [bytes(letter[c] for c in name) if all(c in letter for c in name) else b"" for name, _ in names]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int32)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int32)
        # chunks may be encoded apart if no piece holds white space after another character
        self.apart = not any(re.search("[^▁]▁|[\t\n]", self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self._young: dict[bytes, tuple[bytes, bytes]] = {}
        self._old: dict[bytes, tuple[bytes, bytes]] = {}
        self._strings()

    def _strings(self) -> None:
        """Every id in decimal with what follows it: "," or the end of its side ("|" and ";")."""
        each = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"]
        each += [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]
        self.words = pa.array(each, pa.binary())

    def plain(self, text: str) -> bool:
        return self.apart and not self.exact and not _ODD.search(text)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of blank + text by both; None where their bytes are not those of blank + text."""
        want = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        return np.array(a, "<u2"), np.array(b, "<u2")

    def _learn(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        texts = [c.decode() for c in chunks]
        both = zip(self.a.encode_batch_fast(texts, add_special_tokens=False),
                   self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1), texts, strict=True)
        # B writes a blank before each text it is given, but for an empty one
        alone = [self.b.piece_to_id("▁")]
        return [(np.array(a.ids, "<u2").tobytes(), np.array(alone if t == " " else b if t[0] == " " else b[1:], "<u2").tobytes())
                for a, b, t in both]

    def chunks(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of each chunk (white space, then a word) by both."""
        young, old = self._young, self._old
        new = [c for c in chunks if c not in young and c not in old]
        made = dict(zip(new, self._learn(new), strict=True)) if new else {}
        out = [young.get(c) or old.get(c) or made[c] for c in chunks]
        for c, ids in zip(chunks, out, strict=True):
            if len(c) <= 48:
                young[c] = ids
        if len(young) >= CACHE_CHUNKS:
            self._old, self._young = young, {}
        return out

    def encode(self, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of plain blocks by A and B and how many of each every block has. Blocks begin
        with white space."""
        data = np.frombuffer(b"".join(blocks), np.uint8)
        starts = np.cumsum([0, *map(len, blocks)])
        white = data <= 0x20
        head = np.empty(len(data), bool)
        head[:1] = True
        head[1:] = white[1:] & ~white[:-1]
        head[starts[:-1]] = True
        at = np.flatnonzero(head)
        cuts = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        code = words.indices.to_numpy()
        ids = self.chunks(words.dictionary.to_pylist())
        first = np.searchsorted(at, starts)  # the first chunk of each block
        out = []
        for side in (0, 1):
            size = np.fromiter((len(x[side]) >> 1 for x in ids), np.int64, len(ids))
            flat = np.frombuffer(b"".join([x[side] for x in ids]), "<u2")
            length = size[code]
            ends = np.cumsum(length)
            place = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[code] - ends + length, length)
            out += [flat[place], np.diff(np.append(0, ends)[first])]
        return out[0], out[2], out[1], out[3]


def components(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the last token of every group, for two sequences of token lengths
    over the same bytes.

    All tokens are ordered by their end, A before B. The farthest-right token that overlaps a
    token is of the other side or the token itself, and pointers never go left, so doubling ends
    in the last token of each group, which points to itself.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    if not len(end_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = int(end_a[-1])
    seen_a, seen_b = (np.zeros(total + 1, np.int32) for _ in range(2))
    seen_a[end_a] = 1
    seen_b[end_b] = 1
    seen_a, seen_b = np.cumsum(seen_a, dtype=np.int32), np.cumsum(seen_b, dtype=np.int32)  # ends up to each byte
    n_a, n_b = np.arange(len(end_a), dtype=np.int32), np.arange(len(end_b), dtype=np.int32)
    place_a, place_b = n_a + seen_b[end_a - 1], n_b + seen_a[end_b]  # in the common order
    pointer = np.empty(len(end_a) + len(end_b), np.int32)
    # the token that holds the last byte of another one overlaps it farthest to the right
    pointer[place_a] = np.maximum(place_a, place_b[seen_b[end_a - 1]])
    pointer[place_b] = np.maximum(place_b, place_a[seen_a[end_b - 1]])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            break
        pointer = further
    last_b = np.flatnonzero(pointer[place_b] == place_b)
    return seen_a[end_b[last_b]].astype(np.int64) - 1, last_b


@dataclass
class _Row:
    """What is known of a document while its blocks are read."""

    n_a: int = 0
    n_b: int = 0
    groups: int = 0
    digest: object = None
    links: list | None = None

    def add(self, text: memoryview, n_a: int, n_b: int, links: np.ndarray) -> None:
        if self.digest is None:
            self.digest, self.links = hashlib.sha256(), []
        else:
            self.digest.update(b";")
        self.digest.update(text)
        self.n_a += n_a
        self.n_b += n_b
        self.groups += len(links)
        self.links.append(links)


def _align(tools: BothTokenizers, ids_a, ids_b, n_a, n_b, rows: list[_Row]) -> None:
    """Groups of consecutive blocks; block i is added to ``rows[i]``."""
    last_a, last_b = components(tools.size_a[ids_a], tools.size_b[ids_b])
    many_a, many_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    # the ids of a group, A's then B's, each with the sign that follows it
    code = np.empty(len(ids_a) + len(ids_b), np.int32)
    code_a, code_b = ids_a.astype(np.int32) * 2, ids_b.astype(np.int32) * 2 + 2 * len(tools.bytes_a)
    code_a[last_a] += 1
    code_b[last_b] += 1
    code[np.arange(len(ids_a)) + np.repeat(last_b + 1 - many_b, many_a)] = code_a
    code[np.arange(len(ids_b)) + np.repeat(last_a + 1, many_b)] = code_b
    text = tools.words.take(pa.array(code))
    data, cuts = memoryview(text.buffers()[2]), np.frombuffer(text.buffers()[1], np.int32)
    link = ids_b[last_b].astype(np.uint32) << np.uint32(16) | ids_a[last_a]
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    at = np.append(0, cuts[ends_a + ends_b]).tolist()
    group = np.append(0, np.searchsorted(last_a, ends_a - 1) + 1).tolist()
    for i, row in enumerate(rows):
        row.add(data[at[i]:at[i + 1] - 1], int(n_a[i]), int(n_b[i]), link[group[i]:group[i + 1]])


def _blocks(text: str) -> Iterator[bytes]:
    """Blank + text in blocks of about ``BLOCK`` bytes, cut where white space follows a word."""
    data = b" " + text.encode()
    start = 0
    while len(data) - start > BLOCK:
        cut = next((m.start() + 1 for m in re.compile(rb"[^\t\n ][\t\n ]").finditer(data, start + BLOCK)), len(data))
        yield data[start:cut]
        start = cut
    if start < len(data):
        yield data[start:]


_made: dict[tuple[str, str], BothTokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> BothTokenizers:
    """The worker's pair of tokenizers, made once."""
    key = path_a, path_b
    if key not in _made:
        _made[key] = BothTokenizers(path_a, path_b)
    return _made[key]


def align_texts(tools: BothTokenizers, texts: list[str | None]) -> list[_Row]:
    """The alignment of every whole text; null, empty and texts that a tokenizer does not give
    back have no tokens."""
    rows = [_Row() for _ in texts]
    held, into, size = [], [], 0

    def flush() -> None:
        if held:
            _align(tools, *tools.encode(held), into)
            held.clear()
            into.clear()

    for row, text in zip(rows, texts, strict=True):
        if not text:
            continue
        if not tools.plain(text):
            ids = tools.whole(text)
            if ids:
                _align(tools, *ids, np.array([len(ids[0])]), np.array([len(ids[1])]), [row])
            continue
        for block in _blocks(text):
            if size + len(block) > BLOCK:
                flush()
                size = 0
            held.append(block)
            into.append(row)
            size += len(block)
    flush()
    return rows


def align(docs: DataFrame, keep: list[str], text_col: str = "text", path_a: str | None = None,
          path_b: str | None = None) -> DataFrame:
    """``keep`` columns, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256`` (of ``a1,a2|b1;...``;
    empty without tokens) and ``links`` of every whole text: the pairs of ids that end a group
    together, repeats included, sorted, as little-endian unsigned 32-bit ``b << 16 | a``.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte after a
    blank, have no tokens. Special tokens' strings are plain text. Repeated rows are aligned
    each; a column of ``keep`` with the name of a result is an error.
    """
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "links"]
    if {c.lower() for c in keep} & set(names):
        raise ValueError(f"kept columns clash with {names}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(path_a, path_b)
        for b in parts:
            texts = b.column(b.num_columns - 1)
            step = max(1, min(b.num_rows, 4 * BLOCK * b.num_rows // max(1, texts.nbytes)))
            for i in range(0, b.num_rows, step):
                rows = align_texts(tools, texts.slice(i, step).to_pylist())
                cols = [c.slice(i, step) for c in b.columns[:-1]]
                cols += [pa.array([getattr(r, n) for r in rows], pa.int64()) for n in ("n_a", "n_b", "groups")]
                cols += [pa.array([r.digest.hexdigest() if r.digest else "" for r in rows]),
                         pa.array([np.sort(np.concatenate(r.links)).astype("<u4").tobytes() if r.links else b"" for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], *names])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no pair with the same
    B id is held by more. Counted in each task before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["pair", "n"])
        for b in parts:
            key, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > COUNT_ROWS:
                key, n = _tally(keys, counts)
                if len(key) > COUNT_ROWS // 2:
                    yield out(key, n)
                    key, n = key[:0], n[:0]
                keys, counts, held = [key], [n], len(key)
        if held:
            yield out(*_tally(keys, counts))

    total = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    total = save(total.withColumn("b", F.shiftright("pair", 16)), "pair-counts")
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return save(total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def _hot(counts: DataFrame, limit: int) -> int:
    """The least count of which at most ``limit`` pairs have it or more, to a factor of two."""
    size = F.floor(F.log2("n")).cast("int").alias("size")
    rows = counts.groupBy(size).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("size")).collect()  # at most 63
    least = 1 << 62
    for r in rows:
        limit -= r["pairs"]
        if limit < 0:
            break
        least = 1 << r["size"]
    return least


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` without ``links``, with ``n_links``, ``n_best`` and ``count_sum``.

    Counts of the most frequent pairs, ``HOT_PAIRS`` at most, go to every task; the links of all
    other pairs are joined with their counts.
    """
    names = [c for c in aligned.columns if c != "links"]
    (row,) = private(aligned.columns, "row")
    least = _hot(counts, HOT_PAIRS)
    top = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    held = aligned.sparkSession.sparkContext.broadcast(
        tuple(top[c].to_numpy()[order].astype(t) for c, t in (("pair", np.uint32), ("n", np.int64), ("best", bool))))
    some_rare = bool(counts.filter(F.col("n") < least).head(1))
    keyed = save(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned-rows") if some_rare else aligned

    def look(binary: list[bytes]):
        pair, n, best = held.value
        link = np.frombuffer(b"".join(binary), "<u4")
        size = np.array([len(x) >> 2 for x in binary], np.int64)
        at = np.minimum(np.searchsorted(pair, link), max(0, len(pair) - 1))
        hit = pair[at] == link if len(pair) else np.zeros(len(link), bool)
        return link, size, hit, np.where(hit, n[at], 0) if len(pair) else hit * 0, hit & best[at] if len(pair) else hit

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            _, size, _, n, best = look(b.column(b.num_columns - 1).to_pylist())
            ends = np.cumsum(size)
            sums = [np.diff(np.append(0, np.append(0, np.cumsum(x))[ends])) for x in (best.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size), *map(pa.array, sums)],
                                             [*b.schema.names[:-1], "n_links", "n_best", "count_sum"])

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            link, size, hit, _, _ = look(b.column(1).to_pylist())
            key = np.repeat(b.column(0).to_numpy(), size)[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(link[~hit].astype(np.int64))], ["row", "pair"])

    fields = [f for f in keyed.schema.fields if f.name != "links"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    out = keyed.select(*[F.col(f"`{f.name}`") for f in fields], "links").mapInArrow(
        run, f"{schema}n_links long, n_best long, count_sum long")
    if not some_rare:
        return out
    found = keyed.select(F.col(row).alias("row"), "links").mapInArrow(rare, "row long, pair long")
    found = found.groupBy("row", "pair").agg(F.count(F.lit(1)).alias("k")).join(counts, "pair")
    found = found.groupBy(F.col("row").alias(row)).agg(F.sum(F.col("k") * F.col("n")).alias("rare_sum"),
                                                       F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rare_best"))
    joined = out.join(found, row, "left")
    more = lambda c, r: (F.col(c) + F.coalesce(F.col(r), F.lit(0))).alias(c)
    return joined.select(*[F.col(f"`{c}`") for c in names], "n_links", more("n_best", "rare_best"), more("count_sum", "rare_sum"))


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                      path_b: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, counts of tokens, groups and links, ``n_best``,
    ``count_sum`` and ``groups_sha256``; see ``align`` and ``score_links``. Null and repeated ids
    stay as they are, other columns are not used, an empty table gives no rows."""
    aligned = save(align(docs, [id_col], text_col, path_a, path_b), "aligned")
    out = score_links(aligned, pair_counts(aligned))
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
