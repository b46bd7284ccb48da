"""Token ids of whole texts with a public BPE vocabulary, one Arrow batch at a time."""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks and pieces in each of the cache's two generations, per Python worker.
CACHE_ENTRIES = 300_000
#: Chunks longer than this are encoded each time.
CACHE_CHARS = 48


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Ids of ``tokenizers`` for a word-level BPE file whose normaliser collapses white space
    and lower-cases.

    Words never merge across white space, so the ids of a text are the ids of its chunks.
    Each batch is split and dictionary-encoded by Arrow, only chunks not met before are
    encoded, and the ids are gathered with numpy. Texts in Latin letters are lower-cased and split
    by the vocabulary's pattern in Arrow, so that a chunk is a piece that is encoded by itself; in
    other texts chunks stand between white space, and those outside plain Latin text go
    through the full tokenizer. ``exact=True`` (tests) sends everything through it.

    ``special_as_text=False`` gives the ids of the vocabulary file as it is: the string of an
    added token, as in "a <|endoftext|> b", is that token. True encodes such strings like other
    text, for files in which the token's id must only stand between documents.
    """

    def __init__(self, path: str, exact: bool = False, special_as_text: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self._added = [t for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.exact = exact
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # Fixed value: the split pattern of the vocabulary file.
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # the same in Arrow's expressions, and texts that are not split by it
        self._pieces = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \p{L}\p{N}]+"
        held = "|".join(("(?i:" + re.escape(t.content) + ")") if t.normalized else re.escape(t.content) for t in self._added)
        self._other = r"[^\t-\r -\x{24f}]|[\x{130}\x{85}\x{a0}]" + (f"|{held}" if held else "")
        self._odd = re.compile("[^\t-\r -ɏ]|[İ\u0085 ]").search
        self._letters = _byte_letters()
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _full(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else "".join([self._letters[b] for b in piece.encode()])
        return array(self._code, [t.id for t in self.tok.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
            if not self.exact and low.isalpha():
                return self._piece(low) if low == chunk else self._kept(low, self._piece)
        elif self._odd(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return self._full(chunk)
        if self.exact:
            return self._full(chunk)
        pieces = self._split(chunk.lower())
        if pieces == [chunk]:
            return self._piece(chunk)
        return b"".join([self._kept(p, self._piece) for p in pieces])

    def _adds(self, chunks: pa.Array) -> np.ndarray:
        """Places of the chunks that hold the string of an added token."""
        held = np.zeros(len(chunks), bool)
        for t in self._added:
            held |= pc.match_substring(chunks, t.content, ignore_case=t.normalized).to_numpy(zero_copy_only=False)
        return np.flatnonzero(held)

    def _kept(self, key: str, make) -> bytes:
        got = self._young.get(key)
        if got is None:
            got = self._old.get(key)
            if got is None:
                got = make(key)
            if len(key) <= CACHE_CHARS:
                self._young[key] = got
                if len(self._young) >= CACHE_ENTRIES:
                    self._old, self._young = self._young, {}
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of length n + 1); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if self.exact or pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # Arrow counts these as white space
            parts = [self._full(t) for t in texts.to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64) // self.dtype.itemsize
            return np.frombuffer(b"".join(parts), self.dtype), np.concatenate([[0], np.cumsum(sizes)])
        other = pc.match_substring_regex(texts, self._other).to_numpy(zero_copy_only=False)
        if not other.any():
            return self._encode(self._by_pieces(texts), self._piece)
        if other.all():
            return self._by_chunks(texts)
        rows = np.flatnonzero(~other), np.flatnonzero(other)
        plain = self._encode(self._by_pieces(texts.take(pa.array(rows[0]))), self._piece)
        rest = self._by_chunks(texts.take(pa.array(rows[1])))
        parts: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        for which, (ids, at) in zip(rows, (plain, rest), strict=True):
            for i, a, z in zip(which.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                parts[i] = ids[a:z]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _by_pieces(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self._pieces, "\\0 "))

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(pc.utf8_split_whitespace(texts), self._chunk, True)

    def _encode(self, split: pa.Array, make, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of chunks, each encoded by ``make`` if it is new; ``added``: look for added tokens."""
        rows = len(split)
        begin = split.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(split.flatten())
        begin -= begin[0]
        del split
        chunks = words.dictionary.to_pylist()
        adds = {int(i): self._full(chunks[i]) for i in self._adds(words.dictionary)} if added else {}
        ids = list(map(self._young.get, chunks))
        for i, got in enumerate(ids):
            if i in adds:
                ids[i] = adds[i]
            elif got is None:
                ids[i] = self._kept(chunks[i], make)
        del chunks
        if not ids:
            return np.empty(0, self.dtype), np.zeros(rows + 1, np.int64)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        code = words.indices.to_numpy()
        del words, ids
        if not len(code):
            return np.empty(0, self.dtype), np.zeros(rows + 1, np.int64)
        kind = np.int32 if size.max() * len(code) < 1 << 31 else np.int64
        length = size.astype(kind)[code]
        ends = np.cumsum(length, dtype=kind)
        shift = (np.cumsum(size) - size).astype(kind)[code]
        shift -= ends
        shift += length
        place = np.arange(ends[-1], dtype=kind)
        place += np.repeat(shift, length)
        del shift, length
        return flat[place], np.concatenate([[0], ends])[begin].astype(np.int64)


_made: dict[tuple[str, bool], WordBpe] = {}


def encoder(path: str, special_as_text: bool = True) -> WordBpe:
    """The worker's encoder for a vocabulary file, made once."""
    key = path, special_as_text
    if key not in _made:
        _made[key] = WordBpe(path, special_as_text=special_as_text)
    return _made[key]


def batches(texts: pa.Array, chars: int = 4 << 20):
    """Slices (start, stop) of about ``chars`` bytes of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > chars:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size)


def token_table(docs, keep: list[str], text_col: str = "text", path: str | None = None, end_id: int | None = 2,
                special_as_text: bool = True):
    """``keep`` columns, ``n`` (number of ids) and ``ids`` (little-endian binary, 2 bytes an id
    where the vocabulary allows, else 4) of every whole text, ``end_id`` last. Null is empty.
    ``special_as_text`` as in ``WordBpe``."""
    from pyspark.sql import functions as F

    path = path or vocabulary_path()

    def run(parts):
        enc = encoder(path, special_as_text)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for b in parts:
            texts = b.column(b.num_columns - 1)
            for start, stop in batches(texts):
                ids, at = enc.encode(texts.slice(start, stop - start))
                flat = memoryview(ids.tobytes())
                at = (at * width).tolist()
                rows = [bytes(flat[a:z]) + tail for a, z in zip(at, at[1:], strict=False)]
                n = np.fromiter(map(len, rows), np.int64, len(rows)) // width
                kept = [c.slice(start, stop - start) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(rows, pa.binary())],
                                                 [*b.schema.names[:-1], "n", "ids"])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}n long, ids binary")


def id_dtype(path: str) -> np.dtype:
    """The type of the ids in ``token_table``."""
    return encoder(path).dtype
