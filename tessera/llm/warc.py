"""WARC archives: written with revisit records, segmentation and chunked transfer framing, and
read back by putting segments together again."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, save
from tessera.llm.files import AtomicFile, filesystem, listing, spread

#: Payloads from this size on are written once; equal ones revisit the first.
LEAST_REVISIT = 100
#: Blocks larger than this are cut into a record and its continuations.
SEGMENT_BYTES = 1 << 14
CHUNK_BYTES = 1 << 12
#: A task begins a new archive once the last has this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Digests of repeated payloads that are broadcast at most.
MAX_BROADCAST_DIGESTS = 100_000
READ_BYTES = 1 << 20

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- framing -----------------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; chunk extensions and trailers are passed over. None if
    the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if not size:
            return b"".join(out)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, as each record of a .warc.gz is."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record of a .warc.gz stream."""
    plain, unzip = bytearray(), zlib.decompressobj(31)
    for data in chunks:
        while data:
            plain += unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        at = 0
        while (end := plain.find(b"\r\n\r\n", at)) >= 0:
            lines = plain[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            if len(plain) < end + 4 + size + 4:
                break
            yield fields, bytes(plain[end + 4:end + 4 + size])
            at = end + 4 + size + 4
        del plain[:at]


# --- writing -----------------------------------------------------------------------------

def _name(page: object, digest: str) -> str:
    """What the record ids of a page's payload begin with: rows that repeat a page's id with another
    payload have other names. A null id is an empty one."""
    return f"urn:x-page:{'' if page is None else quote(str(page), safe='')}:{digest}"


def _page(name: str | None) -> str | None:
    """The page id in a record name, None for null."""
    return None if name is None else unquote(name.strip("<>").split(":")[2]) or None


def _records(page: object, url: str | None, html: bytes, digest: str, refers: object, place: str) -> Iterator[bytes]:
    own = _name(page, digest)
    name = f"<{own}:{place}>"
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else own
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name),
              ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        yield record([*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_name(refers, digest)}>")], head)
        return
    block = head + chunked(html)
    if len(block) <= SEGMENT_BYTES:
        yield record(fields, block)
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    yield record([*fields, ("WARC-Segment-Number", "1")], block[:SEGMENT_BYTES])
    for k, at in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}:{place}:{k}>"), ("WARC-Date", DATE),
                ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if k == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[at:at + SEGMENT_BYTES])


def with_revisits(pages: DataFrame, id_col: str, text_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, html, digest, refers): ``refers`` is the smallest id with an equal payload of at
    least ``least`` bytes, null where that is the row itself."""
    html = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    again = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = save(again, "repeated-payloads")
    again = F.broadcast(again) if again.count() <= MAX_BROADCAST_DIGESTS else again
    return rows.join(again, "digest", "left").select(
        "id", "url", "html", "digest", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html",
                   least: int = LEAST_REVISIT) -> DataFrame:
    """Writes .warc.gz files of about ``ARCHIVE_BYTES``; returns (name, records) of each."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, files, n = TaskContext.get().partitionId(), None, [], 0
        for b in parts:
            for page, url, html, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                if out is None:
                    name = f"pages-{task:06d}-{len(files):05d}.warc.gz"
                    out, n = AtomicFile(folder, name), 0
                    out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"),
                                             ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                            b"format: WARC File Format 1.1\r\n")))
                for data in _records(page.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers.as_py(), f"{task}-{len(files)}-{n}"):
                    out.write(member(data))
                n += 1
                if out.size >= ARCHIVE_BYTES:
                    out.commit()
                    files.append((name, n))
                    out = None
        if out:
            out.commit()
            files.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())],
                                         ["name", "records"])

    given = pages if "url" in pages.columns else pages.withColumn("url", F.lit(None).cast("string"))
    rows = with_revisits(given, id_col, text_col, least)
    return save(rows.mapInArrow(run, "name string, records long"), "archives")


# --- reading -----------------------------------------------------------------------------

_RAW = "name string, type string, record string, url string, origin string, part int, whole long, refers string, block binary"


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every archive but warcinfo, one row each; an archive is one task's work."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["name", "type", "record", "url", "origin", "part", "whole", "refers", "block"]
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], cols)

        for b in parts:
            for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f, place = filesystem(path)
                rows, size = [], 0
                with f.open_input_stream(place, compression=None) as handle:
                    for h, block in read_records(iter(lambda h=handle: h.read(READ_BYTES), b"")):
                        if h["warc-type"] == "warcinfo":
                            continue
                        whole = h.get("warc-segment-total-length")
                        rows.append((name, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"),
                                     h.get("warc-segment-origin-id"), int(h.get("warc-segment-number", 0)),
                                     int(whole) if whole else None, h.get("warc-refers-to"), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spread(listing(spark, folder, "*.warc.gz").select("path", "name")).mapInArrow(run, _RAW)


def reassemble(records: DataFrame) -> DataFrame:
    """(type, record, url, refers, block, complete): whole records. Segments are grouped by their
    origin's id and joined in order; ``complete`` holds if none of 1 to n is missing and the
    length is the total that the last one states. Only segments are shuffled; a repeated
    segment counts once."""
    whole = records.filter("part = 0").select("type", "record", "url", "refers", "block", F.lit(True).alias("complete"))
    cut = records.filter("part > 0").withColumn("key", F.coalesce("origin", "record"))
    cut = cut.select("key", "part", "type", "url", "whole", "block").repartition("key").sortWithinPartitions("key", "part")
    joined = cut.mapInArrow(_join_segments, "type string, record string, url string, block binary, complete boolean")
    return whole.unionByName(joined.withColumn("refers", F.lit(None).cast("string")))


def _join_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records from segments in the order of their records and numbers. Each segment is
    copied once, so the work is linear in the record's length."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        numbers = [p for p, *_ in held]
        block = b"".join([x for *_, x in held])
        first = next((kind for p, kind, *_ in held if p == 1), None)
        total = max((w for _, _, _, w, _ in held if w is not None), default=None)
        ok = numbers == list(range(1, len(held) + 1)) and len(block) == total and first is not None
        url = max((u for _, _, u, _, _ in held if u is not None), default=None)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
            (first, pa.string()), (key, pa.string()), (url, pa.string()), (block, pa.binary()), (ok, pa.bool_()))],
            ["type", "record", "url", "block", "complete"])

    for b in parts:
        for k, *segment in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if held and k != key:
                yield close()
                held = []
            key = k
            if not held or segment[0] != held[-1][0]:  # a repeated segment counts once
                held.append(segment)
    if held:
        yield close()


def payload_of(block: bytes) -> bytes | None:
    """The HTTP payload of a response block; None if its framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return dechunk(body)
    return body


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(id, url, type, payload, payload_bytes, digest, refers, complete, name, target) of the
    pages in the archives; ``target`` is the ``name`` of the record that a revisit refers to. A revisit has its response's length and digest and no payload of its own; where a
    record is incomplete or its response missing, ``complete`` is false and these are null."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            payload, digest = [], []
            for kind, block, complete in zip(b.column(0).to_pylist(), b.column(4), b.column(5).to_pylist(), strict=True):
                data = payload_of(block.as_py()) if complete and kind == "response" else None
                payload.append(data)
                digest.append(None if data is None else hashlib.sha256(data).hexdigest())
            ids = [[_page(r) for r in b.column(i).to_pylist()] for i in (1, 3)]
            names = [[r and ":".join(r.strip("<>").split(":")[:4]) for r in b.column(i).to_pylist()] for i in (1, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0], pa.string()), b.column(2), b.column(0), pa.array(payload, pa.binary()), pa.array(digest, pa.string()),
                 pa.array(ids[1], pa.string()), b.column(5), pa.array(names[0], pa.string()), pa.array(names[1], pa.string())],
                ["id", "url", "type", "payload", "digest", "refers", "complete", "name", "target"])

    rows = reassemble(scan_archives(spark, folder)).mapInArrow(
        run, "id string, url string, type string, payload binary, digest string, refers string, complete boolean, name string, target string")
    return rows.select(F.col("id").cast(id_type).alias("id"), "url", "type", "payload",
                       F.octet_length("payload").cast("long").alias("payload_bytes"), "digest",
                       F.col("refers").cast(id_type).alias("refers"),
                       (F.col("complete") & (F.col("digest").isNotNull() | (F.col("type") == "revisit"))).alias("complete"),
                       "name", "target")


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Lengths and digests of revisits from the responses they name. A page id may stand in several
    records with other payloads; a record's name tells these apart."""
    answers = read.filter("type = 'response'").groupBy(F.col("name").alias("target")).agg(
        F.max("payload_bytes").alias("n"), F.max("digest").alias("d"))
    again = read.filter("type = 'revisit'").join(answers, "target", "left").select(
        "id", "type", F.col("n").alias("payload_bytes"), F.col("d").alias("digest"), "refers",
        (F.col("complete") & F.col("d").isNotNull()).alias("complete"))
    return read.filter("type = 'response'").select(*again.columns).unionByName(again)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", folder: str | None = None,
                       least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row and reads the archives back: per row the id, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to`` and ``complete``.

    A null html is an empty payload. Null and repeated ids are written each, and revisits name the
    payload they refer to beside its id, so a repeated id with other payloads does no harm; rows that
    repeat the smallest id of equal payloads are responses too. Payloads of any length are segmented.
    Columns other than the id, the html and ``url`` are not used; an empty table writes no
    archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    made = write_archives(pages, folder, id_col, text_col, least)
    if not made.head(1):
        return spark.createDataFrame([], f"`{id_col}` {kind}, payload_bytes long, payload_digest string, "
                                         f"record_type string, refers_to {kind}, complete boolean")
    read = save(read_archives(spark, folder, kind).drop("payload", "url"), "archive-rows")
    return resolve_revisits(read).select(
        F.col("id").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "complete")
