"""WARC archives: writer and salvage reader.

The reader walks an archive record by record: plain records, or gzip members
of one record or more.  A record is taken only when its checks hold (version line,
header block, Content-Length inside the file, the end mark, the gzip CRC, and
the block and payload digests where given).  After a failed check it searches
for the next version line or gzip member whose record is valid, goes on from
there, and logs the bytes between as a quarantined gap.  A record cut short by
damage does not hide those after it: the search starts one byte after the
failed start, not after its claimed length.

Archives are written by Spark's file writer (its commit protocol leaves whole
files of successful tasks alone) and read with ``binaryFile``, so any store
that Spark reads will do.  The reader holds one file at a time in a task; the
writer deals records to files by their running bytes, so a file holds
``RECORDS_BYTES`` and one record more at most.  A gzip member is inflated
whole; of one whose CRC or end is missing what was inflated before the damage is
walked like any other bytes, and the rest is a gap.  Digests are compared as
Base32 or as hex of any case; folded header lines are joined.

Cases: a null or empty payload is a record of 0 bytes; a null ``page_id`` is the
smallest id; rows that repeat the largest id of a payload are all responses; blanks
and control characters are not written into a URI (a null or empty one is
``urn:no-url``); payloads of any length up to the reader's file bound of 2 GB; no
pages: no record.  Columns but ``page_id, url, payload`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import publish, scratch, table

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
RECORDS_BYTES = 32 << 20
INFLATE_BYTES = 1 << 16
MAX_BROADCAST_ROWS = 1_000_000  # about 60 bytes each
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
FOLD = re.compile(rb"\r\n[ \t]+")
HEADER_END = re.compile(rb"\r\n\r\n")
FIELDS = ("kind string, path string, at long, length long, reason string, record_type string, record_id string, "
          "target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record of an HTTP response; a revisit has the HTTP header alone, whose Content-Length is the full payload's."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    if kind == "response":
        block += payload
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def _digest_differs(want: str | None, data: bytes) -> bool:
    """Whether a ``sha1:`` digest, Base32 or hex, is not that of ``data``; other algorithms are not checked."""
    name, _, value = (want or "").partition(":")
    if name.lower() != "sha1":
        return False
    made = hashlib.sha1(data).digest()
    return made.hex() != value.lower() if len(value) == 40 else sha1_base32(data) != value.upper()


def _base32(digest: str) -> str:
    """A SHA-1 digest given as hex or Base32, as upper-case Base32."""
    return base64.b32encode(bytes.fromhex(digest)).decode() if len(digest) == 40 else digest.upper()


def parse_record(data: bytes | memoryview, start: int) -> tuple[int, dict]:
    """The record at ``start``: its end and fields.  Raises ``ValueError`` with the failed check."""
    view = memoryview(data)
    if not re.match(rb"WARC/1\.[01]\r\n", bytes(view[start:start + 10])):
        raise ValueError("no version line")
    found = HEADER_END.search(view, start)
    if not found:
        raise ValueError("no end of header")
    window, end = bytes(view[start:found.start()]), found.start() - start
    fields: dict[str, str] = {}
    for line in FOLD.sub(b" ", window).split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    body = start + end + 4
    stop = body + int(fields["content-length"])
    if stop + 4 > len(view) or bytes(view[stop:stop + 4]) != CRLF * 2:
        raise ValueError("no end mark after the block")
    block = bytes(view[body:stop])
    if _digest_differs(fields.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    kind = fields.get("warc-type", "")
    http, sep, payload = block.partition(CRLF * 2) if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    want = fields.get("warc-payload-digest")
    size = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(found[1]) if found else None
    elif _digest_differs(want, payload):
        raise ValueError("payload digest differs")
    digest = _base32(want[5:]) if (want or "")[:5].lower() == "sha1:" else None
    strip = lambda s: s[1:-1] if s and s.startswith("<") else s
    return stop + 4, {"record_type": kind, "record_id": strip(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"),
                      "refers_to_id": strip(fields.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size,
                      "payload": None if kind == "revisit" else payload}


def inflate_member(data: bytes | memoryview, start: int) -> tuple[int, bytes, str]:
    """The gzip member at ``start``: its end, its bytes, and the failed check (empty if none).

    Of a damaged member: the bytes inflated before the damage; the step that fails is repeated byte by byte.
    """
    inflate = zlib.decompressobj(31)
    out, at, view = [], start, memoryview(data)
    while not inflate.eof and at < len(view):
        before = inflate.copy()
        try:
            out.append(inflate.decompress(view[at:at + INFLATE_BYTES]))
        except zlib.error as e:
            why, stop = f"gzip member: {e}", min(at + INFLATE_BYTES, len(view))
            try:
                while at < stop:
                    out.append(before.decompress(view[at:at + 1]))
                    at += 1
            except zlib.error:
                pass
            return at, b"".join(out), why
        at += INFLATE_BYTES
    if not inflate.eof:
        return len(view), b"".join(out), "gzip member cut short"
    return min(at, len(view)) - len(inflate.unused_data), b"".join(out), ""


def walk(data: bytes, start: int = 0, gzipped: bool = True) -> Iterator[dict]:
    """Records and gaps of ``data`` from ``start``; a gzip member of several records is walked by the same loop."""
    at, gap, why = start, None, ""
    while at < len(data):
        try:
            if gzipped and data[at:at + 3] == b"\x1f\x8b\x08":
                end, plain, damage = inflate_member(data, at)
                if damage:
                    saved = [r | {"at": at, "length": 0} for r in walk(plain, gzipped=False) if r["kind"] == "record"]
                    if saved and gap is not None:
                        yield {"kind": "gap", "at": gap, "length": at - gap, "reason": why}
                        gap = None
                    yield from saved
                    raise ValueError(damage)
                inner = walk(plain, gzipped=False)
                head = list(islice(inner, 2))  # a gap is followed by a record or by nothing
                if not any(r["kind"] == "record" for r in head):
                    raise ValueError(head[0]["reason"] if head else "empty gzip member")
                found = (r | {"at": at, "length": end - at} for r in chain(head, inner))
            else:
                end, record = parse_record(data, at)
                found = [{"kind": "record", "at": at, "length": end - at, **record}]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            near = START.search(data, at + 1)
            at = near.start() if near else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "at": gap, "length": at - gap, "reason": why}
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield {"kind": "gap", "at": gap, "length": len(data) - gap, "reason": why}


def salvage(data: bytes) -> Iterator[dict]:
    """All valid records of an archive in order, and the gaps between them.

    A record is ``kind='record'``; a gap is ``kind='gap'`` with the failed
    check of its first byte in ``reason``.  ``at`` and ``length`` are bytes of
    the file; records and gaps cover the file without overlap, but for those inside
    one gzip member, which all have the member's bytes.  Records saved from a damaged
    member have its start and length 0; its bytes are in the gap that follows.  Empty file: nothing.
    """
    yield from walk(data)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path`` (see ``salvage``), with their file's ``path``.

    ``payloads=False`` leaves the payload bytes out of the result (they are still checked).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def walk(batches):
        import pyarrow as pa
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for row in range(batch.num_rows):
                name, rows, held = batch.column(0)[row].as_py(), [], 0
                for r in salvage(batch.column(1)[row].as_py()):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r | {"path": name})
                    held += len(r.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(walk, FIELDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add ``digest`` and ``response_id``: the largest ``page_id`` among the pages of equal payload, where there are several.

    Only payloads that occur more than once enter the lookup, pre-aggregated
    before the shuffle; it is broadcast up to ``MAX_BROADCAST_ROWS`` and a
    skew-splitting join beyond.
    """
    hexes = pages.withColumn("sha", F.sha1("payload"))
    repeats = hexes.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = publish(repeats.select("sha", "response_id"), "warc-repeats")
    n = repeats.count()
    return hexes.join(F.broadcast(repeats) if n <= MAX_BROADCAST_ROWS else repeats, "sha", "left")


def write_archives(pages: DataFrame, path: str, file_bytes: int = RECORDS_BYTES) -> None:
    """Write ``page_id, url, payload`` (binary, null: empty) as WARC archives under ``path``.

    A task begins its next file (a folder ``archive=N`` has the N-th of each task) once one holds ``file_bytes``.

    Of pages with equal payloads the one with the largest ``page_id`` is the
    response and the others revisit it; rows that repeat that id are responses too.
    A null ``page_id`` is the smallest id.
    """
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = with_revisits(pages).withColumn(
        "first", F.col("response_id").isNull() | F.col("response_id").eqNullSafe(F.col("page_id")))

    def records(batches):
        import pyarrow as pa
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int32())], names=["record", "archive"])
        archive, filled = 0, 0  # the number of the task's file, and its bytes so far
        for batch in batches:
            out, held = [], 0
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "response_id", "first")]
            for i in range(batch.num_rows):
                page, url, payload, response, first = (c[i].as_py() for c in cols)
                uri = re.sub(r"[\x00-\x20\x7f]+", "", url or "") or "urn:no-url"
                r = make_record("response" if first else "revisit", f"urn:page:{page}", uri, payload, sha1_base32(payload),
                                None if first else f"urn:page:{response}")
                if filled >= file_bytes:
                    archive, filled = archive + 1, 0
                filled += len(r)
                out.append((r[:-2], archive))  # the writer ends each row with the last CRLF
                held += len(r)
                if held > 8 << 20:
                    yield batch_of(out)
                    out, held = [], 0
            yield batch_of(out)

    made = rows.mapInArrow(records, "record binary, archive int").select(F.col("record").cast("string").alias("value"), "archive")
    made.write.partitionBy("archive").option("lineSep", "\r\n").text(path)


def salvage_to(spark: SparkSession, path: str, out: str, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read the archives under ``path`` once, write what was found under ``out``, and return ``(records, gaps)``.

    The folder ``kind=gap`` is the quarantine log: file, first byte, length and failed check of every gap.
    """
    found = read_archives(spark, path, payloads)
    found.write.partitionBy("kind").parquet(out)
    back = spark.read.schema(found.schema).parquet(out)
    return back.where("kind = 'record'"), back.where("kind = 'gap'").select("path", "at", "length", "reason")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive record; a gap in the archives just written is an error, not a lost page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = scratch(spark, "warc")
    write_archives(pages, path)
    found, gaps = salvage_to(spark, path, scratch(spark, "warc-read"), payloads=False)
    if lost := gaps.head(5):
        raise ValueError(f"quarantined bytes in the archives under {path}: {lost}")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.when(F.col("record_type") == "revisit", number("refers_to_id")).alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last_id FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN last_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last_id IS DISTINCT FROM page_id THEN last_id END AS refers_to
FROM b
"""
