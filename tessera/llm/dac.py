"""Token ids in directly addressable codes, with random access to any token.

An id is cut into 8-bit chunks, low chunk first.  Level k holds the k-th
chunks of the ids that have one, and a bitmap that tells which of them go on;
a directory holds the bitmap's rank at every ``RANK_STEP`` positions.  The
chunk of token i on the next level is at ``rank(i)``, so any token is read by
one step a level, and no block is decoded.

A segment is the codes of consecutive documents in ascending ``doc_id`` order
with their ids and lengths::

    "DAC1" | total bytes u64 | range u32 | number u32 | documents u32 | levels u32 | tokens u64
    doc ids i64[documents] | null flags u8[documents] | lengths u64[documents]
    level: entries u64 | chunks u8[entries] | bitmap ceil(entries/8) | ranks u64[entries/RANK_STEP + 1]

Segments follow one another in a file, each ended by a line feed (the row
separator of Spark's writer, so files are committed by Spark on any store).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bytebpe import load, vocabulary
from tessera.llm.common import partitions, publish, range_cuts, range_no, scratch, table

MAGIC, HEAD = b"DAC1", struct.Struct("<4sQIIIIQ")
RANK_STEP = 512
SEGMENT_TOKENS = 1 << 20
ENCODE_BYTES = 8 << 20  # of text, encoded at once
FILE_SEGMENTS = 16


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int], rng: int, number: int) -> bytes:
    """A segment of ``ids`` (all documents' tokens in order)."""
    values, levels = ids.astype("<u4"), []
    while True:
        rest = values >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP)) if len(more) else np.zeros(0, "u8")
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        levels.append(struct.pack("<Q", len(values)) + (values & np.uint32(255)).astype("u1").tobytes() + bits.tobytes() + ranks.tobytes())
        values = rest[more]
        if not len(values):
            break
    docs = (np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
            + np.array(lengths, "<u8").tobytes())
    size = HEAD.size + len(docs) + sum(map(len, levels))
    return HEAD.pack(MAGIC, size, rng, number, len(doc_ids), len(levels), len(ids)) + docs + b"".join(levels)


class Segment:
    """A segment over its bytes; nothing is decoded on opening."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, self.size, self.rng, self.number, n, levels, self.tokens = HEAD.unpack_from(data, at)
        if magic != MAGIC or at + self.size > len(data):
            raise ValueError("not a whole DAC1 segment")
        pos = at + HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(data, dtype, count, pos)
            pos += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lengths = take("<u8", n).astype("int64")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.levels = []
        for _ in range(levels):
            entries = int(take("<u8", 1)[0])
            self.levels.append((take("u1", entries), take("u1", -(-entries // 8)), take("<u8", -(-entries // RANK_STEP) + 1)))

    def rank(self, level: int, i: int) -> int:
        """Continuing entries before entry ``i``."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_STEP
        out = int(ranks[block])
        first, whole = block * RANK_STEP // 8, i // 8
        out += int(np.bitwise_count(bits[first:whole]).sum())
        return out + (int(bits[whole]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else out

    def token(self, i: int) -> int:
        """The i-th token of the segment."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start … stop - 1``: a range of each level, found by two ranks."""
        out, where, shift = np.zeros(stop - start, "<u4"), np.arange(stop - start), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= chunks[start:stop].astype("<u4") << np.uint32(shift)
            more = np.unpackbits(bits[start // 8:-(-stop // 8)], bitorder="little")[start % 8:start % 8 + stop - start].astype(bool)
            where, shift = where[more], shift + 8
            start = self.rank(level, start)
            stop = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def heads_of(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(range, number, tokens) of a file's segments, from their heads alone."""
    at = 0
    while at < len(data):
        magic, size, rng, number, _, _, tokens = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a DAC1 segment")
        yield rng, number, tokens
        at += size + 1


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(data):
        one = Segment(data, at)
        yield one
        at += one.size + 1


def parts(batch, most: int) -> Iterator:
    """Slices of a batch whose texts have ``most`` bytes and one text more at most."""
    import pyarrow.compute as pc
    begun = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype("int64"))])[:-1]
    cuts = [0, *(np.flatnonzero(np.diff(begun // most)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, n_ranges: int | None = None) -> None:
    """Encode ``doc_id, text`` and write the ids as segments under ``path``, in ascending ``doc_id`` order.

    Every document ends with ``end_id`` (null text: that id alone).  One
    shuffle deals the texts to ranges of ``doc_id``; each range is sorted and
    encoded as a stream, a segment at a time.  Ties in ``doc_id`` are in order
    of text, a null ``doc_id`` is last.
    """
    n_ranges = n_ranges or max(1, partitions(docs.sparkSession))
    cuts = range_cuts(docs, "doc_id", n_ranges)
    rows = docs.select("doc_id", "text", range_no(F.col("doc_id"), cuts).alias("rng"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("rng")).sortWithinPartitions(
        "rng", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())

    def encode(batches):
        import pyarrow as pa
        bpe, end = load(tokenizer_path), np.array([end_id], "<u4")
        held, ids, lengths, size, now, number = [], [], [], 0, None, 0

        def out():
            nonlocal size, number
            data = pack(np.concatenate(held), ids, lengths, now, number)
            held.clear(), ids.clear(), lengths.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for batch in batches:
            for part in parts(batch, ENCODE_BYTES):
                texts = [text or "" for text in part.column("text").to_pylist()]
                flat, counts = bpe.encode_all(texts)
                at = 0
                for doc_id, rng, n in zip(part.column("doc_id").to_pylist(), part.column("rng").to_pylist(), counts.tolist(), strict=True):
                    if ids and (rng != now or size >= SEGMENT_TOKENS):
                        yield out()
                    if rng != now:
                        now, number = rng, 0
                    held += [flat[at:at + n], end]
                    ids.append(doc_id)
                    lengths.append(n + 1)
                    at, size = at + n, size + n + 1
                held[:] = [np.concatenate(held)] if held else []  # copies, so that a part's ids go with it
        if ids:
            yield out()

    made = rows.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``start`` is the number of tokens in all documents before it: running sums
    within a range of segments and over the ranges, whose number is that of
    the writer's partitions.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    fields = "rng int, number int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches):
        import pyarrow as pa
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    n, flat = len(s.doc_ids), s.slice(0, s.tokens)  # the segment's levels once; documents are cut from it
                    raw, starts = memoryview(flat.tobytes()), (4 * s.starts).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts, starts[1:])]
                    cols = [pa.array([s.rng] * n, pa.int32()), pa.array([s.number] * n, pa.int32()), pa.array(s.starts[:-1].astype("int64")),
                            pa.array(s.doc_ids, pa.int64()), pa.array(s.lengths), pa.array(crc, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(s.starts.astype("int32")), pa.array(flat.astype("int32"))))
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in fields.split(", ")])

    def heads(batches):
        import pyarrow as pa
        for batch in batches:
            rows = [r for content in batch.column(0) for r in heads_of(content.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["rng", "number", "tokens"])

    rows = files.mapInArrow(read, fields)
    if ids:
        lengths = publish(files.mapInArrow(heads, "rng int, number int, tokens long"), "dac-heads")
    else:  # rows without ids are small: written once, and the segments' lengths summed from them
        rows = publish(rows, "dac-documents")
        lengths = rows.groupBy("rng", "number").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    by_range = lengths.groupBy("rng").agg(F.sum("tokens").alias("tokens"))
    by_range = by_range.select("rng", F.coalesce(F.sum("tokens").over(before.orderBy("rng")), none).alias("range_start"))
    base = lengths.join(F.broadcast(by_range), "rng").select(
        "rng", "number", (F.col("range_start") + F.coalesce(F.sum("tokens").over(before.partitionBy("rng").orderBy("number")), none)).alias("base"))
    rows = rows.join(base, ["rng", "number"])
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """Per row of ``documents`` what its ids read back from the files say; null texts, ids, ties and empty tables as ``write_tokens`` says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "dac")
    write_tokens(docs, path, vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)
