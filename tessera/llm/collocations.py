"""Phrase collocations by direct-address tiling of word pairs, longer phrases by recursion.

1. Words are counted by language; those with ``min_count`` occurrences are numbered by falling frequency (a rarer word
   is in no candidate).  Texts become streams of word numbers, broken (-1) at piece and document ends and at rarer words.
2. Two neighbours of a stream make a pair of numbers.  The square of number pairs is cut into tiles of ``TILE`` x
   ``TILE``.  As numbers go by frequency, most pairs fall into few tiles near the corner: a tile with many pairs in
   a task is counted in a dense array with ``numpy.bincount``, the pairs of the other tiles are sorted and run-length
   coded (COO).  Spark adds the tasks' counts up by pair.
3. Pairs with ``min_count`` occurrences are ranked and numbered again, the stream is rewritten in their numbers, and its
   neighbours (two phrases of m words that overlap in m - 1) are the phrases of m + 1 words; and so on up to
   ``max_words``.  No frequent phrase is missed, as each part of a frequent phrase is frequent.
4. Counts of the phrases' parts are joined on (language, phrase); scores are exact in decimal(38,0).

Lookups (words to numbers, pairs to numbers) go through a table handed to every worker while it has at most
``MAX_TABLE`` words or ``MAX_PAIRS`` pairs (two sorted arrays, 12 bytes a pair); beyond that through a shuffle join of
the distinct elements of each stream row.  Both give the same rows, and a task holds one table or one row at a time.

Defined results: a null or empty text has no words; a null language is ``und``, together with documents that say ``und``; rows that repeat an id all
count, as ids are not read; ties in score and count go to the phrase first in UTF-8 byte order; an empty table gives no
rows.  Only ``text`` and ``lang`` are read, so other columns cannot clash.  A language may have 2**31 numbered phrases of a length; more raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import prepare, publish, small_batches, table
from tessera.operators.rowindex import with_group_index

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
MAX_TABLE = 1_000_000  # words of a worker's table, about 130 bytes each
MAX_PAIRS = 8_000_000  # pairs of a worker's table, 12 bytes each
TILE = 1024
DENSE_PAIRS = TILE * TILE // 16  # pairs of a tile from which it is counted in a dense array
PAIR_BUFFER = 1 << 21
DENSE_TILES = 8  # dense arrays kept by a task
WORD_BUFFER = 500_000  # distinct words kept by a task
STREAM = 1 << 18  # numbers of a stream row, about
SLICE = 1 << 16  # rows handed on at once
BREAK = b"."
_BYTES = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in A-Z lower case; pieces end at ``BREAK``, which is no word."""
    return (text or "").encode().lower().translate(_BYTES).replace(b".", b" . ").split()


def _word_counts(batches):
    """(lang, word, n) of a task, handed on beyond ``WORD_BUFFER`` distinct words."""
    from collections import Counter
    from itertools import islice

    import pyarrow as pa
    counts: dict[str, Counter] = {}

    def rows():
        for lang, c in counts.items():
            c.pop(BREAK, None)
            items = iter(c.items())
            while part := list(islice(items, SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([w for w, _ in part], pa.binary()).cast(pa.string()),
                                                  pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])

    for rb in batches:
        for lang, text in zip(rb.column("lang").to_pylist(), rb.column("text")):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > WORD_BUFFER:
                yield from rows()
                counts.clear()
    yield from rows()


def _cut(batches, number, row):
    """Texts → ``row(lang, ids)`` by language, about ``STREAM`` numbers a row; ``number(lang, words)`` gives their numbers or None."""
    held, size = {}, {}

    def cut(lang):
        size[lang] = 0
        return row(lang, squeeze(np.concatenate(held.pop(lang))))

    for rb in batches:
        for lang, text in zip(rb.column("lang").to_pylist(), rb.column("text")):
            words = words_of(text.as_py())
            ids = number(lang, words) if words else None
            if ids is None:
                continue
            held.setdefault(lang, []).extend((ids, np.array([-1], np.int32)))
            size[lang] = size.get(lang, 0) + len(words) + 1
            if size[lang] >= STREAM:
                yield cut(lang)
            elif sum(size.values()) >= 4 * STREAM:  # many languages in a task
                for other in list(held):
                    yield cut(other)
    for lang in list(held):
        yield cut(lang)


def _streams(numbers):
    """Texts → streams of word numbers by language."""
    def fn(batches):
        import pyarrow as pa
        known = numbers.value

        def number(lang, words):
            if lang not in known:
                return None
            get = known[lang].get
            return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

        def row(lang, ids):
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ids.tobytes()], pa.binary())], names=["lang", "ids"])

        return _cut(batches, number, row)
    return fn


def _local_words(batches):
    """Texts → streams of places in the row's own list of distinct words, ``keys``."""
    import pyarrow as pa
    own: dict[str, dict[bytes, int]] = {}

    def number(lang, words):
        place = own.setdefault(lang, {BREAK: -1})
        return np.fromiter((place.setdefault(w, len(place) - 1) for w in words), np.int32, len(words))

    def row(lang, ids):
        keys = pa.array(list(own.pop(lang))[1:], pa.binary()).cast(pa.string())
        return _local_row(lang, ids, keys)

    return _cut(batches, number, row)


def _local_row(lang, ids, keys):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([ids.tobytes()], pa.binary()),
                                       pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], names=["lang", "ids", "keys"])


def squeeze(ids: np.ndarray) -> np.ndarray:
    """Runs of breaks become one; numbers alone between breaks, which have no neighbour, go."""
    edge = np.array([-1], np.int32)
    ids = np.concatenate([edge, ids, edge])
    real = ids >= 0
    paired = np.zeros(len(ids), bool)
    paired[1:-1] = real[1:-1] & (real[:-2] | real[2:])
    keep = paired.copy()
    keep[1:] |= paired[:-1]  # the break after a run
    out = np.where(paired, ids, -1)
    return out[keep]


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """Number pairs of neighbours as ``a << 32 | b``."""
    a, b = ids[:-1], ids[1:]
    there = (a >= 0) & (b >= 0)
    return a[there].astype(np.int64) << 32 | b[there]


def runs(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])) if len(sorted_codes) else np.zeros(0, int)
    return sorted_codes[starts], np.diff(np.append(starts, len(sorted_codes)))


def tiled(codes: np.ndarray) -> np.ndarray:
    """The codes' bits dealt anew: tile row, tile column, then the place in the tile; sorted, the pairs of a tile stand together."""
    bits = TILE.bit_length() - 1
    out = codes >> 32 + bits << 31 + bits
    out |= (codes & 0xFFFFFFFF) >> bits << 2 * bits
    out |= (codes >> 32 & TILE - 1) << bits
    out |= codes & TILE - 1
    return out


def untiled(keys: np.ndarray) -> np.ndarray:
    bits = TILE.bit_length() - 1
    out = (keys >> 31 + bits << bits | keys >> bits & TILE - 1) << 32
    out |= (keys >> 2 * bits & (1 << 31 - bits) - 1) << bits
    out |= keys & TILE - 1
    return out


class Tiles:
    """Counts of one language's pairs in a task: dense arrays for full tiles, sorted runs for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.buffer: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray):
        self.buffer.append(tiled(codes))
        self.held += len(codes)
        if self.held >= PAIR_BUFFER:
            yield from self.fold()

    def fold(self):
        """Counts the buffer; yields (codes, counts) of sparse tiles and of dense ones beyond ``DENSE_TILES``."""
        if not self.buffer:
            return
        keys = np.concatenate(self.buffer)
        self.buffer, self.held = [], 0
        keys.sort()
        bits = 2 * (TILE.bit_length() - 1)
        tiles, sizes = runs(keys >> bits)
        full = (sizes >= DENSE_PAIRS) | np.isin(tiles, np.fromiter(self.dense, np.int64, len(self.dense)))
        ends = np.cumsum(sizes)
        for tile, start, end in zip(tiles[full].tolist(), (ends - sizes)[full].tolist(), ends[full].tolist()):
            count = np.bincount(keys[start:end] & TILE * TILE - 1, minlength=TILE * TILE)
            if tile in self.dense:
                self.dense[tile] += count
                continue
            self.dense[tile] = count
            if len(self.dense) > DENSE_TILES:
                yield from self.cells()
        sparse = np.repeat(~full, sizes)
        if sparse.any():
            keys = keys[sparse]
            for i in range(0, len(keys), PAIR_BUFFER // 8):  # a code on a border is in two runs, and both are added up
                cells, n = runs(keys[i:i + PAIR_BUFFER // 8])
                yield untiled(cells), n

    def cells(self):
        """The dense tiles' cells that are not zero; the arrays are let go."""
        while self.dense:
            tile, count = self.dense.popitem()
            at = np.flatnonzero(count)
            yield untiled(tile * TILE * TILE + at), count[at]


COUNTS = "lang string, code long, n long"


def _pair_counts(batches):
    """Streams → (lang, code, n) of a task."""
    import pyarrow as pa
    tiles: dict[str, Tiles] = {}

    def out(lang, counted):
        for codes, n in counted:
            for i in range(0, len(codes), SLICE):
                c = codes[i:i + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c), pa.array(n[i:i + SLICE].astype(np.int64))], names=["lang", "code", "n"])
        if sum(len(t.dense) for t in tiles.values()) > DENSE_TILES:
            for other, t in tiles.items():
                yield from out(other, t.cells())

    for rb in batches:
        for lang, ids in zip(rb.column("lang").to_pylist(), rb.column("ids")):
            codes = pair_codes(np.frombuffer(ids.as_buffer(), np.int32))
            for i in range(0, len(codes), PAIR_BUFFER):
                yield from out(lang, tiles.setdefault(lang, Tiles()).add(codes[i:i + PAIR_BUFFER]))
                if sum(t.held for t in tiles.values()) >= PAIR_BUFFER:  # many languages in a task
                    for other, t in tiles.items():
                        yield from out(other, t.fold())
    for lang, t in tiles.items():
        yield from out(lang, t.fold())
        yield from out(lang, t.cells())


def _rewrite(numbers):
    """Streams of phrases of m words → streams of the frequent phrases of m + 1 words."""
    def fn(batches):
        import pyarrow as pa
        for rb in batches:
            langs, streams = [], []
            for lang, raw in zip(rb.column("lang").to_pylist(), rb.column("ids")):
                if lang not in numbers.value:
                    continue
                codes, own = numbers.value[lang]  # sorted
                ids = np.frombuffer(raw.as_buffer(), np.int32)
                a, b = ids[:-1].astype(np.int64), ids[1:]
                there = np.flatnonzero((a >= 0) & (b >= 0))
                pair = a[there] << 32 | b[there]
                at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
                new = np.full(max(0, len(ids) - 1), -1, np.int32)
                new[there] = np.where(codes[at] == pair, own[at], -1)
                langs.append(lang)
                streams.append(squeeze(new).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(streams, pa.binary())], names=["lang", "ids"])
    return fn


def _local_pairs(batches):
    """Streams → streams of places in the row's own list of distinct pair codes, ``keys``."""
    import pyarrow as pa
    for rb in batches:
        for lang, raw in zip(rb.column("lang").to_pylist(), rb.column("ids")):
            ids = np.frombuffer(raw.as_buffer(), np.int32)
            there = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys, place = np.unique(pair_codes(ids), return_inverse=True)
            at = np.full(max(0, len(ids) - 1), -1, np.int32)
            at[there] = place
            yield _local_row(lang, at, pa.array(keys))


def _renumbered(batches):
    """Streams of places and (place << 32 | number) of the places that have one → streams of numbers."""
    import pyarrow as pa
    for rb in batches:
        streams = []
        for raw, found in zip(rb.column("ids"), rb.column("found")):
            at, found = np.frombuffer(raw.as_buffer(), np.int32), found.values.to_numpy()
            number = np.full(int(at.max(initial=-1)) + 2, -1, np.int32)  # the last is that of place -1
            number[found >> 32] = found & 0xFFFFFFFF
            number[-1] = -1
            streams.append(squeeze(number[at]).tobytes())
        yield pa.RecordBatch.from_arrays([rb.column("lang"), pa.array(streams, pa.binary())], names=["lang", "ids"])


def _blocks(batches):
    """(lang, code, id) → codes and numbers of a batch by language, packed."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for rb in batches:
        for lang in rb.column("lang").unique():
            part = rb.filter(pc.equal(rb.column("lang"), lang))
            packed = [pa.array([part.column(c).to_numpy().tobytes()], pa.binary()) for c in ("code", "id")]
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()], pa.string()), *packed], names=["lang", "codes", "ids"])


STREAMS = "lang string, ids binary"
#: Rows are long: a page's size is looked at after every few rows, not after a hundred, as pages are compressed in memory outside the heap.
STREAM_FILES = {"parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8", "parquet.block.size.row.check.min": "8", "parquet.block.size.row.check.max": "64"}


def numbered(counts: DataFrame, key: str) -> DataFrame:
    """(lang, key, n, id): ids by falling n, then key, from 0 in each language; no language in one task."""
    ids = with_group_index(counts.withColumn("__falling", -F.col("n")), "lang", ["__falling", key], "id", start=0).drop("__falling")
    small = F.when(F.col("id") >= 1 << 31, F.raise_error(F.lit("over 2**31 frequent phrases of one length in a language"))).otherwise(F.col("id"))
    return publish(ids.withColumn("id", small), "phrase-ids")


def is_small(ids: DataFrame, max_table: int) -> bool:
    return ids.count() <= max_table


def shuffled(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(lang, ids) of ``rows`` (lang, ids, keys), whose places in ``keys`` become the numbers in ``ids`` (lang, key, id).

    Only a row's distinct keys meet ``ids``, so no key is met more often than there are rows."""
    rows = publish(rows.withColumn("row", F.monotonically_increasing_id()), "local-streams", STREAM_FILES)
    each = rows.select("row", "lang", F.posexplode("keys").alias("place", key))
    pair = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("id"))
    found = each.join(ids.select("lang", key, "id"), ["lang", key]).groupBy("row").agg(F.collect_list(pair).alias("found"))
    return rows.select("row", "lang", "ids").join(found, "row").select("lang", "ids", "found").mapInArrow(_renumbered, STREAMS)


def word_streams(docs: DataFrame, ids: DataFrame, max_table: int = MAX_TABLE) -> DataFrame:
    """(lang, ids): texts as numbers of the words in ``ids`` (lang, word, id), packed int32, -1 breaks."""
    if not is_small(ids, max_table):
        return shuffled(docs.mapInArrow(_local_words, "lang string, ids binary, keys array<string>"), ids, "word")
    known: dict[str, dict[bytes, int]] = {}
    for r in ids.select("lang", "word", "id").toLocalIterator():
        known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
    return docs.mapInArrow(_streams(docs.sparkSession.sparkContext.broadcast(known)), STREAMS)


def pair_table(ids: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted codes and their numbers by language, collected some thousand pairs a row."""
    packed = ids.select("lang", "code", F.col("id").cast("int").alias("id")).orderBy("lang", "code").mapInArrow(_blocks, "lang string, codes binary, ids binary")
    parts: dict[str, list] = {}
    for r in packed.toLocalIterator():
        parts.setdefault(r["lang"], []).append((r["codes"], r["ids"]))
    known = {}
    for lang in list(parts):
        codes, own = zip(*parts.pop(lang))
        known[lang] = (np.frombuffer(b"".join(codes), np.int64), np.frombuffer(b"".join(own), np.int32))
    return known


def longer_streams(streams: DataFrame, ids: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The streams in the numbers of the frequent pairs ``ids`` (lang, code, id)."""
    if not is_small(ids, max_pairs):
        return shuffled(streams.mapInArrow(_local_pairs, "lang string, ids binary, keys array<long>"), ids, "code")
    return streams.mapInArrow(_rewrite(streams.sparkSession.sparkContext.broadcast(pair_table(ids))), STREAMS)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, max_table: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language as (lang, n); [(lang, id, phrase, n, prefix, suffix)] for 1, 2, ... words).

    Only phrases with ``min_count`` occurrences; ``prefix`` and ``suffix`` are ids of the list before.  ``max_table``
    stands for ``MAX_TABLE`` and ``MAX_PAIRS``."""
    max_words_known, max_pairs = (MAX_TABLE, MAX_PAIRS) if max_table is None else (max_table, max_table)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    # a task's counts are added up once, in Python, and dealt as they are: a second map of them in the JVM hardly has equal keys to add
    words = publish(docs.mapInArrow(_word_counts, "lang string, word string, n long").repartition("lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    ids = numbered(words.where(F.col("n") >= min_count), "word")
    none = F.lit(None).cast("long")
    levels = [ids.select("lang", "id", F.col("word").alias("phrase"), "n", none.alias("prefix"), none.alias("suffix"))]
    streams = publish(word_streams(docs, ids, max_words_known), "word-streams", STREAM_FILES)
    for m in range(2, max_words + 1):
        counts = streams.mapInArrow(_pair_counts, COUNTS).repartition("lang", "code").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        ids = numbered(publish(counts.where(F.col("n") >= min_count), "phrase-counts"), "code")
        prefix, suffix = F.shiftright("code", 32), F.col("code").bitwiseAND((1 << 32) - 1)
        ids = ids.withColumn("prefix", prefix).withColumn("suffix", suffix)
        first = levels[-1].select("lang", F.col("id").alias("prefix"), F.col("phrase").alias("first"))
        last = levels[-1].select("lang", F.col("id").alias("suffix"), F.substring_index("phrase", " ", -1).alias("last"))
        named = ids.join(first, ["lang", "prefix"]).join(last, ["lang", "suffix"])
        levels.append(publish(named.select("lang", "id", F.concat_ws(" ", "first", "last").alias("phrase"), "n", "prefix", "suffix"), "phrases"))
        if m < max_words:
            streams = publish(longer_streams(streams, ids, max_pairs), "phrase-streams", STREAM_FILES)
    return totals, levels


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, max_table: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``max_words`` words from (text, lang)."""
    totals, levels = phrase_counts(docs, min_count, max_words, max_table)
    every, cuts = None, None
    for m, level in enumerate(levels, 1):
        counts = level.select("lang", "phrase", "n")
        every = counts if every is None else every.unionAll(counts)
        if m == 1:
            continue
        own = level.select("lang", "id", "phrase", F.col("n").alias("a"))
        if m < max_words:  # a longer phrase as frequent as this one
            longer = levels[m].select("lang", F.explode(F.array("prefix", "suffix")).alias("id"), "n").groupBy("lang", "id").agg(F.max("n").alias("longer"))
            own = own.join(longer, ["lang", "id"], "left").where(F.coalesce("longer", F.lit(-1)) < F.col("a")).drop("longer")
        at = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.lit(m - 1))).alias("k"))
        words = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
        at = at.withColumn("first", words(F.col("k"))).withColumn("rest", words(F.col("k") - m))
        cuts = at if cuts is None else cuts.unionAll(at)
    left, right = every.toDF("lang", "first", "l"), every.toDF("lang", "rest", "r")
    parts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    thousandfold = (whole("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)")
    score = F.call_function("div", thousandfold * whole("n"), whole("l") * whole("r"))
    scored = (parts.withColumn("score", score).groupBy("lang", "phrase", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of ``documents``; nulls, ties, repeats and empty tables as the module says."""
    prepare(spark)
    small_batches(spark)
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_GRAMS = "\nUNION ALL ".join(f"SELECT lang, piece, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 1} + 1), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM pieces"
                             for m in range(1, MAX_WORDS + 1))
ORACLE = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT lang, unnest(string_split(translate(t, '.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13), '..........'), '.')) AS piece FROM texts),
pieces AS (SELECT lang, piece, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM cut),
grams AS ({_GRAMS}),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON s.lang = b.lang AND b.m > s.m AND b.a >= s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
cand AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM f WHERE m >= 2 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cand c JOIN total USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
worst AS (SELECT lang, phrase, a, n, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst
QUALIFY rank <= {TOP}"""
