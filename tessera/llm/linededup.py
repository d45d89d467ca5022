"""Line deduplication by levelled sorted runs of line hashes (SQL functions only).

A line's key is the line without blanks at both ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines except in the largest ``doc_id`` that holds them.

1. One scan of the texts writes the line log: (document, line number, 128-bit key hash) of the lines that are long
   enough.  Texts themselves are not written.
2. The log is cut into batches of falling ``doc_id``, so a key's first batch holds its largest document.  Each batch
   is counted with partial sums before the shuffle, so a line found in a third of all documents is a row a task.
3. ``LineRuns`` takes the batches one by one.  A batch is anti-joined with the runs: keys not there are new and become
   a run of their own (key, owner, documents), sorted by hash; the others add to the counts of known keys.  Runs are
   tables bucketed and sorted by hash, so the merge joins move no rows.  ``FANOUT`` runs of a level are merged
   into one run of the next level, so a batch meets a number of runs that grows with the logarithm of the batches.
4. Keys with enough documents meet the line log (a sort-merge join that Spark may split at a frequent line), which
   gives each text the numbers of its dropped lines; what stays is cut out between them.

Defined results: a null or empty text is one empty line; a null ``doc_id`` counts as one document, smaller than all
others; rows that share a ``doc_id`` are one document when documents are counted, and each such row is returned; an
empty table gives no rows; the input's columns come back inside the struct ``row``, so no name can clash.  Two keys
with equal 128-bit hashes would count as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, prepare, publish, range_cuts, scratch, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 8
FANOUT = 3
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
LOWEST = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_log(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, line_no, h1, h2) of each line whose key has ``min_chars`` code points.  ``doc`` is the id, null as the lowest number."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc"), F.xxhash64("text").alias("text_hash"),
                        F.posexplode(text_lines(F.col("text"))).alias("line_no", "line"))
    keys = (lines.select("doc", "text_hash", "line_no", line.alias("line")).where(F.char_length("line") >= min_chars)
            .withColumn("key", F.translate("line", UPPER, LOWER)))
    return keys.select("doc", "text_hash", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, owner, n): the keys seen so far, their owner and the documents of their first batch.

    ``levels[k]`` lists the runs of level ``k``; every run is a table with ``buckets`` buckets by hash, each sorted.
    The runs' keys are disjoint.  ``again`` lists tables of (h1, h2, n) for known keys found in later batches.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.again: list[str] = []

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"line_{kind}_{uuid.uuid4().hex[:12]}"
        (df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", scratch(self.spark, name)).saveAsTable(name))
        return name

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """One batch (h1, h2, owner, n): unseen keys become a run, the others are counted again.

        Batches come in falling order of documents, so a known key's owner stands."""
        new, known = batch, None
        for name in self.runs:
            run = self.spark.table(name).select(*KEY)
            new = new.join(run, KEY, "left_anti")
            found = batch.join(run, KEY, "left_semi").select(*KEY, "n")
            known = found if known is None else known.unionAll(found)
        if known is not None:
            self.again.append(self._write(known, "again"))
        self._push(self._write(new, "run"), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(self._write(self._all(old), "run"), level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")

    def _all(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionAll(self.spark.table(name))
        return out

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of the keys in at least ``min_docs`` documents."""
        seen = self._all(self.runs)
        total = F.col("n")
        if self.again:
            more = self._all(self.again).groupBy(*KEY).agg(F.sum("n").alias("more"))
            seen = seen.join(more, KEY, "left")
            total = total + F.coalesce("more", F.lit(0))
        return seen.where(total >= min_docs).select(*KEY, "owner")

    def drop(self) -> None:
        for name in [*self.runs, *self.again]:
            self.spark.sql(f"DROP TABLE {name}")


def batches_of(log: DataFrame, n: int, runs: LineRuns) -> list[DataFrame]:
    """The log's keys (h1, h2, owner, n) in ``n`` batches of falling documents, counted in one job and bucketed like the runs."""
    cuts = sorted(range_cuts(log, "doc", n), reverse=True)
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc") >= cut, i).otherwise(number)
    counted = (log.select(number.alias("batch"), *KEY, "doc").groupBy("batch", *KEY)
               .agg(F.max("doc").alias("owner"), F.count_distinct("doc").alias("n")))
    name = f"line_batches_{uuid.uuid4().hex[:12]}"
    (counted.repartition(runs.buckets, *KEY).write.format("parquet").partitionBy("batch").bucketBy(runs.buckets, *KEY).sortBy(*KEY)
     .option("path", scratch(log.sparkSession, name)).saveAsTable(name))
    whole = log.sparkSession.table(name)
    return [whole.where(F.col("batch") == i).select(*KEY, "owner", "n") for i in range(len(cuts) + 1)]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                fanout: int = FANOUT) -> DataFrame:
    """(row, n_lines, n_dropped, kept): ``row`` holds the input's columns, ``kept`` the text without its dropped lines."""
    spark = docs.sparkSession
    log = publish(line_log(docs.select("doc_id", "text"), min_chars), "line-log")
    runs = LineRuns(spark, fanout=fanout)
    for batch in batches_of(log, batches, runs):
        runs.add(batch)
    repeated = publish(runs.repeated(min_docs), "line-repeated")
    runs.drop()
    dropped = (log.join(repeated, KEY).where(F.col("doc") != F.col("owner"))
               .groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = (F.coalesce("row.doc_id", F.lit(LOWEST)) == F.col("doc")) & (F.xxhash64("row.text") == F.col("text_hash"))
    lines = rows.join(dropped, at, "left").select("row", "gone", text_lines(F.col("row.text")).alias("lines"))
    n = F.size("lines")
    ends = F.concat(F.array(F.lit(-1)), "gone", F.array(n))  # what stays lies between consecutive numbers
    between = F.transform(F.sequence(F.lit(1), F.size("gone") + 1),
                          lambda i: F.slice("lines", F.element_at("ends", i) + 2, F.element_at("ends", i + 1) - F.element_at("ends", i) - 1))
    kept = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.flatten(between), "\n"))
    return (lines.withColumn("ends", F.when(F.col("gone").isNotNull(), ends))
            .select("row", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: lines, dropped lines and the digest of what is kept; nulls, repeats and empty tables as the module says."""
    prepare(spark)
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LOWEST}) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keys AS (SELECT r, doc, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
often AS (SELECT key, max(doc) AS owner FROM keys WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc) >= {MIN_DOCS}),
kept AS (SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM keys k
         WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.key = k.key AND o.owner <> k.doc) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n_kept, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""
