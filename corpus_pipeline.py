"""Corpus pipeline: quality, language, near duplicates, mix, tokens.

Each stage takes the rows that the one before kept, written as Parquet and
read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cotrain, jaccard, langid, mixing, transducer
from tessera.llm.bytebpe import vocabulary
from tessera.llm.common import prepare, publish, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good; null and blank texts go."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return cotrain.keep_good(docs, labels)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    prepare(spark)
    small_batches(spark)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest ``doc_id``."""
    prepare(spark)
    small_batches(spark)
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is drawn, shard by shard, shuffled within a shard."""
    prepare(spark)
    small_batches(spark)
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "source", "text")]).alias("rest"))
    drawn = mixing.shuffled(mixing.mixture(packed))
    return drawn.select(*[F.col(c) if c in ("doc_id", "source", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of the text read back from them."""
    prepare(spark)
    small_batches(spark)
    rows = transducer.encode_documents(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("source_mix", mix),
    ("bpe_tokens", tokens),
]

ORACLE_SQL = None  # SQL expresses none of the learned stages; tests/llm test their operators one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
