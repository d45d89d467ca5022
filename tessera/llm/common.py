"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the shared folder known and this package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark from any store."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def publish(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (the writer's ``options``) to the shared folder and read it back.

    Cuts the lineage: what follows reads the written rows, so a lost executor
    costs its own tasks only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` values of ``key`` that cut the rows into near-equal ranges, ascending.

    One aggregation over the key column alone; the values are rows' own keys,
    none of them the smallest.  ``n`` is a number of partitions, so the list is small.
    """
    if n < 2:
        return []
    row = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("q"), F.min(key).alias("low")).first()
    return sorted(c for c in set(row["q"] or []) if c > row["low"])


def range_no(key: Column, cuts: list[int]) -> Column:
    """Number of the range that an integer ``key`` falls into; a cut opens its range, a null key is in the last.

    A binary search over the cuts as an array literal, so a row's cost grows with the logarithm of their number."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    marks = F.array(*[F.lit(c).cast("long") for c in cuts])
    whole = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))  # the number of cuts at or below the key lies in low … high

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["low"] + span["high"]) / 2).cast("int")
        above = (span["low"] < span["high"]) & (F.get(marks, mid) <= key)
        return F.struct(F.when(above, mid + 1).otherwise(span["low"]).alias("low"),
                        F.when(above, span["high"]).otherwise(F.least(mid, span["high"])).alias("high"))

    found = F.reduce(F.sequence(F.lit(0), F.lit(n.bit_length())), whole, halve, lambda span: span["low"])
    return F.when(key.isNull(), F.lit(n)).otherwise(found)


PIPELINE_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most ``PIPELINE_BATCH_BYTES`` at a time in this session: long texts by the thousand cost each worker, and the JVM beside it, their size again and again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if size > PIPELINE_BATCH_BYTES:
        spark.conf.set(name, f"{PIPELINE_BATCH_BYTES}b")
