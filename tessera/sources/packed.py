"""Packed-dataset publishing and reuse (S2-S5) and the metrics sink."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import SHARD_BYTES


def packed_name(name: str, max_seq_length: int) -> str:
    """Deterministic dataset name ``{name}-seq{max_seq_length}-tokenized-grouped``."""
    return f"{name}-seq{max_seq_length}-tokenized-grouped"


def packed_path(root: str, name: str, max_seq_length: int) -> str:
    return f"{root.rstrip('/')}/{packed_name(name, max_seq_length)}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def records_per_shard(block_size: int, target_bytes: int = SHARD_BYTES,
                      bytes_per_token: int = 5, overhead: int = 64) -> int:
    """Rows per output file so a file stays under ``target_bytes`` (int32 id + int8 mask)."""
    return max(1, int(target_bytes // (block_size * bytes_per_token + overhead)))


def write_packed(df: DataFrame, root: str, name: str, max_seq_length: int,
                 block_size: int | None = None, target_bytes: int = SHARD_BYTES,
                 sample_run: bool = False) -> str | None:
    """Publish packed splits under one path, partitioned by ``split``, bounded shards.

    Skipped (returns None) for capped sample runs, as the reference does.
    """
    if sample_run:
        return None
    path = packed_path(root, name, max_seq_length)
    n = records_per_shard(block_size or max_seq_length, target_bytes)
    (df.write.mode("overwrite").option("maxRecordsPerFile", n)
     .partitionBy("split").parquet(path))
    return path


def read_packed(spark: SparkSession, root: str, name: str, max_seq_length: int,
                split: str | None = None) -> DataFrame:
    """Read a published packed dataset; a split filter prunes partitions."""
    df = spark.read.parquet(packed_path(root, name, max_seq_length))
    return df if split is None else df.filter(F.col("split") == split)


def require_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """Raise when the split has no rows (one-row probe, no full scan)."""
    if df.filter(F.col(split_col) == split).isEmpty():
        raise ValueError(f"split {split!r} is empty in the given dataset")
    return df


def build_or_read(spark: SparkSession, root: str, name: str, max_seq_length: int,
                  build: Callable[[], DataFrame], overwrite: bool = False,
                  block_size: int | None = None) -> DataFrame:
    """Reuse the published dataset unless ``overwrite``; else build, publish, re-read."""
    path = packed_path(root, name, max_seq_length)
    if overwrite or not path_exists(spark, f"{path}/_SUCCESS"):  # a folder without it is an unfinished write
        write_packed(build(), root, name, max_seq_length, block_size)
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str, run: str, phase: str, fmt: str = "json") -> None:
    """Write one phase's metrics (e.g. train / eval) partitioned by run and phase; a rerun replaces that phase."""
    (df.withColumn("run", F.lit(run)).withColumn("phase", F.lit(phase))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "phase").format(fmt).save(path))
