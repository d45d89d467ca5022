"""Corpus sources (S1, S9) and text-column resolution."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a raw corpus by path and format (parquet, json, text, csv, orc).

    ``text`` files yield one row per line in a ``value`` column; give an explicit
    schema for json/csv so no inference pass runs over the corpus.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "text":
        return reader.text(path).withColumnRenamed("value", "text")
    return reader.format(fmt).load(path)


def text_column(df: DataFrame) -> str:
    """``text`` when present, otherwise the first column; it must be a string."""
    names = df.columns
    if not names:
        raise ValueError("corpus has no columns")
    name = "text" if "text" in names else names[0]
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise TypeError(f"text column {name!r} is {df.schema[name].dataType.simpleString()}, not string")
    return name


def select_text(df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Project to the resolved text column (renamed ``text``) plus ``keep`` columns."""
    name = text_column(df)
    return df.select(*keep, F.col(name).alias("text"))


def pin(df: DataFrame, keep_in_memory: bool = True) -> DataFrame:
    """``keep_in_memory``: persist with spill to disk, never memory-only."""
    return df.persist(StorageLevel.MEMORY_AND_DISK) if keep_in_memory else df
