"""Parquet table access with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` if any are given, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def checked_count(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, or an error when they are read if there aren't as many as expected."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    text = F.concat(F.lit(f"expected {expected} rows, found "), F.col("__n").cast("string"))
    return rows.join(F.broadcast(n)).where(F.when(F.col("__n") == expected, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).drop("__n")


def current_rows(meta: DataFrame, *columns: str, key: str = "id", version: str = "loadedat", first: str | None = None) -> DataFrame:
    """One row per ``key``: that with the greatest ``version``, with ``columns`` of it.

    Exact copies count once. Rows of equal ``version`` and other content are ordered by ``columns`` (nulls first), so
    the result doesn't depend on row order; a null ``version`` is older than any. A null key is a key of its own.
    ``first`` adds the smallest ``version`` under that name. The maximum is combined before the shuffle, so a key
    delivered any number of times sends one row per task.
    """
    best = F.max(F.struct(F.col(version).alias("__v"), *[F.col(c) for c in columns])).alias("__best")
    aggs = [best] + ([F.min(version).alias(first)] if first else [])
    out = meta.groupBy(key).agg(*aggs)
    return out.select(key, *[F.col("__best")[c].alias(c) for c in columns], *([first] if first else []))
