"""Synthetic graphs: a star, two stars, and scattered papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _papers(spark: SparkSession, n: int, masses: dict[int, float]) -> DataFrame:
    mass = F.lit(0.2)
    for paper, value in masses.items():
        mass = F.when(F.col("id") == paper, value).otherwise(mass)
    return spark.range(1, n + 1).select("id", mass.alias("mass")).withColumn("radius", F.sqrt(F.col("mass") / F.pi()))


def star(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Papers (id, mass, radius) and links (src, dst, freq): paper 1, which all others refer to."""
    return _papers(spark, n, {1: 0.2 + 0.1 * (n - 1)}), spark.range(2, n + 1).select(F.col("id").alias("src"), F.lit(1).cast("bigint").alias("dst"), F.lit(1).cast("bigint").alias("freq"))


def double_star(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Papers 1 and 2, which all others refer to."""
    links = spark.range(3, n + 1).select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2)])).alias("dst"), F.lit(1).cast("bigint").alias("freq"))
    return _papers(spark, n, {k: 0.2 + 0.1 * (n - 2) for k in (1, 2)}), links


def scattered(spark: SparkSession, n: int, categories: int, seed: int) -> DataFrame:
    """Papers without links, with a category, a radius up to 4 and a place within 100, drawn by ``seed``."""
    at = spark.range(1, n + 1)
    return at.select("id", F.floor(F.rand(seed) * categories).cast("int").alias("category"), (F.rand(seed + 1) * 4).alias("radius"), *[((F.rand(seed + 2 + k) - 0.5) * 200).alias(c) for k, c in enumerate("xy")])
