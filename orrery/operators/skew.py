"""Per-key results where a few keys hold most rows (problem 5)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so there are at most 1 / HEAVY_SHARE heavy keys, whatever the data.
HEAVY_SHARE = 1 / 1024


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys with at least ``share`` of the rows that have a key: at most 1 / share rows (__key, __rows, __parts). A heavy key's parts are as many as
    leave each of them about that share of all rows.

    Counts are combined before the shuffle. The total is a one-row aggregate.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    total = df.agg(F.count(key).alias("__total"))
    return counts.join(F.broadcast(total), F.col("__rows") >= F.col("__total") * F.lit(share)).select("__key", "__rows", F.ceil(F.col("__rows") / (F.col("__total") * F.lit(share))).cast("int").alias("__parts"))


def _parts(salts: int | None) -> Column:
    return F.col("__parts") if salts is None else F.lit(salts)


def salted_distinct_count(df: DataFrame, key: str, value: str, name: str, salts: int | None = None, share: float = HEAVY_SHARE) -> DataFrame:
    """(key, name): the number of distinct non-null values of each non-null key, without imbalance.

    Stage 1 appends a salt to heavy keys and counts distinct values for each key and salt; stage 2 adds the partial
    counts. The salt is a hash of the value, as random as one drawn but the same for equal values, so that no value
    is counted under two salts and the sums are exact even if a task is run again. Keys that are not heavy keep
    salt 0. ``salts`` are by the key's rows unless given. A key with null values only counts 0; a null key gives no row.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where(F.col("__k").isNotNull())
    heavy = F.broadcast(heavy_keys(df.select(key), key, share).select(F.col("__key").alias("__k"), _parts(salts).alias("__parts")))
    salted = rows.join(heavy, "__k", "left").withColumn("__salt", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64("__v"), F.col("__parts")).cast("int")).otherwise(0))
    partial = salted.groupBy("__k", "__salt").agg(F.count_distinct("__v").alias("__n"))
    return partial.groupBy(F.col("__k").alias(key)).agg(F.sum("__n").alias(name))


def salted_aggregate(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], salts: int | None = None, share: float = HEAVY_SHARE) -> DataFrame:
    """Any aggregate that merges, in two stages: ``partial`` for each key and salt, then ``merge`` over its columns.

    The salt of a heavy key's row is a hash of all its columns, so that a task run again deals rows alike. Null keys
    are grouped together, as groupBy does, and spread as a heavy key.
    """
    heavy = F.broadcast(heavy_keys(df, key, share).select(F.col("__key").alias("__hk"), _parts(salts).alias("__hp")))
    rows = df.join(heavy, F.col(key) == F.col("__hk"), "left")
    parts = F.when(F.col(key).isNull(), F.lit(salts or ceil(1 / share))).otherwise(F.col("__hp"))
    salt = F.when(parts.isNotNull(), F.pmod(F.xxhash64(*df.columns), parts).cast("int")).otherwise(0)
    staged = rows.withColumn("__salt", salt).groupBy(key, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return staged.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])


def count_mismatches(claims: DataFrame, links: DataFrame, key: str, claim: str, link_key: str, link_value: str) -> DataFrame:
    """(key, claimed, counted): keys whose non-null claim differs from their distinct link values (0 without links).

    Distinct rows; a key with several claims is held against each. The counts have one row per key, so the join
    isn't skewed.
    """
    counted = salted_distinct_count(links, link_key, link_value, "counted")
    kept = claims.where(F.col(claim).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(claim).alias("claimed"))
    out = kept.join(counted, F.col("__id") == F.col(link_key), "left").withColumn("counted", F.coalesce("counted", F.lit(0).cast("bigint")))
    return out.where(F.col("claimed") != F.col("counted")).select(F.col("__id").alias(key), "claimed", "counted").distinct()
