"""Items that appear together (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import written


def item_pairs(df: DataFrame, items: Column) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, pmi) for every two items a < b that share a basket.

    ``items`` is an array of strings, one per row of df (the basket). Items are deduplicated within the basket, null and empty
    ones left out; a null or empty basket counts nowhere, a basket of one item only in the marginals. n counts baskets with any
    item. Pairs are emitted in order, as a stream, and their counts combined before the shuffle, so that it carries distinct
    pairs rather than occurrences. The marginals are counted with the pairs: an item by itself is the pair (a, null), the basket
    (null, null). One pass over the baskets and one aggregation give all counts, which are written; the rest reads these.
    """
    basket = df.select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))).alias("__items")).where(F.size("__items") > 0)
    null = F.array(F.lit(None).cast("string"))
    heads = basket.select(F.posexplode(F.concat(null, "__items")).alias("__k", "a"), "__items")
    # The partners of item number k are the items after it; the null in front stands for the marginal.
    after = F.when(F.col("__k") > 0, F.slice("__items", F.col("__k") + 1, F.greatest(F.size("__items") - F.col("__k"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    counts = heads.select("a", F.explode(F.concat(null, after)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts, "pairs")
    pairs = counts.where("a is not null and b is not null").withColumnRenamed("c", "n_ab")
    ones = counts.where("a is not null and b is null")
    total = counts.where("a is null").select(F.col("c").alias("n"))
    out = (
        pairs.join(ones.select("a", F.col("c").alias("n_a")), "a")
        .join(ones.select(F.col("a").alias("b"), F.col("c").alias("n_b")), "b")
        .join(F.broadcast(total))
    )
    lift = F.col("n").cast("double") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))


def lifted(pairs: DataFrame, least: int = 3, lift: int = 3) -> DataFrame:
    """The pairs in at least ``least`` baskets and at least ``lift`` times as often as chance (in whole numbers, so exact)."""
    exact = F.col("n").cast("decimal(38,0)") * F.col("n_ab") >= F.col("n_a").cast("decimal(38,0)") * F.col("n_b") * lift
    return pairs.where((F.col("n_ab") >= least) & exact)
