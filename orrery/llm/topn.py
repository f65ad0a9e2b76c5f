"""Top N items within every group (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task's heaps may hold together before they are sent on and begun anew.
HEAP_ROWS = 1_000_000


def _heaps(groups: list[str], n: int, room: int):
    """A task's bounded heaps: of what is held and each batch, the n best rows of every group stay."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows.groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((rows["__item"].to_numpy(), ~rows["__score"].to_numpy(), codes))
        codes = codes[order]
        begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        rank = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        return rows.iloc[order[rank < n]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, fresh = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                fresh += len(batch)
            if fresh > room // 4:
                held, fresh = [best(pd.concat(held))], 0
                if len(held[0]) > room:
                    yield held.pop()
        if held:
            yield best(pd.concat(held))

    return run


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: int, room: int = HEAP_ROWS) -> DataFrame:
    """(group..., item, score, place): the n items of greatest score in each group, ties to the smaller item.

    score and item are integers; rows with a null in either don't compete, and null group values form a group. Repeated
    rows are items of their own. Each task keeps a bounded heap of n rows per group before the shuffle, so that a group of
    millions of rows sends n rows per task; a task with so many groups that its heaps outgrow ``room`` rows sends them on and
    begins anew. After the shuffle the heaps of a group are merged by the same order.
    """
    names = [f"__g{k}" for k in range(len(group))]
    kind = dict(df.dtypes)
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(group, names)], F.col(score).cast("bigint").alias("__score"), F.col(item).cast("bigint").alias("__item"))
    rows = rows.where(F.col("__score").isNotNull() & F.col("__item").isNotNull())
    # Integer groups with nulls would become floats in pandas; as text they stay exact.
    sent = rows.select(*[F.col(a).cast("string").alias(a) for a in names], "__score", "__item")
    heaps = sent.mapInPandas(_heaps(names, n, room), sent.schema)
    order = Window.partitionBy(*names).orderBy(F.desc("__score"), "__item")
    merged = heaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return merged.select(*[F.col(a).cast(kind[c]).alias(c) for c, a in zip(group, names)], F.col("__item").alias(item), F.col("__score").alias(score), F.col("place").cast("bigint"))
