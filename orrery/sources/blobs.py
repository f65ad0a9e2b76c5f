"""Packed link lists: one binary field per paper, little-endian records of id (4 bytes) and, if set up so, order, frequency and
citation count (2 bytes each)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlobLayout:
    """Which optional members the records have."""

    order: bool = True
    freq: bool = True
    ncites: bool = True

    @property
    def width(self) -> int:
        return 4 + 2 * (self.order + self.freq + self.ncites)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([("id", "<u4"), *[(n, "<u2") for n in ("order", "freq", "ncites") if getattr(self, n)]])


def unpack_links(df: DataFrame, key: str, blob: str, layout: BlobLayout = BlobLayout()) -> DataFrame:
    """(key, slot, other, ord, freq, ncites): a row for each record; missing members are order 0, frequency 1, no citations.

    A null or empty blob gives no row, nor does one whose length isn't a multiple of a record's: count those with
    ``bad_blobs``. A batch of blobs lies end to end in memory, so it is decoded in one step, without a copy of a large
    blob for each of its records as a generator over the row would make.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column(0), batch.column(1)
            data = np.frombuffer(b"".join(blobs.to_pylist()), dtype=layout.dtype)
            counts = np.array([len(b) for b in blobs.to_pylist()], dtype=np.int64) // layout.width
            begins = np.cumsum(counts) - counts
            key_of = pa.array(np.repeat(np.arange(len(counts)), counts))
            column = lambda name, default: data[name].astype(np.int64) if name in data.dtype.names else np.full(len(data), default, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(key_of), pa.array(np.arange(len(data), dtype=np.int64) - np.repeat(begins, counts)), *[pa.array(column(n, d)) for n, d in (("id", 0), ("order", 0), ("freq", 1), ("ncites", 0))]],
                ["key", "slot", "other", "ord", "freq", "ncites"],
            )

    size = F.octet_length(blob)
    good = df.where((size > 0) & (size % layout.width == 0)).select(F.col(key).cast("bigint").alias("key"), F.col(blob).alias("blob"))
    return good.mapInArrow(run, "key bigint, slot bigint, other bigint, ord bigint, freq bigint, ncites bigint").withColumnRenamed("key", key)


def bad_blobs(df: DataFrame, blob: str, layout: BlobLayout = BlobLayout()) -> DataFrame:
    """The rows whose blob has a bad length."""
    return df.where(F.octet_length(blob) % layout.width != 0)


def _little(x: Column, size: int) -> Column:
    h = F.lpad(F.hex(x), size * 2, "0")
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))])


def pack_links(links: DataFrame, key: str, layout: BlobLayout = BlobLayout()) -> DataFrame:
    """(key, blob): the records of each key in the order of ``slot``; the inverse of ``unpack_links`` but for keys without links."""
    record = F.concat(_little(F.col("other"), 4), *[_little(F.col(n), 2) for n, on in (("ord", layout.order), ("freq", layout.freq), ("ncites", layout.ncites)) if on])
    rows = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", record.alias("r")))).alias("l"))
    return rows.select(key, F.unhex(F.array_join(F.transform("l", lambda s: s["r"]), "")).alias("blob"))
