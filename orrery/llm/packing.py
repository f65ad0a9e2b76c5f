"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written

#: The public vocabulary's file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary parts text into pieces before merging; fixed values.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Pieces whose token count a worker remembers.
REMEMBERED = 500_000


class TokenCounter:
    """Exact token counts. Merges never cross a piece, so a text's count is the sum of its pieces', which are remembered."""

    def __init__(self, vocabulary: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) > REMEMBERED:
                    self.clear()
                n = self[piece] = len(encode(piece))
                return n

        self.known = Known()
        self.ascii, self.any, self.odd = re.compile(_ASCII_PIECES).findall, regex.compile(PIECES).findall, re.compile("[\x1c-\x1f\ud800-\udfff]").search

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = self.ascii if text.isascii() and not self.odd(text) else self.any
        return sum(map(self.known.__getitem__, pieces(text)))


def token_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens) of each document; null and empty texts have 0 tokens. The vocabulary (about 1 MB) is broadcast."""
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["__d", "n_tokens"])

    kind = dict(documents.dtypes)[doc]
    return documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t")).mapInArrow(run, f"__d {kind}, n_tokens bigint").withColumnRenamed("__d", doc)


@dataclass(frozen=True)
class Run:
    """``times`` containers, from number ``first`` on, that each hold items of these sizes (largest first)."""

    first: int
    times: int
    sizes: tuple[int, ...]


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """A plan that packs counts[size] items of each size from 1 to capacity.

    Items of one size can stand for each other, so the plan is made on the histogram: one container is composed, then
    repeated as often as the histogram allows. Composing: fill greedily with the largest item that fits; then replace the
    container's smallest item with two unpacked items that fit its expanded gap more tightly, until none do. Every repeat uses
    up a size to within one container's need, so the number of runs is bounded by the capacity (at most the sum of
    capacity / size over sizes), not by the number of items.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    sizes, plan, first = np.arange(capacity + 1), [], 0
    while left[1:].any():
        spare, chosen, gap = left.copy(), [], capacity
        while gap:
            fitting = np.flatnonzero(spare[1 : gap + 1])
            if not len(fitting):
                break
            size = int(fitting[-1]) + 1
            chosen.append(size)
            spare[size] -= 1
            gap -= size
        while gap and chosen:
            smallest = chosen[-1]
            spare[smallest] += 1
            room = gap + smallest
            top = np.maximum.accumulate(np.where(spare[: room + 1] > 0, sizes[: room + 1], 0))  # the largest size there is up to each
            one = np.flatnonzero(spare[: room + 1] > 0)
            one = one[one > 0]
            two = top[room - one]
            alone = (two == one) & (spare[one] < 2)  # the pair would use one item twice
            if alone.any():
                two[alone] = top[one[alone] - 1]
            total = np.where(two > 0, one + two, 0)
            k = int(total.argmax()) if len(total) else 0
            if not len(total) or total[k] <= smallest:
                spare[smallest] -= 1
                break
            a, b = int(one[k]), int(two[k])
            spare[a] -= 1
            spare[b] -= 1
            chosen = sorted([*chosen[:-1], a, b], reverse=True)
            gap = capacity - sum(chosen)
        used = np.bincount(chosen, minlength=capacity + 1)
        need = np.flatnonzero(used)
        times = int((left[need] // used[need]).min())
        left[need] -= used[need] * times
        plan.append(Run(first, times, tuple(chosen)))
        first += times
    return plan


def pack(items: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, per_task: int = 100_000) -> DataFrame:
    """(item, part, n, container, place): each item's container and its place in it, both from 0.

    An item up to the capacity is part 0 and stays whole; a longer one is cut into parts 0, 1, ... of the capacity and a last
    one of the rest. Items of size 0 (null counts as 0) take no room and are dealt to the containers of the first run. Repeated
    items are packed each. Only the histogram (one row per size, at most capacity + 1) comes to the driver. Items of a size are
    numbered in buckets by their hash of about ``per_task`` rows, so a size that most items share is numbered by many tasks.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    whole = items.select(F.col(item).alias("__i"), n.alias("__n"))
    cut = F.when(F.col("__n") <= capacity, F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.col("__n").alias("n")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / capacity)), lambda k: F.struct(k.alias("part"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - k * capacity).alias("n")))
    )
    parts = written(whole.select("__i", F.inline(cut)), "parts")
    counts = {r[0]: r[1] for r in parts.groupBy("n").count().collect()}
    none = counts.pop(0, 0)
    plan = best_two_fit(counts, capacity) or [Run(0, 1, ())]

    # Where the k-th item of a size goes: segments of ranks, each of which fills the same places of a run of containers.
    segments, begun = [], {}
    for run in plan:
        for s in dict.fromkeys(run.sizes):
            each = run.sizes.count(s)
            segments.append((s, begun.get(s, 0), run.first, each, run.sizes.index(s)))
            begun[s] = begun.get(s, 0) + each * run.times
    head, spread = len(plan[0].sizes), plan[0].times
    table = sorted(segments)
    keys = np.array([[s, at] for s, at, *_ in table], dtype=np.int64).reshape(-1, 2)
    vals = np.array([x[1:] for x in table], dtype=np.int64).reshape(-1, 4)
    sent = items.sparkSession.sparkContext.broadcast((keys, vals))

    buckets = max(1, -(-sum(counts.values(), none) // per_task))
    hashed = parts.withColumn("__b", F.pmod(F.xxhash64("__i", "part"), F.lit(buckets)))
    before = hashed.groupBy("n", "__b").count()
    offsets = before.select("n", "__b", (F.sum("count").over(Window.partitionBy("n").orderBy("__b")) - F.col("count")).alias("__o"))
    within = Window.partitionBy("n", "__b").orderBy("__i", "part")
    ranked = hashed.withColumn("__k", F.row_number().over(within) - 1).join(offsets, ["n", "__b"]).select("__i", "part", "n", (F.col("__k") + F.col("__o")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, to = sent.value
        wide = starts[:, 0] * (1 << 50) + starts[:, 1]
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            container, spot = rank % spread, head + rank // spread
            some = n > 0
            if some.any():
                k = np.searchsorted(wide, n[some] * (1 << 50) + rank[some], side="right") - 1
                at, first, each, base = to[k].T
                container[some] = first + (rank[some] - at) // each
                spot[some] = base + (rank[some] - at) % each
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(container), pa.array(spot)], ["__i", "part", "n", "container", "place"])

    kind = dict(items.dtypes)[item]
    return ranked.mapInArrow(place, f"__i {kind}, part bigint, n bigint, container bigint, place bigint").withColumnRenamed("__i", item)
