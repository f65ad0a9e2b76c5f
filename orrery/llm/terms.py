"""Frequency of every distinct value or term (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import written

#: log2 of the record identifiers that a container covers.
CONTAINER = 20
#: Occurrences that a task holds before it makes containers of them.
HELD = 1_000_000


def normal_term(term: Column) -> Column:
    """Lower case, trimmed, inner blanks made one space."""
    return F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))


def encoded(group: np.ndarray, place: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each group's set of places as the gaps between its set bits, seven bits to a byte, the last byte of a gap below
    128. group and place are sorted together and distinct; ``groups`` numbers groups from 0, those without places are empty."""
    first = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
    gaps = np.where(first, place + 1, np.diff(place, prepend=0)).astype(np.uint64)
    width = np.ones(len(gaps), dtype=np.int64)
    for bits in range(7, 64, 7):
        width += gaps >> np.uint64(bits) > 0
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(width.max()) if len(width) else 0):
        some = width > k
        more = np.where(width[some] > k + 1, np.uint8(128), np.uint8(0))
        out[(ends - width)[some] + k] = (gaps[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    sizes = np.bincount(group, weights=width, minlength=groups).astype(np.int64)
    return out, np.concatenate(([0], np.cumsum(sizes)))


def decoded(bits: bytes) -> np.ndarray:
    """The places of an encoded set, ascending."""
    raw = np.frombuffer(bits, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate(([0], last[:-1] + 1))[: len(last)]
    shift = (np.arange(len(raw)) - np.repeat(begin, last - begin + 1)) * 7
    gaps = np.add.reduceat((raw & 127).astype(np.uint64) << shift.astype(np.uint64), begin) if len(last) else np.array([], dtype=np.uint64)
    return np.cumsum(gaps).astype(np.int64) - 1


_BITMAPS = "term string, container bigint, bits binary, records bigint, uses bigint"


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of occurrences (container, place, term) that come sorted by container; those of a null term hold all records."""
    now: int | None = None
    held: list[pa.RecordBatch] = []
    done: dict[str | None, tuple[np.ndarray, int]] = {}  # of a container with very many occurrences: what was made of the earlier ones

    def sets() -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The terms of what is held, its distinct (term number, place) in order, and each term's uses."""
        rows = pa.Table.from_batches(held).combine_chunks()
        coded = pc.dictionary_encode(rows.column("term").combine_chunks())
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        terms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        uses = np.bincount(code, minlength=len(terms))
        place = rows.column("place").to_numpy(zero_copy_only=False)
        some = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(len(place), dtype=bool)
        place, code = place[some].astype(np.int64), code[some]
        # All records of the container: the union of its terms.
        every = np.unique(place)
        pairs = np.unique((code << CONTAINER) | place)
        number = np.concatenate((pairs >> CONTAINER, np.full(len(every), len(terms))))
        return [*terms, None], number, np.concatenate((pairs & ((1 << CONTAINER) - 1), every)), np.append(uses, 0)

    def merge() -> None:
        terms, number, place, uses = sets()
        cuts = np.searchsorted(number, np.arange(len(terms) + 1))
        for k, term in enumerate(terms):
            mine, n = place[cuts[k] : cuts[k + 1]], int(uses[k])
            if term in done:
                mine, n = np.union1d(done[term][0], mine), n + done[term][1]
            done[term] = (mine, n)
        held.clear()

    def send() -> pa.RecordBatch:
        if done:
            if held:
                merge()
            terms, uses = list(done), np.array([n for _, n in done.values()])
            number = np.repeat(np.arange(len(terms)), [len(p) for p, _ in done.values()])
            place = np.concatenate([p for p, _ in done.values()])
            done.clear()
        else:
            terms, number, place, uses = sets()
            held.clear()
        raw, offsets = encoded(number, place, len(terms))
        bits = pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        # The cardinality is read from the container: as many bits are set as there are gaps, each of which ends in one byte below 128.
        ones = np.concatenate(([0], np.cumsum(raw < 128)))
        records = ones[offsets[1:]] - ones[offsets[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([now] * len(terms), pa.int64()), bits, pa.array(records, pa.int64()), pa.array(uses, pa.int64())], ["term", "container", "bits", "records", "uses"])

    for batch in batches:
        keys = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(borders, borders[1:]):
            if a == b:
                continue
            key = batch.column(0)[a].as_py()
            if held or done:
                if key != now:
                    yield send()
            now = key
            held.append(batch.slice(a, b - a))
            if sum(h.num_rows for h in held) > HELD:
                merge()
    if held or done:
        yield send()


def term_bitmaps(df: DataFrame, record: str, terms: Column) -> DataFrame:
    """The vertical layout: (term, container, bits, records, uses), one row per term and container of 2^20 record identifiers.

    ``terms`` is an array of the record's terms. ``bits`` is the compressed bitmap of the records that have the term: the gaps between its set bits,
    seven bits to a byte (``decoded`` reads it); ``records`` is its cardinality, and ``uses`` counts occurrences alongside, repeats included. The row of a
    null term is the union over all terms. Records are dealt by container, so that a record's repeats and all of a container's postings meet
    in one task and are merged by union there; what is shuffled are the records themselves, once, and never a term's postings. A container
    bounds what a task holds of a term however many records have it, and its occurrences are merged into sets as they come. Null or empty terms are
    left out; the record identifier is an integer of any sign; records without one are counted in ``uses`` of the container null, with no bit.
    """
    kept = F.filter(terms, lambda t: t.isNotNull() & (t != ""))
    rows = df.select(F.col(record).cast("bigint").alias("__r"), kept.alias("__t")).where(F.size("__t") > 0)
    rows = rows.withColumn("container", F.shiftright("__r", CONTAINER)).repartition("container").sortWithinPartitions("container")
    each = rows.select("container", F.expr(f"__r & {(1 << CONTAINER) - 1}L").alias("place"), F.explode("__t").alias("term"))
    return each.mapInArrow(_containers, _BITMAPS)


def term_frequencies(bitmaps: DataFrame) -> DataFrame:
    """(term, uses, records) from the bitmaps: document frequency is the cardinality summed over a term's containers. The row of a
    null term has the records with any term."""
    return bitmaps.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, record: str, terms: Column, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """(term, uses, records, mark): ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the share ``common_above``
    of the records that have a term, else null.

    A term that is both is rare. The number of records with a term is the cardinality of the union of all bitmaps, one row.
    """
    counted = written(term_frequencies(term_bitmaps(df, record, terms)), "terms")
    total = counted.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("__n"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("__n") * F.lit(common_above), "common")
    return counted.where("term is not null").join(F.broadcast(total)).select("term", "uses", "records", mark.alias("mark"))
