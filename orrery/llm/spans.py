"""Long exact spans shared between records (problem 10).

A span of ``span`` characters holds ``reach`` + 1 = span - gram + 1 runs of ``gram`` characters (grams). Of every such window, the gram
of the least hash is an anchor. The choice depends on the window's characters alone, so two records that share a span
share an anchor at the same place of it. Anchors are about 2 / (reach + 2) of all positions, and nothing else is sent:

1. Each task sketches its anchors (count-min: a few rows of counters, of which only none, one and more are told apart); the sketches
   are merged into one bit per counter: occupied by two or more records. They overestimate, so no repeated anchor is lost.
2. A second scan sends those anchors whose counters are all occupied, with the characters around them, and they are grouped
   exactly. In a group, two anchors whose common surroundings make up a whole span prove the span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import written

#: Places that an anchor can have in a span, less one. Larger: fewer anchors, shorter grams.
REACH = 63
#: log2 of the counters in a row of the sketch, and the rows. What is broadcast has ROWS * 2^WIDTH / 8 bytes (16 MB), whatever the data.
WIDTH, ROWS = 26, 2
#: Counters that are merged, and sent, together.
SEGMENT = 18
#: Characters hashed at once; longer texts are cut into slices that overlap by a span less one.
SLICE = 1 << 20
#: Anchors that a task holds before it sends its sketch on and begins a new one.
HELD = 4_000_000
#: Rows of a group that are compared with one another in one piece.
CELL = 512
#: log2 of the bits of the set of copies that is broadcast (16 MB), and the tasks that build it.
COPY_BITS, COPY_TASKS = 27, 16
#: Identifiers that this set may name by mistake and that are sent along (8 MB); for more, their texts are searched apart.
EXCEPTIONS = 1_000_000
#: Anchors of equal gram that one task holds, and rows that are numbered at once; beyond the first a group is dealt to tasks by document.
GROUP, BATCH = 65_536, 16_384
#: A stretch common to more texts than this is counted by sets of texts, not by pairs.
LARGE = 128

_BASE = 0x9E3779B97F4A7C15 | 5
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ROW_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of texts."""

    def __init__(self, span: int, reach: int):
        self.span, self.reach, self.gram = span, reach, span - reach
        n = SLICE + span
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def slices(self, texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
        """(text number, offset, slice) in lists of about SLICE characters."""
        held, chars = [], 0
        for k, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.span + 1), SLICE - self.span + 1):
                piece = text[at : at + SLICE] if len(text) > SLICE else text
                if held and chars + len(piece) > SLICE:
                    yield held
                    held, chars = [], 0
                held.append((k, at, piece))
                chars += len(piece)
        if held:
            yield held

    @staticmethod
    def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
        """op over every n consecutive values, by doubling."""
        have = 1
        while have < n:
            step = min(have, n - have)
            x = op(x[:-step], x[step:])
            have += step
        return x

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per list of slices: text numbers, positions and 64-bit hashes of the anchors, distinct by text and position."""
        for held in self.slices(texts):
            chars = np.frombuffer("".join(p for _, _, p in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            n = len(chars)
            if n < self.span:
                continue
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            grams = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
            order = ((grams ^ (grams >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = self._sliding(order, self.reach + 1, np.minimum)  # by the window's start: n - span + 1 of them
            ends = np.cumsum([len(p) for _, _, p in held])
            for end in ends[:-1]:
                least[max(0, end - self.span + 1) : end] = 0  # windows over the border of two texts
            padded = np.zeros(len(least) + 2 * self.reach, dtype=np.uint32)
            padded[self.reach : self.reach + len(least)] = least
            at = np.flatnonzero(self._sliding(padded, self.reach + 1, np.maximum) == order)
            piece = np.searchsorted(ends, at, side="right")
            number, offset, begin = (np.array(x, dtype=np.int64) for x in ([k for k, _, _ in held], [o for _, o, _ in held], ends - [len(p) for _, _, p in held]))
            yield number[piece], at - begin[piece] + offset[piece], grams[at]


def _counters(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(31))) * _ROW_MIX[row]
    return ((x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(64 - width)).astype(np.int64)


def _bits_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and mask of an identifier's two bits in the set of copies."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    at = np.stack((h >> np.uint64(64 - COPY_BITS), (h * _ROW_MIX[1]) >> np.uint64(64 - COPY_BITS))).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def copy_bits(copies: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds every identifier of copies(doc), and few others; built in the tasks, united on the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << COPY_BITS >> 3, dtype=np.uint8)
        some = False
        for batch in batches:
            if batch.num_rows:
                byte, mask = _bits_of(batch.column(0).to_numpy(zero_copy_only=False))
                np.bitwise_or.at(bits, byte.ravel(), mask.ravel())
                some = True
        if some:
            for part, piece in enumerate(np.split(bits, 64)):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pa.compress(piece.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << COPY_BITS >> 3, dtype=np.uint8)
    size = len(out) // 64
    # Few tasks, as each sends a whole set; only identifiers are moved.
    for part, bits in copies.select("doc").coalesce(COPY_TASKS).mapInArrow(build, "part bigint, bits binary").toLocalIterator():
        out[part * size : (part + 1) * size] |= np.frombuffer(pa.decompress(bytes(bits), size, codec="zstd", asbytes=True), dtype=np.uint8)
    return out


def _packed(bits: np.ndarray) -> tuple[bytes, int]:
    """What is broadcast of a set of bits: compressed, as it is sparse unless there is very much data."""
    return pa.compress(bits.tobytes(), codec="zstd", asbytes=True), bits.size


def _opened(packed: tuple[bytes, int]) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[0], packed[1], codec="zstd", asbytes=True), dtype=np.uint8)


def _skipped(sent) -> tuple[np.ndarray, np.ndarray] | None:
    """What a broadcast (packed bits, exceptions) says to pass over; None for none."""
    return None if sent is None else (_opened(sent.value[0]), sent.value[1])


def _suspect(docs: pa.Array, skip: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which documents to pass over: those in a set of bits, but for a sorted list of exceptions."""
    if skip is None:
        return np.zeros(len(docs), dtype=bool)
    bits, but = skip
    ids = docs.to_numpy(zero_copy_only=False)
    byte, mask = _bits_of(ids)
    found = ((bits[byte] & mask) != 0).all(axis=0)
    return found & ~np.isin(ids, but) if len(but) else found


def sketch(texts: list[tuple[DataFrame, Broadcast | None]], span: int, reach: int = REACH, width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """One bit per counter, (rows, 2^width / 8) bytes: set where two or more records, or a record in two slices, fell.

    texts: tables (__d, __t), each with a broadcast of those that it leaves out (``_skipped``), or None. Each task sends the occupied counters of its own anchors as sorted differences; a segment of counters is
    merged in one task as a stream, in memory of the segment's size. The driver gets the merged bits, whose size is fixed.
    """
    cut = min(SEGMENT, width)

    def built(skip):
        return lambda batches: build(batches, skip)

    def build(batches: Iterator[pa.RecordBatch], skip) -> Iterator[pa.RecordBatch]:
        find, held, n = Anchors(span, reach), [], 0
        left_out = _skipped(skip)

        def send() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            for row in range(rows):
                counters, times = np.unique(_counters(hashes, row, width), return_counts=True)
                borders = np.flatnonzero(np.diff(counters >> cut)) + 1
                out = []
                for c, t in zip(np.split(counters, borders), np.split(times, borders)):
                    low = (c & ((1 << cut) - 1)).astype(np.uint32)
                    code = np.diff(low, prepend=np.uint32(0)) * np.uint32(2) + (t > 1)
                    out.append((row, int(c[0] >> cut), pa.compress(code.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True), len(code)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.int32()))], ["row", "seg", "code", "n"])

        for batch in batches:
            for number, _, hashes in find(batch.column(1).filter(pa.array(~_suspect(batch.column(0), left_out))).to_pylist()):
                both = np.lexsort((hashes, number))
                fresh = np.concatenate(([True], (np.diff(hashes[both]) != 0) | (np.diff(number[both]) != 0)))[: len(both)]
                held.append(hashes[both][fresh])
                n += len(held[-1])
            if n > HELD:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done() -> pa.RecordBatch:
            bits = pa.compress(np.packbits(count > 1).tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], ["row", "seg", "bits"])

        for batch in batches:
            for row, seg, code, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now != (row, seg):
                    if now:
                        yield done()
                    now, count = (row, seg), np.zeros(1 << cut, dtype=np.uint8)
                x = np.frombuffer(pa.decompress(code, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
                at = np.cumsum(x >> np.uint32(1))
                count[at] = np.minimum(2, count[at] + 1 + (x & np.uint32(1))).astype(np.uint8)
        if now:
            yield done()

    parts = None
    for df, left_out in texts:
        part = df.mapInArrow(built(left_out), "row int, seg int, code binary, n int")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.repartition("row", "seg").sortWithinPartitions("row", "seg").mapInArrow(merge, "row int, seg int, bits binary")
    out = np.zeros((rows, 1 << width >> 3), dtype=np.uint8)
    size = 1 << cut >> 3
    for row, seg, bits in merged.toLocalIterator():
        out[row, seg * size : (seg + 1) * size] = np.frombuffer(pa.decompress(bytes(bits), size, codec="zstd", asbytes=True), dtype=np.uint8)
    return out


def repeated_anchors(texts: DataFrame, bits: np.ndarray, span: int, reach: int = REACH, width: int = WIDTH, every: bool = False, skip: Broadcast | None = None) -> DataFrame:
    """(gram, doc, at, before, after) of the anchors that the sketch has as repeated; gram is a 128-bit digest. ``skip``: what to
    leave out (``_skipped``).

    Anchors of equal surroundings are one row of their text: they prove the same. ``at`` is the first one's place, with ``every`` the
    list of all their places.
    """
    kind, schema = (pa.list_(pa.int64()), "array<bigint>") if every else (pa.int64(), "bigint")
    sent = texts.sparkSession.sparkContext.broadcast((_packed(bits), len(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table, left_out = Anchors(span, reach), _opened(sent.value[0]).reshape(sent.value[1], -1), _skipped(skip)
        gram, side = find.gram, reach + 1
        for batch in batches:
            batch = batch.filter(pa.array(~_suspect(batch.column(0), left_out)))
            docs, body = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, position, hashes in find(body):
                keep = np.ones(len(hashes), dtype=bool)
                for row in range(len(table)):
                    c = _counters(hashes, row, width)
                    keep &= (table[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                rows, seen, last = [], {}, -1
                for k, at in zip(number[keep].tolist(), position[keep].tolist()):
                    if k != last:
                        seen, last = {}, k
                    text = body[k]
                    around = text[max(0, at - side) : at + gram + side]
                    if (places := seen.get(key := (min(at, side), around))) is not None:
                        if every:
                            places.append(at)
                        continue
                    seen[key] = places = [at]
                    digest = hashlib.blake2b(text[at : at + gram].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((digest, docs[k], places if every else at, text[max(0, at - side) : at], text[at + gram : at + gram + side]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), kind, pa.string(), pa.string()))], ["gram", "doc", "at", "before", "after"])

    return texts.mapInArrow(run, f"gram binary, doc bigint, at {schema}, before string, after string")


def _cells(anchors: DataFrame, reach: int) -> DataFrame:
    """Groups of two and more anchors, in cells of bounded size: gram, key, x, y, block and the anchor's columns.

    A group of up to CELL rows is one cell. A larger one, as of a notice that many records carry, is first parted by whole spans: each anchor
    names the spans that hold it, by what stands before and after the gram (key: how much before, and both texts' digest), so that only
    records with a common span stay together and a notice shorter than a span costs no comparison. What is still larger is dealt into blocks
    by hash, and each two blocks make a cell: no task ever holds more than two blocks of a group.
    """
    counts = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    grouped = anchors.join(counts, "gram")
    columns = ["gram", "key", "lead", "doc", "at", "before", "after"]
    small = grouped.where(F.col("__n") <= CELL).withColumn("key", F.lit(None).cast("binary")).withColumn("lead", F.lit(-1)).select(*columns, "__n")
    lead = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda n: (n <= F.length("before")) & (reach - n <= F.length("after")))
    parted = grouped.where(F.col("__n") > CELL).drop("__n").withColumn("lead", F.explode(lead))
    around = F.concat(F.when(F.col("lead") > 0, F.right("before", F.col("lead"))).otherwise(""), F.lit("\x01"), F.substr("after", F.lit(1), F.lit(reach) - F.col("lead")))
    parted = parted.withColumn("key", F.unhex(F.md5(F.encode(around, "UTF-8")))).select(*columns)
    sizes = parted.groupBy("gram", "key", "lead").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    both = small.unionByName(parted.join(sizes, ["gram", "key", "lead"]).select(*columns, "__n"))
    dealt = both.withColumn("__blocks", F.ceil(F.col("__n") / CELL).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc", "at"), F.col("__blocks")).cast("int"))
    paired = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return paired.select("gram", "key", "lead", F.least("block", "__o").alias("x"), F.greatest("block", "__o").alias("y"), "block", "doc", "at", "before", "after")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of a with each row of b; 0 is the padding, equal to nothing."""
    same = (a[:, None, :] == b[None, :, :]) & (a[:, None, :] != 0)
    return np.where(same.all(axis=2), same.shape[2], same.argmin(axis=2))


def _codes(texts: list[str], side: int, backward: bool) -> np.ndarray:
    out = np.zeros((len(texts), side), dtype=np.uint32)
    for k, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[k, : len(c)] = (c[::-1] if backward else c) + 1
    return out


def _compare(reach: int):
    side = reach + 1

    def results(rows: list[tuple], lead: int) -> Iterator[tuple]:
        """rows: (block, doc, at, before, after) of one cell, for x == y all of one block; lead: what its rows share before the gram, or -1."""
        first = [r for r in rows if r[0] == rows[0][0]]
        second = [r for r in rows if r[0] != rows[0][0]]
        crossed = bool(second)
        # Rows of equal surroundings are compared once.
        kinds = {}
        for half, part in enumerate((first, second) if crossed else (first,)):
            for r in part:
                kinds.setdefault((r[3], r[4]), ([], []))[half].append(r[1])
        keys = list(kinds)
        if len(keys) == 1 and len(keys[0][0]) == side:
            return
        before, after = _codes([k[0] for k in keys], side, True), _codes([k[1] for k in keys], side, False)
        for begin in range(0, len(keys), 256):
            left = _common(before[begin : begin + 256], before)
            right = _common(after[begin : begin + 256], after)
            # Only where the stretch begins; further on it is found again.
            good = (left + right >= reach) & (left == lead if lead >= 0 else left <= reach)
            for i, j in zip(*np.nonzero(good)):
                a, b = kinds[keys[begin + i]], kinds[keys[j]]
                if crossed or i + begin <= j:
                    yield from ((min(p, q), max(p, q)) for p in a[0] for q in b[1 if crossed else 0] if p != q)

    return results


def _compared(anchors: DataFrame, reach: int) -> DataFrame:
    """(a, b) of the cells, each cell read as a stream of sorted rows. For results that are pairs: all others are made from groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results, now, rows = _compare(reach), None, []

        def sent(found: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        found: set = set()
        for batch in batches:
            for gram, key, lead, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (gram, key, lead, x, y):
                    if len(rows) > 1:
                        found.update(results(rows, now[2]))
                    now, rows = (gram, key, lead, x, y), []
                rows.append(row)
                if len(found) > 100_000:
                    yield sent(found)
                    found = set()
        if len(rows) > 1:
            found.update(results(rows, now[2]))
        if found:
            yield sent(found)

    cell = ["gram", "key", "lead", "x", "y"]
    cells = _cells(anchors, reach).repartition(*cell).sortWithinPartitions(*cell, "block")
    return cells.mapInArrow(run, "a bigint, b bigint")


def _ranks(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(rows, columns + 1): for each number of leading codes, a number that rows of one group share if, and only if, those codes are equal."""
    out = np.empty((len(codes), codes.shape[1] + 1), dtype=np.int64)
    now = np.unique(group, return_inverse=True)[1]
    out[:, 0] = now
    for k in range(codes.shape[1]):
        now = np.unique((now << 22) | codes[:, k].astype(np.int64), return_inverse=True)[1]
        out[:, k + 1] = now
    return out


def _members(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, signature) for each row: of the distinct documents among the rows of equal code; the signature is a sum of hashes."""
    order = np.lexsort((doc, code))
    c, d = code[order], doc[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
    begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    count = np.add.reduceat(new.astype(np.int64), begin)
    sign = np.add.reduceat(np.where(new, _signed(d), np.uint64(0)), begin)
    size = np.diff(np.append(begin, len(c)))
    counts, signs = np.empty(len(c), dtype=np.int64), np.empty(len(c), dtype=np.uint64)
    counts[order], signs[order] = np.repeat(count, size), np.repeat(sign, size)
    return counts, signs


def _signed(docs: np.ndarray) -> np.ndarray:
    h = (docs.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * _ROW_MIX[2]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shared_windows(anchors: DataFrame, reach: int, group: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """(doc, at, low, high, members, sign): the windows around anchors that stand in two or more documents.

    A window holds the gram with n of the span's other characters before it; ``low`` and ``high`` are a run of n for which the window stands in the
    same ``members`` documents; ``sign``, a sum of their hashes, tells that set from others. No two rows of a group are compared:
    for each n, rows are numbered by their n characters before and their reach - n after, and documents are counted by number, so that the work
    is in proportion to the rows, however many share a gram. A gram with more than ``group`` anchors is dealt to many tasks.
    """
    group, batch_rows = group or GROUP, batch_rows or BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def results(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            grams, docs = t.column("gram").to_pylist(), t.column("doc").to_numpy()
            number = np.cumsum([0] + [a != b for a, b in zip(grams, grams[1:])])
            before, after = [x[-reach:] for x in t.column("before").to_pylist()], [x[:reach] for x in t.column("after").to_pylist()]
            front = _ranks(_codes(before, reach, True), number)
            back = _ranks(_codes(after, reach, False), number)
            have_b, have_a = (np.array([len(x) for x in part]) for part in (before, after))
            counts = np.ones((len(docs), reach + 1), dtype=np.int64)
            signs = np.zeros((len(docs), reach + 1), dtype=np.uint64)
            for lead in range(reach + 1):
                some = np.flatnonzero((have_b >= lead) & (have_a >= reach - lead))
                if len(some) > 1:
                    c, s = _members((front[some, lead] << 32) | back[some, reach - lead], docs[some])
                    counts[some, lead], signs[some, lead] = c, s
            shared = counts > 1
            edge = np.zeros((len(docs), reach + 2), dtype=bool)
            edge[:, 0] = edge[:, -1] = True
            edge[:, 1:-1] = (counts[:, 1:] != counts[:, :-1]) | (signs[:, 1:] != signs[:, :-1]) | (shared[:, 1:] != shared[:, :-1])
            row, low = np.nonzero(edge[:, :-1] & shared)
            # The run goes up to the next edge of its row.
            flat = np.flatnonzero(edge.ravel())
            high = flat[np.searchsorted(flat, row * (reach + 2) + low, side="right")] - row * (reach + 2) - 1
            return pa.RecordBatch.from_arrays(
                [t.column("doc").combine_chunks().take(pa.array(row)), t.column("at").combine_chunks().take(pa.array(row)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(counts[row, low]), pa.array(signs[row, low].view(np.int64))],
                ["doc", "at", "low", "high", "members", "sign"],
            )

        for batch in batches:
            # Whole groups only: the last one of a batch may go on in the next.
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= batch_rows:
                rows = pa.Table.from_batches(held).combine_chunks()
                grams = rows.column("gram")
                last = grams[-1].as_py()
                k = n
                while k and grams[k - 1].as_py() == last:
                    k -= 1
                if k:
                    yield results(rows.slice(0, k).to_batches())
                held, n = rows.slice(k).to_batches(), n - k
        if n:
            yield results(held)

    counts = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"))
    grouped = anchors.join(counts.where("__n > 1"), "gram")
    columns = ["gram", "doc", "at", "before", "after"]
    kind = dict(anchors.dtypes)["at"]
    few = grouped.where(F.col("__n") <= group).select(*columns).repartition("gram").sortWithinPartitions("gram")
    out = few.mapInArrow(run, f"doc bigint, at {kind}, low int, high int, members bigint, sign bigint")
    if not counts.where(F.col("__n") > group).isEmpty():
        out = out.unionByName(_dealt_windows(grouped.where(F.col("__n") > group), reach, group))
    return out


def _dealt_windows(grouped: DataFrame, reach: int, group: int) -> DataFrame:
    """The same for grams with very many anchors (grouped: with their number __n): windows are named by a digest and counted within parts
    of a gram, dealt by document, then over the parts; a part's rows meet the totals of its own windows only, so no key is hot."""
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("__n") * 2 / group)).cast("int")
    lead = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda n: (n <= F.length("before")) & (reach - n <= F.length("after")))
    rows = grouped.select("gram", "doc", "at", "before", "after", part.alias("part"), F.explode(lead).alias("lead"))
    around = F.concat(F.when(F.col("lead") > 0, F.right("before", F.col("lead"))).otherwise(""), F.substr("after", F.lit(1), F.lit(reach) - F.col("lead")))
    rows = rows.select("doc", "at", "part", "lead", F.unhex(F.md5(F.concat(F.col("gram"), F.lit(b"|"), F.encode(around, "UTF-8"), F.lit(b"|"), F.col("lead").cast("string").cast("binary")))).alias("key"))
    rows = written(rows, "dealt")
    of_part = rows.select("key", "part", "doc").distinct().groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s"))
    of_part = written(of_part, "parts")
    total = of_part.groupBy("key").agg(F.sum("n").alias("members"), F.xxhash64(F.sum("s")).alias("sign")).where("members > 1")
    known = of_part.select("key", "part").join(total, "key")
    found = rows.join(known, ["key", "part"])
    return found.select("doc", "at", F.col("lead").alias("low"), F.col("lead").alias("high"), "members", "sign")


def exact_classes(documents: DataFrame, doc: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc, rep): of the documents whose text of ``least`` or more characters others have too, each with the smallest identifier
    of its class, except those identifiers themselves; and (doc) of all of that length. One digest per document is shuffled."""
    ids = written(documents.where(F.length(text) >= least).select(F.col(doc).cast("bigint").alias("doc"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("__h")), "digests")
    reps = ids.groupBy("__h").agg(F.min("doc").alias("rep"), F.max("doc").alias("__last")).where(F.col("rep") < F.col("__last")).select("__h", "rep")
    return written(ids.join(reps, "__h").where(F.col("doc") != F.col("rep")).select("doc", "rep").distinct(), "copies"), ids.select("doc")


def _anchored(documents: DataFrame, doc: str, text: str, span: int, reach: int, width: int, rows: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """The repeated anchors of one document per class of exact copies, and the other copies."""
    if not 0 < reach < span:
        raise ValueError("reach must lie between 0 and the span")
    kept = documents.where(F.col(doc).isNotNull() & (F.length(text) >= span))
    copies, ids = exact_classes(kept, doc, text, span)
    texts = kept.select(F.col(doc).cast("bigint").alias("__d"), F.col(text).alias("__t"))
    # Copies are passed over in the scan, by a bit set of fixed size, and no text is moved. What the set names by mistake are exceptions.
    none = np.array([], dtype=np.int64)
    bits = copy_bits(copies)
    send = lambda but: texts.sparkSession.sparkContext.broadcast((_packed(bits), but))
    sent = send(none)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = _skipped(sent)
        for batch in batches:
            yield batch.filter(pa.array(_suspect(batch.column(0), left_out)))

    parts: list[tuple[DataFrame, Broadcast | None]] = [(texts, None)]
    if bits.any():
        mistaken = written(ids.mapInArrow(named, "doc bigint").join(copies.select("doc"), "doc", "left_anti").distinct(), "mistaken")
        if mistaken.count() <= EXCEPTIONS:
            parts = [(texts, send(np.array(sorted(r[0] for r in mistaken.collect()), dtype=np.int64)))]
        else:  # very many: their texts go a way of their own
            parts = [(texts, sent), (texts.join(mistaken.withColumnRenamed("doc", "__d"), "__d", "left_semi"), None)]
    bits = sketch(parts, span, reach, width, rows)
    out = None
    for df, left_out in parts:
        part = repeated_anchors(df, bits, span, reach, width, every, left_out)
        out = part if out is None else out.unionByName(part)
    return written(out, "anchors"), copies


def shared_pairs(documents: DataFrame, doc: str = "doc_id", text: str = "text", span: int = 300, reach: int = REACH, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """Distinct (doca, docb), doca < docb: documents with a common stretch of at least ``span`` characters (code points).

    Null, empty and shorter texts share nothing; null identifiers are left out; repeated rows of one identifier are one
    document, and a stretch repeated inside one document makes no pair. Exact copies are searched for once, by their smallest
    identifier, and set in again at the end.
    """
    anchors, copies = _anchored(documents, doc, text, span, reach, width, rows)
    pairs = _compared(anchors, reach).distinct()
    members = copies.select("doc", "rep")
    a, b = members.select(F.col("doc").alias("__m"), F.col("rep").alias("a")), members.select(F.col("doc").alias("__k"), F.col("rep").alias("b"))
    wide = pairs.join(a, "a", "left").select("b", F.explode(F.array_compact(F.array("a", "__m"))).alias("a")).distinct()
    wide = wide.join(b, "b", "left").select("a", F.explode(F.array_compact(F.array("b", "__k"))).alias("b")).distinct()
    classes = members.unionByName(members.select(F.col("rep").alias("doc"), "rep").distinct())
    inside = classes.select(F.col("doc").alias("a"), "rep").join(classes.select(F.col("doc").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
    both = wide.unionByName(inside)
    return both.select(F.least("a", "b").alias("doca"), F.greatest("a", "b").alias("docb")).distinct()


def partners(sets: DataFrame, large: int | None = None) -> DataFrame:
    """(doc, links): with how many others each document stands in at least one common set; sets(doc, members, sign) distinct, a set of
    ``members`` documents named by (members, sign).

    Partners in sets of up to ``large`` members are listed, at most that many for each row. Of larger sets there are few, and documents that are in the
    same ones have the same partners there: these are counted per combination of large sets, and listed partners that a common large set
    has already are left out.
    """
    large = large or LARGE
    rows = sets.select("doc", F.xxhash64("members", "sign").alias("set"), "members")
    few = rows.where(F.col("members") <= large).select("doc", "set")
    listed = few.join(few.withColumnRenamed("doc", "other"), "set").where("doc <> other").select("doc", "other").distinct()
    many = rows.where(F.col("members") > large).groupBy("doc").agg(F.array_sort(F.collect_set("set")).alias("sets"))
    many = written(many.withColumn("kind", F.xxhash64("sets")), "large")
    kinds = many.groupBy("kind", "sets").agg(F.count(F.lit(1)).alias("n"))
    each = written(kinds.select("kind", "n", F.explode("sets").alias("set")), "kinds")
    met = each.select("kind", "set").join(each.select(F.col("kind").alias("other"), "n", "set"), "set").select("kind", "other", "n").distinct()
    wide = many.join(met.groupBy("kind").agg((F.sum("n") - 1).alias("__wide")), "kind").select("doc", "__wide")
    a = many.select("doc", F.col("sets").alias("__a"))
    b = many.select(F.col("doc").alias("other"), F.col("sets").alias("__b"))
    apart = listed.join(a, "doc", "left").join(b, "other", "left").where(~F.coalesce(F.arrays_overlap("__a", "__b"), F.lit(False)))
    near = apart.groupBy("doc").agg(F.count(F.lit(1)).alias("__near"))
    none = F.lit(0).cast("bigint")
    return near.join(wide, "doc", "full").select("doc", (F.coalesce("__near", none) + F.coalesce("__wide", none)).alias("links"))


def shared_classes(documents: DataFrame, doc: str = "doc_id", text: str = "text", span: int = 300, reach: int = REACH, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(doc, class, copies, links) of every document: the smallest identifier with the same text, how many have it, and with how many different
    texts it shares a span. The compact form of ``shared_pairs``, whose size doesn't grow with the copies of a text; made from the sets of texts
    that hold a stretch, not from pairs.

    Texts shorter than the span, null or empty are each a class of their own with one copy and no links; null identifiers are left out.
    """
    anchors, copies = _anchored(documents, doc, text, span, reach, width, rows)
    links = partners(written(shared_windows(anchors, reach).select("doc", "members", "sign").distinct(), "sets")).select(F.col("doc").alias("class"), "links")
    size = copies.groupBy(F.col("rep").alias("class")).agg((F.count(F.lit(1)) + 1).alias("copies"))
    ids = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("__d")).distinct()
    classes = ids.join(copies.select(F.col("doc").alias("__d"), "rep"), "__d", "left").select("__d", F.coalesce("rep", "__d").alias("class"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    out = classes.join(links, "class", "left").join(size, "class", "left")
    return out.select(F.col("__d").alias(doc), "class", F.coalesce("copies", one).alias("copies"), F.coalesce("links", none).alias("links"))


def shared_share(documents: DataFrame, doc: str = "doc_id", text: str = "text", span: int = 300, reach: int = REACH, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(doc, n_chars, spans, shared_chars, share) of every document: its stretches found in others too, and their share of its text.

    Stretches that touch or overlap count as one. A document without any, or with a null or empty text, has 0 and 0.0; exact
    copies have one stretch, the whole. A stretch that a document holds several times counts at each place.
    """
    anchors, copies = _anchored(documents, doc, text, span, reach, width, rows, every=True)
    windows = shared_windows(anchors, reach).select("doc", F.explode("at").alias("at"), "low", "high")
    found = windows.select("doc", (F.col("at") - F.col("high")).alias("begin"), (F.col("at") - F.col("low") + span).alias("stop")).distinct()
    lengths = documents.select(F.col(doc), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("begin", "stop"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("chars"), F.lit(-1).cast("bigint").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + (x["begin"] > s["to"]).cast("bigint")).alias("n"),
            (s["chars"] + F.greatest(F.lit(0).cast("bigint"), x["stop"] - F.greatest(x["begin"], s["to"]))).alias("chars"),
            F.greatest(s["to"], x["stop"]).alias("to"),
        ),
    )
    per_doc = found.groupBy(F.col("doc").alias("__d")).agg(joined.alias("j")).select("__d", F.col("j.n").alias("__n"), F.col("j.chars").alias("__c"))
    whole = copies.select("doc").unionByName(copies.select(F.col("rep").alias("doc"))).distinct().select(F.col("doc").alias("__w"), F.lit(True).alias("__whole"))
    out = lengths.join(per_doc, F.col(doc) == F.col("__d"), "left").join(whole, F.col(doc) == F.col("__w"), "left")
    none = F.lit(0).cast("bigint")
    chars = F.when(F.col("__whole"), F.col("n_chars")).otherwise(F.coalesce("__c", none))
    spans = F.when(F.col("__whole"), F.lit(1).cast("bigint")).otherwise(F.coalesce("__n", none))
    return out.select(doc, "n_chars", spans.alias("spans"), chars.alias("shared_chars")).withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
