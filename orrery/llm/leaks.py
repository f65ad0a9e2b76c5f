"""Evaluation texts leaking into training text (problem 9)."""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of test text in one search table, and tables that one scan of the corpus goes through; more test items take further scans.
BLOCK_CHARS, TABLES = 4_000_000, 8

#: Invisible characters, with a line break after a soft hyphen.
_INVISIBLE = re.compile("­[ \t\r]*\n[\\s>]*|[­​-‍⁠﻿]")
#: Where a word may be broken at a line's end, over quotation marks of a mail if there are any.
_BREAK = re.compile("[-‐‑][ \t\r]*\n[\\s>|]*")
_WORD = re.compile(r"[^\W_]+")
_PIECES = re.compile(rf"[^\W_]+(?:{_BREAK.pattern}[^\W_]+)*")


def pieces(text: str | None) -> tuple[list[str], list[int]]:
    """The running pieces of a text, runs of letters or digits without case and typography, and the numbers of those that a hyphen at
    a line's end divides from the piece before: such a word is whole or two, and either reading counts. Null gives none."""
    if not text:
        return [], []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    text = text.casefold()
    if "\n" not in text or not _BREAK.search(text):
        return _WORD.findall(text), []
    out, glued = [], []
    for m in _PIECES.finditer(text):
        parts = _BREAK.split(m[0])
        glued += range(len(out) + 1, len(out) + len(parts))
        out += parts
    return out, glued


def words(text: str | None) -> list[str]:
    """The running words of a text, those broken at a line's end put together."""
    out, glued = pieces(text)
    for k in reversed(glued):
        out[k - 1 : k + 1] = ["".join(out[k - 1 : k + 1])]
    return out


class WuManber:
    """Multi-pattern search over words: all runs of ``m`` words of the test items, in every reading, are the patterns.

    A block is two words. ``shift`` has, for a block, how far the window may move on when the block stands at its end; blocks
    that no pattern holds allow m - 1, a word that no item holds allows m. Where the shift is 0, the block selects a bucket of
    patterns, and the window is compared with them directly.
    """

    def __init__(self, items: list[tuple[int, str]], m: int):
        self.m, self.vocabulary, self.shift, self.buckets = m, {}, {}, {}
        self.flat = array("I")  # the items' words, one item after another; a bucket holds (beginning, item)
        for item, text in items:
            parts, glued = pieces(text)
            ids = [self._number(w) for w in parts]
            base = len(self.flat)
            self.flat.extend(ids)
            for at in range(len(ids) - m + 1):
                self._add(ids[at : at + m], base + at, item)
            for run in self._joined(parts, glued, glued, lambda word, before: self._number(word)):
                self.flat.extend(run)
                self._add(run, len(self.flat) - m, item)

    def _number(self, word: str) -> int:
        return self.vocabulary.setdefault(word, len(self.vocabulary) + 1)

    def _add(self, run: list[int], begin: int, item: int) -> None:
        far = self.m - 1
        for k in range(1, self.m):
            block = (run[k - 1] << 32) | run[k]
            self.shift[block] = min(self.shift.get(block, far), far - k)
        self.buckets.setdefault((run[-2] << 32) | run[-1], []).append((begin, item))

    def _joined(self, parts: list[str], glued: list[int], near: list[int], number) -> Iterator[list[int]]:
        """The runs of m words with at least one broken word put together, if one of ``near``; ``number`` gives a word's number after
        another, or 0 to give up."""
        m, glue = self.m, set(glued)

        def walk(at: int, run: list[int], joined: bool) -> Iterator[list[int]]:
            if len(run) == m:
                if joined:
                    yield list(run)
                return
            word = ""
            for to in range(at, len(parts)):
                if to > at and to not in glue:
                    break
                word += parts[to]
                if n := number(word, run[-1] if run else 0):
                    run.append(n)
                    yield from walk(to + 1, run, joined or to > at)
                    run.pop()

        begins = set()
        for k in near:
            low, left = k - 1, m - 1
            # m - 1 words before a broken one take more pieces where some of them are broken themselves.
            while low > 0 and left:
                low -= 1
                left -= low not in glue
            begins.update(range(low, k))
        for at in sorted(begins):
            yield from walk(at, [], False)

    def _follows(self, word: str, before: int) -> int:
        """The number of a word that may stand after another in some pattern, else 0."""
        n = self.vocabulary.get(word, 0)
        return n if n and (not before or (before << 32) | n in self.shift) else 0

    def _items(self, run: list[int]) -> Iterator[int]:
        window = array("I", run)
        for begin, item in self.buckets.get((run[-2] << 32) | run[-1], ()):
            if self.flat[begin : begin + self.m] == window:
                yield item

    def search(self, parts: list[str], glued: list[int]) -> set[int]:
        """The items of which a text, given by its pieces, has m running words in some reading."""
        m, get, shift, found = self.m, self.vocabulary.get, self.shift, set()
        ids = [get(w, 0) for w in parts]
        at, end, far = m - 1, len(ids), m - 1
        while at < end:
            last = ids[at]
            if not last:
                at += m
                continue
            step = shift.get((ids[at - 1] << 32) | last, far)
            if step:
                at += step
                continue
            found.update(self._items(ids[at - m + 1 : at + 1]))
            at += 1
        known = [k for k in glued if parts[k - 1] + parts[k] in self.vocabulary or k - 1 in glued or k + 1 in glued]
        for run in self._joined(parts, glued, known, self._follows):
            found.update(self._items(run))
        return found


#: Search tables of this worker process by broadcast, so that its tasks share them; those of one scan at most.
_TABLES: dict[str, WuManber] = {}


def _tables(sent: list, run: int) -> list[WuManber]:
    """The tables of blocks (key, broadcast), made where this process has none."""
    for old in _TABLES.keys() - {key for key, _ in sent}:
        del _TABLES[old]
    for key, block in sent:
        if key not in _TABLES:
            _TABLES[key] = WuManber(block.value, run)
    return [_TABLES[key] for key, _ in sent]


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", run: int = 13, block_chars: int = BLOCK_CHARS, tables: int = TABLES
) -> DataFrame:
    """Distinct (doc, item): the document has at least ``run`` running words of the item, in order.

    A word broken by a hyphen at a line's end, in document or item, is read whole and as two words, and either counts; so what is found of an
    item doesn't depend on which others are searched for. ``items`` has the columns item and text. Items of fewer words, null and empty texts
    give nothing; items of equal text are reported each. Identifiers are integers; a null document identifier is kept, items without identifier
    are left out. The test items travel to the executors in blocks of at most ``block_chars`` characters (or one item); a scan of the corpus goes through
    ``tables`` blocks at once, each of which a worker process makes a table of once, and what is beyond takes further scans: so what a worker
    holds is bounded however many items there are. No document moves. A test text is searched for whole.
    """

    def blocks() -> Iterator[list[tuple[int, str]]]:
        held, chars = [], 0
        for i, t in items.select(F.col(item).cast("bigint"), text).where(F.col(item).isNotNull() & (F.col(text) != "")).toLocalIterator():
            if held and chars + len(t) > block_chars:
                yield held
                held, chars = [], 0
            held.append((i, t))
            chars += len(t)
        yield held

    spark = documents.sparkSession
    rows = documents.select(F.col(doc).cast("bigint").alias("__d"), F.col(text).alias("__t")).where(F.length("__t") > 0)

    def scan(sent: list) -> DataFrame:
        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = [t.search for t in _tables(sent, run)]
            for batch in batches:
                hits = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts = pieces(t)
                    hits += [(d, i) for search in searches for i in sorted(search(*parts))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["__d", "__i"])

        return rows.mapInArrow(run_batches, "__d bigint, __i bigint")

    out, held = None, []
    for block in [*blocks(), None]:
        if block is not None:
            held.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
        if held and (block is None or len(held) == tables):
            part, held = scan(held), []
            out = part if out is None else out.unionByName(part)
    return out.select(F.col("__d").alias(doc), F.col("__i").alias(item)).distinct()
