"""An inverted index over texts, and ranked search in it."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.search import TEXT_CAP, tokens

#: Parts of a stored index, by a checksum of the term: a search reads those of its words only.
PARTS = 64


def postings(rows: DataFrame, texts: list[str]) -> DataFrame:
    """(term, id, uses): how often each word stands in each row's texts; null texts have none. A row's words are counted where the row is."""
    words = F.array_sort(tokens(F.concat_ws(" ", *texts)))
    distinct = F.array_distinct(words)
    counted = F.transform(distinct, lambda w: F.struct(w.alias("term"), F.size(F.filter(words, lambda v: v == w)).cast("bigint").alias("uses")))
    return rows.select("id", F.inline(counted)).select("term", "id", "uses")


def write_index(found: DataFrame, path: str, parts: int = PARTS) -> None:
    """Postings in parts by term, sorted by term within, so that a search skips what its words aren't in. A term in very many rows is dealt to many files
    of its part by its rows' identifiers."""
    part = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(parts)).cast("int")
    rows = found.withColumn("part", part).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(8)))
    rows.repartition("part", "__salt").sortWithinPartitions("part", "term", "id").drop("__salt").write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, id, uses, part)."""
    return spark.read.parquet(path)


def words_of(typed: str) -> list[str]:
    """The distinct words of a typed query, sorted."""
    return sorted({t for t in re.split(r"[\W_]+", typed.lower()) if t})


def ranked(index: DataFrame, typed: str, rows: int, most: int = TEXT_CAP, parts: int = PARTS) -> DataFrame:
    """(id, relevance, o): rows with any typed word, the most relevant first, then by id; o is the place from 0.

    Relevance is the sum over words of their uses times the squared logarithm of ``rows`` over the number of rows with the word, so that rare words count
    more, and a word of every row nothing. Words that nothing holds, and queries without words, find nothing. Only the words' parts of the index are read.
    """
    wanted = words_of(typed)
    hit = index.where(F.col("term").isin(wanted))
    if "part" in index.columns:
        hit = hit.where(F.col("part").isin(sorted({zlib.crc32(w.encode()) % parts for w in wanted})))
    rarity: Column = F.pow(F.log10(F.lit(float(max(rows, 1))) / F.col("__df")), 2)
    weights = hit.groupBy("term").agg(F.count(F.lit(1)).alias("__df"))  # at most one row per typed word
    scored = hit.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(F.col("uses") * rarity).alias("relevance"))
    best = scored.orderBy(F.desc(F.round("relevance", 9)), "id").limit(most)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.round("relevance", 9)).alias("k"), "id", "relevance"))).alias("l"))  # at most ``most`` rows
    return listed.select(F.posexplode("l").alias("o", "x")).select("x.id", "x.relevance", F.col("o").cast("bigint").alias("o"))
