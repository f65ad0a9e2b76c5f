"""The citation graph: papers, references, and what is counted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.labels import keyword_slots
from orrery.operators.packed import CATEGORIES, unpacked
from orrery.sources.blobs import unpack_links
from orrery.sources.tables import current_rows, table

#: Frequencies are capped here, in a byte.
MOST_FREQ = 255
#: Categories that a paper may have, and that there may be at all; number 0 stands for unknown ones.
OWN_CATEGORIES, ALL_CATEGORIES = 4, 256
#: The configured filter of the metadata.
NOT_DELETED = "coalesce(lower(trim(status)), '') <> 'deleted'"


def papers(spark: SparkSession, folder: str, *columns: str, where: str = NOT_DELETED, extra: str = "") -> DataFrame:
    """The metadata's current rows that pass a configured filter: id and ``columns``.

    ``extra`` may hold a configured order and limit, as SQL text (``ORDER BY ... LIMIT ...``).
    """
    needed = [c for c in dict.fromkeys((*columns, *(["status"] if "status" in where else []))) if c != "id"]
    rows = current_rows(table(spark, folder, "meta_data", "id", *needed, "loadedat"), *needed).where(F.expr(where))
    if extra:
        rows = spark.sql(f"SELECT * FROM {{rows}} {extra}", rows=rows)
    return rows.select("id", *[c for c in columns if c != "id"])


def counts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """pcite's columns besides blobs, one row per paper (exact copies count once; of others the greatest is taken)."""
    rows = table(spark, folder, "pcite", "id", *columns)
    return rows.groupBy("id").agg(F.max(F.struct(*columns)).alias("m")).select("id", "m.*")


def blob_links(spark: SparkSession, folder: str, blob: str = "refs") -> DataFrame:
    """(id, slot, other, ord, freq, ncites): the decoded blobs, exact copies of rows once.

    Copies are dropped while links are packed, when a link is ten bytes of shuffle rather than a row.
    """
    return unpack_links(table(spark, folder, "pcite", "id", blob).dropDuplicates(["id", blob]), "id", blob)


def edges(decoded: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, ord, freq, ncites) of the references from and to known papers (id); not to itself, frequencies capped at 255.

    Repeated references stay, each with its order.
    """
    ids = known.select("id")
    rows = decoded.select(F.col("id").alias("src"), F.col("other").alias("dst"), "ord", F.least("freq", F.lit(MOST_FREQ)).cast("bigint").alias("freq"), "ncites").where("src <> dst")
    return rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def reverse(links: DataFrame) -> DataFrame:
    """The same links from the cited paper: (paper, citing, ord, freq)."""
    return links.select(F.col("dst").alias("paper"), F.col("src").alias("citing"), "ord", "freq")


def citation_counts(links: DataFrame, known: DataFrame, only_frequent: bool = False) -> DataFrame:
    """(id, cites) of every known paper; repeated references count each. ``only_frequent`` leaves out links of frequency 0 (those that
    are no references)."""
    cited = (links.where("freq > 0") if only_frequent else links).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("cites"))
    return known.select("id").join(cited, "id", "left").select("id", F.coalesce("cites", F.lit(0)).cast("bigint").alias("cites"))


def external_cites(links: DataFrame) -> DataFrame:
    """(id, cites): the citation count that the references to a paper carry; of several the one of the last referring paper."""
    return links.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("src", "ord", "ncites"))["ncites"].alias("cites"))


def category_dictionary(categories: DataFrame, name: str = "maincat", most: int = ALL_CATEGORIES) -> DataFrame:
    """(cat, number): the first ``most`` - 1 distinct names numbered from 1 in order; bounded, so it may be broadcast."""
    names = categories.select(F.lower(F.trim(name)).alias("cat")).where("cat <> ''").distinct()
    top = names.orderBy("cat").limit(most - 1)
    return top.select("cat", F.row_number().over(Window.orderBy("cat")).cast("bigint").alias("number"))


def known_categories(rows: DataFrame, dictionary: DataFrame, packed: str = "allcats", most: int = OWN_CATEGORIES) -> DataFrame:
    """rows with ``cats``: the numbers of the first ``most`` known categories of the packed list, in its order, padded with 0.

    The dictionary has at most 256 rows and becomes one array, so no list is torn apart and grouped again.
    """
    all_names = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("cat", "number"))).alias("__names"))
    listed = F.transform(F.coalesce(unpacked(F.col(packed), CATEGORIES), F.array().cast("array<struct<val:string,err:boolean>>")), lambda x: F.try_element_at(F.col("__names"), F.lower(x["val"])))
    first = F.slice(F.filter(listed, lambda n: n.isNotNull()), 1, most)
    return rows.join(F.broadcast(all_names)).withColumn("cats", F.concat(first, F.slice(F.array_repeat(F.lit(0).cast("bigint"), most), 1, F.lit(most) - F.size(first)))).drop("__names")


def keyword_rows(rows: DataFrame, column: str = "keywords") -> DataFrame:
    """(id, slot, keyword) of the first five slots that aren't empty."""
    return rows.select("id", F.posexplode(keyword_slots(F.col(column))).alias("slot", "keyword"))


def _ranged(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``__p``, the range of a whole-number key they lie in: as many ranges as shuffle partitions (64 at least), about equally full."""
    parts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts).alias("cuts"))
    cuts = cuts.select(F.coalesce("cuts", F.array().cast("array<bigint>")).cast("array<bigint>").alias("__cuts"))
    return rows.join(F.broadcast(cuts)).withColumn("__p", F.size(F.filter("__cuts", lambda c: c < F.col(key)))).drop("__cuts")


def indexed(rows: DataFrame, key: str = "id", name: str = "idx") -> DataFrame:
    """rows with their place (from 0) in the order of a unique key of whole numbers, without gathering them in one task.

    Rows are dealt into ranges of the key; ranks within a range are shifted by the number of rows in the ranges before.
    """
    ranged = _ranged(rows, key)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row per range
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return ranged.withColumn("__k", rank).join(F.broadcast(before), "__p").withColumn(name, (F.col("__k") + F.col("__before") - 1).cast("bigint")).drop("__p", "__k", "__before")


def least_before(rows: DataFrame, group: str, key: str, value: str, name: str) -> DataFrame:
    """rows with the least ``value`` of the rows of their group with a smaller ``key``; null if there is none. Ranges of the key are worked on apart."""
    ranged = _ranged(rows, key)
    firm = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(group, "__p").agg(F.min(value).alias("__m")).select(group, "__p", F.min("__m").over(firm).alias("__before"))  # one row per range
    near = Window.partitionBy(group, "__p").orderBy(key).rangeBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("__near", F.min(value).over(near)).join(before, [group, "__p"]).withColumn(name, F.least("__near", "__before")).drop("__p", "__near", "__before")


def best_by(rows: DataFrame, key: list[str], score: str, tie: str, value: str, name: str) -> DataFrame:
    """(key..., name): the value of each key's greatest score, ties to the smaller ``tie``."""
    return rows.groupBy(*key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), F.col(value).alias("v")))["v"].alias(name))


def sliding_windows(id_: Column, start: int, stop: int, width: int, step: int) -> Column:
    """Array of the begins of the windows (begin to begin + width, both included) that hold an identifier, for windows that begin at start,
    start + step, ... up to stop, but not in a month after the twelfth. By arithmetic: a row meets width / step windows, not all."""
    low = F.greatest(F.ceil((id_ - width - start) / F.lit(step)), F.lit(0))
    high = F.least(F.floor((id_ - start) / F.lit(step)), F.lit((stop - start) // step))
    begins = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.lit(start).cast("bigint") + k * step)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(begins, lambda b: F.floor((b % 10_000_000) / 625_000) < 12)
