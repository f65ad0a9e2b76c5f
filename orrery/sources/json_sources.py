"""JSON and text sources: layouts, reference lists, other links, categories, regions, abstracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.labels import abstract_text

#: Colour and dimming of a category that names none; fixed values.
DEFAULT_COLOUR, DEFAULT_DIM = [0.7, 0.3, 0.6], [0.55, 0.48]


def _arrays(spark: SparkSession, path: str) -> DataFrame:
    """(value): the elements of a top-level array of arrays, as arrays of numbers, from one document or one element per line."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<array<double>>")).alias("v"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, r) of a layout ``[[id, x, y, r], ...]``; elements that are no quadruples are left out."""
    rows = _arrays(spark, path).where(F.size("v") == 4)
    return rows.select(F.col("v")[0].cast("bigint").alias("id"), *[F.col("v")[k + 1].cast("int").alias(n) for k, n in enumerate("xyr")])


def read_layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of one quadruple per line, which are split among tasks."""
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", r"^\s*\[?(\[.*?\])\]?,?\s*$", "$1"), "array<double>").alias("v")).where(F.size("v") == 4)
    return rows.select(F.col("v")[0].cast("bigint").alias("id"), *[F.col("v")[k + 1].cast("int").alias(n) for k, n in enumerate("xyr")])


def write_layout(layout: DataFrame, path: str) -> None:
    """A layout as text, one quadruple per line."""
    layout.select(F.to_json(F.array(*[F.col(c).cast("bigint") for c in ("id", "x", "y", "r")])).alias("value")).write.mode("overwrite").text(path)


def write_layout_links(links: DataFrame, path: str) -> None:
    """Links (src, dst, weight) as ``[src, [[dst, weight], ...]]``, one source per line, weights to six digits."""
    # Without the zeros at the end, which the JVM keeps.
    weight = F.regexp_replace(F.format_string("%.6g", "weight"), r"(?:(\.\d*?[1-9])|\.)0*(?=e|$)", "$1")
    item = F.struct("dst", F.concat(F.lit("["), F.col("dst"), F.lit(","), weight, F.lit("]")).alias("j"))
    rows = links.groupBy("src").agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = F.concat(F.lit("["), F.col("src"), F.lit(",["), F.array_join(F.transform("l", lambda s: s["j"]), ","), F.lit("]]"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def read_references(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Papers (id, allcats) and references (src, dst, freq) of ``[{"id", "allcats", "refs": [[dst, freq], ...]}, ...]``; with ``lines`` of
    objects one to a line, whose files are split among tasks."""
    rows = spark.read.schema("id bigint, allcats string, refs array<array<bigint>>").json(path, multiLine=not lines)
    refs = rows.select(F.col("id").alias("src"), F.explode("refs").alias("v")).where(F.size("v") >= 1)
    return rows.select("id", "allcats"), refs.select("src", F.col("v")[0].alias("dst"), F.coalesce(F.get("v", F.lit(1)), F.lit(1)).alias("freq"))


def read_other_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of weighted links in the form of references."""
    rows = spark.read.schema("id bigint, refs array<array<double>>").json(path, multiLine=True)
    links = rows.select(F.col("id").alias("src"), F.explode("refs").alias("v")).where(F.size("v") >= 2)
    return links.select("src", F.col("v")[0].cast("bigint").alias("dst"), F.col("v")[1].alias("weight"))


def merge_other_links(refs: DataFrame, other: DataFrame) -> DataFrame:
    """References with the weights of other links: (src, dst, freq, weight). A link that is no reference has frequency 0."""
    added = other.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    both = refs.select("src", "dst", "freq").join(added, ["src", "dst"], "full")
    return both.select("src", "dst", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(cat, col, dim, display) of a categories file; missing or short colours and dimming factors are the file's defaults."""
    schema = "default_col array<double>, default_dim_facs array<double>, cats array<struct<cat:string, col:array<double>, dim_facs:array<double>, display:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    col = F.when(F.size("default_col") == 3, F.col("default_col")).otherwise(F.array(*map(F.lit, DEFAULT_COLOUR)))
    dim = F.when(F.size("default_dim_facs") == 2, F.col("default_dim_facs")).otherwise(F.array(*map(F.lit, DEFAULT_DIM)))
    each = rows.select(col.alias("dc"), dim.alias("dd"), F.explode("cats").alias("c"))
    return each.select(
        F.col("c.cat").alias("cat"), F.when(F.size("c.col") == 3, F.col("c.col")).otherwise(F.col("dc")).alias("col"),
        F.when(F.size("c.dim_facs") == 2, F.col("c.dim_facs")).otherwise(F.col("dd")).alias("dim"), F.coalesce("c.display", F.lit("")).alias("display"),
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, radius, label) of a regions file; member names in any case."""
    rows = spark.read.option("multiLine", True).json(path)
    have = {c.lower(): c for c in rows.columns}
    kinds = {"x": "int", "y": "int", "radius": "int", "label": "string"}
    return rows.select(*[(F.col(have[n]) if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def read_abstracts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, abstract) of the XML files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", abstract_text(F.decode("content", "UTF-8")).alias("abstract"))
