"""Sinks: positions, tile and label files, the map's index, shared links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.labels import valid_suffix
from orrery.operators.user_state import upsert
from orrery.sources.json_sources import read_layout


def save_table(rows: DataFrame, folder: str, name: str, suffix: str = "") -> str:
    """Writes a table's new version beside the old one and returns its path; readers move on when they are told the path.

    Parquet folders can't be replaced in one step while they are read, and rows may come from the old version itself.
    """
    if suffix and not valid_suffix(suffix):
        raise ValueError(f"not a table suffix: {suffix!r}")
    path = f"{folder}/{name}{'_' + suffix if suffix else ''}.parquet"
    rows.write.mode("errorifexists").parquet(path)
    return path


def load_layout_into_table(spark: SparkSession, layout: str, table: str, target: str) -> None:
    """A layout file's positions put into a table of positions, which is made if there is none (``table`` empty); written to ``target``."""
    new = read_layout(spark, layout).groupBy("id").agg(F.max(F.struct("x", "y", "r")).alias("p")).select("id", "p.*")
    rows = upsert(spark.read.parquet(table).select("id", "x", "y", "r"), new, ["id"]) if table else new
    rows.write.mode("errorifexists").parquet(target)


def write_zone_files(zones: DataFrame, path: str) -> None:
    """Zone labels (depth, xi, yi, json) as compressed text in folders by depth and column."""
    rows = zones.select("depth", "xi", "yi", F.col("json").alias("value")).repartition("depth", "xi")
    rows.write.mode("overwrite").partitionBy("depth", "xi", "yi").option("compression", "gzip").text(path)


def write_tiles(drawn: DataFrame, path: str) -> None:
    """Draw lists by depth and column, the circles of a tile together, largest first."""
    rows = drawn.repartition("depth", "xi").sortWithinPartitions("depth", "xi", "yi", F.desc("pr"))
    rows.write.mode("overwrite").partitionBy("depth", "xi").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """The map's index, one line."""
    index.select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_shared(links: DataFrame, code: str) -> DataFrame:
    """The shared state of a code or of its modification key: at most one row."""
    return links.where((F.col("code") == code) | (F.col("modkey") == code)).orderBy("code").limit(1)


def save_shared(links: DataFrame, new: DataFrame) -> DataFrame:
    """Shared links (code, modkey, state) with new ones added, or replaced where the modification key is that of the code."""
    allowed = new.join(links.select("code", F.col("modkey").alias("__key")), "code", "left").where(F.col("__key").isNull() | (F.col("__key") == F.col("modkey"))).drop("__key")
    return upsert(links, allowed.select(*links.columns), ["code"])
