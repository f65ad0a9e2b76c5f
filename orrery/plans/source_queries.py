"""Queries that go through files as the map's programs exchange them: layouts, references, categories and links in JSON."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery.operators import citations as C
from orrery.operators import layout as L
from orrery.plans.catalog_queries import _DICT, _edges
from orrery.plans.graph_queries import _LINKS
from orrery.plans.registry import Registry
from orrery.session import scratch
from orrery.sources import json_sources as J
from orrery.sources.tables import table

R = Registry()
query = R.query


def _path(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


@query("select distinct id, x, y, r from map_data", prelude=False)
def json_layout(spark, folder):
    """A layout file written and read again, an element per line, so that files are split among tasks."""
    path = _path(spark, "layout")
    J.write_layout(table(spark, folder, "map_data").distinct(), path)
    return J.read_layout_lines(spark, path)


@query(_LINKS + " select '[' || src || ',[' || string_agg('[' || dst || ',' || printf('%.6g', weight::double) || ']', ',' order by dst) || ']]' as line from links1 group by src")
def json_links(spark, folder):
    path = _path(spark, "links")
    J.write_layout_links(L.layout_links(_edges(spark, folder)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(" select src, dst, freq from e")
def json_references(spark, folder):
    """References by way of a file of objects, one to a line."""
    path = _path(spark, "references")
    listed = _edges(spark, folder).groupBy("src").agg(F.collect_list(F.array("dst", "freq")).alias("refs"))
    rows = C.papers(spark, folder, "allcats").join(listed.withColumnRenamed("src", "id"), "id", "left")
    rows.select("id", "allcats", F.coalesce("refs", F.array().cast("array<array<bigint>>")).alias("refs")).write.json(path)
    return J.read_references(spark, path, lines=True)[1]


@query(f", {_DICT} select cat, case when number % 2 = 0 then 0.5 else 0.7 end as red, case when number % 3 = 0 then 0.25 else 0.55 end as dimmed, upper(cat) as display from d")
def json_categories(spark, folder):
    """Categories by way of their file; those that name no colour or too short a one have the file's."""
    path = _path(spark, "categories")
    rows = C.category_dictionary(C.papers(spark, folder, "maincat", where="true"))
    col = F.when(F.col("number") % 2 == 0, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.2))).otherwise(F.array(F.lit(0.9)))
    dim = F.when(F.col("number") % 3 == 0, F.array(F.lit(0.25), F.lit(0.5)))
    whole = rows.agg(F.collect_list(F.struct("cat", col.alias("col"), dim.alias("dim_facs"), F.upper("cat").alias("display"))).alias("cats"))  # at most 255 rows
    whole.write.json(path)
    return J.read_categories(spark, path).select("cat", F.col("col")[0].alias("red"), F.col("dim")[0].alias("dimmed"), "display")


QUERIES, ORACLES = R.queries, R.oracles
