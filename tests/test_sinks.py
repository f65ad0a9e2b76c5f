from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery import sinks
from orrery.operators.serving import explain_paper
from orrery.sources.statements import single_row, statement
from tests.conftest import rows_of


def test_positions(spark, tmp_path):
    (tmp_path / "l.json").write_text("[[1,2,3,4],[2,5,6,7]]")
    old = sinks.save_table(spark.createDataFrame([(1, 0, 0, 0), (9, 1, 1, 1)], "id bigint, x int, y int, r int"), str(tmp_path), "map", "a1")
    sinks.load_layout_into_table(spark, str(tmp_path / "l.json"), old, str(tmp_path / "new"))
    assert rows_of(spark.read.parquet(str(tmp_path / "new"))) == [(1, 4, 2, 3), (2, 7, 5, 6), (9, 1, 1, 1)]
    sinks.load_layout_into_table(spark, str(tmp_path / "l.json"), "", str(tmp_path / "fresh"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 2
    with pytest.raises(ValueError):
        sinks.save_table(spark.range(1), str(tmp_path), "map", "../x")


def test_files(spark, tmp_path):
    zones = spark.createDataFrame([(0, 1, 1, "a"), (1, 2, 1, "b")], "depth int, xi int, yi int, json string")
    sinks.write_zone_files(zones, str(tmp_path / "z"))
    assert spark.read.text(str(tmp_path / "z")).where("depth = 1 and xi = 2").first()["value"] == "b"
    drawn = spark.createDataFrame([(0, 1, 1, 7, 1.0)], "depth int, xi int, yi int, id bigint, pr double")
    sinks.write_tiles(drawn, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.write_index(spark.createDataFrame([("{}",)], "json string"), str(tmp_path / "i"))
    assert spark.read.text(str(tmp_path / "i")).first()[0] == "{}"


def test_shared_links(spark):
    links = spark.createDataFrame([("c", "k", "s")], "code string, modkey string, state string")
    new = spark.createDataFrame([("c", "k", "t"), ("d", "m", "u")], "code string, modkey string, state string")
    assert rows_of(sinks.save_shared(links, new)) == [("c", "k", "t"), ("d", "m", "u")]
    assert rows_of(sinks.save_shared(links, new.withColumn("modkey", F.lit("no")).where("code = 'c'"))) == [("c", "k", "s")]
    assert sinks.load_shared(links, "k").first()["state"] == "s" and sinks.load_shared(links, "x").count() == 0


def test_statements(spark):
    t = spark.range(5)
    assert [r[0] for r in statement(spark, "SELECT id FROM {t} WHERE id > ? AND id < ?", 1, 3, t=t).collect()] == [2]
    assert single_row(t) is None and single_row(t.where("id = 1"))[0] == 1 and single_row(t.limit(0)) is None


def test_explain(spark):
    papers = spark.createDataFrame([(1, "T", "A"), (2, "U", "B")], "id bigint, title string, authors string")
    links = spark.createDataFrame([(1, 2, 5), (2, 1, 6)], "src bigint, dst bigint, ord bigint")
    assert sorted(r["role"] for r in explain_paper(papers, links, 1).collect()) == ["citation", "paper", "reference"]
