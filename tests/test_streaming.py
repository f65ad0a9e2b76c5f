from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.streaming.increments import citations_by_day, monthly, run_to_end, table_stream, upsert_batches, upserted
from tests.conftest import SF, rows_of


def stream_of(spark, folder, rows, schema, per_file=3):
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], schema).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    return table_stream(spark, str(folder), "t")


def test_upsert_batches(spark, tmp_path):
    rows = [(k % 4, k, f"v{k}") for k in range(10)]
    query = upsert_batches(stream_of(spark, tmp_path, rows, "id bigint, version bigint, v string"), str(tmp_path / "out"), ["id"], "version", parts=3)
    query.awaitTermination()
    assert rows_of(upserted(spark, str(tmp_path / "out"), "id bigint, version bigint, v string")) == [(0, "v8", 8), (1, "v9", 9), (2, "v6", 6), (3, "v7", 7)]
    # What no list names any more is gone; the parts of the last two lists are there.
    assert len(list((tmp_path / "out").glob("orrery_batch=*/orrery_part=*"))) <= 2 * 3


def test_links_by_month(spark, tmp_path):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(k, day(k * 5)) for k in range(12)] + [(3, day(15)), (99, None)]
    out = monthly(run_to_end(citations_by_day(stream_of(spark, tmp_path, rows, "linkid bigint, seenat timestamp_ntz")), "links_by_month", ["day"]))
    assert rows_of(out.select(F.col("month").alias("a"), F.col("links").alias("b"))) == [("2020-01", 7), ("2020-02", 5)]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_whole_table(spark):
    out = run_to_end(citations_by_day(table_stream(spark, SF, "links")), "links_all", ["day"])
    want = spark.read.parquet(f"{SF}/links.parquet").where("seenat is not null").select("linkid", "seenat").distinct().count()
    assert out.agg(F.sum("links")).first()[0] == want


def test_nothing_to_read(spark, tmp_path):
    spark.createDataFrame([], "linkid bigint, seenat timestamp_ntz").write.parquet(f"{tmp_path}/t.parquet")
    days = run_to_end(citations_by_day(table_stream(spark, str(tmp_path), "t")), "nothing", ["day"])
    assert monthly(days).count() == 0
    assert upserted(spark, str(tmp_path / "none"), "id bigint").count() == 0
