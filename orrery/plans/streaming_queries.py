"""Queries that run a stream over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans.registry import Registry
from orrery.session import scratch
from orrery.streaming.increments import citations_by_day, monthly, run_to_end, table_stream, upsert_batches, upserted, windowed_counts

#: More files than a table has.
ALL = 1_000_000

R = Registry()
query = R.query


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", prelude=False)
def stream_event_windows(spark, folder):
    # What is there is one batch, so that rows of any age count whatever the order of the files.
    out = run_to_end(windowed_counts(table_stream(spark, folder, "events", ALL)), "stream_event_windows", ["start", "event_type"])
    return out.withColumn("total", F.round("total", 4))


@query("select strftime(seenat, '%Y-%m') as month, count(*)::bigint as links from (select distinct linkid, seenat from links where seenat is not null) group by 1", prelude=False)
def stream_citations_by_month(spark, folder):
    return monthly(run_to_end(citations_by_day(table_stream(spark, folder, "links", ALL)), "stream_citations_by_month", ["day"]))


@query("select id, nullif(max({'r': trendrun, 'l': loadedat, 's': coalesce(score, -1), 'n': coalesce(numcites, -1)})['n'], -1) as numcites from trending where loadedat is not null group by id", prelude=False)
def stream_latest_scores(spark, folder):
    """The last known number of citations of every trending paper, kept up by a stream of upserts."""
    path = scratch(spark, "latest")
    rows = table_stream(spark, folder, "trending", ALL).where("loadedat is not null")
    rows = rows.select("id", F.struct("trendrun", "loadedat", F.coalesce("score", F.lit(-1)).alias("s"), F.coalesce("numcites", F.lit(-1)).alias("n")).alias("version"), "numcites")
    upsert_batches(rows, path, ["id"], "version").awaitTermination()
    return upserted(spark, path, rows.schema).select("id", "numcites")


QUERIES, ORACLES = R.queries, R.oracles
