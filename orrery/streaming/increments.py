"""Structured Streaming over arriving links and events: counts in event time, and the latest rows of a key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import scratch

#: Parts of a table that is kept up by ``upsert_batches``; a batch rewrites those that its keys fall into.
PARTS = 64


def table_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; the schema is that of the table."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}*")


def citations_by_day(links: DataFrame, lateness: str = "400 days") -> DataFrame:
    """(day, links): new links by the day they were seen on; links later than the watermark are dropped, and so is their state.

    Links without a time give no row. Deduplicated by their identifier and time within the watermark. ``monthly`` adds days up.
    """
    timed = links.where(F.col("seenat").isNotNull()).select("linkid", F.col("seenat").cast("timestamp").alias("seenat")).withWatermark("seenat", lateness)
    once = timed.dropDuplicates(["linkid", "seenat"])
    return once.groupBy(F.window("seenat", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("links")).select(F.col("w.start").alias("day"), "links")


def monthly(days: DataFrame) -> DataFrame:
    """(month, links) by calendar month, of the stored result of ``citations_by_day``."""
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("links").alias("links"))


def windowed_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events(ts, event_type, value) in tumbling windows."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Runs a stream of aggregates by ``key`` over what there is, and returns each key's last row.

    A batch writes the groups that it changed (update mode, so that the watermark lets go of old state) to files of its own, which
    a batch run again after a failure replaces; nothing comes to the driver.
    """
    spark = stream.sparkSession
    path = scratch(spark, f"stream-{name}")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    fs, target = _files(spark, f"{path}/rows")
    if not fs.exists(target):  # there was nothing to read
        return spark.createDataFrame([], stream.schema)
    values = [c for c in stream.columns if c not in key]
    kept = spark.read.schema(f"{', '.join(f'`{c}` {k}' for c, k in stream.dtypes)}, batch int").parquet(f"{path}/rows")
    return kept.groupBy(*key).agg(F.max(F.struct("batch", *values)).alias("__b")).select(*key, *[F.col(f"__b.{c}") for c in values])


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table of a schema that ``upsert_batches`` keeps at a path, as of its last batch; no rows if there has been none."""
    parts = _manifest(spark, path, None)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).parquet(*[f"{path}/orrery_batch={v}/orrery_part={p}" for p, v in sorted(parts.items())]).drop("orrery_batch", "orrery_part")


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """Which batch wrote each part, by the last list of parts there is, or the last of a batch below ``before``."""
    fs, target = _files(spark, f"{path}/lists")
    have = [int(f.getPath().getName()) for f in fs.listStatus(target)] if fs.exists(target) else []
    have = [n for n in have if before is None or n < before]
    if not have:
        return {}
    return {int(p): v for p, v in json.loads(spark.read.text(f"{path}/lists/{max(have)}", wholetext=True).first()[0]).items()}


def upsert_batches(stream: DataFrame, path: str, key: list[str], version: str, parts: int = PARTS):
    """Starts a stream whose every batch replaces a stored table's rows of equal key by those of greater version.

    The table lies in parts by a hash of the key, and a batch rewrites only those that it has rows for, beside the old ones; then it writes a list of
    the current parts, which is what readers follow (``upserted``). A batch run again after a failure goes by the list before its own and replaces what
    it wrote. Parts that neither the list nor the one before it names are dropped.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = _manifest(spark, path, number)
        rows = batch.withColumn("orrery_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
        rows = rows.persist()
        touched = sorted(r[0] for r in rows.select("orrery_part").distinct().collect())
        old = [f"{path}/orrery_batch={before[p]}/orrery_part={p}" for p in touched if p in before]
        names = [c for c in batch.columns if c not in key and c != version]
        both = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select(*rows.columns)) if old else rows
        best = both.groupBy("orrery_part", *key).agg(F.max(F.struct(version, *names)).alias("__b")).select("orrery_part", *key, "__b.*")
        best.select(*batch.columns, "orrery_part").write.mode("overwrite").partitionBy("orrery_part").parquet(f"{path}/orrery_batch={number}")
        rows.unpersist()
        now = before | {p: number for p in touched}
        spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists/{number}")
        earlier = _manifest(spark, path, number - 1) if number else {}
        for p, v in earlier.items():
            if before[p] != v:
                fs, target = _files(spark, f"{path}/orrery_batch={v}/orrery_part={p}")
                fs.delete(target, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
