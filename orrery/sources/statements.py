"""SQL statements with parameters, single rows, and tables behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def statement(spark: SparkSession, sql: str, *parameters, **tables: DataFrame) -> DataFrame:
    """A statement with ``?`` for each parameter and ``{name}`` for each table; parameters are never pasted into its text."""
    return spark.sql(sql, args=list(parameters), **tables) if parameters else spark.sql(sql, **tables)


def single_row(df: DataFrame) -> Row | None:
    """The row of a result of exactly one; None for none or several."""
    rows = df.limit(2).collect()
    return rows[0] if len(rows) == 1 else None


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read by ranges of a key in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.options(lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()
