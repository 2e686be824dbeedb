"""Links, levels and grids over the driver's tables: the same expressions for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrain.functions.geo import haversine

#: SQL of the observations; text of both engines.
OBS = """
SELECT CAST(user_id % 20 AS VARCHAR(9)) AS cml_id, CAST(event_id % 2 AS VARCHAR(9)) AS channel_id, event_id, ts AS time,
  CASE WHEN event_id % 17 <> 0 THEN -40 - value / 25 END AS rsl,
  CAST(15 + event_id % 3 AS DOUBLE) AS tsl,
  CASE WHEN event_id % 13 <> 0 THEN CASE WHEN value > 250 THEN 1.0E0 ELSE 0.0E0 END END AS wet,
  value
FROM events
"""
LINKS = """
SELECT CAST(i AS VARCHAR(9)) AS cml_id, 7 + 0.02E0 * (i % 5) AS site_a_lon, 50 + 0.02E0 * floor(i / 5.0E0) AS site_a_lat,
  7 + 0.02E0 * (i % 5) + 0.03E0 AS site_b_lon, 50 + 0.02E0 * floor(i / 5.0E0) + 0.01E0 AS site_b_lat,
  CAST(10 + i AS DOUBLE) AS frequency_ghz, CASE WHEN i % 2 = 0 THEN 'H' ELSE 'V' END AS polarization
FROM (SELECT {twenty} AS i)
"""
LINKS_DUCKDB = LINKS.format(twenty="unnest(range(20))")
SERIES = "PARTITION BY cml_id, channel_id ORDER BY time"


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, channel_id, event_id, time, rsl, tsl, wet, value."""
    return _sql(spark, sf_dir, OBS)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cml_id, coordinates, length_km, frequency_ghz, polarization."""
    out = spark.sql(LINKS.format(twenty="explode(sequence(0, 19))"))
    return out.withColumn("length_km", haversine(F.col("site_a_lon"), F.col("site_a_lat"), F.col("site_b_lon"), F.col("site_b_lat")))


def hours(column: str = "time"):
    """A time as hours since 1970."""
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 3600).cast("bigint")
