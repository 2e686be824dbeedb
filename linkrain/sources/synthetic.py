"""Seeded example networks in place of data files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrain.functions.geo import haversine


def example_links(spark: SparkSession, n: int = 75, seed: int = 1) -> DataFrame:
    """links (cml_id, site coordinates, length_km, frequency_ghz, polarization)."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    out = spark.range(n).withColumns({"cml_id": F.col("id").cast("string"), "site_a_lon": 7 + u("lon") * 2, "site_a_lat": 50 + u("lat") * 2})
    out = out.withColumns({"site_b_lon": F.col("site_a_lon") + (u("dx") - 0.5) * 0.2, "site_b_lat": F.col("site_a_lat") + (u("dy") - 0.5) * 0.2})
    out = out.withColumn("length_km", haversine(F.col("site_a_lon"), F.col("site_a_lat"), F.col("site_b_lon"), F.col("site_b_lat")))
    return out.withColumns({"frequency_ghz": F.round(10 + u("f") * 28, 2), "polarization": F.when(u("p") < 0.5, "H").otherwise("V")}).drop("id")


def example_observations(spark: SparkSession, links: int = 75, days: float = 10, step_seconds: int = 60, seed: int = 1) -> DataFrame:
    """obs (cml_id, channel_id, time, time_ns, tsl, rsl): a dry level, noise, showers of attenuation, sentinels and gaps."""
    rows = int(days * 86400 / step_seconds)
    ids = spark.range(links * 2 * rows)
    t, link = F.floor(F.col("id") / (links * 2)), F.floor((F.col("id") % (links * 2)) / 2)
    df = ids.select(link.cast("string").alias("cml_id"), F.concat(F.lit("channel_"), (F.col("id") % 2 + 1).cast("string")).alias("channel_id"), t.alias("t"))
    u = lambda *what: F.pmod(F.xxhash64(*what, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    shower = F.floor(F.col("t") / 90)
    rain = F.when(u("cml_id", shower) < 0.15, 12 * F.sin(F.pi() * (F.col("t") % 90) / 90) * u(shower)).otherwise(0.0)
    level = -45 - 10 * u("cml_id") - rain + (u("cml_id", "channel_id", "t") - 0.5) * 0.4
    df = df.withColumns({"tsl": F.when(u("cml_id", "t", F.lit("s")) < 0.001, 255.0).otherwise(15.0), "rsl": F.when(u("cml_id", "channel_id", "t", F.lit("g")) < 0.003, -99.9).otherwise(F.round(level, 1))})
    seconds = 1_704_067_200 + F.col("t") * step_seconds
    return df.select("cml_id", "channel_id", F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("time"), (seconds * 1_000_000_000).alias("time_ns"), "tsl", "rsl")


def one_link(spark: SparkSession, **how) -> DataFrame:
    return example_observations(spark, links=1, **how)


def min_max(spark: SparkSession, links: int = 75, days: float = 10, seed: int = 1) -> DataFrame:
    """Levels of 15 minutes: tx_min, tx_max, rx_min, rx_max."""
    obs = example_observations(spark, links, days, seed=seed).where("tsl < 100 and rsl > -99")
    bins = obs.groupBy("cml_id", "channel_id", F.window(F.col("time").cast("timestamp"), "15 minutes").alias("w"))
    out = bins.agg(*(f("tsl" if s == "tx" else "rsl").alias(f"{s}_{n}") for s in ("tx", "rx") for n, f in (("min", F.min), ("max", F.max))))
    return out.select("cml_id", "channel_id", F.col("w.start").cast("timestamp_ntz").alias("time"), "tx_min", "tx_max", "rx_min", "rx_max")
