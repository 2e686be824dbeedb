"""Whole processing chains, as plans of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.functions.powerlaw import a_b, rain_rate
from linkrain.operators import baseline, nearby, timeseries, wetdry


def with_power_law(links: DataFrame) -> DataFrame:
    """Adds a and b, once for each sub-link."""
    a, b = a_b(F.col("frequency_ghz"), F.col("polarization"))
    return links.withColumns({"a": a, "b": b})


def levels_to_rain(obs: DataFrame, links: DataFrame, gap_seconds: float = 300, rows: int = 60, threshold: float = 0.8, n: int = 1, waa_max: float = 2.2, delta_t: float = 1.0, tau: float = 15.0) -> DataFrame:
    """rsl and tsl to trsl, wet, baseline, waa, att and rain (mm/h). All windows share one exchange by series."""
    df = timeseries.mask_sentinels(obs, tsl=F.col("tsl") < 255, rsl=F.col("rsl") > -99.9)
    df = df.withColumn("trsl", timeseries.total_loss(F.col("tsl"), F.col("rsl")))
    df = timeseries.interpolate(df, "trsl", gap_seconds)
    df = wetdry.rolling_std_wet(df, rows=rows, threshold=threshold)
    df = baseline.baseline_constant(df, n=n)
    df = baseline.waa_schleiss(df, waa_max=waa_max, delta_t=delta_t, tau=tau)
    df = df.withColumn("att", timeseries.clamp(F.col("trsl") - F.col("baseline") - F.col("waa")))
    df = df.join(with_power_law(links).select("cml_id", "length_km", "a", "b"), "cml_id")
    return df.withColumn("rain", rain_rate(F.col("att"), F.col("length_km"), a=F.col("a"), b=F.col("b"))).drop("a", "b")


def hourly_rain(rain: DataFrame, label: str = "right") -> DataFrame:
    return timeseries.resample(rain, "1 hour", {"rain": F.avg("rain")}, label=label, dense=False)


def nearby_levels_to_rain(levels: DataFrame, links: DataFrame, radius_km: float = 15, interval: int = 15, **how) -> DataFrame:
    """pmin and pmax of steps to wet, pref and rain by the nearby-link approach."""
    df = levels.join(with_power_law(links).select("cml_id", "length_km", "a", "b"), "cml_id")
    df = nearby.nearby_wetdry(df, links, radius_km, interval=interval, **how)
    df = baseline.reference_level(df, rows=int(24 * 60 / interval))
    low, high = nearby.corrected_levels(F.col("pmin"), F.col("pmax"), F.col("wet"), F.col("pref"))
    rain = nearby.nearby_rain(F.col("pref"), low, high, F.col("F"), F.col("length_km"), a=F.col("a"), b=F.col("b"))
    return df.withColumn("rain", rain).drop("a", "b")
