"""Links and their neighbours: distances, nearby wet/dry classification, corrected levels, rain rates; min-max data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrain.functions.geo import EARTH_KM, haversine
from linkrain.functions.powerlaw import _coefficients
from linkrain.operators.timeseries import KEYS, series

_DISTANCES = {"aa": ("a", "a"), "ab": ("a", "b"), "ba": ("b", "a"), "bb": ("b", "b")}


def _pairs(left: DataFrame, right: DataFrame) -> dict[str, Column]:
    same = left.cml_id1 == right.cml_id2
    return {n: F.when(same, F.lit(0.0)).otherwise(haversine(left[f"site_{i}_lon1"], left[f"site_{i}_lat1"], right[f"site_{j}_lon2"], right[f"site_{j}_lat2"])) for n, (i, j) in _DISTANCES.items()}


def _sides(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = [f"site_{s}_{c}" for s in "ab" for c in ("lon", "lat")]
    return tuple(links.select(F.col("cml_id").alias(f"cml_id{n}"), *(F.col(c).alias(f"{c}{n}") for c in names)) for n in (1, 2))


def endpoint_distances(links: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Distances in km of all pairs of links: from a to a, a to b, b to a and b to b; 0 for a link and itself.

    It is the full matrix, as asked for; neighbours() finds near pairs without it.
    """
    left, right = _sides(links)[0], _sides(others if others is not None else links)[1]
    return left.join(right, F.lit(True)).select("cml_id1", "cml_id2", *(d.alias(n) for n, d in _pairs(left, right).items()))


def neighbours(links: DataFrame, radius_km: float) -> DataFrame:
    """Pairs (cml_id1, cml_id2), a link and itself included, whose four distances are all below radius_km.

    Sites a that near lie in the same or an adjacent cell of a grid at least as wide as the radius, so pairs
    meet by an equi-join on cells. Cells are bands of latitude, cut by longitude as wide as the radius needs
    at the band's end that is nearer to a pole.
    """
    lat_cell = math.degrees(radius_km / EARTH_KM) * 1.0000001
    bands = math.ceil(180 / lat_cell) + 2

    def width(band: Column) -> Column:
        edge = F.least(F.lit(89.9), F.greatest(F.abs(band * lat_cell - 90), F.abs((band + 1) * lat_cell - 90)) + lat_cell)
        return F.least(F.lit(360.0), lat_cell / F.cos(F.radians(edge)) * 1.0000001)

    left, right = _sides(links)
    cell = lambda lon, w: F.floor((lon + 180) / w)
    count = lambda w: F.greatest(F.lit(1), F.floor(F.lit(360.0) / w))
    own = F.floor((F.col("site_a_lat2") + 90) / lat_cell)
    right = right.withColumn("band", own).withColumn("x", F.pmod(cell(F.col("site_a_lon2"), F.lit(360.0) / count(width(own))), count(width(own))))
    left = left.withColumn("band", F.explode(F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("site_a_lat1") + 90) / lat_cell) + d), lambda b: b.between(-1, bands))))
    n = count(width(F.col("band")))
    left = left.withColumn("x", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("site_a_lon1"), F.lit(360.0) / n) + d, n)))))
    met = left.join(right, ["band", "x"])
    near = None
    for d in _pairs(left, right).values():
        near = d < radius_km if near is None else near & (d < radius_km)
    return met.where(near).select("cml_id1", "cml_id2")


def nearby_wetdry(df: DataFrame, links: DataFrame, radius_km: float = 15, thresh_median_p: float = -1.4, thresh_median_pl: float = -0.7, min_links: int = 3, interval: int = 15, timeperiod: int = 24, min_hours: float = 6, compat_edges: bool = True, time: str = "time") -> DataFrame:
    """Adds wet (1, 0 or null) and F to rows (cml_id, channel_id, time, pmin, length_km).

    The drop of a link below its highest level of the last timeperiod hours is compared with the medians of
    all links near it, itself included; more than min_links must be near and have values. F sums the excess
    of a link over the median of timeperiod * 4 rows. Steep wet steps make their surroundings wet;
    compat_edges also does so at the ends of a series, where there is no step to look at.
    """
    w = series(KEYS, time)
    period, needed = int(timeperiod * 60 / interval), int(min_hours * 60 / interval)
    frame = w.rowsBetween(1 - period, 0)
    df = df.withColumn("dp", F.col("pmin") - F.when(F.count("pmin").over(frame) >= needed, F.max("pmin").over(frame)))
    df = df.withColumn("dpl", F.col("dp") / F.col("length_km"))
    near = neighbours(links, radius_km)
    enough = near.groupBy("cml_id1").count().where(F.col("count") > min_links).select("cml_id1")
    near = near.join(enough, "cml_id1", "left_semi").withColumnRenamed("cml_id2", "cml_id")
    seen = df.select(*KEYS, time, "dp", "dpl").join(near, "cml_id").groupBy(F.col("cml_id1").alias("cml_id"), "channel_id", time)
    medians = seen.agg(F.count("dp").alias("n"), F.percentile("dp", F.lit(0.5)).alias("mp"), F.percentile("dpl", F.lit(0.5)).alias("mpl"))
    medians = medians.where(F.col("n") > min_links).drop("n")
    df = df.join(medians, [*KEYS, time], "left")
    df = df.withColumn("wet0", F.when(F.col("mp").isNotNull() & F.col("mpl").isNotNull(), ((F.col("mp") < thresh_median_p) & (F.col("mpl") < thresh_median_pl)).cast("double")))
    long = w.rowsBetween(1 - timeperiod * 4, 0)
    excess = F.col("dpl") - F.col("mpl")
    df = df.withColumn("F", F.when(F.count(excess).over(long) >= timeperiod * 4, F.sum(excess).over(long) * (interval / 60)))
    df = df.withColumn("__t", F.coalesce((F.col("wet0") == 1) & (F.col("dp") < -2), F.lit(False)))
    hit = F.col("__t")
    for step in (F.lag("__t", 1), F.lead("__t", 1), F.lead("__t", 2)):
        hit = hit | F.coalesce(step.over(w), F.lit(compat_edges))
    wet = F.when(F.col("wet0").isNotNull(), F.when(hit, F.lit(1.0)).otherwise(F.col("wet0")))
    return df.withColumn("wet", wet).drop("dp", "dpl", "mp", "mpl", "wet0", "__t")


def corrected_levels(pmin: Column, pmax: Column, wet: Column, pref: Column) -> tuple[Column, Column]:
    """Levels of wet steps below the reference level, the reference level otherwise and where a condition has a null."""
    low = F.when((pmin < pref) & (wet.cast("double") == 1), pmin).otherwise(pref)
    return low, F.when((low < pref) & (pmax < pref), pmax).otherwise(pref)


def nearby_rain(pref: Column, p_c_min: Column, p_c_max: Column, f_score: Column, length_km: Column, f_ghz=None, pol=None, a=None, b=None, approximation: str = "ITU_2005", waa_max: float = 2.3, alpha: float = 0.33, f_threshold: float | None = -32.5) -> Column:
    """alpha times the rain rate of the largest attenuation and the rest that of the smallest; null where F is not above its threshold."""
    a, b = _coefficients(f_ghz, pol, a, b, approximation)
    low, high = ((F.when(x < 0, F.lit(0.0)).otherwise(x)) for x in (pref - p_c_max - waa_max, pref - p_c_min - waa_max))
    rate = alpha * F.pow(high / (a * length_km), F.lit(1.0) / b) + (1 - alpha) * F.pow(low / (a * length_km), F.lit(1.0) / b)
    return rate if f_threshold is None else F.when(F.coalesce(f_score <= f_threshold, F.lit(False)), F.lit(None).cast("double")).otherwise(rate)


def attenuation_min_max(df: DataFrame, out: str = "att_max", g_t: float = 1.0, g_r: float = 0.6, rows: int = 7, keys=KEYS, time: str = "time") -> DataFrame:
    """Largest attenuation above the zero level, from tx_min, tx_max, rx_min, rx_max.

    Quantisation is corrected by half of g_t + g_r, missing values are the series' rounded mean, the zero level
    is the smallest of the last rows + 1 values; the first rows values are null, negative ones 0.
    """
    w = series(keys, time)
    whole = Window.partitionBy(*keys)
    half = (g_t + g_r) / 2
    high, low = F.col("tx_max") - F.col("rx_min") - half, F.col("tx_min") - F.col("rx_max") + half
    df = df.withColumns({"__h": F.coalesce(high, F.rint(F.avg(high).over(whole))), "__l": F.coalesce(low, F.rint(F.avg(low).over(whole)))})
    att = F.col("__h") - F.min("__l").over(w.rowsBetween(-rows, 0))
    return df.withColumn(out, F.when(F.row_number().over(w) > rows, F.greatest(att, F.lit(0.0)))).drop("__h", "__l")
