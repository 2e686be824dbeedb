"""Queries over the driver's tables, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrain.functions import antenna, powerlaw
from linkrain.functions.geo import climatological_variogram, haversine, haversine_sql
from linkrain.functions.udf import apply_along_time
from linkrain.operators import baseline, blackout, metrics, models, nearby, spatial, temporal, timeseries, wetdry
from linkrain.plans import flows
from linkrain.plans.adapter import LINKS_DUCKDB, OBS, SERIES, hours, links, observations
from linkrain.sources import files, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_O = f"obs AS ({OBS})"
_T = f"{_O}, t AS (SELECT *, tsl - rsl AS trsl FROM obs)"
_L = f"l0 AS ({LINKS_DUCKDB}), links AS (SELECT *, {haversine_sql('site_a_lon', 'site_a_lat', 'site_b_lon', 'site_b_lat')} AS length_km FROM l0)"
_W = f"WINDOW w AS ({SERIES})"
_HOUR = "CAST(floor(epoch(time) / 3600) AS BIGINT)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark, d) -> DataFrame:
    return observations(spark, d).withColumn("trsl", F.col("tsl") - F.col("rsl"))


def _r(name: str, places: int = 6):
    """A rounded column; no negative zero."""
    return (F.round(F.col(name), places) + F.lit(0.0)).alias(name)


# --- relational operators


@query(f"WITH {_O} SELECT event_id, CASE WHEN rsl > -55 THEN rsl END AS rsl, CASE WHEN tsl < 17 THEN tsl END AS tsl, round(CASE WHEN tsl < 17 THEN tsl END - CASE WHEN rsl > -55 THEN rsl END, 6) AS trsl FROM obs")
def r1_r2_clean_levels(spark, d):
    df = timeseries.mask_sentinels(observations(spark, d), rsl=F.col("rsl") > -55, tsl=F.col("tsl") < 17)
    return df.withColumn("trsl", timeseries.total_loss(F.col("tsl"), F.col("rsl"))).select("event_id", "rsl", "tsl", _r("trsl"))


@query(f"WITH {_O} SELECT event_id, cml_id FROM obs WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def r3_between_times(spark, d):
    df = timeseries.between_times(observations(spark, d), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-06 12:00:00").cast("timestamp_ntz"))
    return df.select("event_id", "cml_id")


_GAP = f"""p AS (SELECT *, CASE WHEN trsl IS NOT NULL THEN epoch_us(time) END AS us FROM t),
g AS (SELECT *, last_value(trsl IGNORE NULLS) OVER b AS v0, last_value(us IGNORE NULLS) OVER b AS t0, first_value(trsl IGNORE NULLS) OVER f AS v1, first_value(us IGNORE NULLS) OVER f AS t1
  FROM p WINDOW b AS ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT * EXCLUDE (trsl), coalesce(trsl, CASE WHEN t1 - t0 <= 21600000000 THEN v0 + (v1 - v0) * (epoch_us(time) - t0) / (t1 - t0) END) AS trsl FROM g)"""


@query(f"WITH {_T}, {_GAP} SELECT event_id, round(trsl, 6) AS trsl FROM filled")
def r4_interpolate(spark, d):
    return timeseries.interpolate(_t(spark, d), "trsl", 6 * 3600).select("event_id", _r("trsl"))


_STD = f"""s AS (SELECT *, CASE WHEN count(trsl) OVER c = 12 THEN stddev_pop(trsl) OVER c END AS dev FROM t WINDOW c AS ({SERIES} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
wd AS (SELECT * EXCLUDE (wet), coalesce(dev > 5, false) AS wet FROM s)"""


@query(f"WITH {_T}, {_STD} SELECT event_id, round(dev, 6) AS dev FROM s")
def r5_rolling_std(spark, d):
    return timeseries.rolling(_t(spark, d), "trsl", 12, "std", "dev", centre=True).select("event_id", _r("dev"))


@query(
    f"""WITH {_O} SELECT event_id, CASE WHEN count(rsl) OVER a >= 3 THEN round(max(rsl) OVER a, 6) END AS hi, CASE WHEN count(rsl) OVER a >= 3 THEN round(median(rsl) OVER a, 6) END AS mid,
    CASE WHEN count(rsl) OVER a = 8 THEN round(sum(rsl) OVER a, 6) END AS total FROM obs WINDOW a AS ({SERIES} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
)
def r6_rolling(spark, d):
    df = timeseries.rolling(observations(spark, d), "rsl", 8, "max", "hi", min_rows=3)
    df = timeseries.rolling(df, "rsl", 8, "median", "mid", min_rows=3)
    return timeseries.rolling(df, "rsl", 8, "sum", "total").select("event_id", _r("hi"), _r("mid"), _r("total"))


@query(
    f"""WITH {_T}, b AS (SELECT cml_id, channel_id, {_HOUR} AS hour, avg(trsl) AS m, min(trsl) AS lo, max(trsl) AS hi, sum(trsl) AS total FROM t GROUP BY ALL),
    e AS (SELECT cml_id, channel_id, unnest(range(lo, hi + 1)) AS hour FROM (SELECT cml_id, channel_id, min(hour) AS lo, max(hour) AS hi FROM b GROUP BY ALL))
    SELECT cml_id, channel_id, hour + 1 AS hour, round(m, 6) AS m, round(lo, 6) AS lo, round(hi, 6) AS hi, round(coalesce(total, 0), 6) AS total FROM e LEFT JOIN b USING (cml_id, channel_id, hour)"""
)
def r7_resample(spark, d):
    made = {"m": F.avg("trsl"), "lo": F.min("trsl"), "hi": F.max("trsl"), "total": F.sum("trsl")}
    df = timeseries.resample(_t(spark, d), "1 hour", made, label="right", zero=["total"])
    return df.select("cml_id", "channel_id", hours().alias("hour"), *map(_r, made))


_FRACTION = "f AS (SELECT cml_id, channel_id, count(*) FILTER (wet = 1)::DOUBLE / count(*) AS wet_fraction, count(*) FILTER (wet = 1)::DOUBLE / nullif(count(*) FILTER (wet = 0), 0) AS wet_dry_ratio FROM obs GROUP BY ALL)"


@query(f"WITH {_O}, {_FRACTION} SELECT cml_id, channel_id, round(wet_fraction, 6) AS wet_fraction, round(wet_dry_ratio, 6) AS wet_dry_ratio FROM f")
def r8_wet_fraction(spark, d):
    return timeseries.wet_fraction(observations(spark, d)).select("cml_id", "channel_id", _r("wet_fraction"), _r("wet_dry_ratio"))


@query(f"WITH {_O}, {_FRACTION} SELECT event_id, CASE WHEN wet_fraction < 0.1E0 THEN value END AS value FROM obs JOIN f USING (cml_id, channel_id)")
def r9_quiet_links(spark, d):
    return timeseries.keep_quiet_links(observations(spark, d), "value", 0.1).select("event_id", "value")


@query(
    f"""WITH {_O}, {_L} SELECT event_id, cml_id, CASE WHEN channel_id = '0' THEN rsl END AS rsl, CASE WHEN channel_id = '1' THEN tsl END AS tsl, frequency_ghz FROM obs LEFT JOIN links USING (cml_id)"""
)
def r10_concat_merge(spark, d):
    df = observations(spark, d)
    both = timeseries.concat(df.where("channel_id = '0'").select("event_id", "cml_id", "rsl"), df.where("channel_id = '1'").select("event_id", "cml_id", "tsl"))
    return timeseries.merge(both, links(spark, d).select("cml_id", "frequency_ghz"), ["cml_id"])


@query(f"WITH {_O} SELECT a.event_id, b.value FROM obs a LEFT JOIN (SELECT * FROM obs WHERE rsl IS NOT NULL) b USING (cml_id, channel_id, time)")
def r11_align(spark, d):
    df = observations(spark, d)
    valid = df.where("rsl is not null").select(*timeseries.KEYS, "time", "value")
    return timeseries.align(valid, df).join(df.select(*timeseries.KEYS, "time", "event_id"), [*timeseries.KEYS, "time"]).select("event_id", "value")


@query(
    f"""WITH {_O}, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cml_id, channel_id) AS n, lag(rsl, 2) OVER w AS before, rsl - lag(rsl) OVER w AS step FROM obs {_W})
    SELECT a.event_id, a.before, round(a.step, 6) AS step, b.rsl AS next_round FROM n a JOIN n b ON a.cml_id = b.cml_id AND a.channel_id = b.channel_id AND b.i = a.i % a.n + 1"""
)
def r12_shift_roll(spark, d):
    w = timeseries.series()
    x = F.col("rsl")
    df = observations(spark, d).withColumns({"before": timeseries.shifted(x, 2, w), "step": x - timeseries.shifted(x, 1, w), "next_round": timeseries.rolled(x, -1, w)})
    return df.select("event_id", "before", _r("step"), "next_round")


@query(
    f"""WITH {_O}, x AS (SELECT *, coalesce(wet = 1, false) AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY cml_id, channel_id) AS n FROM obs {_W}),
    y AS (SELECT *, coalesce(lag(x) OVER w, first_value(x) OVER (PARTITION BY cml_id, channel_id ORDER BY time DESC)) AS p, coalesce(lead(x) OVER w, first_value(x) OVER w) AS q, x AND NOT coalesce(lag(x) OVER w, false) AS b FROM x {_W})
    SELECT event_id, q AND NOT x AS starts, p AND NOT x AS ends, CASE WHEN x THEN sum(b::INT) OVER w END::BIGINT AS event FROM y {_W}"""
)
def r13_event_edges(spark, d):
    return timeseries.event_edges(observations(spark, d)).select("event_id", "starts", "ends", "event")


@query(f"WITH {_T}, m AS (SELECT cml_id, channel_id, median(trsl) AS m FROM t GROUP BY ALL) SELECT event_id, round(trsl - m, 6) AS x FROM t JOIN m USING (cml_id, channel_id)")
def r14_detrend(spark, d):
    return timeseries.detrend(_t(spark, d), "trsl", "x").select("event_id", (F.round("x", 6) + 0.0).alias("x"))


@query(
    f"""WITH {_O} SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS by_time, round(sum(value) OVER (PARTITION BY cml_id, channel_id ORDER BY value, time ROWS UNBOUNDED PRECEDING), 4) AS by_value FROM obs {_W}"""
)
def r15_running_sums(spark, d):
    df = timeseries.running_sum(observations(spark, d), "value", "by_time")
    return timeseries.running_sum(df, "value", "by_value", by_value=True).select("event_id", _r("by_time", 4), _r("by_value", 4))


@query(f"WITH {_O} SELECT event_id, CASE WHEN value > -rsl * 5 THEN 1 ELSE 0 END AS best FROM obs")
def r16_more_likely(spark, d):
    return observations(spark, d).select("event_id", timeseries.more_likely(-F.col("rsl") * 5, F.col("value")).alias("best"))


@query(f"WITH {_O}, g AS (SELECT *, epoch_us(lead(time) OVER (PARTITION BY cml_id ORDER BY time)) - epoch_us(time) AS gap FROM obs) SELECT event_id FROM g WHERE gap IS NULL OR gap > 3600000000")
def r17_debounce(spark, d):
    return timeseries.debounce(observations(spark, d), 3600).select("event_id")


@query(f"WITH {_O} SELECT floor(rsl / 2) * 2 AS rsl, floor(value / 50) * 50 AS value, count(*) AS n FROM obs WHERE rsl IS NOT NULL GROUP BY ALL")
def r18_histogram(spark, d):
    return timeseries.histogram(observations(spark, d), {"rsl": 2.0, "value": 50.0})


@query(f"WITH {_L} SELECT cml_id, round((site_a_lon + site_b_lon) / 2, 9) AS lon, round((site_a_lat + site_b_lat) / 2, 9) AS lat FROM links")
def r19_centre(spark, d):
    return timeseries.centre(links(spark, d)).select("cml_id", _r("lon", 9), _r("lat", 9))


# --- wet/dry


@query(f"WITH {_T}, {_STD} SELECT event_id, wet FROM wd")
def w1_rolling_std_wet(spark, d):
    return wetdry.rolling_std_wet(_t(spark, d), rows=12, threshold=5.0).select("event_id", "wet")


_PAIRS = ", ".join(f"CASE WHEN a.cml_id = b.cml_id THEN 0 ELSE {haversine_sql(f'a.site_{i}_lon', f'a.site_{i}_lat', f'b.site_{j}_lon', f'b.site_{j}_lat')} END AS {i}{j}" for i in "ab" for j in "ab")
_D = f"d AS (SELECT a.cml_id AS cml_id1, b.cml_id AS cml_id2, {_PAIRS} FROM links a, links b)"


@query(f"WITH {_L}, {_D} SELECT cml_id1, cml_id2, round(aa, 6) AS aa, round(ab, 6) AS ab, round(ba, 6) AS ba, round(bb, 6) AS bb FROM d")
def w2_distances(spark, d):
    return nearby.endpoint_distances(links(spark, d)).select("cml_id1", "cml_id2", *map(_r, ("aa", "ab", "ba", "bb")))


@query(f"WITH {_L}, {_D} SELECT cml_id1, cml_id2 FROM d WHERE aa < 5 AND ab < 5 AND ba < 5 AND bb < 5")
def w2_neighbours(spark, d):
    return nearby.neighbours(links(spark, d), 5)


def _levels(spark, d):
    """Hourly smallest and largest levels of both channels."""
    made = {"pmin": F.min(F.col("rsl") - F.col("tsl")), "pmax": F.max(F.col("rsl") - F.col("tsl"))}
    return timeseries.resample(observations(spark, d), "6 hours", made, dense=False)


_SIX = "CAST(floor(epoch(time) / 21600) * 6 AS BIGINT)"
_LEVELS = f"lv AS (SELECT cml_id, channel_id, {_SIX} AS hour, min(rsl - tsl) AS pmin, max(rsl - tsl) AS pmax FROM obs GROUP BY ALL)"
_SERIES6 = "PARTITION BY cml_id, channel_id ORDER BY hour"
_NEARBY = f"""nb AS (SELECT cml_id1, cml_id2, count(*) OVER (PARTITION BY cml_id1) AS k FROM d WHERE aa < 5 AND ab < 5 AND ba < 5 AND bb < 5),
dp AS (SELECT lv.*, length_km, frequency_ghz, polarization, pmin - CASE WHEN count(pmin) OVER x >= 2 THEN max(pmin) OVER x END AS dp FROM lv JOIN links USING (cml_id) WINDOW x AS ({_SERIES6} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
md AS (SELECT cml_id1 AS cml_id, channel_id, hour, median(dp) AS mp, median(dp / length_km) AS mpl FROM nb JOIN dp ON cml_id2 = cml_id WHERE k > 3 GROUP BY ALL HAVING count(dp) > 3),
w0 AS (SELECT dp.*, mp, mpl, dp / length_km - mpl AS ex, CASE WHEN mp IS NOT NULL AND mpl IS NOT NULL THEN (mp < -4 AND mpl < -1)::INT::DOUBLE END AS wet0 FROM dp LEFT JOIN md USING (cml_id, channel_id, hour)),
w1 AS (SELECT *, coalesce(wet0 = 1 AND dp < -2, false) AS tr, CASE WHEN count(ex) OVER y = 96 THEN sum(ex) OVER y * 6 END AS F FROM w0 WINDOW y AS ({_SERIES6} ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
nw AS (SELECT *, CASE WHEN wet0 IS NOT NULL THEN CASE WHEN tr OR coalesce(lag(tr) OVER z, true) OR coalesce(lead(tr) OVER z, true) OR coalesce(lead(tr, 2) OVER z, true) THEN 1.0 ELSE wet0 END END AS wet FROM w1 WINDOW z AS ({_SERIES6}))"""


def _nearby(spark, d):
    ls = links(spark, d)
    df = _levels(spark, d).join(ls.select("cml_id", "length_km", "frequency_ghz", "polarization"), "cml_id")
    return nearby.nearby_wetdry(df, ls, 5, -4.0, -1.0, 3, interval=360, min_hours=12)


@query(f"WITH {_O}, {_L}, {_D}, {_LEVELS}, {_NEARBY} SELECT cml_id, channel_id, hour, round(pmin, 6) AS pmin, wet::DOUBLE AS wet, round(F, 4) AS F FROM nw")
def w3_nearby_wetdry(spark, d):
    return _nearby(spark, d).select("cml_id", "channel_id", hours().alias("hour"), _r("pmin"), "wet", _r("F", 4))


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _stft() -> str:
    """Power of windows of 16 rows as sums of cosines and sines, relative to the calmest 24 rows."""
    k, n = np.arange(9)[:, None], np.arange(16)
    window = np.hamming(16)
    scale = np.where((k[:, 0] == 0) | (k[:, 0] == 8), 1.0, 2.0) * 60 / (window**2).sum()
    part = lambda f, i: f"pow(list_dot_product(x, {_list(f(2 * np.pi * k[i] * n / 16) * window)}), 2)"
    power = ", ".join(f"{float(scale[i])!r} * ({part(np.cos, i)} + {part(np.sin, i)}) AS p{i}" for i in range(9))
    mean = ", ".join(f"avg(p{i}) AS m{i}" for i in range(9))
    low, high = (" + ".join(f"p{i} / m{i}" for i in r) for r in (range(4), range(4, 9)))
    gap = _GAP.replace("trsl", "rsl").replace(" FROM t)", " FROM obs)").replace("CASE WHEN t1 - t0 <= 21600000000 THEN ", "").replace("(t1 - t0) END)", "(t1 - t0))")
    return f"""WITH {_O}, {gap},
    rows AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN count(rsl) OVER f = 16 THEN list(rsl) OVER f END AS x, CASE WHEN count(rsl) OVER c = 24 THEN stddev_samp(rsl) OVER c END AS s
      FROM filled WINDOW w AS ({SERIES}), f AS ({SERIES} ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING), c AS ({SERIES} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    calm AS (SELECT cml_id, channel_id, arg_min(i, s) AS stop FROM rows WHERE s IS NOT NULL GROUP BY ALL),
    power AS (SELECT event_id, cml_id, channel_id, i, {power} FROM rows),
    dry AS (SELECT cml_id, channel_id, {mean} FROM power JOIN calm USING (cml_id, channel_id) WHERE i >= stop - 24 AND i < stop GROUP BY ALL),
    diff AS (SELECT event_id, ({low}) / 4 - ({high}) / 5 AS v FROM power LEFT JOIN dry USING (cml_id, channel_id))
    SELECT event_id, coalesce(v > 1.5, false) AS wet, round(v, 6) AS P_sum_diff FROM diff"""


@query(_stft())
def w4_stft_wet(spark, d):
    return wetdry.stft_wet(timeseries.interpolate(observations(spark, d), "rsl", 1e9), window_length=16, dry_length=24, f_divide=4e-3).select("event_id", "wet", _r("P_sum_diff"))


@query(
    f"""WITH {_O}, s AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN count(rsl) OVER f = 10 THEN stddev_samp(rsl) OVER f END AS s FROM obs WINDOW w AS ({SERIES}), f AS ({SERIES} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT cml_id, channel_id, (arg_min(i, s) - 10)::INT AS dry_start, arg_min(i, s)::INT AS dry_stop FROM s WHERE s IS NOT NULL GROUP BY ALL"""
)
def w5_calmest_period(spark, d):
    return wetdry.calmest_period(observations(spark, d), rows=10)


def _weights(*shapes):
    rng = np.random.default_rng(0)
    return [rng.normal(size=s) / np.sqrt(s[0]) for s in shapes]


def _mlp_sql() -> str:
    a, b = _weights((80, 8), (8, 2))
    hidden = ", ".join(f"greatest(0, list_dot_product(x, {_list(a[:40, j])}) + list_dot_product(y, {_list(a[40:, j])})) AS h{j}" for j in range(8))
    out = [" + ".join(f"h{j} * {float(b[j, k])!r}" for j in range(8)) for k in (0, 1)]
    return f"""WITH {_O}, s AS (SELECT event_id, cml_id, channel_id, time, (value - lag(value) OVER w)::FLOAT::DOUBLE AS a, (tsl - lag(tsl) OVER w)::FLOAT::DOUBLE AS b FROM obs {_W}),
    x AS (SELECT event_id, count(a) OVER f = 40 AND count(b) OVER f = 40 AS whole, list(coalesce(a, 0)) OVER f AS x, list(coalesce(b, 0)) OVER f AS y FROM s WINDOW f AS ({SERIES} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
    h AS (SELECT event_id, {hidden} FROM x WHERE whole)
    SELECT event_id, round(1 / (1 + exp(({out[0]}) - ({out[1]}))), 4) AS p_wet FROM obs LEFT JOIN h USING (event_id)"""


@query(_mlp_sql())
def w7_mlp_wet_dry(spark, d):
    a, b = _weights((80, 8), (8, 2))
    layers = [("dense", (a, np.zeros(8))), ("relu", ()), ("dense", (b, np.zeros(2))), ("softmax", ())]
    df = observations(spark, d).withColumn("other", F.col("tsl"))
    return models.mlp_wet_dry(df, ("value", "other"), layers, "rad_online", keys=("cml_id", "channel_id")).select("event_id", _r("p_wet", 4))


def _cnn(channels: int):
    a, b = _weights((3, channels, 4), (4, 1))
    return [("conv", (a, np.zeros(4))), ("relu", ()), ("meanpool", ()), ("dense", (b, np.zeros(1))), ("sigmoid", ())]


def _cnn_sql(frame: str, scaled: bool) -> str:
    """The network of _cnn(2) over lists of 40 values of both columns in single precision."""
    a, b = _weights((3, 2, 4), (4, 1))
    part = lambda o: " + ".join(f"{name}[s + {k}]::DOUBLE * {float(a[k, c, o])!r}" for k in range(3) for c, name in enumerate("xy"))
    pooled = " + ".join(f"{float(b[o, 0])!r} * list_sum(list_transform(range(1, 39), lambda s: greatest(0, {part(o)}))) / 38" for o in range(4))
    scales = f"""n AS (SELECT value, tsl, sum(e) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS n FROM (SELECT *, (count(*) OVER ({SERIES} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) = 40)::INT AS e FROM obs)),
    m AS (SELECT sum(value * n) / sum(n) AS mx, sum(tsl * n) / sum(n) AS my FROM n), sp AS (SELECT sqrt(sum(pow(value - mx, 2) * n) / sum(n)) AS sx, sqrt(sum(pow(tsl - my, 2) * n) / sum(n)) AS sy FROM n, m),"""
    x, y = ("((value::FLOAT - mx::FLOAT) / sx::FLOAT)::FLOAT", "((tsl::FLOAT - my::FLOAT) / sy::FLOAT)::FLOAT") if scaled else ("value::FLOAT", "tsl::FLOAT")
    return f"""WITH {_O}, {scales if scaled else ''}
    v AS (SELECT event_id, cml_id, channel_id, time, {x} AS x, {y} AS y FROM obs{', m, sp' if scaled else ''}),
    w AS (SELECT event_id, CASE WHEN count(*) OVER f = 40 THEN list(x) OVER f END AS x, CASE WHEN count(*) OVER f = 40 THEN list(y) OVER f END AS y FROM v WINDOW f AS ({SERIES} ROWS BETWEEN {frame}))
    SELECT event_id, CASE WHEN x IS NOT NULL THEN round(1 / (1 + exp(-({pooled}))), 4) END AS p_wet FROM w"""


@query(_cnn_sql("39 PRECEDING AND CURRENT ROW", True))
def w8_cnn_trailing(spark, d):
    return models.cnn_trailing(observations(spark, d), ["value", "tsl"], _cnn(2), 40, keys=("cml_id", "channel_id")).select("event_id", _r("p_wet", 4))


@query(_cnn_sql("34 PRECEDING AND 5 FOLLOWING", False))
def w9_cnn_centred(spark, d):
    return models.cnn_centred(observations(spark, d), ["value", "tsl"], _cnn(2), 40, 12, keys=("cml_id", "channel_id")).select("event_id", _r("p_wet", 4))


# --- baselines and wet antenna attenuation

_B1 = f"""i AS (SELECT *, row_number() OVER w AS i, coalesce(wet <> 0, true) AS x FROM t {_W}),
b1 AS (SELECT a.*, b.trsl AS baseline FROM (SELECT *, max(CASE WHEN NOT x OR i = 1 THEN i END) OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM i {_W}) a JOIN i b ON a.cml_id = b.cml_id AND a.channel_id = b.channel_id AND a.k = b.i)"""


@query(f"WITH {_T}, {_B1} SELECT event_id, round(baseline, 6) AS baseline FROM b1")
def b1_baseline_constant(spark, d):
    return baseline.baseline_constant(_t(spark, d)).select("event_id", _r("baseline"))


_MEAN5 = "CASE WHEN len(list_filter(buf, lambda x: x IS NULL)) > 0 THEN NULL ELSE list_avg(buf) END"


@query(
    f"""WITH RECURSIVE {_T}, i AS (SELECT *, row_number() OVER w AS i, coalesce(wet <> 0, true) AS x, coalesce(lag(coalesce(wet <> 0, true)) OVER w, false) AS px FROM t {_W}),
    rec AS (
      SELECT cml_id, channel_id, 5::BIGINT AS i, list(trsl ORDER BY i) AS buf FROM i WHERE i <= 5 GROUP BY ALL
      UNION ALL
      SELECT s.cml_id, s.channel_id, s.i, list_append(buf[2:5], CASE WHEN s.x AND NOT s.px THEN {_MEAN5} WHEN s.x THEN buf[5] ELSE s.trsl END)
      FROM rec r JOIN i s ON s.cml_id = r.cml_id AND s.channel_id = r.channel_id AND s.i = r.i + 1)
    SELECT event_id, round(CASE WHEN i.i <= 5 THEN trsl ELSE buf[5] END, 6) AS baseline FROM i LEFT JOIN rec USING (cml_id, channel_id, i)"""
)
def b1_baseline_constant_n5(spark, d):
    return baseline.baseline_constant(_t(spark, d), n=5).select("event_id", _r("baseline"))


def _linear(ignore: bool) -> str:
    state = "last_value(CASE WHEN i = 1 THEN 0.0 ELSE wet END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)" if ignore else "wet"
    # wet of the first row does not count; events lie between two anchors
    return f"""WITH {_O}, i AS (SELECT *, value AS v, row_number() OVER w AS i FROM obs {_W}),
    s AS (SELECT *, {state} AS s FROM i {_W}),
    a AS (SELECT *, i = 1 OR coalesce(s = 0, false) AS anchor FROM s),
    sp AS (SELECT cml_id, channel_id, i, v, lead(i) OVER w AS j, lead(v) OVER w AS u FROM a WHERE anchor {_W}),
    ev AS (SELECT sp.*, coalesce(bool_or(a.s IS NULL), false) AS bad FROM sp LEFT JOIN a ON a.cml_id = sp.cml_id AND a.channel_id = sp.channel_id AND a.i > sp.i AND (a.i < sp.j OR sp.j IS NULL) GROUP BY ALL),
    bk AS (SELECT *, lag(bad AND j > i + 1, 1, false) OVER w AS bad0 FROM ev {_W})
    SELECT a.event_id, round(CASE WHEN a.anchor THEN CASE WHEN CASE WHEN bk.j > bk.i + 1 THEN bk.bad ELSE bk.bad0 END THEN NULL ELSE a.v END
      WHEN bk.j IS NULL THEN 0.0 WHEN bk.bad THEN NULL ELSE bk.v + (bk.u - bk.v) * (a.i - bk.i) / (bk.j - bk.i) END, 6) AS baseline
    FROM a JOIN bk ON a.cml_id = bk.cml_id AND a.channel_id = bk.channel_id AND a.i >= bk.i AND (a.i < bk.j OR bk.j IS NULL)""".replace(f"WHERE anchor {_W}", f"WHERE anchor WINDOW w AS ({SERIES})").replace(f"FROM ev {_W}", "FROM ev WINDOW w AS (PARTITION BY cml_id, channel_id ORDER BY i)")


@query(_linear(False))
def b2_baseline_linear(spark, d):
    return baseline.baseline_linear(observations(spark, d), "value").select("event_id", _r("baseline"))


@query(_linear(True))
def b2_baseline_linear_ignore_nan(spark, d):
    return baseline.baseline_linear(observations(spark, d), "value", ignore_nan=True).select("event_id", _r("baseline"))


_LV = f"{_O}, {_LEVELS}, lw AS (SELECT *, (pmin < -62)::INT::DOUBLE AS wet FROM lv)"
_PREF = f"pf AS (SELECT *, median(CASE WHEN wet = 0 THEN (pmin + pmax) / 2 END) OVER (PARTITION BY cml_id, channel_id ORDER BY hour ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS pref FROM lw)"


def _pref(spark, d):
    df = _levels(spark, d).withColumn("wet", (F.col("pmin") < -62).cast("double"))
    return baseline.reference_level(df, rows=12)


@query(f"WITH {_LV}, {_PREF} SELECT cml_id, channel_id, hour, round(pref, 6) AS pref FROM pf")
def b3_reference_level(spark, d):
    return _pref(spark, d).select("cml_id", "channel_id", hours().alias("hour"), _r("pref"))


_WAA = """rec AS (
  SELECT cml_id, channel_id, event_id, i, 0.0::DOUBLE AS waa FROM {src} WHERE i = 1
  UNION ALL
  SELECT s.cml_id, s.channel_id, s.event_id, s.i, CASE WHEN s.trsl - s.baseline IS NULL THEN NULL
    WHEN s.{wet} AND r.waa IS NOT NULL THEN least(s.trsl - s.baseline, {top}, r.waa + ({top} - r.waa) * 3 * 1 / 15) ELSE least(s.trsl - s.baseline, {top}) END
  FROM rec r JOIN {src} s ON s.cml_id = r.cml_id AND s.channel_id = r.channel_id AND s.i = r.i + 1)"""


@query(f"WITH RECURSIVE {_T}, {_B1}, src AS (SELECT *, coalesce(wet = 1, false) AS y FROM b1), {_WAA.format(src='src', wet='y', top='2.3')} SELECT event_id, round(waa, 6) AS waa FROM rec")
def a1_waa_schleiss(spark, d):
    return baseline.waa_schleiss(baseline.baseline_constant(_t(spark, d))).select("event_id", _r("waa"))


def _leijnse_terms(f_hz: float) -> list[tuple[complex, complex]]:
    """(c, k) of the four terms c exp(k l) whose sum's squared size is the power ratio for a film of thickness l."""
    n, thick, wave = 1.73 + 0.014j, 0.001, 2j * np.pi * f_hz / antenna.LIGHT
    water = complex(np.sqrt(antenna.permittivity_values(f_hz, 293.0)))
    dry = sum(t * (1 + t * n) ** 2 * np.exp(-t * wave * n * thick) for t in (1, -1))
    return [(complex((1 + s * water) * (water + s * t * n) * (n + t) * np.exp(-t * wave * n * thick) / (2 * water * dry)), complex(-s * wave * water)) for t in (1, -1) for s in (1, -1)]


def _leijnse_sql(terms: list[tuple[str, str, str, str]]) -> str:
    """WAA of a film l for terms given as SQL of real and imaginary parts."""
    re = " + ".join(f"exp({kr} * l) * ({cr} * cos({ki} * l) - {ci} * sin({ki} * l))" for cr, ci, kr, ki in terms)
    im = " + ".join(f"exp({kr} * l) * ({cr} * sin({ki} * l) + {ci} * cos({ki} * l))" for cr, ci, kr, ki in terms)
    return f"10 * log10(pow({re}, 2) + pow({im}, 2))"


def _numbers(f_hz: float) -> list[tuple[str, str, str, str]]:
    return [tuple(f"{x!r}::DOUBLE" for x in (c.real, c.imag, k.real, k.imag)) for c, k in _leijnse_terms(f_hz)]


@query(f"WITH {_O}, f AS (SELECT event_id, 2.06e-5::DOUBLE * pow(value / 10, 0.24) AS l FROM obs) SELECT event_id, round({_leijnse_sql(_numbers(20e9))}, 6) AS waa FROM f")
def a2_waa_leijnse(spark, d):
    df = observations(spark, d).select("event_id", antenna.leijnse(F.col("value") / 10, F.lit(20e9)).alias("waa"))
    return df.select("event_id", _r("waa"))


def _attenuated(spark, d):
    """Rows with a link's parameters; coefficients of the power law are worked out once for each link."""
    about = flows.with_power_law(links(spark, d)).select("cml_id", "frequency_ghz", "polarization", "length_km", "a", "b")
    return observations(spark, d).join(about, "cml_id").withColumn("att", F.col("value") / 20)


# --- attenuation and rain


def _nodes() -> str:
    t = powerlaw.table("ITU_2005")
    rows = ", ".join(f"({f!r}::DOUBLE, '{p}', {float(t[f'k_{p}'][i])!r}::DOUBLE, {float(t[f'alpha_{p}'][i])!r}::DOUBLE)" for i, f in enumerate(t["f"].tolist()) if 10 <= f < 30 for p in "HV")
    return f"ab AS (SELECT * FROM (VALUES {rows}) AS v(frequency_ghz, polarization, a, b))"


_AB = f"{_L}, {_nodes()}, pl AS (SELECT * FROM links JOIN ab USING (frequency_ghz, polarization))"


@query(f"WITH {_AB} SELECT cml_id, round(a, 6) AS a, round(b, 6) AS b FROM pl")
def k1_coefficients(spark, d):
    return flows.with_power_law(links(spark, d)).select("cml_id", _r("a"), _r("b"))


def _rate(att: str, a: str = "a") -> str:
    return f"CASE WHEN {att} < 0 OR pow({att} / ({a} * length_km), 1 / b) < 0.1 THEN 0 ELSE pow({att} / ({a} * length_km), 1 / b) END"


@query(f"WITH {_O}, {_AB} SELECT event_id, round({_rate('(-rsl - 42)')}, 6) AS rain FROM obs JOIN pl USING (cml_id)")
def k3_rain_rate(spark, d):
    df = _attenuated(spark, d)
    r = powerlaw.rain_rate(-F.col("rsl") - 42, F.col("length_km"), a=F.col("a"), b=F.col("b"))
    return df.select("event_id", r.alias("rain")).select("event_id", _r("rain"))


@query(f"WITH {_O}, {_AB} SELECT event_id, round({_rate('(-rsl - 42)', f'(a * pow({float(np.log(90) + powerlaw.EULER_GAMMA)!r}::DOUBLE, b))')}, 6) AS rain FROM obs JOIN pl USING (cml_id)")
def k4_rain_rate_min_max(spark, d):
    df = _attenuated(spark, d)
    r = powerlaw.rain_rate_min_max(-F.col("rsl") - 42, F.col("length_km"), a=F.col("a"), b=F.col("b"))
    return df.select("event_id", r.alias("rain")).select("event_id", _r("rain"))


@query(
    f"""WITH {_O}, b AS (SELECT cml_id, channel_id, {_SIX} AS hour, max(tsl) - min(rsl) - 0.8 AS h, min(tsl) - max(rsl) + 0.8 AS l FROM obs GROUP BY ALL),
    c AS (SELECT *, coalesce(h, round_even(avg(h) OVER p, 0)) AS hh, coalesce(l, round_even(avg(l) OVER p, 0)) AS ll FROM b WINDOW p AS (PARTITION BY cml_id, channel_id))
    SELECT cml_id, channel_id, hour, CASE WHEN row_number() OVER q > 7 THEN round(greatest(hh - min(ll) OVER (q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0), 6) END AS att_max FROM c WINDOW q AS ({_SERIES6})"""
)
def k5_attenuation_min_max(spark, d):
    made = {f"{s}_{n}": f(c) for s, c in (("tx", "tsl"), ("rx", "rsl")) for n, f in (("min", F.min), ("max", F.max))}
    df = timeseries.resample(observations(spark, d), "6 hours", made, dense=False)
    return nearby.attenuation_min_max(df).select("cml_id", "channel_id", hours().alias("hour"), _r("att_max"))


_CORRECTED = "co AS (SELECT *, CASE WHEN lo < pref AND pmax < pref THEN pmax ELSE pref END AS hi FROM (SELECT *, CASE WHEN pmin < pref AND wet = 1 THEN pmin ELSE pref END AS lo FROM pf))"


@query(f"WITH {_LV}, {_PREF}, {_CORRECTED} SELECT cml_id, channel_id, hour, round(lo, 6) AS lo, round(hi, 6) AS hi FROM co")
def k6_corrected_levels(spark, d):
    lo, hi = nearby.corrected_levels(F.col("pmin"), F.col("pmax"), F.col("wet"), F.col("pref"))
    return _pref(spark, d).select("cml_id", "channel_id", hours().alias("hour"), lo.alias("lo"), hi.alias("hi")).select("cml_id", "channel_id", "hour", _r("lo"), _r("hi"))


def _alpha(f: str | None) -> str:
    part = lambda x: f"pow(greatest(pref - {x} - 2.3, 0) / (a * length_km), 1 / b)"
    made = f"CASE WHEN pref IS NULL OR lo IS NULL OR hi IS NULL THEN NULL ELSE 0.33 * {part('lo')} + 0.67 * {part('hi')} END"
    return f"CASE WHEN {f} <= -32.5 THEN NULL ELSE {made} END" if f else made


@query(f"WITH {_LV}, {_PREF}, {_CORRECTED}, {_AB} SELECT cml_id, channel_id, hour, round({_alpha('pmin + 30')}, 5) AS rain FROM co JOIN pl USING (cml_id)")
def k7_nearby_rain(spark, d):
    lo, hi = nearby.corrected_levels(F.col("pmin"), F.col("pmax"), F.col("wet"), F.col("pref"))
    df = _pref(spark, d).join(flows.with_power_law(links(spark, d)), "cml_id")
    r = nearby.nearby_rain(F.col("pref"), lo, hi, F.col("pmin") + 30, F.col("length_km"), a=F.col("a"), b=F.col("b"))
    return df.select("cml_id", "channel_id", hours().alias("hour"), r.alias("rain")).select("cml_id", "channel_id", "hour", _r("rain", 5))


def _inverse_sql(waa: str, more: str = "") -> str:
    """WAA by the table of 100 attenuations of each link: the last entry not above an observed value, and the next."""
    return f"""WITH {_O}, {_AB}{more}, pt AS (SELECT k, CASE WHEN k = 0 THEN 0 ELSE pow(10, -10 + 13 * k / 99.0::DOUBLE) END AS ar FROM range(100) r(k)),
    rn AS (SELECT pl.*, k, ar, pow(ar / (a * length_km), 1 / b) AS rain, 2.06e-5::DOUBLE * pow(pow(ar / (a * length_km), 1 / b), 0.24) AS l FROM pl, pt),
    tb AS (SELECT cml_id, k, ar, CASE WHEN ar = 0 THEN 0 ELSE {waa} END AS w FROM rn{' JOIN ks USING (frequency_ghz)' if more else ''}),
    tn AS (SELECT cml_id, ar + w AS total, w, lead(ar + w) OVER n AS t1, lead(w) OVER n AS w1 FROM tb WINDOW n AS (PARTITION BY cml_id ORDER BY k))
    SELECT event_id, round(w + (w1 - w) * (value / 20 - total) / (t1 - total), 6) AS waa FROM obs ASOF JOIN tn ON obs.cml_id = tn.cml_id AND obs.value / 20 >= tn.total"""


_NAMES = [tuple(f"{x}{i}" for x in ("cr", "ci", "kr", "ki")) for i in range(4)]
_KS = ", ks AS (SELECT * FROM (VALUES " + ", ".join(f"({f}.0::DOUBLE, {', '.join(x for t in _numbers(f * 1e9) for x in t)})" for f in range(10, 30)) + f") AS v(frequency_ghz, {', '.join(x for t in _NAMES for x in t)}))"


@query(_inverse_sql(_leijnse_sql(_NAMES), _KS))
def a3_waa_leijnse_from_observed(spark, d):
    w = antenna.leijnse_from_observed(F.col("att"), F.col("frequency_ghz") * 1e9, F.col("polarization"), F.col("length_km"))
    return _attenuated(spark, d).select("event_id", w.alias("waa")).select("event_id", _r("waa"))


@query(f"WITH {_O} SELECT event_id, round(14 * (1 - exp(-0.1 * pow(value / 10, 0.55))), 6) AS waa FROM obs")
def a4_waa_pastorek(spark, d):
    return observations(spark, d).select("event_id", antenna.pastorek(F.col("value") / 10).alias("waa")).select("event_id", _r("waa"))


@query(_inverse_sql("14 * (1 - exp(-0.1 * pow(rain, 0.55)))"))
def a5_waa_pastorek_from_observed(spark, d):
    w = antenna.pastorek_from_observed(F.col("att"), F.col("frequency_ghz") * 1e9, F.col("polarization"), F.col("length_km"))
    return _attenuated(spark, d).select("event_id", w.alias("waa")).select("event_id", _r("waa"))


_DEBYE = antenna._debye(293.0)


@query(
    f"""WITH {_L}, p AS (SELECT cml_id, frequency_ghz AS f, {_DEBYE[0]!r}::DOUBLE AS e0, {_DEBYE[1]!r}::DOUBLE AS e1, {_DEBYE[2]!r}::DOUBLE AS e2, {_DEBYE[3]!r}::DOUBLE AS f1, {_DEBYE[4]!r}::DOUBLE AS f2 FROM links)
    SELECT cml_id, round(e2 + (e1 - e2) / (1 + (f / f2) * (f / f2)) + (e0 - e1) / (1 + (f / f1) * (f / f1)), 6) AS re, round((e1 - e2) * (f / f2) / (1 + (f / f2) * (f / f2)) + (e0 - e1) * (f / f1) / (1 + (f / f1) * (f / f1)), 6) AS im FROM p"""
)
def a6_permittivity(spark, d):
    re, im = antenna.permittivity(F.col("frequency_ghz") * 1e9)
    return links(spark, d).select("cml_id", re.alias("re"), im.alias("im")).select("cml_id", _r("re"), _r("im"))


# --- blackout gaps

_MARKS = f"""n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cml_id, channel_id) AS n FROM obs {_W}),
m AS (SELECT a.*, b.rsl IS NULL AND coalesce(a.rsl < -52, false) AS gap_start, c.rsl IS NULL AND coalesce(a.rsl < -52, false) AS gap_end
  FROM n a JOIN n b ON a.cml_id = b.cml_id AND a.channel_id = b.channel_id AND b.i = a.i % a.n + 1 JOIN n c ON a.cml_id = c.cml_id AND a.channel_id = c.channel_id AND c.i = (a.i + a.n - 2) % a.n + 1)"""
# a row's state: opened by a start, closed by a valid row without one or by an end
_MASKS = """fw AS (SELECT a.event_id, a.rsl IS NULL AND coalesce((SELECT arg_max(b.gap_start AND NOT b.gap_end, b.i) FROM m b WHERE b.cml_id = a.cml_id AND b.channel_id = a.channel_id AND b.i <= a.i AND b.rsl IS NOT NULL), false) AS fw FROM m a),
bw AS (SELECT a.event_id, a.rsl IS NULL AND coalesce((SELECT arg_min(b.gap_end AND NOT b.gap_start, b.i) FROM m b WHERE b.cml_id = a.cml_id AND b.channel_id = a.channel_id AND b.i >= a.i AND b.rsl IS NOT NULL), false) AS bw FROM m a)"""


@query(f"WITH {_O}, {_MARKS} SELECT event_id, gap_start, gap_end FROM m")
def g1_gap_markers(spark, d):
    return blackout.gap_markers(observations(spark, d), -52).select("event_id", "gap_start", "gap_end")


@query(f"WITH {_O}, {_MARKS}, {_MASKS} SELECT event_id, fw AS blackout FROM fw")
def g2_mask_from_markers(spark, d):
    return blackout.mask_from_markers(blackout.gap_markers(observations(spark, d), -52)).select("event_id", "blackout")


@query(f"WITH {_O}, {_MARKS}, {_MASKS} SELECT event_id, fw OR bw AS blackout FROM fw JOIN bw USING (event_id)")
def g3_blackout(spark, d):
    return blackout.blackout_mask(observations(spark, d), -52).select("event_id", "blackout")


@query(f"WITH {_O}, {_MARKS}, {_MASKS} SELECT cml_id, count(*) FILTER (fw OR bw) AS n_blackout FROM fw JOIN bw USING (event_id) JOIN obs USING (event_id) GROUP BY ALL HAVING count(*) FILTER (fw OR bw) > 0")
def g3_blackout_links(spark, d):
    return blackout.blackout_minutes(blackout.blackout_mask(observations(spark, d), -52), least=0)


# --- space


@query(f"WITH {_L} SELECT cml_id, round(length_km, 6) AS length_km FROM links")
def p1_haversine(spark, d):
    return links(spark, d).select("cml_id", haversine(F.col("site_a_lon"), F.col("site_a_lat"), F.col("site_b_lon"), F.col("site_b_lat")).alias("length_km")).select("cml_id", _r("length_km"))


_POINTS = "pt AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 11 <> 0 THEN embedding[3]::DOUBLE END AS z FROM embeddings)"
_GRID = "gr AS (SELECT j::INT AS yi, i::INT AS xi, -0.25 + i * 0.05 AS x, -0.25 + j * 0.05 AS y FROM range(11) a(i), range(11) b(j))"


def _points(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    e = lambda i: F.col("embedding")[i].cast("double")
    return v.select(F.col("vec_id").alias("point_id"), e(0).alias("x"), e(1).alias("y"), F.when(F.col("vec_id") % 11 != 0, e(2)).alias("z"))


def _grid(spark):
    return spatial.make_grid(spark, (-0.2, 0.22), (-0.2, 0.22), 0.05)


def _idw(where: str, nnear: int = 8, power: str = "d * d") -> str:
    return f"""WITH {_POINTS}, {_GRID}, dd AS (SELECT yi, xi, point_id, z, sqrt(pow(gr.x - pt.x, 2) + pow(gr.y - pt.y, 2)) AS d FROM gr, pt WHERE z IS NOT NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY yi, xi ORDER BY d, point_id) AS k FROM dd WHERE {where}),
    v AS (SELECT yi, xi, sum(z / ({power})) / sum(1 / ({power})) AS value FROM rk WHERE k <= {nnear} GROUP BY ALL)
    SELECT gr.yi, gr.xi, round(value, 6) AS value FROM gr LEFT JOIN v USING (yi, xi)"""


@query(_idw("d < 0.1", 5, "d"))
def p4_interpolate(spark, d):
    return spatial.interpolate(_points(spark, d), _grid(spark), "idw", nnear=5, p=1, max_distance=0.1).select("yi", "xi", _r("value"))


@query(_idw("true"))
def p3_idw(spark, d):
    return spatial.interpolate_idw(_points(spark, d), _grid(spark), 8, 2).select("yi", "xi", _r("value"))


@query(_idw("d < 0.06"))
def p5_idw_max_distance(spark, d):
    return spatial.interpolate_idw(_points(spark, d), _grid(spark), 8, 2, 0.06).select("yi", "xi", _r("value"))


@query()
def p6_kriging(spark, d):
    p = _points(spark, d).withColumn("time", F.col("point_id") % 2)
    return spatial.interpolate_kriging(p, _grid(spark), "time", {"sill": 0.02, "range": 0.3, "nugget": 0.002}).select("yi", "xi", "time", _r("value"), _r("sigma"))


_GAMMA = "CASE WHEN {d} < 1e-10 THEN 0 WHEN {d} <= 0.3 THEN 0.018 * (1.5 * ({d} / 0.3) - 0.5 * pow({d} / 0.3, 3)) + 0.002 ELSE 0.02 END"


@query(
    f"""WITH {_POINTS}, {_GRID}, dd AS (SELECT yi, xi, point_id % 2 AS time, point_id, pt.x, pt.y, z, sqrt(pow(gr.x - pt.x, 2) + pow(gr.y - pt.y, 2)) AS d FROM gr, pt WHERE z IS NOT NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY yi, xi, time ORDER BY d, point_id) AS k FROM dd),
    g AS (SELECT a.yi, a.xi, a.time, a.z AS z1, b.z AS z2, {_GAMMA.format(d='a.d')} AS g1, {_GAMMA.format(d='b.d')} AS g2, {_GAMMA.format(d='sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))')} AS g12
      FROM rk a JOIN rk b ON a.yi = b.yi AND a.xi = b.xi AND a.time = b.time AND a.k = 1 AND b.k = 2),
    w AS (SELECT *, 0.5 + (g2 - g1) / (2 * g12) AS w1 FROM g)
    SELECT yi, xi, time, round(w1 * z1 + (1 - w1) * z2, 6) AS value, round(w1 * g1 + (1 - w1) * g2 + g1 - (1 - w1) * g12, 6) AS sigma FROM w"""
)
def p6_kriging_closest(spark, d):
    """Kriging of the two closest points, whose systems have a closed form."""
    p = _points(spark, d).withColumn("time", F.col("point_id") % 2)
    return spatial.interpolate_kriging(p, _grid(spark), "time", {"sill": 0.02, "range": 0.3, "nugget": 0.002}, n_closest=2).select("yi", "xi", "time", _r("value"), _r("sigma"))


@query(f"WITH {_GRID} SELECT yi, xi, round(x, 9) AS x, round(y, 9) AS y FROM gr")
def p7_grid(spark, d):
    return _grid(spark).select("yi", "xi", _r("x", 9), _r("y", 9))


_VARIOGRAM = """SELECT DISTINCT time::DATE AS day FROM obs"""


@query(
    f"""WITH {_O}, y AS (SELECT day, dayofyear(day)::DOUBLE AS j FROM ({_VARIOGRAM})),
    v AS (SELECT day, pow(0.84 + 0.20 * cos(2 * pi() / 365 * (j - 162)), 4) AS sill, pow(15.51 + 2.06 * cos(2 * pi() / 365 * (j - 7.37)), 4) / 1000 AS reach FROM y)
    SELECT dayofyear(day)::INT AS day, round(sill, 6) AS sill, round(reach, 6) AS range, round(0.1 * sill, 6) AS nugget FROM v"""
)
def p8_variogram(spark, d):
    days = observations(spark, d).select(F.to_date("time").alias("date")).distinct()
    v = climatological_variogram(F.col("date"), F.lit(1.0))
    return days.select(F.dayofyear("date").alias("day"), *(c.alias(n) for n, c in v.items())).select("day", *map(_r, v))


_MAP = "gr AS (SELECT j::INT AS yi, i::INT AS xi, 6.99 + i * 0.01 AS x, 49.99 + j * 0.01 AS y FROM range(16) a(i), range(12) b(j))"


def _map(spark):
    return spatial.make_grid(spark, (7.0, 7.135), (50.0, 50.095), 0.01)


@query(
    f"""WITH {_L}, {_MAP}, s AS (SELECT yi, xi, x, y, site_a_lon AS ax, site_a_lat AS ay, site_b_lon - site_a_lon AS dx, site_b_lat - site_a_lat AS dy FROM gr, links),
    u AS (SELECT *, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t FROM s)
    SELECT yi, xi, bool_or(sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2)) <= 0.0043) AS covered FROM u GROUP BY ALL"""
)
def p9_coverage(spark, d):
    return spatial.coverage(_map(spark), links(spark, d), 0.0043).select("yi", "xi", "covered")


# Liang-Barsky: the part of a path inside of a cell
_LOW, _SIDE = 0.0037, 0.01
_CLIP = f"""{_MAP}, c AS (SELECT cml_id, yi, xi, site_b_lon - site_a_lon AS dx, site_b_lat - site_a_lat AS dy, x - {_SIDE / 2} + {_LOW} - site_a_lon AS lx, y - {_SIDE / 2} + {_LOW} - site_a_lat AS ly FROM gr, links),
wt AS (SELECT cml_id, yi, xi, least(1, greatest(lx / dx, (lx + {_SIDE}) / dx), greatest(ly / dy, (ly + {_SIDE}) / dy)) - greatest(0, least(lx / dx, (lx + {_SIDE}) / dx), least(ly / dy, (ly + {_SIDE}) / dy)) AS weight FROM c),
wp AS (SELECT * FROM wt WHERE weight > 1e-9)"""


def _path_weights(spark, d):
    return spatial.path_weights(links(spark, d), 6.99 + _LOW, 49.99 + _LOW, _SIDE, 16, 12)


@query(f"WITH {_L}, {_CLIP} SELECT cml_id, yi, xi, round(weight, 6) AS weight FROM wp")
def p10_path_weights(spark, d):
    return _path_weights(spark, d).where("weight > 1e-9").select("cml_id", "yi", "xi", _r("weight"))


_FIELD = f"fd AS (SELECT yi, xi, hour AS time, (yi * 7 + xi * 3 + hour) % 10 / 4.0::DOUBLE AS value FROM gr, (SELECT DISTINCT {_SIX} AS hour FROM obs))"


def _field(spark, d):
    times = observations(spark, d).select((F.floor(hours() / 6) * 6).alias("time")).distinct()
    value = (F.col("yi") * 7 + F.col("xi") * 3 + F.col("time")) % 10 / F.lit(4.0)
    return _map(spark).select("yi", "xi").join(times, F.lit(True)).withColumn("value", value)


@query(f"WITH {_O}, {_L}, {_CLIP}, {_FIELD} SELECT cml_id, time, round(sum(value * weight), 6) AS value FROM fd JOIN wp USING (yi, xi) GROUP BY ALL")
def p11_along_paths(spark, d):
    return spatial.along_paths(_field(spark, d), _path_weights(spark, d)).select("cml_id", "time", _r("value"))


@query(f"WITH {_O}, {_L}, {_CLIP}, {_FIELD} SELECT cml_id, time, round(sum(value * weight), 6) AS value FROM fd JOIN wp USING (yi, xi) WHERE time > 473400 AND time < 473700 GROUP BY ALL")
def v6_grid_series(spark, d):
    periods = links(spark, d).select("cml_id", F.lit(473400).cast("bigint").alias("start"), F.lit(473700).cast("bigint").alias("stop"))
    return spatial.series_within_period(_field(spark, d), _path_weights(spark, d), periods).select("cml_id", "time", _r("value"))


# --- scores and time

_SCORED = "x AS (SELECT cml_id, CASE WHEN event_id % 13 <> 0 THEN value / 100 END AS r, CASE WHEN event_id % 17 <> 0 THEN -rsl - 42 END AS p FROM obs)"


def _scored(spark, d):
    df = observations(spark, d)
    return df.select("cml_id", F.when(F.col("event_id") % 13 != 0, F.col("value") / 100).alias("reference"), F.when(F.col("event_id") % 17 != 0, -F.col("rsl") - 42).alias("predicted"))


_BOOLS = "y AS (SELECT cml_id, CASE WHEN r IS NOT NULL THEN (r > 2)::INT END AS r, CASE WHEN p IS NOT NULL THEN (p > 8)::INT END AS p FROM x)"


def _bools(spark, d):
    return _scored(spark, d).select("cml_id", (F.col("reference") > 2).cast("double").alias("reference"), (F.col("predicted") > 8).cast("double").alias("predicted"))


_V1 = """c AS (SELECT cml_id, count(*) FILTER (r = 1 AND p = 1) AS tp, count(*) FILTER (r = 0 AND p = 0) AS tn, count(*) FILTER (r = 0 AND p = 1) AS fp, count(*) FILTER (r = 1 AND p = 0) AS fn,
count(*) AS n, count(*) FILTER (r IS NULL OR p IS NULL) AS nn, count(*) FILTER (r IS NULL) AS nr, count(*) FILTER (p IS NULL) AS np FROM y GROUP BY ALL)"""


@query(
    f"""WITH {_O}, {_SCORED}, {_BOOLS}, {_V1} SELECT cml_id, round(fp / (fp + tn), 6) AS false_wet_rate, round(fn / (fn + tp), 6) AS missed_wet_rate,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS matthews_correlation, round(tp / (fn + tp), 6) AS true_wet_rate, round(tn / (fp + tn), 6) AS true_dry_rate,
    fp + tn AS N_dry_reference, fn + tp AS N_wet_reference, tp AS N_true_wet, tn AS N_true_dry, fp AS N_false_wet, fn AS N_missed_wet, n AS N_all_pairs, nn AS N_nan_pairs, nr AS N_nan_reference_only, np AS N_nan_predicted_only FROM c"""
)
def v1_wet_dry_metrics(spark, d):
    df = metrics.wet_dry_metrics(_bools(spark, d), by=("cml_id",))
    return df.select("cml_id", *(_r(c) if "rate" in c or "corr" in c else c for c in df.columns[1:]))


@query(
    f"""WITH {_O}, {_SCORED}, z AS (SELECT cml_id, CASE WHEN p IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN p END AS p, r IS NULL AS nr, p IS NULL AS np FROM x)
    SELECT cml_id, round(corr(r, p), 6) AS pearson_correlation, round(stddev_pop(p - r) / avg(r), 6) AS coefficient_of_variation, round(sqrt(avg((p - r) * (p - r))), 6) AS root_mean_square_error, round(avg(abs(p - r)), 6) AS mean_absolute_error,
    round(sum(r), 5) AS R_sum_reference, round(sum(p), 5) AS R_sum_predicted, round(avg(r), 6) AS R_mean_reference, round(avg(p), 6) AS R_mean_predicted,
    round(count(*) FILTER (r <= 2 AND p > 2) / nullif(count(*) FILTER (r <= 2), 0), 6) AS false_wet_rate, round(count(*) FILTER (r > 2 AND p <= 2) / nullif(count(*) FILTER (r > 2), 0), 6) AS missed_wet_rate,
    round(avg(p) FILTER (r <= 2 AND p > 2), 6) AS false_wet_precipitation_rate, round(avg(r) FILTER (r > 2 AND p <= 2), 6) AS missed_wet_precipitation_rate, 2.0::DOUBLE AS rainfall_threshold_wet,
    count(*) AS N_all_pairs, count(*) FILTER (nr OR np) AS N_nan_pairs, count(*) FILTER (nr) AS N_nan_reference_only, count(*) FILTER (np) AS N_nan_predicted_only FROM z GROUP BY ALL"""
)
def v2_rain_metrics(spark, d):
    df = metrics.rain_metrics(_scored(spark, d), 2.0, by=("cml_id",))
    return df.select("cml_id", *(c if c.startswith("N_") else _r(c, 5 if "sum" in c else 6) for c in df.columns[1:]))


@query(f"WITH {_O}, {_SCORED}, {_BOOLS}, {_V1} SELECT round(sum(fp) / sum(fp + tn), 6) AS false_wet_rate, round(sum(fn) / sum(fn + tp), 6) AS missed_wet_rate FROM c")
def v3_wet_error_rates(spark, d):
    return metrics.wet_error_rates(_bools(spark, d)).select(_r("false_wet_rate"), _r("missed_wet_rate"))


@query(f"WITH {_O}, {_SCORED}, {_BOOLS}, {_V1} SELECT round(sum(fp) / sum(fp + tn), 6) AS wet_error, round(sum(fn) / sum(fn + tp), 6) AS dry_error FROM c")
def v4_wet_dry_error(spark, d):
    return metrics.wet_dry_error(_bools(spark, d)).select(_r("wet_error"), _r("dry_error"))


@query(f"WITH {_O}, h AS (SELECT cml_id, channel_id, {_SIX} AS hour, avg(value) AS v FROM obs GROUP BY ALL) SELECT round(corr(a.v, b.v), 6) AS pearson_correlation FROM h a JOIN h b ON a.cml_id = b.cml_id AND a.hour = b.hour AND a.channel_id = '0' AND b.channel_id = '1'")
def v5_series_correlation(spark, d):
    df = timeseries.resample(observations(spark, d), "6 hours", {"v": F.avg("value")}, dense=False)
    return metrics.series_correlation(df.where("channel_id = '0'"), df.where("channel_id = '1'"), "v", "v", ("cml_id", "time")).select(_r("pearson_correlation"))


def _index(spark, d):
    """Whole hours that have observations."""
    return observations(spark, d).select(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).distinct()


_INDEX = "ix AS (SELECT DISTINCT date_trunc('hour', time) AS t FROM obs)"


@query(f"WITH {_O}, {_INDEX} SELECT cml_id, epoch_us(t) AS at, round(avg(value), 6) AS value FROM obs ASOF JOIN ix ON ix.t <= obs.time GROUP BY ALL")
def v7_resample_to(spark, d):
    df = temporal.resample_to(observations(spark, d), _index(spark, d), ["value"], "left", ("cml_id",))
    return df.select("cml_id", F.unix_micros(F.col("time").cast("timestamp")).alias("at"), _r("value"))


@query(
    f"""WITH {_O}, {_INDEX}, sp AS (SELECT greatest((SELECT min(time) FROM obs), (SELECT min(t) FROM ix)) AS a, least((SELECT max(time) FROM obs), (SELECT max(t) FROM ix)) AS b)
    SELECT epoch_us(t) AS at, round(max(value), 6) AS top, count(*) AS n FROM (SELECT obs.* FROM obs, sp WHERE time BETWEEN a AND b) o ASOF JOIN ix ON ix.t >= o.time GROUP BY ALL"""
)
def t1_aggregate_onto(spark, d):
    df = temporal.aggregate_onto(observations(spark, d), _index(spark, d), {"top": F.max("value"), "n": F.count("*")})
    return df.select(F.unix_micros(F.col("time").cast("timestamp")).alias("at"), _r("top"), "n")


@query(f"WITH {_O} SELECT event_id, round(value - avg(value) OVER (PARTITION BY cml_id, channel_id), 6) AS x FROM obs")
def t3_apply_along_time(spark, d):
    return apply_along_time(observations(spark, d), lambda v: v - v.mean(), {"v": "value"}, "x").select("event_id", (F.round("x", 6) + 0.0).alias("x"))


@query()
def s2_example_network(spark, d):
    return synthetic.example_observations(spark, 5, 0.5).groupBy("cml_id", "channel_id").agg(F.count("*").alias("n"), F.round(F.avg("rsl"), 6).alias("rsl"))


@query(f"WITH {_O} SELECT event_id, cml_id, tsl, rsl FROM obs WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-08'")
def s4_write_by_date(spark, d):
    """Observations written by date and read again for three days, whose folders alone are scanned."""
    path = files.scratch(spark)
    files.write_by_date(observations(spark, d), path)
    days = F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-07").cast("date"))
    return files.read_observations(spark, path).where(days).select("event_id", "cml_id", "tsl", "rsl")


@query(f"WITH {_O} SELECT cml_id, channel_id, epoch_us(time) * 1000 AS time_ns, tsl, rsl FROM obs")
def s9_csv(spark, d):
    path = files.scratch(spark)
    made = observations(spark, d).withColumn("time_ns", F.unix_micros(F.col("time").cast("timestamp")) * 1000)
    made.select("cml_id", "channel_id", "time", "time_ns", "tsl", "rsl").write.option("header", True).csv(path)
    return files.read_csv(spark, path).select("cml_id", "channel_id", "time_ns", "tsl", "rsl")


# --- chains

_FLAG = f"""{_T}, {_GAP}, s AS (SELECT * EXCLUDE (wet), CASE WHEN count(trsl) OVER c = 12 THEN stddev_pop(trsl) OVER c END AS dev, row_number() OVER w AS i FROM filled WINDOW c AS ({SERIES} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), w AS ({SERIES})),
i AS (SELECT *, coalesce(dev > 5, false) AS x FROM s),
b1 AS (SELECT a.*, b.trsl AS baseline FROM (SELECT *, max(CASE WHEN NOT x OR i = 1 THEN i END) OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM i {_W}) a JOIN i b ON a.cml_id = b.cml_id AND a.channel_id = b.channel_id AND a.k = b.i),
{_WAA.format(src='b1', wet='x', top='2.2')}, {_AB},
rr AS (SELECT b1.*, length_km, a, b, CASE WHEN b1.trsl - baseline - waa < 0 THEN 0 ELSE b1.trsl - baseline - waa END AS att FROM b1 JOIN rec USING (cml_id, channel_id, i) JOIN pl USING (cml_id))"""


def _flagship(spark, d):
    return flows.levels_to_rain(observations(spark, d), links(spark, d), gap_seconds=6 * 3600, rows=12, threshold=5.0)


@query(f"WITH RECURSIVE {_FLAG} SELECT cml_id, channel_id, {_HOUR} + 1 AS hour, round(avg({_rate('att')}), 5) AS rain FROM rr GROUP BY ALL")
def flagship_hourly_rain(spark, d):
    return flows.hourly_rain(_flagship(spark, d)).select("cml_id", "channel_id", hours().alias("hour"), _r("rain", 5))


@query(
    f"""WITH RECURSIVE {_FLAG}, {_MAP}, fr AS (SELECT cml_id, channel_id, count(*) FILTER (x)::DOUBLE / count(*) AS wf FROM rr GROUP BY ALL),
    sm AS (SELECT cml_id, sum(CASE WHEN wf < 0.95 THEN {_rate('att')} END) AS z FROM rr JOIN fr USING (cml_id, channel_id) GROUP BY ALL),
    dd AS (SELECT yi, xi, cml_id, z, sqrt(pow(x - (site_a_lon + site_b_lon) / 2, 2) + pow(y - (site_a_lat + site_b_lat) / 2, 2)) AS d FROM gr, sm JOIN links USING (cml_id) WHERE z IS NOT NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY yi, xi ORDER BY d, cml_id) AS k FROM dd WHERE d < 0.05),
    v AS (SELECT yi, xi, sum(z / (d * d)) / sum(1 / (d * d)) AS value FROM rk WHERE k <= 5 GROUP BY ALL)
    SELECT gr.yi, gr.xi, round(value, 4) AS value FROM gr LEFT JOIN v USING (yi, xi)"""
)
def flagship_rain_map(spark, d):
    """Rain sums of the links with few wet rows, on a grid."""
    df = timeseries.keep_quiet_links(_flagship(spark, d), "rain", 0.95)
    sums = df.groupBy("cml_id").agg(F.sum("rain").alias("z"))
    at = timeseries.centre(links(spark, d)).select("cml_id", "lon", "lat")
    points = sums.join(at, "cml_id").select(F.col("cml_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "z")
    return spatial.interpolate_idw(points, _map(spark), 5, 2, 0.05).select("yi", "xi", _r("value", 4))


_CHAIN = f"""{_O}, {_L}, {_D}, {_LEVELS}, {_NEARBY.replace('nw AS', 'lw AS')}, pf AS (SELECT *, median(CASE WHEN wet = 0 THEN (pmin + pmax) / 2 END) OVER ({_SERIES6} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS pref FROM lw), {_CORRECTED}, {_nodes()}"""


@query(f"WITH {_CHAIN} SELECT cml_id, channel_id, hour, wet::DOUBLE AS wet, round(pref, 6) AS pref, round({_alpha('F')}, 5) AS rain FROM co JOIN ab USING (frequency_ghz, polarization)")
def nearby_chain_rain(spark, d):
    df = flows.nearby_levels_to_rain(_levels(spark, d), links(spark, d), 5, 360, thresh_median_p=-4.0, thresh_median_pl=-1.0, min_hours=12)
    return df.select("cml_id", "channel_id", hours().alias("hour"), "wet", _r("pref"), _r("rain", 5))
