"""Operators over series against plain loops and published example values.

Numbers that results are compared with, where no loop makes them, are fixed values: published example results.
"""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkrain.functions.geo import haversine
from linkrain.operators import baseline, blackout, nearby, temporal, timeseries, wetdry

SCHEMA = "cml_id string, channel_id string, time int, trsl double, wet double"


def frame(spark, series, schema=SCHEMA):
    """One series for each list of value rows."""
    return spark.createDataFrame([(str(s), "1", t, *v) for s, rows in enumerate(series) for t, v in enumerate(rows)], schema)


def column(df, name, s=0):
    return np.array([r[name] for r in df.where(F.col("cml_id") == str(s)).orderBy("time").collect()], float)


def some_series(n=6, rows=90, seed=3, null_wet=0.1, null_value=0.1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        wet, made = rng.random() < 0.5, []
        for _ in range(rows):
            if rng.random() < 0.2:
                wet = not wet
            w = None if rng.random() < null_wet * (k % 3 > 0) else float(wet or k == 5)
            v = None if rng.random() < null_value * (k % 2) else round(rng.uniform(40, 60), 3)
            made.append((v, w))
        out.append(made)
    return out


def plain_constant(values, wet, n):
    """Row by row: the definition."""
    out = list(values[:n])
    for i in range(n, len(values)):
        if wet[i] and not wet[i - 1]:
            out.append(float(np.mean(out[i - n : i])))
        else:
            out.append(out[i - 1] if wet[i] else values[i])
    return np.array(out, float)


@pytest.mark.parametrize("n", [1, 3])
def test_constant_baseline(spark, n):
    data = some_series()
    got = baseline.baseline_constant(frame(spark, data), n=n).cache()
    for s, rows in enumerate(data):
        v = [np.nan if x is None else x for x, _ in rows]
        w = [x is None or x != 0 for _, x in rows]
        np.testing.assert_allclose(column(got, "baseline", s), plain_constant(v, w, n), rtol=1e-12)


def plain_linear(values, wet, ignore):
    """Events and their anchors, one at a time."""
    n, state = len(values), [False]
    for w in wet[1:]:
        state.append((state[-1] if ignore else None) if w is None else w != 0)
    out = [0.0] * n
    dry = [i for i, s in enumerate(state) if s is False or i == 0]
    for a in dry:
        out[a] = values[a]
    for a, b in zip(dry, dry[1:]):
        if b > a + 1:
            spoiled = any(state[i] is None for i in range(a + 1, b))
            for i in range(a, b + 1):
                if spoiled:
                    out[i] = np.nan
                elif i not in (a, b):
                    out[i] = values[a] + (values[b] - values[a]) * (i - a) / (b - a)
                elif i == a or i == b:
                    out[i] = values[i]
    return np.array(out, float)


@pytest.mark.parametrize("ignore", [False, True])
def test_linear_baseline(spark, ignore):
    data = some_series(null_value=0)
    got = baseline.baseline_linear(frame(spark, data), "trsl", ignore_nan=ignore).cache()
    for s, rows in enumerate(data):
        want = plain_linear([v for v, _ in rows], [w for _, w in rows], ignore)
        np.testing.assert_allclose(column(got, "baseline", s), want, rtol=1e-10)


@pytest.mark.parametrize("waa_max, delta_t, tau, at", [(1.5, 1, 15, [0, 1.106784, 1.48616494, 0.8, 0.8, 0]), (1.8, 5, 30, [0, 1.771875, 1.79999914, 0.8, 0.8, 0])])
def test_schleiss(spark, waa_max, delta_t, tau, at):
    trsl = [0.0] * 10 + [3.0] * 30 + [0.8] * 20 + [0.0] * 10
    df = frame(spark, [[(x, float(x > 1)) for x in trsl]]).withColumn("baseline", F.lit(0.0))
    got = column(baseline.waa_schleiss(df, waa_max=waa_max, delta_t=delta_t, tau=tau), "waa")
    np.testing.assert_allclose(got[[5, 15, 30, 40, 50, 65]], at, atol=1e-6)


@pytest.mark.parametrize("tau", [15, 2])
def test_schleiss_loop(spark, tau):
    data = some_series(seed=5)
    df = frame(spark, data).withColumn("baseline", F.lit(47.0))
    got = baseline.waa_schleiss(df, tau=tau).cache()
    for s, rows in enumerate(data):
        waa = [0.0]
        for v, w in rows[1:]:
            a, last = (np.nan if v is None else v - 47.0), waa[-1]
            top = np.nan if v is None else min(a, 2.3)
            waa.append(min(top, last + (2.3 - last) * 3 / tau) if w == 1 and last == last and top == top else top)
        np.testing.assert_allclose(column(got, "waa", s), waa, atol=1e-9)


def test_reference_level(spark):
    rows = list(zip(np.linspace(0, -30, 200).tolist(), np.linspace(0, 10, 200).tolist(), [1.0] * 100 + [0.0] * 100))
    df = frame(spark, [rows], "cml_id string, channel_id string, time int, pmin double, pmax double, wet double")
    got = column(baseline.reference_level(df), "pref")
    assert np.isnan(got[:100]).all()
    np.testing.assert_allclose([got[100], got[-1]], [-5.02512563, -7.61306533], atol=1e-7)


def test_blackout(spark):
    x = [-63, -66, -67, -69, -64, None, -64, -66, -70, None, -70, -68]
    data = [x, [None, *x[1:]], [*x[:-1], None]]
    df = frame(spark, [[(None if v is None else float(v),) for v in d] for d in data], "cml_id string, channel_id string, time int, rsl double").cache()
    got = blackout.blackout_mask(df, -65)
    hit = [np.flatnonzero(column(got, "blackout", s)).tolist() for s in range(3)]
    assert hit == [[9], [0, 9], [9]]
    marks = blackout.gap_markers(df, -65)
    forward = blackout.mask_from_markers(marks)
    assert np.flatnonzero(column(forward, "blackout", 0)).tolist() == [9]


def test_distances(spark):
    links = spark.createDataFrame([(f"id{i}", x, x, 0.0, 0.0) for i, x in enumerate([0.0, 0.01, 0.02, 0.5])], "cml_id string, site_a_lat double, site_a_lon double, site_b_lat double, site_b_lon double")
    d = {(r.cml_id1, r.cml_id2): r.aa for r in nearby.endpoint_distances(links).collect()}
    np.testing.assert_allclose([d["id0", "id1"], d["id0", "id2"], d["id0", "id3"], d["id1", "id3"], d["id2", "id3"], d["id0", "id0"]], [1.57154642, 3.14309282, 78.57682262, 77.0052762, 75.4337298, 0], atol=1e-5)


@pytest.mark.parametrize("centre", [(7.0, 50.0), (179.95, 10.0), (0.0, 88.0)])
def test_neighbours_are_those_of_the_matrix(spark, centre):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a = (centre[0] + rng.uniform(-0.4, 0.4), centre[1] + rng.uniform(-0.4, 0.4))
        rows.append((str(i), (a[0] + 180) % 360 - 180, a[1], (a[0] + rng.uniform(-0.05, 0.05) + 180) % 360 - 180, a[1] + 0.02))
    links = spark.createDataFrame(rows, "cml_id string, site_a_lon double, site_a_lat double, site_b_lon double, site_b_lat double")
    full = nearby.endpoint_distances(links).where("aa < 15 and ab < 15 and ba < 15 and bb < 15").select("cml_id1", "cml_id2")
    got = [tuple(r) for r in nearby.neighbours(links, 15).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in full.collect()}


def test_nearby_wetdry(spark):
    lin = np.linspace
    p = np.concatenate([np.full(1460, -40.0), lin(-40, -60, 15), lin(-60, -40, 25), np.full(60, -40.0), lin(-40, -50, 300), lin(-50, -40, 60), np.full(60, -40.0), lin(-40, -70, 20), lin(-70, -40, 20), np.full(30, -40.0)])
    coords = [("id0", 0.0, 0.005, 0.01), ("id1", 0.01, 0.02, 0.02), ("id2", 0.02, 0.0, 0.03), ("id3", 0.5, 0.512, 0.51), ("id4", -0.075, 0.075, 0.075)]
    links = spark.createDataFrame([(i, a, a, b, c) for i, a, b, c in coords], "cml_id string, site_a_lat double, site_a_lon double, site_b_lat double, site_b_lon double")
    lengths = links.select("cml_id", haversine(F.col("site_a_lon"), F.col("site_a_lat"), F.col("site_b_lon"), F.col("site_b_lat")).alias("length_km"))
    rows = [(i, "1", t, float(v)) for i, *_ in coords for t, v in enumerate(p)]
    df = spark.createDataFrame(rows, "cml_id string, channel_id string, time int, pmin double").join(lengths, "cml_id")
    got = nearby.nearby_wetdry(df, links, 15, -2.0, -0.3).cache()
    far = got.where("cml_id = 'id3'").agg(F.count("wet"), F.count("F")).first()
    assert tuple(far) == (0, 0)
    near = got.where("cml_id = 'id0'").orderBy("time").toPandas()
    assert near.wet.iloc[-2:].tolist() == [1, 1] and near.wet.iloc[23:24].notna().all() and near.wet.iloc[:23].isna().all()
    assert near.wet.iloc[-100:-1].tolist() == [0] * 30 + [1] * 39 + [0] * 29 + [1]
    assert got.agg(F.sum("F")).first()[0] == pytest.approx(7086.41961, abs=1e-5)
    assert got.where("cml_id = 'id4'").agg(F.sum("wet")).first()[0] == 328
    plain = nearby.nearby_wetdry(df, links, 15, -2.0, -0.3, compat_edges=False)
    a = got.where("cml_id = 'id0'").agg(F.sum("wet")).first()[0]
    assert a - plain.where("cml_id = 'id0'").agg(F.sum("wet")).first()[0] == 2


def test_corrected_levels_and_rain(spark):
    pmin, pmax = np.linspace(0, -30, 100), np.linspace(0, -20, 100)
    wet = np.array([0.0] * 50 + [1.0] * 50)
    wet[85] = 0
    f = np.full(100, -20.0)
    f[20] = -44
    df = spark.createDataFrame([(i, float(a), float(b), float(w), float(x)) for i, (a, b, w, x) in enumerate(zip(pmin, pmax, wet, f))], "i int, pmin double, pmax double, wet double, f double")
    low, high = nearby.corrected_levels(F.col("pmin"), F.col("pmax"), F.col("wet"), F.lit(-4.0))
    df = df.withColumns({"lo": low, "hi": high}).orderBy("i")
    r = nearby.nearby_rain(F.lit(-4.0), F.col("lo"), F.col("hi"), F.col("f"), F.lit(5.0), F.lit(25.0), F.lit("V"))
    got = np.array([x[0] for x in df.select(r).collect()], float)
    assert np.isnan(got[20]) and got[85] == 0
    np.testing.assert_allclose(got[[50, 99]], [7.96550311, 26.24290154], atol=1e-6)
    r = nearby.nearby_rain(F.lit(-4.0), F.col("lo"), F.col("hi"), F.col("f"), F.lit(5.0), a=F.lit(1.0), b=F.lit(1.0))
    got = np.array([x[0] for x in df.select(r).collect()], float)
    np.testing.assert_allclose(got[[50, 99]], [1.09353535, 3.4], atol=1e-7)
    with pytest.raises(ValueError):
        nearby.nearby_rain(F.lit(-4.0), F.col("lo"), F.col("hi"), F.col("f"), F.lit(5.0), f_ghz=F.lit(25.0), a=F.lit(1.0))


def test_interpolation_gaps(spark):
    x = [None, 1.0, None, None, 4.0, None, None, None, None, 9.0, None]
    df = spark.createDataFrame([("0", "1", t * 60, v) for t, v in enumerate(x)], "cml_id string, channel_id string, s int, v double").withColumn("time", F.timestamp_seconds("s"))
    got = [r["v"] for r in timeseries.interpolate(df, "v", 180).orderBy("time").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, None, 9.0, None]


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=60)
    v[[7, 30]] = np.nan
    df = frame(spark, [[(None if np.isnan(x) else float(x),) for x in v]], "cml_id string, channel_id string, time int, v double")
    s = pd.Series(v)
    for rows in (6, 7):
        np.testing.assert_allclose(column(timeseries.rolling(df, "v", rows, "std", "o", centre=True), "o"), s.rolling(rows, center=True).std(ddof=0), atol=1e-12)
        np.testing.assert_allclose(column(timeseries.rolling(df, "v", rows, "max", "o", min_rows=2), "o"), s.rolling(rows, min_periods=2).max(), atol=1e-12)


def test_resample_is_dense(spark):
    df = spark.createDataFrame([("a", "1", "2024-01-01 00:10:00", 1.0), ("a", "1", "2024-01-01 00:50:00", 3.0), ("a", "1", "2024-01-01 03:00:00", 5.0)], "cml_id string, channel_id string, time string, v double").withColumn("time", F.to_timestamp_ntz("time"))
    got = timeseries.resample(df, "1 hour", {"m": F.avg("v"), "s": F.sum("v")}, label="right", zero=["s"]).orderBy("time").collect()
    assert [(r.time.hour, r.m, r.s) for r in got] == [(1, 2.0, 4.0), (2, None, 0.0), (3, None, 0.0), (4, 5.0, 5.0)]


def test_edges_and_debounce(spark):
    df = frame(spark, [[(0.0, w) for w in (0.0, 1.0, 1.0, 0.0, None, 1.0, 0.0)]])
    got = timeseries.event_edges(df).orderBy("time").collect()
    assert [r.event for r in got] == [None, 1, 1, None, None, 2, None]
    assert [r.starts for r in got] == [True, False, False, False, True, False, False]
    assert [r.ends for r in got] == [False, False, False, True, False, False, True]
    t = spark.createDataFrame([("a", s) for s in (0, 100, 5000, 5100, 9000)], "cml_id string, s int").withColumn("time", F.timestamp_seconds("s"))
    assert sorted(r.s for r in timeseries.debounce(t, 3600).collect()) == [100, 5100, 9000]


def test_min_max_attenuation(spark):
    rng = np.random.default_rng(2)
    tx = np.round(rng.uniform(10, 20, (2, 40)), 0)
    rx = np.round(rng.uniform(-60, -40, (2, 40)), 0)
    tx.sort(axis=0), rx.sort(axis=0)
    rx[0, 11] = np.nan
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in np.vstack([tx, rx]).T]
    df = frame(spark, [rows], "cml_id string, channel_id string, time int, tx_min double, tx_max double, rx_min double, rx_max double")
    high, low = tx[1] - rx[0] - 0.8, tx[0] - rx[1] + 0.8
    high[np.isnan(high)] = np.rint(np.nanmean(high))
    want = [np.nan] * 7 + [max(0.0, high[i] - low[i - 7 : i + 1].min()) for i in range(7, 40)]
    np.testing.assert_allclose(column(nearby.attenuation_min_max(df), "att_max"), want, atol=1e-9)


def test_stft(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, 900)
    x[600:760] -= 8 * np.sin(np.linspace(0, np.pi, 160))
    wet, info = wetdry.stft_values(x, window_length=64, threshold=1.5, f_divide=1e-3, dry_length=300)
    assert wet[640:720].mean() > 0.8 and wet[50:500].mean() < 0.1
    assert np.isnan(info["P_sum_diff"][:31]).all() and not wet[:31].any()
    direct = np.abs(np.fft.rfft(x[100:164] * np.hamming(64))) ** 2
    got = info["Pxx"][1:-1, 100 + 31]
    np.testing.assert_allclose(got / got[0], direct[1:-1] / direct[1], rtol=1e-9)
    with pytest.raises(AttributeError):
        wetdry.stft_values(x, window_length=64, dry_length=100, t_dry_start=1)
    df = frame(spark, [[(float(v),) for v in x]], "cml_id string, channel_id string, time int, rsl double")
    out = wetdry.stft_wet(df, window_length=64, threshold=1.5, dry_length=300)
    np.testing.assert_array_equal(column(out, "wet").astype(bool), wet)
    calm = wetdry.calmest_period(df, rows=300).first()
    assert (calm.dry_start, calm.dry_stop) == wetdry.calmest_values(x, 300)


@pytest.mark.parametrize("label", ["left", "right"])
def test_assign_times(spark, label):
    rng = random.Random(4)
    t, index = sorted(rng.randint(0, 100) for _ in range(50)), sorted({rng.randint(5, 95) for _ in range(12)})
    df = spark.createDataFrame([(i, x, float(x)) for i, x in enumerate(t)], "i int, time int, v double")
    got = {r.i: r.label_time for r in temporal.assign_times(df, spark.createDataFrame([(x,) for x in index], "time int"), label, width=9).collect()}
    for i, x in enumerate(t):
        side = [y for y in index if (y >= x if label == "right" else y <= x)]
        assert got[i] == ((min(side) if label == "right" else max(side)) if side else None)
