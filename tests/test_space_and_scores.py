"""Interpolation, coverage, path weights, metrics, learned models, streams, readers.

Numbers that results are compared with, where no loop makes them, are fixed values: published example results.
"""

import sys
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkrain.operators import metrics, models, spatial
from linkrain.sources import files, synthetic
from linkrain.sources import models as weights
from linkrain.streaming import levels


def points(spark, rows):
    return spark.createDataFrame([(str(i), float(x), float(y), None if z is None else float(z)) for i, (x, y, z) in enumerate(rows)], "point_id string, x double, y double, z double")


def grid_of(spark, xs, ys):
    return spark.createDataFrame([(j, i, float(x), float(y)) for j, y in enumerate(ys) for i, x in enumerate(xs)], "yi int, xi int, x double, y double")


def test_idw_grid(spark):
    p = points(spark, zip(range(1, 6), [2, 4, 3, 5, 1], range(1, 6)))
    g = grid_of(spark, [0, 2, 4, 6], [0, 2, 4, 6])
    got = spatial.interpolate_idw(p, g, 12, 2).orderBy("yi", "xi").toPandas().value.to_numpy()
    np.testing.assert_allclose(got[:4], [2.05352949, 2.54119688, 4.09027081, 4.42468505], atol=1e-7)
    none = points(spark, [(1, 2, None), (2, 3, None)])
    assert spatial.interpolate_idw(none, g, 12, 2).agg(F.count("value"), F.count("*")).first() == (0, 16)
    with pytest.raises(ValueError):
        spatial.interpolate_idw(p, g, 1)


@pytest.mark.parametrize("nnear, most", [(3, None), (4, 1.5), (12, 0.8)])
def test_idw_loop(spark, nnear, most):
    rng = np.random.default_rng(0)
    rows = rng.uniform(0, 5, (30, 3))
    rows[0, :2] = 2, 2
    g = grid_of(spark, range(6), range(6))
    got = spatial.interpolate_idw(points(spark, rows), g, nnear, 2, most).orderBy("yi", "xi").toPandas()
    for r in got.itertuples():
        d = np.hypot(rows[:, 0] - r.x, rows[:, 1] - r.y)
        own = [i for i in np.argsort(d)[:nnear] if most is None or d[i] < most]
        if not own:
            assert np.isnan(r.value)
        elif d[own[0]] < 1e-10:
            assert r.value == pytest.approx(rows[own[0], 2])
        else:
            w = d[own] ** -2.0
            assert r.value == pytest.approx((w * rows[own, 2]).sum() / w.sum())


def test_kriging(spark):
    rng = np.random.default_rng(3)
    x, y, z = rng.uniform(0, 10, (3, 12))
    v = {"sill": 2.0, "range": 5.0, "nugget": 0.1}
    value, sigma = spatial.kriging_values(x, y, z, x, y, v)
    np.testing.assert_allclose(value, z, atol=1e-8)
    np.testing.assert_allclose(sigma, 0, atol=1e-8)
    flat, _ = spatial.kriging_values(x, y, np.full(12, 3.0), np.array([1.0, 99.0]), np.array([2.0, 99.0]), v)
    np.testing.assert_allclose(flat, 3.0)
    all_, _ = spatial.kriging_values(x, y, z, np.array([4.0]), np.array([5.0]), v)
    near, _ = spatial.kriging_values(x, y, z, np.array([4.0]), np.array([5.0]), v, n_closest=12)
    np.testing.assert_allclose(all_, near)
    p = points(spark, zip(x, y, z)).withColumn("time", F.lit(1))
    g = grid_of(spark, [4.0], [5.0])
    out = spatial.interpolate_kriging(p, g, parameters=v).first()
    assert out.value == pytest.approx(all_[0])
    assert spatial.interpolate_kriging(p.withColumn("z", F.lit(None).cast("double")), g).first().value is None


def test_further_variogram_models():
    d = np.array([0.0, 0.5, 1.0, 4.0])
    v = {"sill": 1.5, "range": 3.0, "nugget": 0.5}
    np.testing.assert_allclose(spatial.semivariance(d, v, "hole-effect"), [0, *(0.5 + 1 - (1 - x) * np.exp(-x) for x in (0.5, 1.0, 4.0))])
    np.testing.assert_allclose(spatial.semivariance(d, {"scale": 2.0, "exponent": 1.5, "nugget": 0.5}, "power"), [0, *(0.5 + 2 * x**1.5 for x in (0.5, 1.0, 4.0))])


def test_nearest_points_by_levels_of_squares(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW", 0)
    rng = np.random.default_rng(4)
    at = np.vstack([rng.uniform(0, 1, (60, 2)), rng.uniform(40, 41, (30, 2)), [[500.0, 3.0]]])
    p = points(spark, [(*x, float(i)) for i, x in enumerate(at)]).withColumn("point_id", F.col("point_id").cast("int")).withColumn("t", F.col("point_id") % 2)
    g = grid_of(spark, [0.0, 0.4, 7.0, 40.2, 499.0], [0.0, 0.7, 40.5])
    got = spatial.nearest_points(g, p, 7, None, ("t",)).collect()
    found = {}
    for r in got:
        found.setdefault((r.yi, r.xi, r.t), []).append((r.d, r.point_id))
    for c in g.collect():
        for t in (0, 1):
            want = sorted((float(np.hypot(c.x - x, c.y - y)), i) for i, (x, y) in enumerate(at.tolist()) if i % 2 == t)[:7]
            assert [i for _, i in sorted(found[c.yi, c.xi, t])] == [i for _, i in want]
    assert spatial.nearest_points(g, p.limit(0), 7, None, ("t",)).count() == 0


def test_the_kriging_query_uses_all_points(spark, tmp_path):
    from linkrain.plans import registry

    rng = np.random.default_rng(8)
    v = rng.uniform(-0.2, 0.2, (260, 3)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.yi, r.xi, r.time): r.value for r in registry.QUERIES["p6_kriging"](spark, str(tmp_path)).collect()}
    ids = np.arange(260)
    for time in (0, 1):
        x, y, z = v[(ids % 2 == time) & (ids % 11 != 0)].astype(float).T
        cells = registry._grid(spark).collect()
        want, _ = spatial.kriging_values(x, y, z, np.array([c.x for c in cells]), np.array([c.y for c in cells]), {"sill": 0.02, "range": 0.3, "nugget": 0.002})
        np.testing.assert_allclose([got[c.yi, c.xi, time] for c in cells], want, atol=2e-6)


def test_large_kriging_maps_are_solved_without_a_task_for_all_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y, z = rng.normal(0, 0.125, (3, 300))
    x[5:8], y[5:8] = x[5], y[5]
    cx, cy = np.array([-0.1, 0.0, x[20], x[5], 9.0]), np.array([0.1, 0.0, y[20], y[5], 9.0])
    v = {"sill": 0.02, "range": 0.3, "nugget": 0.002}
    small = np.arange(300) < 40
    want = {t: spatial.kriging_values(x[own], y[own], z[own], *(a.ravel() for a in np.meshgrid(cx, cy)), v) for t, own in ((0, small), (1, ~small))}
    dense = spatial.kriging_values

    def few(x, *rest):
        assert len(x) <= 100
        return dense(x, *rest)

    monkeypatch.setattr(spatial, "DENSE", 100, raising=False)
    monkeypatch.setattr(spatial, "kriging_values", few)
    p = points(spark, zip(x, y, z)).withColumn("time", (F.col("point_id").cast("int") >= 40).cast("int"))
    got = spatial.interpolate_kriging(p, grid_of(spark, cx, cy), parameters=v).toPandas().sort_values(["time", "yi", "xi"])
    for t in (0, 1):
        np.testing.assert_allclose(got.loc[got["time"] == t, ["value", "sigma"]].to_numpy().T, want[t], atol=1e-8)


def test_kriging_with_a_fitted_variogram():
    x, y, z = np.arange(1, 6.0), np.array([2, 3, 3, 5, 3.0]), np.array([1, 2, 3, 4, 3.0])
    gx, gy = np.meshgrid(np.linspace(0, 6, 4), np.linspace(0, 6, 4))
    value, _ = spatial.kriging_values(x, y, z, gx.ravel(), gy.ravel(), None, nlags=10)
    want = [2.11825683, 2.14974322, 2.55817076, 2.54075673, 1.4905079, 1.70555872, 2.76440966, 2.5806816, 2.06495187, 2.60523688, 3.60004479, 2.90631718, 2.53986917, 2.93249053, 3.45374888, 2.90229311]
    np.testing.assert_allclose(value, want, atol=1e-7)


def test_coverage(spark):
    links = spark.createDataFrame([("a", 1.0, 1.0, 3.0, 2.0), ("b", 4.0, 4.0, 4.0, 4.0)], "cml_id string, site_a_lon double, site_a_lat double, site_b_lon double, site_b_lat double")
    g = grid_of(spark, np.arange(0, 5, 0.25), np.arange(0, 5, 0.25))
    got = spatial.coverage(g, links, 0.3).toPandas()
    a, b = np.array([1.0, 1.0]), np.array([3.0, 2.0])
    for r in got.itertuples():
        p = np.array([r.x, r.y])
        t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        assert r.covered == bool(np.linalg.norm(p - a - t * (b - a)) <= 0.3 or np.linalg.norm(p - 4) <= 0.3)


def test_path_weights_and_series(spark):
    links = spark.createDataFrame([("a", 0.2, 0.1, 3.4, 2.3), ("b", 1.0, 1.0, 1.0, 3.0), ("c", 2.0, 0.1, 2.0, 0.2)], "cml_id string, site_a_lon double, site_a_lat double, site_b_lon double, site_b_lat double")
    w = spatial.path_weights(links, 0.0, 0.0, 1.0, 5, 5).cache()
    sums = {r.cml_id: r.s for r in w.groupBy("cml_id").agg(F.sum("weight").alias("s")).collect()}
    assert all(s == pytest.approx(1) for s in sums.values())
    t = (np.arange(200_000) + 0.5) / 200_000
    x, y = 0.2 + 3.2 * t, 0.1 + 2.2 * t
    cells, n = np.unique(np.stack([np.floor(y + 0.5), np.floor(x + 0.5)]), axis=1, return_counts=True)
    want = {(int(a), int(b)): k / 200_000 for (a, b), k in zip(cells.T, n)}
    got = {(r.yi, r.xi): r.weight for r in w.where("cml_id = 'a'").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)
    field = spark.createDataFrame([(0, yi, xi, float(yi + xi)) for yi in range(5) for xi in range(5)], "time int, yi int, xi int, value double")
    along = {r.cml_id: r.value for r in spatial.along_paths(field, w).collect()}
    assert along["a"] == pytest.approx(sum((a + b) * k for (a, b), k in got.items()))


def test_grid_bounds(spark):
    g = spatial.make_grid(spark, (0.0, 1.0), (0.0, 0.5), 0.5)
    assert sorted({r.x for r in g.collect()}) == [-0.5, 0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        spatial.make_grid(spark, (0, 1), (0, 1), None)


def test_wet_dry_metrics(spark):
    t, f, n = 1.0, 0.0, None
    rows = list(zip([t, f, t, t, f, t, f, n, n, n], [t, f, f, t, t, t, t, t, f, n]))
    m = metrics.wet_dry_metrics(spark.createDataFrame(rows, "reference double, predicted double")).first()
    assert m.matthews_correlation == pytest.approx(0.09128709, abs=1e-7)
    assert (m.N_all_pairs, m.N_nan_pairs, m.N_nan_reference_only, m.N_nan_predicted_only) == (10, 3, 3, 1)
    none = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "reference double, predicted double")
    assert metrics.wet_dry_metrics(none).first().matthews_correlation == 0


def test_rain_metrics(spark):
    n = None
    rows = list(zip([1, 0, 1, 1, 1, 0, 1, 0, n, n, n], [1, 0, 0, 0, 1, 1, 0.01, 1, 1, 0, n]))
    rows = [tuple(None if x is None else float(x) for x in r) for r in rows]
    m = metrics.rain_metrics(spark.createDataFrame(rows, "reference double, predicted double"), 0.1).first()
    np.testing.assert_allclose([m.pearson_correlation, m.coefficient_of_variation, m.root_mean_square_error], [-0.256899818, 1.246767019, 0.788994613], atol=1e-8)


def test_mlp_windows(spark, tmp_path):
    v = np.linspace(0, 20, 480)
    rows = [("a", i, None if i == 304 else float(x), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cml_id string, time int, c1 double, c2 double")
    rng = np.random.default_rng(0)
    layers = [("dense", (rng.normal(size=(80, 4)), np.zeros(4))), ("relu", ()), ("dense", (rng.normal(size=(4, 2)), np.zeros(2))), ("softmax", ())]
    weights.save(layers, str(tmp_path / "m.npz"))
    loaded = weights.load(str(weights.resolve(str(tmp_path / "m.npz"))))
    out = models.mlp_wet_dry(df, ("c1", "c2"), loaded).orderBy("time").toPandas()
    ok = out.p_wet.notna().to_numpy()
    assert not ok[:40].any() and ok[40:304].all() and not ok[304:344].any() and ok[345:].all()
    np.testing.assert_allclose((out.p_dry + out.p_wet)[ok], 1, rtol=1e-6)
    with pytest.raises(ValueError):
        models.mlp_windows(df, ("c1", "c2"), "nothing")


def test_cnn_windows(spark):
    df = spark.createDataFrame([("a", i, 59.0, 56.0 + (i == 5)) for i in range(30)], "cml_id string, time int, tl1 double, tl2 double")
    rng = np.random.default_rng(0)
    layers = [("conv", (rng.normal(size=(3, 2, 4)), np.zeros(4))), ("relu", ()), ("meanpool", ()), ("dense", (rng.normal(size=(4, 1)), np.zeros(1))), ("sigmoid", ())]
    out = models.cnn_trailing(df, ["tl1", "tl2"], layers, length=18).orderBy("time").toPandas()
    assert out.p_wet.notna().tolist() == [i >= 17 for i in range(30)]
    scales = models.sample_scales(df, ["tl1", "tl2"], 18)
    held = np.array([[56.0 + (j == 5) for j in range(i - 17, i + 1)] for i in range(17, 30)])
    np.testing.assert_allclose(scales, [(59.0, 1.0), (held.mean(), held.std())])
    with pytest.raises(KeyError):
        models.cnn_trailing(df, ["tl1", "tl2"], layers, keys=("link",))
    out = models.cnn_centred(df, ["tl1", "tl2"], layers, length=18, reflength=6).orderBy("time").toPandas()
    assert out.p_wet.notna().tolist() == [15 <= i <= 27 for i in range(30)]


def test_model_names(tmp_path):
    for bad in ("x.pth", "x.pt2", "name"):
        with pytest.raises(ValueError):
            weights.resolve(bad)
    (tmp_path / "a.npz").write_bytes(b"")
    assert weights.list_cached(tmp_path) == ["a.npz"] and weights.clear_cache(tmp_path) == 1


def test_sources(spark, tmp_path):
    links = synthetic.example_links(spark, 4)
    obs = synthetic.example_observations(spark, 4, 0.1)
    assert links.count() == 4 and obs.count() == 4 * 2 * 144
    files.write_by_date(obs, str(tmp_path / "obs"))
    assert files.read_observations(spark, str(tmp_path / "obs")).count() == obs.count()
    assert synthetic.min_max(spark, 2, 0.1).count() > 0


def test_streams(spark, tmp_path):
    obs = pd.DataFrame({"cml_id": "a", "channel_id": "1", "time": pd.date_range("2024-01-01", periods=120, freq="min"), "trsl": np.arange(120.0), "wet": [int(30 <= i < 60) for i in range(120)]})
    for k in range(3):
        spark.createDataFrame(obs.iloc[k * 40 : (k + 1) * 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("cml_id string, channel_id string, time timestamp, trsl double, wet bigint").parquet(str(tmp_path / "in"))

    def drained(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).toPandas()

    bins = drained(levels.resample_stream(read(), "15 minutes", "1 minute", ["trsl"]), "bins")
    assert bins.trsl_n.tolist() == [15] * 7 and bins.trsl_min.min() == 0
    events = drained(levels.wet_sessions(read().withColumn("wet", F.when(F.col("trsl") == 119, 1).otherwise(F.col("wet"))), "5 minutes", "1 minute"), "wet_events")
    assert [(r.n_wet, (r.stop - r.start).total_seconds()) for r in events.itertuples()] == [(30, 29 * 60 + 300)]
    out = drained(levels.baseline_stream(read()), "base").sort_values("time")
    want = np.where((np.arange(120) >= 30) & (np.arange(120) < 60), 29.0, np.arange(120.0))
    np.testing.assert_allclose(out.baseline, want)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Queries that run Python in workers, from a folder in which the package can't be found."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from linkrain.plans.registry import QUERIES
for q in ("a3_waa_leijnse_from_observed", "a5_waa_pastorek_from_observed", "b1_baseline_constant_n5", "p6_kriging", "t3_apply_along_time", "w4_stft_wet", "w7_mlp_wet_dry", "w8_cnn_trailing", "w9_cnn_centred"):
    assert QUERIES[q](spark, "/root/testdata/sf0.001").count() > 0, q
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


class FakeLink(dict):
    def __init__(self, attrs, parts):
        super().__init__(parts)
        self.attrs = attrs


def test_hdf5_reader_gives_batches(monkeypatch):
    seconds = np.array([0.0, 60.0, 120.5])
    channel = FakeLink({"frequency": 18.5e9, "polarization": "V"}, {"time": seconds, "tx": np.array([1, 2, 3]), "rx": np.array([-40.0, np.nan, -42.0])})
    where = {"site_a_latitude": 50.0, "site_a_longitude": 7.0, "site_b_latitude": 50.1, "site_b_longitude": 7.1}
    tree = {f"cml_{i}": FakeLink({"id": f"l{i}"} | where, {"channel_1": channel, "product_1": {}}) for i in range(3)}

    class File(dict):
        def __init__(self, path, mode):
            super().__init__(tree)

        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    fake = types.ModuleType("h5py")
    fake.File = File
    monkeypatch.setitem(sys.modules, "h5py", fake)
    monkeypatch.setattr(files, "_ROWS", 2)
    reader = files._Hdf5Reader("file", 2)
    parts = reader.partitions()
    assert [p.names for p in parts] == [["cml_0", "cml_1"], ["cml_2"]]
    batches = [b for p in parts for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [2, 1] * 3
    names = [f.split(" ")[0] for f in files.CmlHdf5.schema(None).split(", ")]
    assert all(b.schema.names == names for b in batches)
    row = batches[-1].to_pylist()[0]
    assert row["cml_id"] == "l2" and row["frequency_ghz"] == 18.5 and row["site_b_lon"] == 7.1 and row["time_ns"] == 120_500_000_000 and row["rsl"] == -42.0


def test_netcdf_reader_gives_batches(monkeypatch):
    import datetime

    class Variable:
        def __init__(self, dimensions, values, units=None):
            self.dimensions, self.values, self.units = dimensions, values, units

        def __getitem__(self, at):
            return self.values[at]

    levels = np.ma.masked_less(np.arange(12.0).reshape(2, 3, 2), 1)  # cml_id, time, channel_id
    variables = {
        "cml_id": Variable(("cml_id",), np.array(["a", "b"])), "channel_id": Variable(("channel_id",), np.array(["c1", "c2"])), "time": Variable(("time",), np.arange(3), "minutes"),
        "tsl": Variable(("cml_id", "time", "channel_id"), levels), "rsl": Variable(("cml_id", "time", "channel_id"), -levels),
        "length": Variable(("cml_id",), np.array([4.5, 7.0])), "frequency": Variable(("cml_id", "channel_id"), np.array([[10.0, 11.0], [12.0, 13.0]])), "polarization": Variable(("channel_id", "cml_id"), np.array([["H", "V"], ["V", "H"]])),
    }

    class Dataset(dict):
        def __init__(self, path):
            super().__init__(variables)
            self.variables, self.dimensions = variables, {"cml_id": [0, 0]}

        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    fake = types.ModuleType("netCDF4")
    fake.Dataset = Dataset
    fake.num2date = lambda t, units, **how: [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=int(x)) for x in t]
    monkeypatch.setitem(sys.modules, "netCDF4", fake)
    reader = files._NetcdfReader("file", 1)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 12 and [*rows[0]] == [f.split(" ")[0] for f in files.CmlNetcdf.schema(None).split(", ")]
    first, last = rows[0], rows[-1]
    assert first["cml_id"] == "a" and np.isnan(first["tsl"]) and first["frequency_ghz"] == 10.0 and first["polarization"] == "H" and np.isnan(first["site_a_lat"])
    assert last["cml_id"] == "b" and last["channel_id"] == "c2" and last["tsl"] == 11.0 and last["length_km"] == 7.0 and last["polarization"] == "H" and last["time"] == datetime.datetime(2024, 1, 1, 0, 2)


def test_further_layers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 5, 3))
    kernel, bias = rng.normal(size=(4, 3, 2)), rng.normal(size=2)
    got = models.forward([("convsame", (kernel, bias)), ("tanh", ())], x)
    for n in range(2):
        for s in range(5):
            want = bias + sum(x[n, s + k - 1] @ kernel[k] for k in range(4) if 0 <= s + k - 1 < 5)
            np.testing.assert_allclose(got[n, s], np.tanh(want))
    scale, offset, mean, variance = rng.uniform(1, 2, (4, 3))
    np.testing.assert_allclose(models.forward([("batchnorm", (scale, offset, mean, variance, np.array(1e-3)))], x)[1, 2], [(x[1, 2, c] - mean[c]) / (variance[c] + 1e-3) ** 0.5 * scale[c] + offset[c] for c in range(3)])
    w, u, b = rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), rng.normal(size=8)
    h, c = [0.0, 0.0], [0.0, 0.0]
    for s in range(5):
        z = [sum(x[0, s, k] * w[k, j] for k in range(3)) + sum(h[k] * u[k, j] for k in range(2)) + b[j] for j in range(8)]
        one = lambda v: 1 / (1 + np.exp(-v))
        c = [one(z[2 + j]) * c[j] + one(z[j]) * np.tanh(z[4 + j]) for j in range(2)]
        h = [one(z[6 + j]) * np.tanh(c[j]) for j in range(2)]
    np.testing.assert_allclose(models.forward([("lstm", (w, u, b))], x)[0], h)
