"""Power law, wet antenna attenuation, variogram: published example values.

Numbers that results are compared with, where no loop makes them, are fixed values: published example results.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkrain.functions import antenna, powerlaw
from linkrain.functions.geo import climatological_variogram
from linkrain.functions.udf import apply_along_time, bind, deprecated


def col(df, name):
    return np.array([r[name] for r in df.collect()], float)


def test_coefficients_at_nodes_and_between():
    f = np.arange(1, 100, 0.5)
    a, b = powerlaw.a_b_values(f, "V")
    np.testing.assert_allclose(a[2::40], [0.0000998, 0.117, 0.4712, 0.8889, 1.1915], atol=1e-7)
    np.testing.assert_allclose(b[2::40], [0.949, 0.97, 0.8296, 0.7424, 0.6988], atol=1e-7)
    a, b = powerlaw.a_b_values(f, "H")
    np.testing.assert_allclose([a.sum(), b.sum()], [128.67885799, 175.58906864], atol=1e-7)
    a, b = powerlaw.a_b_values([1.7, 28.9, 82.1], "V")
    np.testing.assert_allclose(a, [7.3246165e-05, 0.210765233, 1.19270158], atol=1e-8)
    np.testing.assert_allclose(b, [0.91564363, 0.92104328, 0.69864681], atol=1e-7)
    a, b = powerlaw.a_b_values([2, 35, 90], "H", "ITU_2003")
    np.testing.assert_allclose([a, b], [[2e-4, 0.263, 1.06], [0.963, 0.979, 0.753]], atol=1e-7)


def test_coefficients_as_columns(spark):
    pdf = pd.DataFrame({"f": [1.0, 1.7, 28.9, 82.1, 100.0], "p": ["V", "h", "Horizontal", "vertical", "v"]})
    a, b = powerlaw.a_b(F.col("f"), F.col("p"))
    got = spark.createDataFrame(pdf).select("f", "p", a.alias("a"), b.alias("b")).toPandas()
    for r in got.itertuples():
        x, y = powerlaw.a_b_values(r.f, r.p)
        np.testing.assert_allclose([r.a, r.b], [x[0], y[0]], rtol=1e-9)


@pytest.mark.parametrize("f, p, t", [(-2, "H", "ITU_2005"), (30, "b", "ITU_2005"), (30, "H", "ITU_2000"), (101, "V", "ITU_2005")])
def test_wrong_arguments_raise(spark, f, p, t):
    with pytest.raises(ValueError):
        powerlaw.a_b_values(f, p, t)
    with pytest.raises(Exception):
        a, _ = powerlaw.a_b(F.lit(float(f)), F.lit(p), t)
        spark.range(1).select(a).collect()


def test_rain_rate(spark):
    att = [0.0, 7.5, 15.0, None, 30.0]
    want = {(0.1, 80): [0, 346.1952323, 917.0924868, np.nan, 2429.43446609], (5, 30): [0, 6.89479467, 14.31845421, np.nan, 29.7352047], (30, 12): [0, 7.29133826, 13.10322105, np.nan, 23.54772138], (50, 5): [0, 47.24635411, 71.08341151, np.nan, 106.946906]}
    df = spark.createDataFrame([(i, a) for i, a in enumerate(att)], "i int, a double").orderBy("i")
    for (length, f), golden in want.items():
        r = powerlaw.rain_rate(F.col("a"), F.lit(float(length)), F.lit(float(f)), F.lit("H"))
        np.testing.assert_allclose(col(df.select(r.alias("r")), "r"), golden, rtol=1e-7)
    assert powerlaw.rain_rate_values(5, 5, 30, "H", "ITU_2003")[0] == pytest.approx(5.1663233, abs=1e-6)
    with pytest.raises(ValueError):
        powerlaw.rain_rate(F.col("a"), F.lit(1.0), F.lit(1.0), F.lit("H"), F.lit(1.0), F.lit(1.0))


def test_antenna_from_observed(spark):
    df = spark.range(10).orderBy("id").select(F.col("id").cast("double").alias("a"))
    args = (F.col("a"), F.lit(23e9), F.lit("H"), F.lit(10.0))
    got = col(df.select(antenna.leijnse_from_observed(*args).alias("w")), "w")
    np.testing.assert_allclose(got, [0, 0.82241041, 1.16192413, 1.34918332, 1.47911528, 1.57976159, 1.66444932, 1.73214808, 1.79472864, 1.84852106], atol=1e-7)
    got = col(df.select(antenna.pastorek_from_observed(*args).alias("w")), "w")
    np.testing.assert_allclose(got, [0, 0.66274715, 1.10407043, 1.45760649, 1.76189926, 2.0291218, 2.26924516, 2.49339808, 2.69506481, 2.88842441], atol=1e-7)
    with pytest.raises(Exception):
        df.select(antenna.pastorek_from_observed(F.lit(-1.0), *args[1:])).collect()


def test_permittivity_column_is_the_complex_one(spark):
    f = np.arange(1, 100, 10) * 1e9
    re, im = antenna.permittivity(F.col("f"), 300.0)
    got = spark.createDataFrame(pd.DataFrame({"f": f})).select("f", re.alias("re"), im.alias("im")).toPandas()
    want = antenna.permittivity_values(got.f.to_numpy(), 300.0)
    np.testing.assert_allclose(got.re + 1j * got.im, want, rtol=1e-12)


def test_pastorek_and_leijnse_columns(spark):
    r = [0.0, 0.001, 0.1, 10.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(r)], "i int, r double").orderBy("i")
    out = df.select(antenna.pastorek(F.col("r")).alias("p"), antenna.leijnse(F.col("r"), F.lit(10e9)).alias("l"))
    x = np.array([0, 0.001, 0.1, 10])
    np.testing.assert_allclose(col(out, "p")[:4], antenna.pastorek_values(x))
    np.testing.assert_allclose(col(out, "l")[:4], antenna.leijnse_values(x, 10e9))
    assert np.isnan(col(out, "p")[4]) and np.isnan(col(out, "l")[4])


def test_variogram(spark):
    rows = [("2022-01-01", 1.0), ("2022-06-01", 1.0), ("2022-06-13", 1.0), ("2022-06-13", 24.0)]
    v = climatological_variogram(F.to_date("d"), F.col("h"))
    got = spark.createDataFrame(rows, "d string, h double").select(*(c.alias(n) for n, c in v.items())).toPandas()
    np.testing.assert_allclose(got.sill, [0.18242923, 1.15661486, 1.16932538, 0.03703330], atol=1e-7)
    np.testing.assert_allclose(got.range, [95.03056923, 37.03493710, 34.72539464, 143.53079842], atol=1e-6)
    np.testing.assert_allclose(got.nugget, 0.1 * got.sill)


def test_binding_and_functions_along_time(spark):
    def f(a, b, c=None, d=1):
        return a

    assert bind(f, 1, b=2) == {"a": 1, "b": 2, "c": None, "d": 1}
    with pytest.raises(TypeError):
        bind(f, 1)
    df = spark.createDataFrame([("x", "1", t, float(t), 2.0) for t in range(5)], "cml_id string, channel_id string, time int, v double, k double")
    out = apply_along_time(df, lambda v, k: np.cumsum(v) * k, {"v": "v"}, "s", {"k": "k"}).orderBy("time")
    assert [r["s"] for r in out.collect()] == [0, 2, 6, 12, 20]

    @deprecated("Use g.")
    def old():
        return 1

    with pytest.warns(DeprecationWarning):
        assert old() == 1
