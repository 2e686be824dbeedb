"""Baselines of wet events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrain.operators.timeseries import KEYS, before, next_valid, series


def _wet(wet: Column, nan_wet: bool = True) -> Column:
    """Wet as a condition; null is wet or dry."""
    return F.coalesce(wet.cast("double") != 0, F.lit(nan_wet))


def _constant(trsl: np.ndarray, wet: np.ndarray, n: int) -> np.ndarray:
    """Rows of an event have the mean of the n baseline values before it."""
    out = trsl.astype(float).copy()
    start = np.flatnonzero(wet & ~np.concatenate(([False], wet[:-1])))
    edge = np.flatnonzero(np.diff(np.concatenate((wet, [False])).astype(int)) == -1)
    for a, b in zip(start, edge):
        a, b = max(a, n), b + 1
        if a < b:
            # a run that reaches into the first n rows goes on from the last of them
            out[a:b] = out[a - 1] if a > 0 and wet[a - 1] else out[a - n : a].mean()
    return out


def baseline_constant(df: DataFrame, trsl: str = "trsl", wet: str = "wet", out: str = "baseline", n: int = 1, keys=KEYS, time: str = "time", nan_wet: str = "wet") -> DataFrame:
    """The level before an event, held through it: mean of the n baseline values before.

    A null wet counts as wet; with nan_wet="propagate" the baseline is null there and until the next dry row.
    For n = 1 this is a window; a longer mean may depend on the event before, so whole series go to numpy.
    """
    w = series(keys, time)
    x = _wet(F.col(wet))
    if n == 1:
        anchor = ~x | (F.row_number().over(w) == 1)
        df = df.withColumn(out, F.last(F.when(anchor, F.struct(F.col(trsl).cast("double").alias("v"))), True).over(before(w))["v"])
    else:
        schema = df.withColumn(out, F.lit(None).cast("double")).schema

        def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(time, kind="stable")
            state = pdf[wet].astype(float).fillna(1.0).to_numpy() != 0
            return pdf.assign(**{out: _constant(pdf[trsl].to_numpy(float), state, n)})

        df = df.groupBy(*keys).applyInPandas(per_series, schema)
        df = df.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    if nan_wet == "propagate":
        unsure = F.last(F.when(F.col(wet).isNull() | ~x, F.col(wet).isNull()), True).over(before(w))
        df = df.withColumn(out, F.when(~F.coalesce(unsure, F.lit(False)), F.col(out)))
    return df


def baseline_linear(df: DataFrame, rsl: str = "rsl", wet: str = "wet", out: str = "baseline", ignore_nan: bool = False, keys=KEYS, time: str = "time") -> DataFrame:
    """A straight line by row number from the last dry row before an event to the first after it.

    The first row is always an anchor; an event that does not end has 0. Unless ignore_nan, which repeats the
    last state, a null wet makes its whole event null, with both anchors.
    """
    w = series(keys, time)
    i = F.row_number().over(w)
    state = F.col(wet).cast("double")
    df = df.withColumns({"__i": i, "__s": state})
    if ignore_nan:
        known = F.last(F.when(F.col("__i") == 1, F.lit(0.0)).otherwise(F.col("__s")), True).over(before(w))
        df = df.withColumn("__s", known)
    event = (F.col("__i") > 1) & (F.col("__s").isNull() | (F.col("__s") != 0))
    point = F.struct(F.col("__i").alias("i"), F.col(rsl).cast("double").alias("v"))
    df = df.withColumn("__e", event)
    df = df.withColumns(
        {
            "__p": F.last(F.when(~F.col("__e"), point), True).over(before(w)),
            "__q": next_valid(F.when(~F.col("__e"), point), keys, time),
            "__z": next_valid(F.when(~F.col("__e"), F.lit(1)), keys, time, 1),
            "__g": F.sum((~F.col("__e")).cast("int")).over(before(w)),
        }
    )
    whole = Window.partitionBy(*keys, "__g").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("__h", F.max((F.col("__e") & F.col("__s").isNull()).cast("int")).over(whole) == 1)
    p, q = F.col("__p"), F.col("__q")
    line = p["v"] + (q["v"] - p["v"]) * (F.col("__i") - p["i"]) / (q["i"] - p["i"])
    opens = F.coalesce(F.lead("__e").over(w), F.lit(False))
    closed = F.col("__z").isNotNull()
    spoiled = F.coalesce(F.lag("__h").over(w), F.lit(False))
    # the state of an anchor depends on what it opens, or else on what it closes
    anchor = F.when(F.when(opens & closed, F.col("__h")).otherwise(spoiled), F.lit(None).cast("double")).otherwise(F.col(rsl).cast("double"))
    inside = F.when(q.isNull(), F.lit(0.0)).when(F.col("__h"), F.lit(None).cast("double")).otherwise(line)
    return df.withColumn(out, F.when(F.col("__e"), inside).otherwise(anchor)).drop("__i", "__s", "__e", "__p", "__q", "__z", "__g", "__h")


def reference_level(df: DataFrame, pmin: str = "pmin", pmax: str = "pmax", wet: str = "wet", out: str = "pref", rows: int = 96, min_rows: int = 1, keys=KEYS, time: str = "time") -> DataFrame:
    """Median of (pmin + pmax) / 2 over the dry ones of the last rows time steps."""
    frame = series(keys, time).rowsBetween(1 - rows, 0)
    x = F.when(F.col(wet).cast("double") == 0, (F.col(pmin) + F.col(pmax)) / 2)
    return df.withColumn(out, F.when(F.count(x).over(frame) >= min_rows, F.percentile(x, F.lit(0.5)).over(frame)))


def waa_schleiss(df: DataFrame, trsl: str = "trsl", baseline: str = "baseline", wet: str = "wet", out: str = "waa", waa_max: float = 2.3, delta_t: float = 1.0, tau: float = 15.0, keys=KEYS, time: str = "time") -> DataFrame:
    """Wet antenna attenuation after Schleiss et al. 2013, which approaches waa_max through a wet event.

    With u = waa_max - waa a dry row has u = c and a wet one u = max(c, q u before), c = max(waa_max - A, 0) and
    q = 1 - 3 delta_t / tau; so u is the largest c q^distance since the last dry row, a running maximum of
    logarithms. For q <= 0 series go to numpy.
    """
    w = series(keys, time)
    q = 1 - 3 * delta_t / tau
    att = F.col(trsl).cast("double") - F.col(baseline).cast("double")
    is_wet = F.coalesce(F.col(wet).cast("double") == 1, F.lit(False))
    if q <= 0:
        schema = df.withColumn(out, F.lit(None).cast("double")).schema

        def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(time, kind="stable")
            a = (pdf[trsl] - pdf[baseline]).to_numpy(float)
            on = pdf[wet].astype(float).to_numpy() == 1
            waa = np.zeros(len(a))
            for i in range(1, len(a)):
                top = min(a[i], waa_max) if a[i] == a[i] else np.nan
                last = waa[i - 1]
                waa[i] = min(top, last + (waa_max - last) * (1 - q)) if on[i] and last == last and top == top else top
            return pdf.assign(**{out: waa})

        out_df = df.groupBy(*keys).applyInPandas(per_series, schema)
        return out_df.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    df = df.withColumns({"__i": F.row_number().over(w), "__a": att})
    new = ~is_wet | (F.col("__i") == 1) | ((F.col("__i") > 2) & F.lag("__a").over(w).isNull())
    df = df.withColumn("__seg", F.sum(new.cast("int")).over(before(w)))
    df = df.withColumn("__c", F.when(F.col("__i") == 1, F.lit(float(waa_max))).otherwise(F.greatest(waa_max - F.col("__a"), F.lit(0.0))))
    # rows since the segment's first
    df = df.withColumn("__j", F.col("__i") - F.max(F.when(new, F.col("__i"))).over(before(w)))
    inside = Window.partitionBy(*keys, "__seg").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    log_q = float(np.log(q)) if q < 1 else 0.0
    top = F.max(F.when(F.col("__c") > 0, F.log("__c") - F.col("__j") * log_q)).over(inside)
    u = F.coalesce(F.exp(F.col("__j") * log_q + top), F.lit(0.0))
    made = F.when(F.col("__i") == 1, F.lit(0.0)).when(F.col("__a").isNotNull(), waa_max - u)
    return df.withColumn(out, made).drop("__i", "__a", "__seg", "__c", "__j")
