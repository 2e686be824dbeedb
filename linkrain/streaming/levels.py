"""Levels as streams: bins with a watermark, and baselines that carry a series' state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resample_stream(df: DataFrame, width: str, late: str, columns: list[str], keys=("cml_id", "channel_id"), time: str = "time") -> DataFrame:
    """Min, max, mean and count of bins, emitted once no row that is at most late behind can change them."""
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("n", F.count))]
    return df.groupBy(*keys, F.window(time, width).alias("w")).agg(*made).select(*keys, F.col("w.start").alias(time), *(f"{c}_{n}" for c in columns for n in ("min", "max", "mean", "n")))


def wet_sessions(df: DataFrame, gap: str, late: str, wet: str = "wet", keys=("cml_id",), time: str = "time") -> DataFrame:
    """Wet events as sessions: a gap without a wet row ends one.

    An event is emitted once later wet rows, of any series, are past its end: Spark filters before it takes
    note of the time, so dry rows don't move the watermark.
    """
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(wet).cast("double") == 1)
    return df.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_wet")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n_wet")


def baseline_stream(df: DataFrame, waa_max: float = 2.3, delta_t: float = 1.0, tau: float = 15.0) -> DataFrame:
    """(cml_id, channel_id, time, trsl, wet, baseline, waa) of rows (cml_id, channel_id, time, trsl, wet).

    The baseline of the last dry row and the wet antenna attenuation are the state of a series. A batch's rows
    are taken in order of time; rows that come later than others of their series in an earlier batch are
    appended to it as if they were next.
    """
    q = 1 - 3 * delta_t / tau

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, waa = state.get if state.exists else (None, 0.0)
        started = state.exists
        for pdf in [pd.concat([*frames])]:
            pdf = pdf.sort_values("time", kind="stable")
            bases, waas = [], []
            for trsl, wet in zip(pdf["trsl"].astype(float), pdf["wet"].astype(float)):
                on = wet != 0
                if not on or not started:
                    base = trsl
                att = np.nan if base is None else trsl - base
                top = min(att, waa_max) if att == att else np.nan
                waa = (min(top, waa_max - q * (waa_max - waa)) if wet == 1 and waa == waa and top == top else top) if started else 0.0
                started = True
                bases.append(base)
                waas.append(waa)
            yield pdf.assign(baseline=np.array(bases, float), waa=np.array(waas, float))[["cml_id", "channel_id", "time", "trsl", "wet", "baseline", "waa"]]
        state.update((float(base), float(waa)))

    out = "cml_id string, channel_id string, time timestamp, trsl double, wet int, baseline double, waa double"
    df = df.select("cml_id", "channel_id", F.col("time").cast("timestamp").alias("time"), F.col("trsl").cast("double").alias("trsl"), F.col("wet").cast("int").alias("wet"))
    return df.groupBy("cml_id", "channel_id").applyInPandasWithState(step, out, "baseline double, waa double", "append", GroupStateTimeout.NoTimeout)
