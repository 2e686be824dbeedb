"""Wet/dry classification of single links: rolling deviation, and short-time Fourier transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.operators.timeseries import KEYS, rolling, series


def rolling_std_wet(df: DataFrame, trsl: str = "trsl", out: str = "wet", rows: int = 60, threshold: float = 0.8, keys=KEYS, time: str = "time") -> DataFrame:
    """Wet where the centred rolling standard deviation is above threshold; dry where there is none."""
    made = rolling(df, trsl, rows, "std", "__std", centre=True, keys=keys, time=time)
    return made.withColumn(out, F.coalesce(F.col("__std") > threshold, F.lit(False))).drop("__std")


def calmest_period(df: DataFrame, rsl: str = "rsl", rows: int = 600, keys=KEYS, time: str = "time") -> DataFrame:
    """(keys, dry_start, dry_stop): row numbers from 0 of the first window of the lowest sample deviation, ending at dry_stop."""
    w = series(keys, time)
    frame = w.rowsBetween(1 - rows, 0)
    x = F.col(rsl)
    made = df.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.when(F.count(x).over(frame) == rows, F.stddev_samp(x).over(frame)).alias("s"))
    stop = F.min_by("i", F.struct("s", "i"))
    return made.where("s is not null").groupBy(*keys).agg(stop.cast("int").alias("dry_stop")).select(*keys, (F.col("dry_stop") - rows).alias("dry_start"), "dry_stop")


def nans(*shape: int) -> np.ndarray:
    return np.full(shape, np.nan)


def calmest_values(rsl: np.ndarray, rows: int) -> tuple[int, int]:
    std = pd.Series(rsl).rolling(rows).std().to_numpy()
    stop = int(np.flatnonzero(std == np.nanmin(std))[0])
    return stop - rows, stop


def spectrogram(rsl: np.ndarray, window: np.ndarray, f_sampling: float) -> tuple[np.ndarray, np.ndarray]:
    """(one-sided power at each row that a full window fits around, NaN elsewhere; frequencies)."""
    n = len(window)
    frames = np.lib.stride_tricks.sliding_window_view(rsl, n) * window
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).T
    if n % 2 == 0:
        power[1:-1] *= 2
    else:
        power[1:] *= 2
    power /= f_sampling * (window**2).sum()
    missing = len(rsl) - power.shape[1]
    front = missing // 2
    return np.concatenate([nans(len(power), front), power, nans(len(power), missing - front)], axis=1), np.fft.rfftfreq(n, 1 / f_sampling)


def stft_values(rsl: np.ndarray, window_length: int = 256, threshold: float = 1.5, f_divide: float = 1e-3, f_sampling: float = 1 / 60.0, t_dry_start=None, t_dry_stop=None, dry_length: int | None = None, window=None, power=None, f=None) -> tuple[np.ndarray, dict]:
    """Wet where the mean of low frequencies, relative to a dry spectrum, exceeds that of high ones by threshold."""
    if power is None:
        power, f = spectrogram(rsl, np.hamming(window_length) if window is None else window, f_sampling)
    elif f is None:
        raise ValueError("a spectrogram needs its frequencies")
    given = t_dry_start is not None, t_dry_stop is not None, dry_length is not None
    if given == (False, False, True):
        t_dry_start, t_dry_stop = calmest_values(rsl, dry_length)
    elif given != (True, True, False):
        raise AttributeError("either t_dry_start and t_dry_stop or dry_length are needed")
    dry = power[:, max(t_dry_start, 0) : t_dry_stop]
    seen = ~np.isnan(dry)
    n = seen.sum(axis=1)
    mean = np.where(n > 0, np.where(seen, dry, 0).sum(axis=1) / np.maximum(n, 1), np.nan)
    norm = power / mean[:, None]
    diff = norm[f <= f_divide].mean(axis=0) - norm[f > f_divide].mean(axis=0)
    return np.where(np.isnan(diff), False, diff > threshold), {"P_norm": norm, "P_sum_diff": diff, "Pxx": power, "P_dry_mean": mean, "f": f}


def stft_wet(df: DataFrame, rsl: str = "rsl", out: str = "wet", keys=KEYS, time: str = "time", **how) -> DataFrame:
    """Adds out and P_sum_diff; a series lies in one task, as its calm period may be anywhere in it.

    Null levels are NaN, which the windows around them spread; a series shorter than the window is dry.
    """
    schema = df.withColumns({out: F.lit(False), "P_sum_diff": F.lit(None).cast("double")}).schema
    length = how.get("window_length", 256)

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        x = pdf[rsl].to_numpy(float)
        if len(x) < max(length, how.get("dry_length") or 0) or (how.get("dry_length") and pd.Series(x).rolling(how["dry_length"]).std().isna().all()):
            return pdf.assign(**{out: False, "P_sum_diff": np.nan})
        wet, info = stft_values(x, **how)
        return pdf.assign(**{out: wet, "P_sum_diff": info["P_sum_diff"]})

    made = df.groupBy(*keys).applyInPandas(per_series, schema)
    return made.withColumn("P_sum_diff", F.when(~F.isnan("P_sum_diff"), F.col("P_sum_diff")))
