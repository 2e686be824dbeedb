"""Blackout gaps: missing levels next to levels below a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrain.operators.timeseries import KEYS, before, next_valid, rolled, series


def gap_markers(df: DataFrame, threshold: float, rsl: str = "rsl", keys=KEYS, time: str = "time") -> DataFrame:
    """gap_start: a low level before a missing one; gap_end: a low level after one. Series are circular."""
    w = series(keys, time)
    low = F.coalesce(F.col(rsl) < threshold, F.lit(False))
    return df.withColumns({"gap_start": rolled(F.col(rsl), -1, w).isNull() & low, "gap_end": rolled(F.col(rsl), 1, w).isNull() & low})


def mask_from_markers(df: DataFrame, start: str = "gap_start", end: str = "gap_end", rsl: str = "rsl", out: str = "blackout", reverse: bool = False, keys=KEYS, time: str = "time") -> DataFrame:
    """Missing rows that follow a start which is no end; reverse: that come before an end which is no start."""
    w = series(keys, time)
    valid = F.when(F.col(rsl).isNotNull(), F.struct(F.col(start).alias("s"), F.col(end).alias("e")))
    if reverse:
        near = next_valid(valid, keys, time)
        opened = near["e"] & ~near["s"]
    else:
        near = F.last(valid, True).over(before(w))
        opened = near["s"] & ~near["e"]
    return df.withColumn(out, F.col(rsl).isNull() & F.coalesce(opened, F.lit(False)))


def blackout_mask(df: DataFrame, threshold: float, rsl: str = "rsl", out: str = "blackout", keys=KEYS, time: str = "time") -> DataFrame:
    """Rows in blackout gaps: missing, with a low level before or after the gap."""
    made = gap_markers(df, threshold, rsl, keys, time)
    made = mask_from_markers(made, rsl=rsl, out="__f", keys=keys, time=time)
    made = mask_from_markers(made, rsl=rsl, out="__b", reverse=True, keys=keys, time=time)
    return made.withColumn(out, F.col("__f") | F.col("__b")).drop("gap_start", "gap_end", "__f", "__b")


def blackout_minutes(df: DataFrame, blackout: str = "blackout", keys=("cml_id",), least: int = 0) -> DataFrame:
    """Rows in blackout of each link, for links with more than least."""
    return df.groupBy(*keys).agg(F.count_if(blackout).alias("n_blackout")).where(F.col("n_blackout") > least)
