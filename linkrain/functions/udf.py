"""Functions of one series applied along time, for every series of a frame."""

from __future__ import annotations

import functools
import inspect
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind(fn: Callable, *args, **kwargs) -> dict:
    """Arguments by name in the order of the signature, defaults included."""
    bound = inspect.signature(fn).bind(*args, **kwargs)
    bound.apply_defaults()
    return dict(bound.arguments)


def apply_along_time(df: DataFrame, fn: Callable, series_columns: dict[str, str], out: str, param_columns: dict[str, str] | None = None, constants: dict | None = None, keys=("cml_id", "channel_id"), time: str = "time", kind: str = "double") -> DataFrame:
    """Adds out = fn(...) of whole series in order of time.

    series_columns and param_columns name columns by argument: arrays over time, or one value for the series
    (several raise). constants are passed as they are. fn returns an array over time; NaN becomes null.
    """
    params, fixed = param_columns or {}, constants or {}
    known = {**{a: None for a in series_columns}, **{a: None for a in params}, **fixed}
    bind(fn, **known)  # a wrong name raises here and not in a task
    schema = df.withColumn(out, F.lit(None).cast(kind)).schema

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        given = {a: pdf[c].to_numpy() for a, c in series_columns.items()}
        for a, c in params.items():
            values = pdf[c].drop_duplicates()
            if len(values) > 1:
                raise ValueError(f"{c} has several values in a series")
            given[a] = values.iloc[0]
        return pdf.assign(**{out: fn(**given, **fixed)})

    made = df.groupBy(*keys).applyInPandas(per_series, schema)
    return made.withColumn(out, F.when(~F.isnan(out), F.col(out))) if kind in ("double", "float") else made


def deprecated(instead: str) -> Callable:
    """Marks a function whose use warns and says what to use instead."""

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args, **kwargs):
            warnings.warn(f"{fn.__name__} is deprecated. {instead}", DeprecationWarning, stacklevel=2)
            return fn(*args, **kwargs)

        return run

    return wrap
