"""Learned wet/dry classifiers: windows of levels, feature scaling, and scoring with a user's weights.

A network is a list of layers, kept as arrays in an .npz file (see linkrain.sources.models): "dense" and "conv"
with weights and bias, "convsame" (ends padded with zeros, so that the number of steps stays), "batchnorm" (scale,
offset, mean, variance and epsilon of inference), "lstm" (weights of input and state, bias; gates in the order
input, forget, cell, output; the last state), "relu", "tanh", "sigmoid", "softmax", "flatten", "maxpool",
"meanpool". Other layers are not read. Weights go to the executors once; batches are scored in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from linkrain.operators.timeseries import series

Layers = list[tuple[str, tuple[np.ndarray, ...]]]


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    """Output of a network; x is (rows, features) or (rows, steps, channels)."""
    for kind, arrays in layers:
        if kind == "dense":
            x = x @ arrays[0] + arrays[1]
        elif kind in ("conv", "convsame"):
            k = arrays[0].shape[0]
            if kind == "convsame":
                x = np.pad(x, ((0, 0), ((k - 1) // 2, k // 2), (0, 0)))
            view = np.lib.stride_tricks.sliding_window_view(x, k, axis=1)
            x = np.einsum("nsck,kco->nso", view, arrays[0], optimize=True) + arrays[1]
        elif kind == "batchnorm":
            scale, offset, mean, variance, epsilon = arrays
            x = (x - mean) / np.sqrt(variance + epsilon) * scale + offset
        elif kind == "lstm":
            x = lstm(x, *arrays)
        elif kind == "relu":
            x = np.maximum(x, 0)
        elif kind == "tanh":
            x = np.tanh(x)
        elif kind == "sigmoid":
            x = 1 / (1 + np.exp(-x))
        elif kind == "softmax":
            e = np.exp(x - x.max(axis=-1, keepdims=True))
            x = e / e.sum(axis=-1, keepdims=True)
        elif kind == "flatten":
            x = x.reshape(len(x), -1)
        elif kind == "maxpool":
            n = int(arrays[0])
            x = x[:, : x.shape[1] // n * n].reshape(len(x), -1, n, x.shape[2]).max(axis=2)
        elif kind == "meanpool":
            x = x.mean(axis=1)
        else:
            raise ValueError(f"layer {kind} is not known")
    return x


def lstm(x: np.ndarray, by_input: np.ndarray, by_state: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The state after the last step of (rows, steps, channels)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    state = cell = np.zeros((len(x), by_state.shape[0]))
    for step in range(x.shape[1]):
        i, f, c, o = np.split(x[:, step] @ by_input + state @ by_state + bias, 4, axis=1)
        cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(c)
        state = sigmoid(o) * np.tanh(cell)
    return state


def window_array(column: str, first: int, last: int, w: WindowSpec) -> Column:
    """Values of rows first to last around a row, null unless all are there and valid."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(column).over(frame) == last - first + 1, F.collect_list(column).over(frame))


def scored(df: DataFrame, arrays: str, predict: Callable[[np.ndarray], np.ndarray], out: str, shape: tuple[int, ...]) -> DataFrame:
    """Adds out, an array of a model's outputs for an array column reshaped to shape; null for null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            made: list = [None] * len(part)
            ok = np.flatnonzero(part.notna().to_numpy())
            if len(ok):
                x = np.stack(part.iloc[ok].to_list()).reshape(-1, *shape).astype(np.float32)
                for i, y in zip(ok, np.asarray(predict(x), float).reshape(len(x), -1)):
                    made[i] = y
            yield pd.Series(made, part.index, dtype=object)

    return df.withColumn(out, run(arrays))


#: Rows before and after a row that the four kinds of windows take, whether of differences, and whether detrended.
MLP_KINDS = {"rad": (-20, 19, False, True), "rg": (-20, 19, False, True), "rad_online": (-39, 0, True, False), "rg_online": (-39, 0, True, False)}


def mlp_windows(df: DataFrame, channels: tuple[str, str], kind: str, keys=("cml_id",), time: str = "time") -> DataFrame:
    """Adds window, the 40 values of the first channel and the 40 of the second.

    Offline kinds subtract a centred median of 720 rows (120 valid at least); online kinds take differences to
    the row before, so their windows look back only.
    """
    if kind not in MLP_KINDS:
        raise ValueError(f"model {kind} is none of {[*MLP_KINDS]}")
    first, last, differences, detrended = MLP_KINDS[kind]
    w = series(keys, time)
    names = []
    for n, c in enumerate(channels):
        x = F.col(c)
        if differences:
            x = x - F.lag(c).over(w)
        elif detrended:
            frame = w.rowsBetween(-360, 359)
            x = x - F.when(F.count(c).over(frame) >= 120, F.percentile(c, F.lit(0.5)).over(frame))
        df = df.withColumn(f"__x{n}", x)
        names.append(f"__x{n}")
    parts = [window_array(n, first, last, w) for n in names]
    return df.withColumn("window", F.when(parts[0].isNotNull() & parts[1].isNotNull(), F.concat(*parts))).drop(*names)


def mlp_wet_dry(df: DataFrame, channels: tuple[str, str], layers: Layers, kind: str = "rad_online", keys=("cml_id",), time: str = "time") -> DataFrame:
    """Adds p_dry and p_wet, null where a value of the window is missing."""
    made = scored(mlp_windows(df, channels, kind, keys, time), "window", lambda x: forward(layers, x), "__p", (80,))
    return made.withColumns({"p_dry": F.col("__p")[0], "p_wet": F.col("__p")[1]}).drop("window", "__p")


def trailing_samples(df: DataFrame, columns: list[str], length: int = 180, keys=("cml_id",), time: str = "time") -> DataFrame:
    """Adds sample: the last length rows of all columns, one array for each column; null unless all are finite."""
    w = series(keys, time)
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns]
    df = df.withColumns({f"__f{i}": x for i, x in enumerate(finite)})
    parts = [window_array(f"__f{i}", 1 - length, 0, w) for i in range(len(columns))]
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok = ok & p.isNotNull()
    return df.withColumn("sample", F.when(ok, F.array(*parts))).drop(*(f"__f{i}" for i in range(len(columns))))


def sample_scales(df: DataFrame, columns: list[str], length: int = 180, keys=("cml_id",), time: str = "time") -> list[tuple[float, float]]:
    """(mean, deviation) of each column over all samples of all links, overlaps counted; a deviation of 0 is 1.

    A value counts as often as samples hold it, so no sample is made for this: the weight of a row is the
    number of complete samples among those that end up to length - 1 rows later.
    """
    w = series(keys, time)
    ok = None
    for c in columns:
        good = F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
        ok = good if ok is None else ok & good
    df = df.withColumn("__ok", ok.cast("int"))
    df = df.withColumn("__end", (F.sum("__ok").over(w.rowsBetween(1 - length, 0)) == length).cast("int"))
    df = df.withColumn("__n", F.sum("__end").over(w.rowsBetween(0, length - 1))).where("__n > 0")
    n = F.sum("__n")
    means = df.agg(*((F.sum(F.col(c) * F.col("__n")) / n).alias(c) for c in columns)).first()
    if means[0] is None:
        return [(0.0, 1.0) for _ in columns]
    spread = df.agg(*(F.sqrt(F.sum(F.pow(F.col(c) - means[c], 2) * F.col("__n")) / n).alias(c) for c in columns)).first()
    return [(means[c], spread[c] or 1.0) for c in columns]


def cnn_trailing(df: DataFrame, columns: list[str], layers: Layers, length: int = 180, keys=("cml_id",), time: str = "time") -> DataFrame:
    """Adds p_wet of the network for the last length rows of scaled columns."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no column {missing}")
    scales = sample_scales(df, columns, length, keys, time)
    centre, spread = (np.array(x, np.float32) for x in zip(*scales))
    made = trailing_samples(df, columns, length, keys, time)
    made = made.withColumn("__a", F.flatten("sample"))
    out = scored(made, "__a", lambda x: forward(layers, (x.transpose(0, 2, 1) - centre) / spread), "__p", (len(columns), length))
    return out.withColumn("p_wet", F.col("__p")[0]).drop("sample", "__a", "__p")


def cnn_centred(df: DataFrame, columns: list[str], layers: Layers, length: int = 180, reflength: int = 60, keys=("cml_id",), time: str = "time") -> DataFrame:
    """Adds p_wet of the network for windows of which a row is length - reflength / 2 rows after the first.

    Rows without a full window are null; values are not checked, null counts as NaN.
    """
    w = series(keys, time)
    back = length - reflength // 2
    frame = w.rowsBetween(-back, length - back - 1)
    parts = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).over(frame) for c in columns]
    whole = F.count(F.lit(1)).over(frame) == length
    made = df.withColumn("__a", F.when(whole, F.flatten(F.array(*parts))))
    out = scored(made, "__a", lambda x: forward(layers, x.transpose(0, 2, 1)), "__p", (len(columns), length))
    return out.withColumn("p_wet", F.when(~F.isnan(F.col("__p")[0]), F.col("__p")[0])).drop("__a", "__p")


