"""Alignment in time: values assigned to the next or last time of an index, and aggregated there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucket(df: DataFrame, time: str, width: int) -> Column:
    """Whole widths (seconds, or units of a numeric time) since zero."""
    numeric = isinstance(df.schema[time].dataType, T.NumericType)
    return F.floor((F.col(time) if numeric else F.unix_seconds(F.col(time).cast("timestamp"))) / width)


def assign_times(df: DataFrame, index: DataFrame, label: str = "right", keys: tuple[str, ...] = (), time: str = "time", out: str = "label_time", width: int = 86_400) -> DataFrame:
    """out is the first time of index at or after a row's ("right"), or the last at or before it ("left"); null without one.

    index: times, for each key if it has the keys, else for all. The as-of join is a union of both, sorted
    within buckets of time, so no row meets more than its own time and no key is in one task; what lies in
    another bucket comes from a table of the buckets' first and last index times. Where the index lacks keys, the
    distinct times are assigned once and rows look theirs up, so the index is never copied for each key. A
    null time has none.
    """
    if label not in ("left", "right"):
        raise ValueError("label is left or right")
    own = tuple(k for k in keys if k in index.columns)
    if len(own) < len(keys):
        found = assign_times(df.select(*own, time).distinct(), index, label, own, time, out, width)
        return df.join(found, [*own, time], "left").select(*df.columns, out)
    times = index.select(*keys, time).distinct()
    right = label == "right"
    df, times = df.withColumn("__b", _bucket(df, time, width)), times.withColumn("__b", _bucket(times, time, width))
    both = df.withColumn("__i", F.lit(False)).unionByName(times.withColumn("__i", F.lit(True)), allowMissingColumns=True)
    # backwards for "right", and at equal times the index first: its last time so far is the one
    towards = (lambda c: c.desc()) if right else (lambda c: c.asc())
    last = lambda c, by, order, end: F.last(c, True).over(Window.partitionBy(*keys, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    near = last(F.when(F.col("__i"), F.col(time)), ["__b"], [towards(F.col(time)), F.col("__i").desc()], 0)
    # one row for each key and bucket
    end = (F.min if right else F.max)(F.when(F.col("__i"), F.col(time)))
    ends = both.groupBy(*keys, "__b").agg(end.alias("__e"))
    far = last(F.col("__e"), [], [towards(F.col("__b"))], -1)
    ends = ends.withColumn("__e", far)
    found = both.withColumn(out, near).where(~F.col("__i")).drop("__i").join(ends, [*keys, "__b"])
    return found.withColumn(out, F.coalesce(out, "__e")).drop("__b", "__e")


def aggregate_onto(df: DataFrame, index: DataFrame, aggregates: dict[str, Column], label: str = "right", keys: tuple[str, ...] = (), time: str = "time", crop: bool = True) -> DataFrame:
    """Aggregates of rows by the time of index that they are assigned to.

    crop first cuts both to the time they have in common, ends included.
    """
    if crop:
        a = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).join(index.agg(F.min(time).alias("c"), F.max(time).alias("d")), F.lit(True))
        span = a.select(F.greatest("a", "c").alias("__a"), F.least("b", "d").alias("__b"))
        cut = lambda x: x.join(F.broadcast(span), F.col(time).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")  # noqa: E731  one row
        df, index = cut(df), cut(index)
    assigned = assign_times(df, index, label, keys, time, "__t").where("__t is not null")
    return assigned.groupBy(*keys, F.col("__t").alias(time)).agg(*(a.alias(n) for n, a in aggregates.items()))


def resample_to(df: DataFrame, index: DataFrame, columns: list[str], label: str = "right", keys: tuple[str, ...] = (), time: str = "time") -> DataFrame:
    """Means of columns' valid values at the times of index; null where there is none."""
    return aggregate_onto(df, index, {c: F.avg(c) for c in columns}, label, keys, time, crop=False)
