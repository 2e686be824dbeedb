"""Relational operators over series: rows of (keys ..., time), one row per sub-link and time.

Windows share one partitioning and order (keys, time), so that Spark sorts a series once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("cml_id", "channel_id")


def series(keys: Iterable[str] = KEYS, time: str = "time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def next_valid(column: Column, keys: Iterable[str] = KEYS, time: str | Column = "time", skip: int = 0) -> Column:
    """The first value that is not null from the row on, or from skip rows later.

    It is the last one in the opposite order: a frame up to the end of a partition would be read anew for each
    row, one from its start is not. The price is a second sort, without another exchange.
    """
    order = F.col(time) if isinstance(time, str) else time
    return F.last(column, True).over(Window.partitionBy(*keys).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -skip))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN, which Spark takes for the largest number, becomes null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def mask_sentinels(df: DataFrame, **valid: Column) -> DataFrame:
    """Null where the condition of a column (name=condition) does not hold or is null."""
    return df.withColumns({c: F.when(ok, F.col(c)) for c, ok in valid.items()})


def total_loss(tsl: Column, rsl: Column) -> Column:
    """Null where either level is."""
    return tsl - rsl


def clamp(att: Column, null_as_zero: bool = False) -> Column:
    """0 for negative values; null stays unless null_as_zero."""
    out = F.when(att < 0, F.lit(0.0)).otherwise(att)
    return F.coalesce(out, F.lit(0.0)) if null_as_zero else out


def between_times(df: DataFrame, start, stop, time: str = "time") -> DataFrame:
    """Rows from start to stop, both included; rows of null time go."""
    return df.where(F.col(time).between(start, stop))


def interpolate(df: DataFrame, column: str, max_gap_seconds: float, out: str | None = None, keys=KEYS, time: str = "time") -> DataFrame:
    """Linear in time between valid neighbours that are no more than max_gap_seconds apart; ends stay null."""
    w = series(keys, time)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    point = F.when(F.col(column).isNotNull(), F.struct(at.alias("t"), F.col(column).alias("v")))
    df = df.withColumns({"__p": F.last(point, True).over(before(w)), "__n": next_valid(point, keys, time)})
    p, n = F.col("__p"), F.col("__n")
    line = p["v"] + (n["v"] - p["v"]) * (at - p["t"]) / (n["t"] - p["t"])
    fits = n["t"] - p["t"] <= int(max_gap_seconds * 1_000_000)
    return df.withColumn(out or column, F.coalesce(F.col(column), F.when(fits, line))).drop("__p", "__n")


def rolling(df: DataFrame, column: str, rows: int, how: str, out: str, centre: bool = False, min_rows: int | None = None, keys=KEYS, time: str = "time") -> DataFrame:
    """how ("std", "mean", "sum", "min", "max", "median") of frames of rows rows; null under min_rows values (all, by default).

    A centred frame of even length has one row more before than after. Standard deviations are of the population.
    """
    first = -(rows // 2) if centre else 1 - rows
    frame = series(keys, time).rowsBetween(first, first + rows - 1)
    x = F.col(column)
    made = {"std": F.stddev_pop(x), "mean": F.avg(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "median": F.percentile(x, F.lit(0.5))}[how]
    return df.withColumn(out, F.when(F.count(x).over(frame) >= (rows if min_rows is None else min_rows), made.over(frame)))


def resample(df: DataFrame, width: str, aggregates: dict[str, Column], keys=KEYS, time: str = "time", label: str = "left", dense: bool = True, zero: Iterable[str] = ()) -> DataFrame:
    """Tumbling bins of a width such as "1 hour"; dense adds the empty bins between a series' first and last.

    aggregates: expressions by name; those in zero are 0 in an empty bin, others null. label names a bin by
    its start or end. One partial aggregate and one exchange; empty bins come from a sequence for each series.
    """
    kind = df.schema[time].dataType
    bins = df.groupBy(*keys, F.window(F.col(time).cast("timestamp"), width).alias("__w")).agg(*(a.alias(n) for n, a in aggregates.items()))
    bins = bins.withColumn("__s", F.col("__w.start"))
    if dense:
        step = F.expr(f"INTERVAL {width}")
        spans = bins.groupBy(*keys).agg(F.min("__s").alias("a"), F.max("__s").alias("b"))
        every = spans.select(*keys, F.explode(F.sequence("a", "b", step)).alias("__s"))
        bins = every.join(bins.drop("__w"), [*keys, "__s"], "left")
    bins = bins.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in zero})
    at = F.col("__s") + F.expr(f"INTERVAL {width}") if label == "right" else F.col("__s")
    return bins.select(*keys, at.cast(kind).alias(time), *aggregates)


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, nulls and repeated rows too; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge(left: DataFrame, right: DataFrame, keys=(*KEYS, "time")) -> DataFrame:
    """Columns of both by keys, rows of left; right columns are null where right has no such keys, as for null keys."""
    return left.join(right, [*keys], "left")


def align(df: DataFrame, reference: DataFrame, keys=KEYS, time: str = "time") -> DataFrame:
    """df at the reference's keys and times, null where df has none."""
    return reference.select(*keys, time).join(df, [*keys, time], "left")


def shifted(column: Column, rows: int, w: WindowSpec) -> Column:
    """The value so many rows before (after, if negative)."""
    return F.lag(column, rows).over(w)


def rolled(column: Column, rows: int, w: WindowSpec) -> Column:
    """Circular shift by one row (1 or -1): the other end of the series comes in, be it null or not."""
    if rows not in (1, -1):
        raise ValueError("rows is 1 or -1")
    boxed = F.struct(column.alias("v"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.lag(boxed, rows).over(w)
    end = F.last(boxed).over(whole) if rows == 1 else F.first(boxed).over(whole)
    return F.coalesce(moved, end)["v"]


def event_edges(df: DataFrame, wet: str = "wet", keys=KEYS, time: str = "time") -> DataFrame:
    """starts and ends mark dry rows before and after wet events (circular); event numbers wet runs from 1, null where dry."""
    w = series(keys, time)
    x = F.coalesce(F.col(wet).cast("boolean"), F.lit(False))
    begin = x & ~F.coalesce(F.lag(x).over(w), F.lit(False))
    return df.withColumns({"starts": rolled(x, -1, w) & ~x, "ends": rolled(x, 1, w) & ~x, "event": F.when(x, F.sum(begin.cast("int")).over(before(w)))})


def detrend(df: DataFrame, column: str, out: str, keys=KEYS) -> DataFrame:
    """Minus the median of the series' valid values; null stays null."""
    medians = df.groupBy(*keys).agg(F.percentile(column, F.lit(0.5)).alias("__m"))
    return df.join(medians, [*keys]).withColumn(out, F.col(column) - F.col("__m")).drop("__m")


def running_sum(df: DataFrame, column: str, out: str, keys=KEYS, time: str = "time", by_value: bool = False) -> DataFrame:
    """Sum up to a row, in order of time or, with ties by time, of value; nulls come last in the latter."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(column), time) if by_value else series(keys, time)
    return df.withColumn(out, F.sum(column).over(before(w)))


def more_likely(p_dry: Column, p_wet: Column) -> Column:
    """1 if wet is the likelier class, else 0, also for nulls and ties."""
    return F.when(p_wet > p_dry, 1).otherwise(0)


def debounce(df: DataFrame, seconds: float, keys=("cml_id",), time: str = "time") -> DataFrame:
    """Rows that no other row of the series follows within so many seconds; rows of null time stay."""
    gap = F.unix_micros(F.lead(F.col(time).cast("timestamp")).over(series(keys, time))) - F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > int(seconds * 1_000_000))).drop("__gap")


def histogram(df: DataFrame, widths: dict[str, float]) -> DataFrame:
    """Counts by bins of the given widths; a bin is named by its lower end. Rows with a null are left out."""
    bins = [(F.floor(F.col(c) / w) * w).alias(c) for c, w in widths.items()]
    return df.dropna(subset=[*widths]).groupBy(*bins).agg(F.count("*").alias("n"))


def centre(links: DataFrame) -> DataFrame:
    """Mean of both sites' coordinates as lon and lat; null where either is."""
    return links.withColumns({"lon": (F.col("site_a_lon") + F.col("site_b_lon")) / 2, "lat": (F.col("site_a_lat") + F.col("site_b_lat")) / 2})


def wet_fraction(df: DataFrame, wet: str = "wet", keys=KEYS) -> DataFrame:
    """Share of rows that are wet (nulls count as rows), and wet by dry rows, for each series."""
    n = F.count_if(F.col(wet).cast("double") == 1)
    return df.groupBy(*keys).agg((n / F.count("*")).alias("wet_fraction"), F.try_divide(n, F.count_if(F.col(wet).cast("double") == 0)).alias("wet_dry_ratio"))


def keep_quiet_links(df: DataFrame, column: str, most: float = 0.3, wet: str = "wet", keys=KEYS) -> DataFrame:
    """Null in a column of series whose wet fraction is not below most."""
    return df.join(wet_fraction(df, wet, keys).select(*keys, "wet_fraction"), [*keys]).withColumn(column, F.when(F.col("wet_fraction") < most, F.col(column)))
