"""Performance of wet/dry classifications and rain estimates, each in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clean(df: DataFrame, reference: str, predicted: str, by) -> DataFrame:
    cols = {n: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for n, c in (("__r", reference), ("__p", predicted))}
    return df.select(*by, *(c.alias(n) for n, c in cols.items())).withColumn("__ok", F.col("__r").isNotNull() & F.col("__p").isNotNull())


def wet_dry_metrics(df: DataFrame, reference: str = "reference", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Rates, Matthews correlation and counts; above 0 is wet. Rates without a case are null.

    The correlation is 0 if nothing is predicted wet or its denominator is zero.
    """
    r, p, ok = F.col("__r") > 0, F.col("__p") > 0, F.col("__ok")
    n = lambda c: F.count_if(ok & c)
    counts = {
        "N_true_wet": n(r & p), "N_true_dry": n(~r & ~p), "N_false_wet": n(~r & p), "N_missed_wet": n(r & ~p), "N_wet_reference": n(r), "N_dry_reference": n(~r),
        "N_all_pairs": F.count("*"), "N_nan_pairs": F.count_if(~ok), "N_nan_reference_only": F.count_if(F.col("__r").isNull()), "N_nan_predicted_only": F.count_if(F.col("__p").isNull()),
    }
    out = _clean(df, reference, predicted, by).groupBy(*by).agg(*(c.alias(k) for k, c in counts.items()))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("N_true_wet", "N_true_dry", "N_false_wet", "N_missed_wet"))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.select(
        *by,
        F.try_divide(fp, F.col("N_dry_reference")).alias("false_wet_rate"),
        F.try_divide(fn, F.col("N_wet_reference")).alias("missed_wet_rate"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, below), F.lit(0.0)).alias("matthews_correlation"),
        F.try_divide(tp, F.col("N_wet_reference")).alias("true_wet_rate"),
        F.try_divide(tn, F.col("N_dry_reference")).alias("true_dry_rate"),
        "N_dry_reference", "N_wet_reference", "N_true_wet", "N_true_dry", "N_false_wet", "N_missed_wet", "N_all_pairs", "N_nan_pairs", "N_nan_reference_only", "N_nan_predicted_only",
    )


def rain_metrics(df: DataFrame, threshold: float, reference: str = "reference", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Correlation, coefficient of variation, errors, sums, means, wet rates; above threshold is wet.

    Pairs with a null or NaN count as such and enter nothing else; what has no case is null.
    """
    ok = F.col("__ok")
    r, p = F.when(ok, F.col("__r")), F.when(ok, F.col("__p"))
    wet_r, wet_p = r > threshold, p > threshold
    made = {
        "pearson_correlation": F.corr(r, p),
        "coefficient_of_variation": F.try_divide(F.stddev_pop(p - r), F.avg(r)),
        "root_mean_square_error": F.sqrt(F.avg(F.pow(p - r, 2))),
        "mean_absolute_error": F.avg(F.abs(p - r)),
        "R_sum_reference": F.sum(r),
        "R_sum_predicted": F.sum(p),
        "R_mean_reference": F.avg(r),
        "R_mean_predicted": F.avg(p),
        "false_wet_rate": F.try_divide(F.count_if(~wet_r & wet_p).cast("double"), F.count_if(~wet_r)),
        "missed_wet_rate": F.try_divide(F.count_if(wet_r & ~wet_p).cast("double"), F.count_if(wet_r)),
        "false_wet_precipitation_rate": F.avg(F.when(~wet_r & wet_p, p)),
        "missed_wet_precipitation_rate": F.avg(F.when(wet_r & ~wet_p, r)),
        "rainfall_threshold_wet": F.first(F.lit(float(threshold))),
        "N_all_pairs": F.count("*"),
        "N_nan_pairs": F.count_if(~ok),
        "N_nan_reference_only": F.count_if(F.col("__r").isNull()),
        "N_nan_predicted_only": F.count_if(F.col("__p").isNull()),
    }
    return _clean(df, reference, predicted, by).groupBy(*by).agg(*(c.alias(k) for k, c in made.items()))


def wet_error_rates(df: DataFrame, reference: str = "reference", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """(false_wet_rate, missed_wet_rate)."""
    return wet_dry_metrics(df, reference, predicted, by).select(*by, "false_wet_rate", "missed_wet_rate")


def wet_dry_error(df: DataFrame, reference: str = "reference", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """(wet_error, dry_error): shares of dry rows called wet and of wet rows called dry."""
    return wet_error_rates(df, reference, predicted, by).select(*by, F.col("false_wet_rate").alias("wet_error"), F.col("missed_wet_rate").alias("dry_error"))


def series_correlation(left: DataFrame, right: DataFrame, value_left: str, value_right: str, keys: tuple[str, ...] = ("time",)) -> DataFrame:
    """Pearson correlation of two frames' values at equal keys."""
    joined = left.select(*keys, F.col(value_left).alias("__l")).join(right.select(*keys, F.col(value_right).alias("__r")), [*keys])
    return joined.agg(F.corr("__l", "__r").alias("pearson_correlation"))
