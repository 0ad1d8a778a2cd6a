"""Baselines, error metrics and residual tables.

Labels are whole numbers of time units, so a histogram ``(label, n)`` holds all the
information a baseline needs and is far smaller than the rows: its size is bounded by the
time span of the log. Baselines are therefore computed on histograms that Spark
pre-aggregates on the map side, never on groups of raw rows. For labels of which nearly all differ (``distinct=True``)
medians come from selection in rounds instead (``operators/selection.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.operators.selection import GROUP_ROWS, exact_quantiles
from viewtide.operators.splits import TEST, TRAIN

# Names of the results table, in its order.
REPORT_NAMES = (
    "Mean Absolute Error (MAE)",
    "Root Mean Squared Error (RMSE)",
    "Baseline Mean Engagement Duration (MAE)",
    "Baseline Median Engagement Duration (MAE)",
)


def label_histogram(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct label (and per ``by``), as columns ``label`` and ``n``."""
    return df.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def weighted_mean(label: Column, n: Column) -> Column:
    return F.sum(label * n) / F.sum(n)


def weighted_median(label: Column, n: Column) -> Column:
    """Exact median; the mean of the two middle labels for an even number of rows."""
    return F.percentile(label, F.lit(0.5), n)


def _mean_median() -> list[Column]:
    label, n = F.col("label"), F.col("n")
    return [weighted_mean(label, n).alias("mean"), weighted_median(label, n).alias("median")]


def _weighted_errors(prediction: Column, prefix: str) -> list[Column]:
    """MAE, MSE and RMSE of a prediction over a label histogram."""
    error, n = F.col("label") - prediction, F.col("n")
    mse = F.sum(error * error * n) / F.sum(n)
    return [
        (F.sum(F.abs(error) * n) / F.sum(n)).alias(f"{prefix}_mae"),
        mse.alias(f"{prefix}_mse"),
        F.sqrt(mse).alias(f"{prefix}_rmse"),
    ]


def baseline_values(df: DataFrame, label: str, distinct: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row: mean and exact median of the training labels."""
    train = df.where(F.col("part") == TRAIN)
    if not distinct:
        return label_histogram(train, label).agg(*_mean_median())
    median = exact_quantiles(train, label, [0.5], group_rows=group_rows).agg(F.max("quantile")).scalar()
    return train.agg(F.avg(F.col(label).cast("double")).alias("mean")).withColumn("median", median)


def baseline_scalar(df: DataFrame, label: str) -> Column:
    """The training mean and median as one scalar subquery (a struct)."""
    return baseline_values(df, label).select(F.struct("mean", "median").alias("baseline")).scalar()


def baseline_metrics(df: DataFrame, label: str) -> DataFrame:
    """Errors on the test part when the training mean or median is predicted for every row."""
    test = label_histogram(df.where(F.col("part") == TEST), label)
    errors = test.withColumn("_base", baseline_scalar(df, label)).agg(
        *_weighted_errors(F.col("_base.mean"), "mean"), *_weighted_errors(F.col("_base.median"), "median")
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("baseline"), *[F.col(f"{b}_{m}").alias(m) for m in ("mae", "mse", "rmse")])
            for b in ("mean", "median")
        ]
    )
    return errors.select(F.inline(rows))


def baseline_residuals(df: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
    """Test rows with the label and its residual against each baseline."""
    test = df.where(F.col("part") == TEST).select(row_id, F.col(label).alias("actual"))
    return test.withColumn("_base", baseline_scalar(df, label)).select(
        row_id,
        "actual",
        (F.col("actual") - F.col("_base.mean")).alias("residual_mean"),
        (F.col("actual") - F.col("_base.median")).alias("residual_median"),
    )


def median_per_streamer(df: DataFrame, label: str, distinct: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Baseline that predicts each streamer's training median, the global one for a new streamer.

    One row per streamer of the test part: the prediction used, test rows and their MAE. With ``distinct`` the test
    labels are not counted by value either, so a streamer's test rows are summed up where they lie.
    """
    train, test = df.where(F.col("part") == TRAIN), df.where(F.col("part") == TEST)
    known = train.where(F.col("streamer").isNotNull())
    if distinct:
        own = exact_quantiles(known, label, [0.5], ["streamer"], group_rows).select("streamer", F.col("quantile").alias("_own"))
        overall = exact_quantiles(train, label, [0.5], group_rows=group_rows).agg(F.max("quantile")).scalar()
        labels = test.select("streamer", F.col(label).alias("label"), F.lit(1).cast("long").alias("n"))
    else:
        own = label_histogram(known, label, ["streamer"]).groupBy("streamer").agg(weighted_median(F.col("label"), F.col("n")).alias("_own"))
        overall = label_histogram(train, label).agg(weighted_median(F.col("label"), F.col("n"))).scalar()
        labels = label_histogram(test, label, ["streamer"])
    return (
        labels.join(own, "streamer", "left")
        .withColumn("prediction", F.coalesce(F.col("_own"), overall))
        .groupBy("streamer", "prediction")
        .agg(
            F.sum("n").alias("test_rows"),
            (F.sum(F.abs(F.col("label") - F.col("prediction")) * F.col("n")) / F.sum("n")).alias("mae"),
        )
    )


def fold_baselines(df: DataFrame, label: str, k: int, fold: str = "fold") -> DataFrame:
    """MAE of both baselines on every fold, fitted on the other folds."""
    hist = label_histogram(df, label, [fold])
    fitted = (
        hist.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .where(F.col("held_out") != F.col(fold))
        .groupBy(F.col("held_out").alias(fold))
        .agg(*_mean_median())
    )
    n = F.col("n")
    return (
        hist.join(fitted, fold)
        .groupBy(fold)
        .agg(
            F.sum(n).alias("rows"),
            (F.sum(F.abs(F.col("label") - F.col("mean")) * n) / F.sum(n)).alias("mean_mae"),
            (F.sum(F.abs(F.col("label") - F.col("median")) * n) / F.sum(n)).alias("median_mae"),
        )
    )


def fold_stability(df: DataFrame, label: str, k: int, fold: str = "fold") -> DataFrame:
    """Mean and standard deviation across folds of the MAE of both baselines."""
    per_fold = fold_baselines(df, label, k, fold)
    spread = per_fold.agg(
        *[f(f"{b}_mae").alias(f"{b}_{s}") for b in ("mean", "median") for s, f in _SPREAD.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("baseline"), *[F.col(f"{b}_{s}").alias(s) for s in _SPREAD])
            for b in ("mean", "median")
        ]
    )
    return spread.select(F.inline(rows))


_SPREAD = {"mae_mean": F.avg, "mae_std": F.stddev_samp}


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: MAE, MSE, RMSE and R2 of a scored table, in a single aggregate.

    R2 of labels that do not vary is 1 for a perfect fit, else 0.
    """
    error = F.col(label) - F.col(prediction)
    mse = F.avg(error * error)
    constant = F.when(mse == 0, 1.0).when(mse > 0, 0.0)
    return scored.agg(
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.coalesce(1 - F.try_divide(mse, F.var_pop(label)), constant).alias("r2"),
    )


def metric_report(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """The results table: model MAE and RMSE, then the MAE of both baselines."""
    named = [F.max(F.when(F.col("baseline") == b, F.col("mae"))).alias(b) for b in ("mean", "median")]
    both = baselines.agg(F.struct(*named).alias("both")).scalar()
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(value).alias("value"))
            for name, value in zip(REPORT_NAMES, ("mae", "rmse", "_both.mean", "_both.median"), strict=True)
        ]
    )
    return metrics.withColumn("_both", both).select(F.inline(rows))


def label_deciles(df: DataFrame, label: str) -> Column:
    """Scalar subquery: the nine inner decile bounds of the labels."""
    bounds = F.percentile(F.col("label"), F.array(*[F.lit(i / 10) for i in range(1, 10)]), F.col("n"))
    return label_histogram(df, label).agg(bounds.alias("bounds")).scalar()


def residual_bias(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean and spread of the residual per streamer, hour of day and decile of the label.

    A mean away from zero in a group is a systematic bias. Needs columns ``streamer`` and
    ``hour_of_day``. Every row contributes to its three groups before one map-side combined
    aggregate.
    """
    scored = scored.withColumn("_bounds", label_deciles(scored, label))
    decile = 1 + F.size(F.filter("_bounds", lambda bound: F.col(label) > bound))
    groups = F.array(
        F.struct(F.lit("streamer").alias("grouping"), F.col("streamer").alias("level")),
        F.struct(F.lit("hour_of_day").alias("grouping"), F.col("hour_of_day").cast("string").alias("level")),
        F.struct(F.lit("decile").alias("grouping"), decile.cast("string").alias("level")),
    )
    return (
        scored.select((F.col(label) - F.col(prediction)).alias("_residual"), F.inline(groups))
        .groupBy("grouping", "level")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("_residual").alias("mean_residual"),
            F.stddev_samp("_residual").alias("std_residual"),
        )
    )


def residual_bins(
    scored: DataFrame, width: float = 1.0, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Scatter plots as counts: cells of actual, predicted and residual of the given width."""
    cell = {
        "actual_bin": F.col(label),
        "predicted_bin": F.col(prediction),
        "residual_bin": F.col(label) - F.col(prediction),
    }
    bins = [(F.floor(c / width) * width).alias(name) for name, c in cell.items()]
    return scored.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))


def comparison_series(scored: DataFrame, baselines: Column, idx: str, label: str, prediction: str) -> DataFrame:
    """Test rows as the four series of the comparison plot, still unsmoothed."""
    return scored.withColumn("_base", baselines).select(
        idx,
        F.col(label).cast("double").alias("actual"),
        F.col(prediction).alias("predicted"),
        F.col("_base.mean").alias("mean_line"),
        F.col("_base.median").alias("median_line"),
    )
