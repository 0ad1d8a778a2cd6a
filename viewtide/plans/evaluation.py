"""From a viewing log to a model report: staged training tables, scoring, smoothed series."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.operators import metrics, splits
from viewtide.operators.windows import rolling_mean
from viewtide.plans import features, models
from viewtide.schema import TREE_LABEL
from viewtide.session import stage_table

ROLLING_WIDTH = 50


def part_of(table: DataFrame, part: str) -> DataFrame:
    return table.where(F.col("part") == part)


def _staged(log: DataFrame, table: DataFrame, cap: int | None, shuffle: bool, row_id: str, name: str) -> DataFrame:
    """Give a feature table its split and a dense index ``idx`` in split order, and stage it."""
    ids = splits.head_rows(log, cap, row_id).select(row_id)
    n = ids.count()
    if shuffle:
        indexed = splits.shuffled_index(table, row_id, name="idx", ids=ids)
    else:
        indexed = table.withColumn("idx", F.col(row_id))
    split = splits.positional_split(indexed, "idx", n=F.lit(n))
    # in index order, so that parts, folds and prefixes skip row groups
    return stage_table(splits.by_spans(split, "idx", n), name)


def tree_table(
    log: DataFrame, cap: int | None = None, unit: str = "10min", shuffle: bool = False, row_id: str = "row_id"
) -> DataFrame:
    """Tree features with ``part`` and ``idx``: the last fifth is test, in file or random order."""
    table = features.tree_features(log, cap, unit, row_id, keep=("streamer",))
    return _staged(log, table, cap, shuffle, row_id, "tree-features")


def out_of_fold_table(
    log: DataFrame, k: int, cap: int | None = None, unit: str = "10min", row_id: str = "row_id"
) -> DataFrame:
    """Staged tree features without leakage between ``k`` contiguous folds in file order, with ``fold`` and ``idx``."""
    folded = splits.kfold(splits.head_rows(log, cap, row_id), row_id, k)
    table = features.out_of_fold_features(folded, k, unit=unit, row_id=row_id).withColumn("idx", F.col(row_id))
    n = splits.head_rows(log, cap, row_id).count()
    return stage_table(splits.by_spans(table, "idx", n), "out-of-fold-features")


def encoded_table(
    log: DataFrame, cap: int | None = None, unit: str = "10min", shuffle: bool = True, row_id: str = "row_id"
) -> DataFrame:
    """Features of the linear model, before encoding, with ``part`` and ``idx``."""
    table = features.encoded_features(log, cap, unit, row_id)
    return _staged(log, table, cap, shuffle, row_id, "encoded-features")


def score_trees(estimator: Estimator, table: DataFrame) -> DataFrame:
    """Fit a tree model on the training part of a staged table and score the test part."""
    return models.fit_and_score(estimator, models.assemble(table), "idx")[1]


def report(table: DataFrame, scored: DataFrame, name: str, label: str = TREE_LABEL) -> DataFrame:
    """Metrics of a model and of both baselines as rows ``(model, metric, value)``."""
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse", "mse")]
    )
    baselines = metrics.baseline_metrics(table, label).select(
        F.concat(F.lit("baseline "), "baseline").alias("model"), F.inline(values)
    )
    return models.metric_table(scored, name).unionByName(baselines)


def test_index(idx: str, n: Column) -> Column:
    """Position of a row inside the test part of a positional split over ``idx``."""
    return F.col(idx) - (n - splits.test_size(n))


def smoothed_comparison(
    scored: DataFrame,
    baselines: Column,
    n: Column,
    idx: str = "idx",
    label: str = "label",
    prediction: str = "prediction",
    sample: int | None = None,
    width: int = ROLLING_WIDTH,
) -> DataFrame:
    """Smoothed label, prediction and baseline series over the test part, or its first rows.

    ``baselines`` is the scalar of ``metrics.baseline_scalar`` and ``n`` the number of rows
    that were split.
    """
    placed = scored.withColumn("test_idx", test_index(idx, n))
    series = metrics.comparison_series(
        splits.head_rows(placed, sample, "test_idx"), baselines, "test_idx", label, prediction
    )
    return rolling_mean(series, "test_idx", series.columns[1:], width)
