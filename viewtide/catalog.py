"""Every query by name: a function of the session and the folder of the input tables.

All of them run over the whole tables. Query functions only put operators together; what they
compute is documented at the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.functions import times
from viewtide.operators import encode, metrics, selection, splits, stats, windows
from viewtide.operators.joins import join_back
from viewtide.plans import evaluation, features, models, tuning
from viewtide.plans.evaluation import ROLLING_WIDTH, part_of
from viewtide.schema import ENCODED_NUMERIC, TREE_LABEL
from viewtide.session import scratch_path, stage_table
from viewtide.sources import interactions, order, records
from viewtide.sources.adapters import events_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small enough to cut rows off the smallest test tables.
HEAD_ROWS = 700
PLOT_SAMPLE = 150
FOLDS = 5
QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)

# Errors against a mean of round-numbered counts are short decimals; with this many digits
# none of them lies halfway between two rounded values.
FINE = 10


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- totals and grouped statistics ---------------------------------------------------------


@query
def interaction_summary(spark, folder):
    return stats.summary(events_log(spark, folder))


@query
def stream_watch_time(spark, folder):
    return stats.stream_watch_time(events_log(spark, folder))


@query
def user_distinct_streams(spark, folder):
    return stats.user_distinct_streams(events_log(spark, folder))


@query
def user_stream_sets(spark, folder):
    return stats.user_stream_sets(events_log(spark, folder))


@query
def most_watched_stream(spark, folder):
    return stats.most_watched_stream(events_log(spark, folder))


@query
def streamer_watch_time(spark, folder):
    return stats.streamer_watch_time(events_log(spark, folder)).drop("rows")


@query
def user_stats(spark, folder):
    return rounded(stats.user_stats(events_log(spark, folder)).drop("rows"), "avg_duration")


@query
def streamer_popularity(spark, folder):
    return stats.streamer_popularity(events_log(spark, folder)).drop("rows").orderBy(F.desc("popularity"), "streamer")


@query
def label_range(spark, folder):
    return stats.label_range(part_of(_split_log(spark, folder), splits.TEST), "duration")


# --- row-level features ---------------------------------------------------------------------


@query
def session_duration(spark, folder):
    log = interactions.session_duration(events_log(spark, folder), TREE_LABEL)
    return log.select("row_id", TREE_LABEL)


@query
def streamer_watch_time_join(spark, folder):
    log = events_log(spark, folder).select("row_id", "streamer", "duration")
    return join_back(log, stats.streamer_watch_time(log), "streamer", "rows")


@query
def user_stats_join(spark, folder):
    log = events_log(spark, folder)
    joined = join_back(log, stats.user_stats(log), "user_id", "rows")
    return rounded(joined.select("row_id", "user_id", "num_streams_watched", "avg_duration"), "avg_duration")


@query
def user_history_join(spark, folder):
    log = events_log(spark, folder)
    joined = join_back(log, stats.user_stats(log, count_name="streams_watched"), "user_id", "rows")
    return rounded(joined.select("row_id", "user_id", "streams_watched", "avg_duration"), "avg_duration")


@query
def streamer_popularity_join(spark, folder):
    log = events_log(spark, folder).select("row_id", "streamer")
    return join_back(log, stats.streamer_popularity(log), "streamer", "rows")


@query
def prev_session_user(spark, folder):
    log = events_log(spark, folder).select("row_id", "user_id", "duration")
    return windows.prev_session(log, "user_id")


@query
def prev_session_user_streamer(spark, folder):
    log = events_log(spark, folder).select("row_id", "user_id", "streamer", "duration")
    return windows.prev_session(log, ["user_id", "streamer"])


@query
def prev_session_by_time(spark, folder):
    """Previous session of the user in order of start time; of equal times, in file order."""
    log = events_log(spark, folder).select("row_id", "user_id", "start_time", "duration")
    return windows.prev_session_by(log, "user_id", ["start_time", "row_id"])


@query
def prev_session_pair_by_time(spark, folder):
    """The same per user and streamer, latest row first among equal times."""
    log = events_log(spark, folder).select("row_id", "user_id", "streamer", "start_time", "duration")
    return windows.prev_session_by(log, ["user_id", "streamer"], ["start_time", F.desc("row_id")])


@query
def time_features_ns(spark, folder):
    log = features.time_features(events_log(spark, folder, "ns"), "ns")
    micros = F.unix_micros(times.epoch_timestamp(F.col("start_time"))).alias("start_micros")
    return log.select("row_id", "start_time", micros, "hour_of_day", "day_of_week")


@query
def time_features_sec(spark, folder):
    log = features.time_features(events_log(spark, folder, "sec"), "sec")
    return log.select("row_id", "start_time", "hour_of_day", "day_of_week")


@query
def time_features_10min(spark, folder):
    log = features.time_features(events_log(spark, folder), "10min")
    return log.select("row_id", "start_time", "hour_of_day", "day_of_week")


@query
def time_of_day(spark, folder):
    hour = times.hour_of_day(F.col("start_time"), "sec")
    return events_log(spark, folder, "sec").select(
        "row_id",
        times.time_of_day(hour).alias("time_of_day"),
        times.time_of_day_order(hour).alias("time_of_day_order"),
    )


@query
def day_label(spark, folder):
    return events_log(spark, folder, "sec").select(
        "row_id", times.day_label(F.col("start_time"), "sec").alias("day_of_week")
    )


@query
def feature_table(spark, folder):
    return rounded(features.tree_features(events_log(spark, folder)), "avg_duration")


@query
def feature_table_ns(spark, folder):
    """10-minute integers taken for nanoseconds: both time features come out constant."""
    return rounded(features.tree_features(events_log(spark, folder), unit="ns"), "avg_duration")


@query
def feature_table_sec(spark, folder):
    return rounded(features.tree_features(events_log(spark, folder, "sec"), unit="sec"), "avg_duration")


@query
def feature_table_train_scope(spark, folder):
    """Statistics from the training part only, without leakage from test rows."""
    marked = splits.positional_split(events_log(spark, folder))
    table = features.tree_features(marked, fit_on=F.col("part") == splits.TRAIN, keep=("part",))
    return rounded(table, "avg_duration")


@query
def feature_table_out_of_fold(spark, folder):
    """Statistics of every row from the other folds only."""
    log = splits.kfold(events_log(spark, folder), "row_id", FOLDS)
    return rounded(features.out_of_fold_features(log, FOLDS), "avg_duration")


@query
def encoded_feature_table(spark, folder):
    return rounded(features.encoded_features(events_log(spark, folder)), "avg_duration")


@query
def encoded_feature_table_sec(spark, folder):
    return rounded(features.encoded_features(events_log(spark, folder, "sec"), unit="sec"), "avg_duration")


# --- order, caps, splits --------------------------------------------------------------------


@query
def row_order(spark, folder):
    return order.parquet_row_order(spark, f"{folder}/events.parquet").select("row_id", "event_id")


@query
def head_rows(spark, folder):
    """The cap itself: the first rows in file order."""
    return splits.head_rows(events_log(spark, folder), HEAD_ROWS)


@query
def split_positional(spark, folder):
    return splits.positional_split(events_log(spark, folder)).select("row_id", "part")


@query
def split_shuffled(spark, folder):
    return splits.hash_split(events_log(spark, folder)).select("row_id", "part")


@query
def split_shuffled_exact(spark, folder):
    log = events_log(spark, folder).select("row_id")
    return splits.positional_split(splits.shuffled_index(log), "shuffled_idx", n=splits.row_count(log))


@query
def kfold_assign(spark, folder):
    log = events_log(spark, folder).select("row_id")
    return splits.kfold(splits.kfold(log, "row_id", 3, "fold_of_3"), "row_id", 5, "fold_of_5")


@query
def validation_tail(spark, folder):
    return splits.validation_tail(events_log(spark, folder)).select("row_id", "part")


@query
def learning_curve_sizes(spark, folder):
    return splits.learning_curve_sizes(events_log(spark, folder).select("row_id"), "row_id", FOLDS)


# --- smoothing and encoding -----------------------------------------------------------------


@query
def rolling_mean(spark, folder):
    means = windows.rolling_mean(events_log(spark, folder), "row_id", ["duration"], ROLLING_WIDTH, block=4_096)
    return rounded(means, "duration")


@query
def minmax_scale(spark, folder):
    table = features.encoded_features(events_log(spark, folder)).select("row_id", *ENCODED_NUMERIC)
    table = stage_table(table, "numeric")  # read twice: for the ranges, then to be scaled
    return rounded(encode.minmax_scale(table, ENCODED_NUMERIC), *ENCODED_NUMERIC)


@query
def minmax_scale_train(spark, folder):
    """The same columns scaled by the ranges of the training part only."""
    log = events_log(spark, folder)
    table = features.encoded_features(log).select("row_id", *ENCODED_NUMERIC)
    table = stage_table(splits.positional_split(table, n=splits.row_count(log)), "numeric")
    scaled = encode.minmax_scale(table, ENCODED_NUMERIC, fit_on=part_of(table, splits.TRAIN))
    return rounded(scaled, *ENCODED_NUMERIC)


@query
def one_hot(spark, folder):
    t = F.col("start_time")
    log = events_log(spark, folder).select(
        "row_id",
        times.time_of_day(times.hour_of_day(t, "10min")).alias("time_of_day"),
        times.day_label(t, "10min").alias("day_of_week"),
    )
    return encode.one_hot(log)


# --- baselines and residuals ----------------------------------------------------------------


def _split_log(spark, folder) -> DataFrame:
    return splits.positional_split(events_log(spark, folder))


@query
def baseline_values(spark, folder):
    return rounded(metrics.baseline_values(_split_log(spark, folder), "duration"), "mean", "median")


# Small enough that the smallest test tables hold groups beyond it.
ORDERED_ROWS = 64


def _ns_log(spark, folder) -> DataFrame:
    """The split log with the watch time in nanoseconds as ``label``, every row's another."""
    return _split_log(spark, folder).withColumn("label", F.col("duration") * 1_000_000_000 + F.col("row_id") * 7919 % 1_000_003 * 997)


@query
def label_quantiles_ns(spark, folder):
    table = selection.exact_quantiles(_ns_log(spark, folder), "label", QUANTILES, ["part"], ORDERED_ROWS)
    return rounded(table, "quantile", digits=3)


@query
def streamer_quantiles_ns(spark, folder):
    table = selection.exact_quantiles(_ns_log(spark, folder), "label", QUANTILES, ["streamer"], ORDERED_ROWS)
    return rounded(table, "quantile", digits=3)


@query
def baseline_values_ns(spark, folder):
    return rounded(metrics.baseline_values(_ns_log(spark, folder), "label", True, ORDERED_ROWS), "mean", "median", digits=3)


@query
def baseline_metrics(spark, folder):
    table = metrics.baseline_metrics(_split_log(spark, folder), "duration")
    return rounded(table, "mae", "mse", "rmse", digits=FINE)


@query
def baseline_metrics_shuffled(spark, folder):
    log = splits.hash_split(events_log(spark, folder))
    return rounded(metrics.baseline_metrics(log, "duration"), "mae", "mse", "rmse", digits=FINE)


@query
def baseline_residuals(spark, folder):
    residuals = metrics.baseline_residuals(_split_log(spark, folder), "duration")
    return rounded(residuals, "residual_mean", "residual_median")


@query
def baseline_median_per_streamer(spark, folder):
    return rounded(metrics.median_per_streamer(_split_log(spark, folder), "duration"), "prediction", "mae")


@query
def fold_baselines(spark, folder):
    log = splits.kfold(events_log(spark, folder), "row_id", FOLDS)
    return rounded(metrics.fold_baselines(log, "duration", FOLDS), "mean_mae", "median_mae", digits=FINE)


@query
def fold_stability(spark, folder):
    log = splits.kfold(events_log(spark, folder), "row_id", FOLDS)
    return rounded(metrics.fold_stability(log, "duration", FOLDS), "mae_mean", "mae_std", digits=FINE)


@query
def residual_bias(spark, folder):
    log = features.time_features(_split_log(spark, folder))
    base = metrics.baseline_scalar(log, "duration")
    scored = log.where(F.col("part") == splits.TEST).select(
        "streamer", "hour_of_day", F.col("duration").alias("label"), base.getField("mean").alias("prediction")
    )
    return rounded(metrics.residual_bias(scored), "mean_residual", "std_residual")


def _scored_by_history(spark, folder) -> DataFrame:
    """Test rows of the feature table, with the user's mean duration as prediction."""
    table = features.tree_features(_split_log(spark, folder), keep=("part",))
    test = table.where(F.col("part") == splits.TEST)
    return test.withColumns({"label": F.col(TREE_LABEL), "prediction": F.col("avg_duration")})


@query
def history_metrics(spark, folder):
    scored = _scored_by_history(spark, folder)
    return rounded(metrics.regression_metrics(scored), "mae", "mse", "rmse", "r2")


@query
def metric_report(spark, folder):
    scored = _scored_by_history(spark, folder)
    baselines = metrics.baseline_metrics(_split_log(spark, folder), "duration")
    return rounded(metrics.metric_report(metrics.regression_metrics(scored), baselines), "value", digits=FINE)


@query
def residual_bins(spark, folder):
    scored = _scored_by_history(spark, folder)
    return metrics.residual_bins(scored, width=1.0)


@query
def smoothed_series(spark, folder):
    """The four smoothed series over the whole test part."""
    return _smoothed_history(spark, folder, None)


@query
def smoothed_sample(spark, folder):
    """The plot sample itself: the first test rows, then smoothed."""
    return _smoothed_history(spark, folder, PLOT_SAMPLE)


def _smoothed_history(spark, folder, sample):
    log = _split_log(spark, folder)
    series = evaluation.smoothed_comparison(
        _scored_by_history(spark, folder),
        metrics.baseline_scalar(log, "duration"),
        splits.row_count(log),
        idx="row_id",
        sample=sample,
    )
    return rounded(series, "actual", "predicted", "mean_line", "median_line")


# --- file sources ---------------------------------------------------------------------------


@query
def scan_interactions(spark, folder):
    """The log written as gzip text by Spark, scanned, checked and stored."""
    text, table = scratch_path(spark, "log-text"), scratch_path(spark, "log")
    interactions.write_log(events_log(spark, folder), text)
    return interactions.ingest_interactions(spark, text, table)


@query
def scan_empty_fields(spark, folder):
    """The log with empty stream and streamer fields, which are keys of their own."""
    text, table = scratch_path(spark, "log-text"), scratch_path(spark, "log")
    i = F.col("row_id")
    log = events_log(spark, folder).withColumns(
        {
            "stream_id": F.when(i % 7 != 0, F.col("stream_id")),
            "streamer": F.when(i % 5 != 0, F.col("streamer")),
        }
    )
    interactions.write_log(log, text)
    return interactions.ingest_interactions(spark, text, table)


def _damaged_scan(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The log with every start time of one event type damaged, as good rows and rejected lines."""
    text = scratch_path(spark, "damaged-text")
    log = events_log(spark, folder)
    start = F.when(F.col("streamer") == "error", F.concat(F.lit("t"), F.col("start_time"))).otherwise(
        F.col("start_time").cast("string")
    )
    interactions.write_log(log.withColumn("start_time", start), text)
    return interactions.scan_with_quarantine(spark, text)


@query
def scan_rejected_lines(spark, folder):
    """The rejected lines of the damaged log with their row ids."""
    return _damaged_scan(spark, folder)[1]


@query
def scan_quarantine(spark, folder):
    """How many rows of the damaged log are read and how many fail."""
    good, bad = _damaged_scan(spark, folder)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("result"), "rows")
              for n, df in (("good", good), ("quarantined", bad))]
    return counts[0].unionByName(counts[1])


@query
def load_records(spark, folder):
    """The log as one Python literal per line, two event types with literals JSON lacks."""
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("streamer", T.StringType()),
            T.StructField("live", T.BooleanType()),
            T.StructField("note", T.StringType()),
            T.StructField("span", T.ArrayType(T.LongType())),
        ]
    )
    plain = F.format_string("{'row_id': %d, 'streamer': '%s', 'live': false, 'span': [%d, %d]}", *_RECORD_FIELDS)
    literal = F.format_string(
        "{'row_id': %d, 'streamer': '%s', 'live': True, 'note': None, 'span': (%d, %d)}", *_RECORD_FIELDS
    )
    text = scratch_path(spark, "records")
    log = events_log(spark, folder)
    files = log.repartition(spark.sparkContext.defaultParallelism, "row_id")
    lines = files.select(F.when(F.col("streamer").isin("click", "error"), literal).otherwise(plain).alias("value"))
    lines.write.option("compression", "gzip").text(text)
    good, _ = records.load_records(spark, text, schema)
    return good.select("row_id", "streamer", "live", "note", F.col("span")[0].alias("first"), F.col("span")[1].alias("last"))


@query
def load_records_mixed(spark, folder):
    """One record per line but for two event types, whose lines hold more: read records and failed lines."""
    one = F.format_string("{'row_id': %d}", "row_id")
    line = F.when(F.col("streamer") == "click", F.concat(one, F.lit(", "), one))
    line = line.when(F.col("streamer") == "error", F.concat(one, F.lit("} rest"))).otherwise(one)
    text = scratch_path(spark, "records")
    log = events_log(spark, folder)
    files = log.repartition(spark.sparkContext.defaultParallelism, "row_id")
    files.select(line.alias("value")).write.option("compression", "gzip").text(text)
    good, bad = records.load_records(spark, text, T.StructType([T.StructField("row_id", T.LongType())]))
    read = good.select("row_id", F.lit(None).cast("string").alias("failed_line"))
    return read.unionByName(bad.select(F.lit(None).cast("bigint").alias("row_id"), F.col("line").alias("failed_line")))


_RECORD_FIELDS = ("row_id", "streamer", "start_time", "stop_time")


# --- models ---------------------------------------------------------------------------------
#
# Fits see every row and run at the functions' default sizes.


def _tree_table(spark, folder, shuffle: bool) -> DataFrame:
    return evaluation.tree_table(events_log(spark, folder), shuffle=shuffle)


def _report(spark, folder, name, estimator, shuffle) -> DataFrame:
    table = _tree_table(spark, folder, shuffle)
    return evaluation.report(table, evaluation.score_trees(estimator, table), name)


@query
def rf_default(spark, folder):
    return _report(spark, folder, "default forest", models.default_forest(), shuffle=False)


@query
def rf_tuned(spark, folder):
    return _report(spark, folder, "tuned forest", models.tuned_forest(), shuffle=True)


@query
def gbt(spark, folder):
    return _report(spark, folder, "boosted trees", models.boosted_trees(), shuffle=False)


def _search(spark, folder, search, **settings) -> DataFrame:
    table = _tree_table(spark, folder, shuffle=True)
    found = search(models.assemble(part_of(table, splits.TRAIN)), **settings)
    scored = models.score(found.bestModel, models.assemble(part_of(table, splits.TEST)))
    return evaluation.report(table, scored, "best forest").unionByName(tuning.search_table(found, spark))


@query
def rf_grid_search(spark, folder):
    return _search(spark, folder, tuning.grid_search)


@query
def rf_random_search(spark, folder):
    return _search(spark, folder, tuning.random_search)


@query
def learning_curve(spark, folder):
    train = models.assemble(part_of(_tree_table(spark, folder, shuffle=True), splits.TRAIN))
    return tuning.learning_curve(train)


@query
def linear_elastic_net(spark, folder):
    table = evaluation.encoded_table(events_log(spark, folder))
    _, scored = models.fit_and_score(models.elastic_net(), models.encode(table), "idx")
    return evaluation.report(table, scored, "elastic net", "duration")


@query
def model_roundtrip(spark, folder):
    """Save a forest, load it, and count the test rows on which the two predict differently."""
    table = models.assemble(_tree_table(spark, folder, shuffle=False))
    model, scored = models.fit_and_score(models.tuned_forest(), table, "idx")
    path = scratch_path(spark, "forest")
    models.save_model(model, path)
    loaded = RandomForestRegressionModel.load(path).setPredictionCol("again")
    return loaded.transform(scored).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("prediction") != F.col("again")).alias("different"),
    )


@query
def encoder_roundtrip(spark, folder):
    """Matrix of the fitted encoder after it and the linear model were saved as one pipeline and loaded again."""
    table = evaluation.encoded_table(events_log(spark, folder))
    encoder = models.fit_encoder(table)
    linear = models.elastic_net().setMaxIter(5).fit(encoder.transform(table.withColumn("label", F.col("duration").cast("double"))))
    path = scratch_path(spark, "pipeline")
    models.save_model(PipelineModel([encoder, linear]), path)
    loaded = PipelineModel.load(path)
    vector = vector_to_array("features")
    matrix = loaded.transform(table).select("row_id", *[vector[i].alias(c) for i, c in enumerate(loaded.stages[0].names())])
    return rounded(matrix, *matrix.columns[1:])


@query
def linear_without_penalty(spark, folder):
    """Slope and intercept of the duration on the user's number of streams, without penalties."""
    table = features.encoded_features(events_log(spark, folder)).select("row_id", "streams_watched", "duration")
    table = models.assemble(stage_table(table, "line"), ["streams_watched"], "duration")
    line = models.elastic_net(0.0, 0.0).setSolver("normal").fit(table)
    rows = [(float(line.coefficients[0]), float(line.intercept))]
    return rounded(spark.createDataFrame(rows, "slope double, intercept double"), "slope", "intercept")


def _bounds(spark, folder, estimator, shuffle) -> DataFrame:
    table = models.assemble(_tree_table(spark, folder, shuffle))
    scored = models.fit_and_score(estimator, table, "idx")[1]
    return models.prediction_bounds(scored, part_of(table, splits.TRAIN))


@query
def rf_tuned_bounds(spark, folder):
    return _bounds(spark, folder, models.tuned_forest(), shuffle=True)


@query
def rf_default_bounds(spark, folder):
    return _bounds(spark, folder, models.default_forest(), shuffle=False)


@query
def model_fold_stability(spark, folder):
    """Errors of the tuned forest on every fold, from models that saw neither its rows nor statistics of them."""
    table = models.assemble(evaluation.out_of_fold_table(events_log(spark, folder), FOLDS))
    return tuning.fold_errors(tuning.out_of_fold_predictions(table, models.tuned_forest(), FOLDS))


@query
def model_fold_rows(spark, folder):
    """Rows of every fold that got a prediction from the model fitted without it, and their mean label."""
    table = models.assemble(evaluation.out_of_fold_table(events_log(spark, folder), FOLDS))
    scored = tuning.out_of_fold_predictions(table, models.tuned_forest(trees=5), FOLDS)
    predicted = scored.where(F.col("prediction").isNotNull())
    return rounded(predicted.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("mean_label")), "mean_label")


@query
def smoothed_comparison(spark, folder):
    """Smoothed label, model and baseline series over the test part of the boosted trees."""
    table = _tree_table(spark, folder, shuffle=False)
    scored = evaluation.score_trees(models.boosted_trees(), table)
    base = metrics.baseline_scalar(table, TREE_LABEL)
    return evaluation.smoothed_comparison(scored, base, splits.row_count(table))


def _forest_scores(spark, folder) -> DataFrame:
    return evaluation.score_trees(models.tuned_forest(), _tree_table(spark, folder, shuffle=True))


@query
def model_residual_bins(spark, folder):
    """Residual and prediction scatter plots of the tuned forest, as counts per cell."""
    return metrics.residual_bins(_forest_scores(spark, folder), width=1.0)


@query
def model_residual_bias(spark, folder):
    """Residuals of the tuned forest per streamer, hour and decile."""
    return metrics.residual_bias(_forest_scores(spark, folder))
