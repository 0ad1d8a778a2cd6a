"""Models on a planted signal: bounds on metrics, never exact predictions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from viewtide.operators import metrics, splits
from viewtide.plans import evaluation, grid, models, tuning
from viewtide.plans.encoder import FeatureEncoder, FeatureEncoderModel
from viewtide.schema import TREE_FEATURES, TREE_LABEL
from viewtide.sources.adapters import events_log


@pytest.fixture(scope="module")
def planted(spark):
    rows = spark.range(1_500).withColumn("row_id", F.col("id"))
    noise = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)) / 97).alias(c) for i, c in enumerate(TREE_FEATURES)]
    table = rows.select("row_id", *noise).withColumn(
        TREE_LABEL, F.round(30 * F.col("avg_duration") + 10 * F.col("total_watch_time")).cast("bigint")
    )
    return splits.positional_split(splits.shuffled_index(table, name="idx"), "idx").cache()


@pytest.fixture(scope="module")
def train(planted):
    return models.assemble(planted.where("part = 'train'"))


def mae(planted, estimator):
    _, scored = models.fit_and_score(estimator, models.assemble(planted))
    return metrics.regression_metrics(scored).first()["mae"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: models.default_forest(trees=10, depth=8),
        lambda: models.tuned_forest(trees=20),
        lambda: models.boosted_trees(rounds=10, rate=0.3),
        lambda: models.elastic_net(),
    ],
    ids=["default forest", "tuned forest", "boosted trees", "elastic net"],
)
def test_models_beat_the_baselines(planted, make):
    baselines = [r["mae"] for r in metrics.baseline_metrics(planted, TREE_LABEL).collect()]
    assert mae(planted, make()) < 0.6 * min(baselines)


def test_metrics_of_known_errors(spark):
    scored = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0)], "label double, prediction double")
    m = metrics.regression_metrics(scored).first()
    assert (m["mae"], m["mse"]) == (pytest.approx(1.0), pytest.approx(5 / 3))
    assert m["rmse"] == pytest.approx((5 / 3) ** 0.5)
    assert m["r2"] == pytest.approx(1 - 5 / 2)


def test_penalty_mapping(spark):
    net = models.elastic_net(l1=0.02, l2=0.03)
    reg, mix = net.getRegParam(), net.getElasticNetParam()
    # half the squared error, so half of each penalty
    assert reg * mix == pytest.approx(0.01)
    assert reg * (1 - mix) / 2 == pytest.approx(0.015)
    assert not net.getStandardization()


def test_r2_of_constant_labels(spark):
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert metrics.regression_metrics(same).first().r2 == 1.0
    off = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert metrics.regression_metrics(off).first().r2 == 0.0


def test_grid_search(train):
    found = tuning.grid_search(train, trees=(3, 6), depths=(1, 6))
    assert len(found.avgMetrics) == 4
    assert found.bestModel.getOrDefault("maxDepth") == 6


def test_random_settings_are_seeded_and_in_range(spark):
    forest = models.default_forest()
    a, b = tuning.random_settings(forest), tuning.random_settings(forest)
    assert len(a) == 50 and a == b
    assert {s[forest.numTrees] for s in a} <= set(range(100, 500))
    assert {s[forest.maxDepth] for s in a} == {5, 10, 15, 30}
    assert {s[forest.minInstancesPerNode] for s in a} == {1, 2, 4}
    assert {s[forest.featureSubsetStrategy] for s in a} == {"2", "all"}


def test_grid_has_each_distinct_setting_once(spark):
    assert len(tuning.forest_grid(models.default_forest())) == 4


def test_random_search(train):
    found = tuning.random_search(train, k=2, draws=2, trees=(2, 4), depths=(3,))
    assert found.bestModel.getNumTrees in (2, 3)
    table = tuning.search_table(found, train.sparkSession).collect()
    assert len(table) == 4
    assert {r["metric"] for r in table} == {"fold_r2_mean", "fold_r2_std"}


def test_learning_curve(train):
    forest = models.default_forest(trees=3, depth=5)
    curve = tuning.learning_curve(train, forest, k=3, steps=4).orderBy("train_size").collect()
    n = train.count()
    assert [r["train_size"] for r in curve] == [splits.prefix_size(n, 3, s, 4) for s in range(1, 5)]
    assert all(r["validation_r2"] > 0.5 for r in curve)
    assert all(r["train_r2"] >= r["validation_r2"] - 0.1 for r in curve)


def test_saved_model_predicts_the_same(spark, planted, tmp_path):
    model, scored = models.fit_and_score(models.tuned_forest(trees=5), models.assemble(planted))
    path = str(tmp_path / "forest")
    models.save_model(model, path)
    models.save_model(model, path)
    loaded = models.score(RandomForestRegressionModel.load(path), models.assemble(planted.where("part = 'test'")))
    assert sorted(scored.select("row_id", "prediction").collect()) == sorted(
        loaded.select("row_id", "prediction").collect()
    )


def test_encoder_width_and_scope(spark):
    rows = [(i, "train" if i < 8 else "test", float(i), 1.0, i, 0, "Night" if i % 2 else "Evening", "Monday", i)
            for i in range(10)]
    df = spark.createDataFrame(
        rows,
        "row_id bigint, part string, streams_watched double, avg_duration double, popularity bigint, "
        "prev_session_duration bigint, time_of_day string, day_of_week string, duration bigint",
    )
    everything = models.encode(df, "all").orderBy("row_id").collect()
    assert everything[9]["features"][0] == pytest.approx(1.0)
    train_only = models.encode(df, "train").orderBy("row_id").collect()
    assert train_only[7]["features"][0] == pytest.approx(1.0)
    assert train_only[9]["features"][0] == pytest.approx(9 / 7)
    with pytest.raises(ValueError, match="fit_scope"):
        models.encode(df, "some")


def test_capped_tables_and_reports(spark, folder):
    log = events_log(spark, folder)
    table = evaluation.tree_table(log, cap=500, shuffle=True)
    assert sorted(r["idx"] for r in table.collect()) == list(range(500))
    assert table.where("part = 'test'").count() == 100
    scored = evaluation.score_trees(models.tuned_forest(trees=3), table)
    assert scored.count() == 100
    named = {(r["model"], r["metric"]) for r in evaluation.report(table, scored, "forest").collect()}
    assert {m for m, _ in named} == {"forest", "baseline mean", "baseline median"}
    assert {k for m, k in named if m == "forest"} == {"mae", "rmse", "mse", "r2"}

    series = evaluation.smoothed_comparison(
        scored, metrics.baseline_scalar(table, TREE_LABEL), splits.row_count(table), sample=60
    )
    rows = series.orderBy("test_idx").collect()
    assert [r["test_idx"] for r in rows] == list(range(60))
    assert [r["predicted"] is None for r in rows] == [True] * 49 + [False] * 11
    assert rows[59]["mean_line"] == pytest.approx(metrics.baseline_values(table, TREE_LABEL).first()["mean"])


def test_a_fit_does_not_depend_on_the_partitions_of_its_table(planted):
    table = models.assemble(planted)
    layouts = [table.repartition(1), table.repartition(7), table.coalesce(2)]
    predictions = [
        [r.prediction for r in models.fit_and_score(models.tuned_forest(trees=5), t)[1].orderBy("row_id").collect()]
        for t in layouts
    ]
    assert predictions[0] == predictions[1] == predictions[2]


def test_a_deep_forest_is_fitted_in_parts(spark, planted, tmp_path, monkeypatch):
    table = models.assemble(planted)
    estimator = models.default_forest(trees=7, depth=12)
    fits = []
    assert models.PART_ROWS // models.PART_TREES > 1200  # the planted rows are too few for parts
    monkeypatch.setattr(models, "PART_ROWS", 0)
    one = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows, setting=None: fits.append((setting or {}).get(self.numTrees)) or one(self, rows, setting))
    found = [models.fit_and_score(estimator, t)[0] for t in (table, table.repartition(7))]
    assert sorted(fits) == [1, 1, 3, 3, 3, 3]
    with ThreadPoolExecutor(1) as pool:  # one fit after the other
        found.append(models.fit(estimator, models.spread(table.where("part = 'train'"), "row_id", *models.span_of(estimator)), pool))
    path = str(tmp_path / "deep")
    models.save_model(found[0], path)
    found.append(RandomForestRegressionModel.load(path))
    trees = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in found]
    assert trees[0] == trees[1] == trees[2] == trees[3]
    assert len(set(trees[0])) == 7 == found[0].getNumTrees
    assert all(m.getOrDefault("maxDepth") == 12 and m.getOrDefault("seed") == models.SEED for m in found)
    test = table.where("part = 'test'").orderBy("row_id")
    joined = [r.prediction for r in found[3].transform(test).collect()]
    by_tree = zip(*([r.prediction for r in t.transform(test).collect()] for t in found[0].trees), strict=True)
    assert joined == pytest.approx([sum(p) / 7 for p in by_tree])
    scored = tuning.random_search(models.assemble(planted.where("part = 'train'")), k=2, draws=1, trees=(4, 5), depths=(None,))
    assert scored.bestModel.getNumTrees == 4


def test_a_large_forest_predicts_in_parts(planted, monkeypatch):
    table = models.assemble(planted)
    estimator, test = models.default_forest(trees=7, depth=12), table.where("part = 'test'")
    monkeypatch.setattr(models, "PART_ROWS", 0)  # fitted in parts too
    laid_out = models.spread(table.where("part = 'train'"), "row_id", *models.span_of(estimator))
    sent, found = [], []
    one = RandomForestRegressionModel.transform
    monkeypatch.setattr(RandomForestRegressionModel, "transform", lambda self, df: sent.append([t.numNodes for t in self.trees]) or one(self, df))
    for bound in (1, 1_000, 1 << 18):
        model = models.fit(estimator, laid_out)  # one that was not used before
        sizes = [tree.numNodes for tree in model.trees]
        monkeypatch.setattr(models, "PREDICT_NODES", bound)
        sent.clear()
        found.append(models.score(model, test))
        assert [n for part in sent for n in part] == sizes
        assert all(len(part) == 1 or sum(part) <= bound for part in sent) and (len(sent) > 1) == (bound < sum(sizes))
    assert found[0].columns == found[1].columns == found[2].columns
    rows = [{r.row_id: (r.prediction, r.residual) for r in scored.collect()} for scored in found]
    assert rows[0].keys() == rows[1].keys() == rows[2].keys() and len(rows[2]) == test.count()
    for i, whole in rows[2].items():
        assert rows[0][i] == pytest.approx(whole) and rows[1][i] == pytest.approx(whole)


def test_a_search_that_was_cut_short_fits_only_what_is_absent(spark, train, tmp_path, monkeypatch):
    table = grid.ResultTable(spark, str(tmp_path / "whole"))
    whole = tuning.grid_search(train, trees=(2, 3), depths=(2, 4), k=2, results=table)

    fits = []
    fit = tuning.spread
    monkeypatch.setattr(tuning, "spread", lambda df, idx: fits.append(1) or fit(df, idx))
    cut = grid.ResultTable(spark, str(tmp_path / "cut"))
    with pytest.raises(RuntimeError, match="cut"):
        monkeypatch.setattr(tuning, "_r2", failing(tuning._r2, after=3))
        tuning.grid_search(train, trees=(2, 3), depths=(2, 4), k=2, results=cut, parallelism=1)
    monkeypatch.undo()
    assert len(cut.finished()) == 3

    monkeypatch.setattr(tuning, "spread", lambda df, idx: fits.append(1) or fit(df, idx))
    fits.clear()
    resumed = tuning.grid_search(train, trees=(2, 3), depths=(2, 4), k=2, results=cut)
    assert len(fits) == 5 + 1  # five folds and the best model
    assert resumed.scores == whole.scores
    # but for the name in the first line
    assert resumed.bestModel.toDebugString.split("\n", 1)[1] == whole.bestModel.toDebugString.split("\n", 1)[1]
    fits.clear()
    again = tuning.grid_search(train, trees=(2, 3), depths=(2, 4), k=2, results=cut)
    assert not fits and again.scores == whole.scores


def failing(function, after):
    calls = []

    def wrapped(*args):
        calls.append(1)
        if len(calls) > after:
            raise RuntimeError("cut")
        return function(*args)

    return wrapped


def test_results_are_kept_by_rows_task_and_parameters(spark, train, tmp_path):
    assert grid.fingerprint(train) == grid.fingerprint(train.repartition(5))
    assert grid.fingerprint(train) != grid.fingerprint(train.where("idx > 0"))
    assert grid.fingerprint(train) != grid.fingerprint(train.withColumn("more", F.lit(1)))

    table = grid.ResultTable(spark, str(tmp_path / "kept"))
    assert table.finished() == {}
    ran = []
    tasks = {f"t{i}": lambda i=i: ran.append(i) or {"a": float(i), "b": None} for i in range(4)}
    assert grid.run_tasks(table, tasks, 1, limit=2) == {f"t{i}": {"a": float(i), "b": None} for i in range(2)}
    (tmp_path / "kept" / "scores" / "half" / "_temporary").mkdir(parents=True)  # a write that was cut short
    found = grid.run_tasks(table, tasks, 3)
    assert sorted(ran) == [0, 1, 2, 3] and len(found) == 4
    table.add("t1", {"a": 9.0})
    assert table.finished()["t1"] == {"a": 9.0}


def test_learning_curve_goes_on(spark, train, tmp_path, monkeypatch):
    forest = models.default_forest(trees=2, depth=3)
    table = grid.ResultTable(spark, str(tmp_path / "curve"))
    first = sorted(tuning.learning_curve_scores(train, forest, k=2, steps=3, results=table).collect())
    monkeypatch.setattr(tuning, "spread", failing(tuning.spread, after=0))
    assert sorted(tuning.learning_curve_scores(train, forest, k=2, steps=3, results=table).collect()) == first
    monkeypatch.undo()
    other = models.default_forest(trees=2, depth=4)
    tuning.learning_curve_scores(train, other, k=2, steps=3, results=table)
    assert len(table.finished()) == 12


def test_encoder_learns_ranges_and_levels_and_is_saved(spark, tmp_path):
    schema = "a double, same bigint, c string, d string"
    df = spark.createDataFrame([(1.0, 7, "x", "only"), (3.0, 7, None, "only"), (None, 7, "w", "only")], schema)
    model = FeatureEncoder(numeric=["a", "same"], categories=["c", "d"]).fit(df)
    assert model.names() == ["a", "same", "c_w", "c_x", "d_only"]
    path = str(tmp_path / "encoder")
    model.save(path)
    loaded = FeatureEncoderModel.load(path)
    unseen = df.unionByName(spark.createDataFrame([(5.0, 8, "new", None)], schema))
    for m in (model, loaded):
        rows = [r.features.toArray().tolist() for r in m.transform(unseen.where("a is not null")).collect()]
        # a constant column is 0, what lies outside the range is not cut, an unknown level has no column
        assert rows == [[0, 0, 0, 1, 1], [1, 0, 0, 0, 1], [2, 1, 0, 0, 0]]
    with pytest.raises(ValueError, match="range of a"):
        FeatureEncoder(numeric=["a"], categories=[]).fit(df.where("false"))


def test_predictions_out_of_fold(spark, planted):
    table = models.assemble(planted)
    estimator = models.tuned_forest(trees=4)
    scored = tuning.out_of_fold_predictions(table, estimator, 3)
    assert scored.count() == scored.select("row_id").distinct().count() == planted.count()
    n = planted.count()
    first, end = splits.fold_bounds(n, 3, 1)
    model = estimator.fit(models.spread(table.where(f"idx < {first} or idx >= {end}"), "idx"))
    want = {r.row_id: r.prediction for r in model.transform(table.where(f"idx >= {first} and idx < {end}")).collect()}
    assert {r.row_id: r.prediction for r in scored.where("fold = 1").collect()} == want
    errors = {r.fold: r for r in tuning.fold_errors(scored).collect()}
    assert [errors[f].rows for f in range(3)] == [b - a for a, b in (splits.fold_bounds(n, 3, f) for f in range(3))]
    assert all(0 < e.mae <= e.rmse for e in errors.values())


@pytest.mark.parametrize(("n", "boosting", "forest"), [(80_000, 10, 10), (1 << 18, 32, 32), (4_800_000, 19, 74), (28_800_000, 28, 110)])
def test_boosting_has_fewer_spans_than_a_forest(spark, n, boosting, forest):
    ends = spark.createDataFrame([(0,), (n - 1,)], "idx bigint")
    laid = [models.spread(ends, "idx", *models.span_of(e)) for e in (models.boosted_trees(), models.tuned_forest())]
    assert [rows.rdd.getNumPartitions() for rows in laid] == [boosting, forest]
    assert sorted(r.idx for r in laid[0].collect()) == [0, n - 1]
