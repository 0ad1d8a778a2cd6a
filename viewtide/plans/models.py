"""Regressors for session duration, as Spark ML estimators."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import Executor, ThreadPoolExecutor
from functools import reduce
from operator import add
from threading import get_ident

from pyspark import SparkContext
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.operators.metrics import regression_metrics
from viewtide.operators.splits import MAX_SPANS, SPAN_ROWS, TEST, TRAIN, by_spans
from viewtide.plans import forest
from viewtide.plans.encoder import FeatureEncoder, FeatureEncoderModel
from viewtide.schema import ENCODED_LABEL, TREE_FEATURES, TREE_LABEL

# Settings of the models.
SEED = 42
FOREST_TREES = 100
TUNED_DEPTH = 10
BOOSTING_ROUNDS, BOOSTING_RATE, BOOSTING_DEPTH = 100, 0.1, 5
L1_PENALTY = L2_PENALTY = 0.01

#: Spark's deepest tree; stands for "no depth limit".
UNLIMITED_DEPTH = 30

#: For forests deeper than the tuned one: least trees and rows times trees of one fit, its rows per partition, and MB of node statistics in a task.
PART_TREES, PART_ROWS, DEEP_SPAN_ROWS, PART_MEMORY = 3, 240_000, 1 << 17, 32

#: Partitions of boosting before they grow: its rounds follow one another, and each task sends three kilobytes whatever it holds.
BOOSTING_SPANS = 32

#: Nodes of a forest that are sent to the tasks as one object, unless a single tree has more; 100 tuned trees stay below.
PREDICT_NODES = 1 << 18

#: Features tried per split when the rule is log2 or sqrt of six features; both give 2.
TWO_OF_SIX = "2"


def assemble(df: DataFrame, features: Sequence[str] = TREE_FEATURES, label: str = TREE_LABEL) -> DataFrame:
    """Add the feature vector and the label as a double; the other columns stay."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return assembler.transform(df.withColumn("label", F.col(label).cast("double")))


def _forest(**settings) -> RandomForestRegressor:
    # With cached node ids a row does not walk every tree again at each level; two to three
    # times faster from depth 10 on.
    return RandomForestRegressor(cacheNodeIds=True, **settings)


def default_forest(trees: int = FOREST_TREES, depth: int = UNLIMITED_DEPTH, seed: int = SEED) -> RandomForestRegressor:
    """Forest with all features at every split and no depth limit but Spark's own."""
    return _forest(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def tuned_forest(trees: int = FOREST_TREES, depth: int = TUNED_DEPTH, seed: int = SEED) -> RandomForestRegressor:
    """Forest with hand-set depth and feature subset."""
    return _forest(numTrees=trees, maxDepth=depth, featureSubsetStrategy=TWO_OF_SIX, seed=seed)


def boosted_trees(
    rounds: int = BOOSTING_ROUNDS, rate: float = BOOSTING_RATE, depth: int = BOOSTING_DEPTH, seed: int = SEED
) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)


def prediction_bounds(scored: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """One row: scored rows, those without a prediction, and predictions outside the range of the training labels.

    A forest predicts means of training labels, so the last two are 0 but for rounding in the last digits.
    """
    seen = train.agg(F.struct(F.min(label).alias("low"), F.max(label).alias("high")).alias("seen")).scalar()
    p = F.col("prediction")
    slack = 1e-9 * F.greatest(F.abs("_seen.low"), F.abs("_seen.high"))
    outside = (p < F.col("_seen.low") - slack) | (p > F.col("_seen.high") + slack)
    return scored.withColumn("_seen", seen).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.isNull()).alias("without_prediction"),
        F.count_if(outside).alias("outside_labels"),
    )


def elastic_net(l1: float = L1_PENALTY, l2: float = L2_PENALTY) -> LinearRegression:
    """Linear model with separate L1 and squared L2 penalties on the squared error.

    The loss is the mean squared error plus ``l1 * |w| + l2 * w^2``. Spark minimises half the mean squared
    error plus ``reg * (mix * |w| + (1 - mix) / 2 * w^2)``, so both penalties are halved, and
    weights are penalised as they are, not scaled by their column's spread.
    """
    reg = l1 / 2 + l2
    return LinearRegression(regParam=reg, elasticNetParam=l1 / 2 / reg if reg else 0.0, standardization=False)


def encode(df: DataFrame, fit_scope: str = "all", label: str = ENCODED_LABEL) -> DataFrame:
    """Feature vector and label of the linear model.

    ``fit_scope="all"`` fits the encoder on every row, test rows included;
    ``"train"`` on the training part only.
    """
    return fit_encoder(df, fit_scope).transform(df.withColumn("label", F.col(label).cast("double")))


def fit_encoder(df: DataFrame, fit_scope: str = "all") -> FeatureEncoderModel:
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope must be 'all' or 'train'")
    return FeatureEncoder().fit(df if fit_scope == "all" else df.where(F.col("part") == TRAIN))


def score(model: Model, df: DataFrame) -> DataFrame:
    """Predictions next to their labels, with residuals."""
    return predict(model, df).withColumn("residual", F.col("label") - F.col("prediction"))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """The model's own ``transform``, but a forest of many nodes reaches the tasks in parts of whole trees.

    The driver writes a model out as one object, and the time for a node grows with their number. Each part predicts
    its own mean, and the forest's is that of all trees, so predictions are the same but for rounding in the last digits.
    """
    if not isinstance(model, RandomForestRegressionModel) or model.getLeafCol() or model.totalNumNodes <= PREDICT_NODES:
        return model.transform(df)
    parts: list[list[DecisionTreeRegressionModel]] = []
    room = 0
    for tree in model.trees:
        if tree.numNodes > room:
            parts.append([])
            room = PREDICT_NODES
        parts[-1].append(tree)
        room -= tree.numNodes
    names = [f"_part_{i}" for i in range(len(parts))]
    scored = df
    for name, trees in zip(names, parts, strict=True):
        part = _of_trees(model, trees, model)
        scored = part._set(numTrees=len(trees), predictionCol=name).transform(scored)
    total = reduce(add, [F.col(name) * len(trees) for name, trees in zip(names, parts, strict=True)])
    return scored.withColumn(model.getPredictionCol(), total / sum(map(len, parts))).drop(*names)


def spread(df: DataFrame, idx: str, span: int = SPAN_ROWS, spans: int = MAX_SPANS) -> DataFrame:
    """The rows of a fit in spans of ``idx``: bagging then gives the same forest on any machine."""
    last = df.agg(F.max(idx)).first()[0]
    return by_spans(df, idx, 0 if last is None else last + 1, span, spans)


def _is_deep(estimator: Estimator) -> bool:
    return isinstance(estimator, RandomForestRegressor) and estimator.getMaxDepth() > TUNED_DEPTH


def span_of(estimator: Estimator) -> tuple[int, ...]:
    """The span of ``spread``, and how many there are before they grow, if these are not the usual ones.

    Every partition of a fit sends statistics of every node, and a deep forest has about as many nodes as rows. Boosting
    runs two stages a level in each of its rounds, so its tasks are many and small.
    """
    if isinstance(estimator, GBTRegressor):
        return SPAN_ROWS, BOOSTING_SPANS
    return (DEEP_SPAN_ROWS,) if _is_deep(estimator) else ()


def cores(spark) -> int:
    """Tasks that can run at once; as many fits of small tables fill the machine."""
    return spark.sparkContext.defaultParallelism


def fit(estimator: Estimator, rows: DataFrame, pool: Executor | None = None, shallow: bool = False) -> Model:
    """Fit ``estimator`` on rows that ``spread`` laid out.

    A deep forest (with ``shallow`` any) over as many rows as a task can hold is grown a tree a task (``plans/forest.py``). Of others
    the trees of a deep forest are fitted in parts, the smaller the more rows there are, several at once in ``pool`` (by
    default as many as there are cores), each with a seed drawn from the forest's own, and joined to one forest. The parts
    depend on the numbers of rows and trees alone, so the forest is the same on any machine.
    """
    if not isinstance(estimator, RandomForestRegressor) or not (shallow or _is_deep(estimator)):
        return estimator.fit(rows)
    n = rows.count()
    if forest.can_grow(estimator, n):
        return forest.fit(estimator, rows)
    if not _is_deep(estimator):
        return estimator.fit(rows)
    trees, draw = estimator.getNumTrees(), random.Random(estimator.getSeed())
    rows = rows.select(estimator.getFeaturesCol(), estimator.getLabelCol())
    step = max(PART_TREES, PART_ROWS // max(1, n))
    if trees <= step:
        return estimator.fit(rows)
    settings = [
        {estimator.numTrees: min(step, trees - first), estimator.seed: draw.getrandbits(63), estimator.maxMemoryInMB: PART_MEMORY}
        for first in range(0, trees, step)
    ]

    def part(setting: dict) -> RandomForestRegressionModel:
        rows.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{get_ident()}")
        return estimator.fit(rows, setting)

    if pool is not None:
        return _joined(estimator, list(pool.map(part, settings)))
    with ThreadPoolExecutor(min(len(settings), cores(rows.sparkSession))) as pool:
        return _joined(estimator, list(pool.map(part, settings)))


def _joined(estimator: RandomForestRegressor, parts: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """One forest of the trees of all ``parts``, with the settings of ``estimator``."""
    return _of_trees(parts[0], [tree for part in parts for tree in part.trees], estimator)


def _of_trees(
    like: RandomForestRegressionModel, trees: Sequence[DecisionTreeRegressionModel], settings: Estimator | Model
) -> RandomForestRegressionModel:
    """A forest of the given ``trees``, named and as wide as ``like``, with the parameters of ``settings``."""
    context = SparkContext._active_spark_context
    jvm = context._jvm.org.apache.spark.ml.regression
    array = context._gateway.new_array(jvm.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree._java_obj
    model = RandomForestRegressionModel(jvm.RandomForestRegressionModel(like.uid, array, like.numFeatures))
    return model._set(**{p.name: value for p, value in settings.extractParamMap().items() if model.hasParam(p.name)})


def fit_and_score(estimator: Estimator, df: DataFrame, row_id: str = "row_id") -> tuple[Model, DataFrame]:
    """Fit on the training part, score the test part."""
    model = fit(estimator, spread(df.where(F.col("part") == TRAIN), row_id, *span_of(estimator)))
    return model, score(model, df.where(F.col("part") == TEST))


def metric_table(scored: DataFrame, name: str) -> DataFrame:
    """Metrics of one model as rows ``(model, metric, value)``."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse", "mse", "r2")]
    )
    return regression_metrics(scored).select(F.lit(name).alias("model"), F.inline(rows))


def release(model: Model) -> None:
    """Take a model back from the tasks once its predictions are computed."""
    if isinstance(model, forest.GrownForest):
        model.release()


def save_model(model: Model, path: str) -> None:
    """Write a fitted model to a shared path, replacing an earlier one."""
    writer: MLWriter = model.write()
    writer.overwrite().save(path)
