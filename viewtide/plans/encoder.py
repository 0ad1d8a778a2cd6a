"""The column transformer of the linear model as an Estimator: min-max scaling and one-hot encoding in one vector.

``fit`` takes one aggregate of the table. The fitted model is expressions over the stored ranges and levels, the same as
``operators/encode.py`` makes, and can be saved, loaded and put into a Pipeline.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.operators.encode import hot_column, level_name, scaled_column
from viewtide.schema import ENCODED_CATEGORIES, ENCODED_NUMERIC

#: Most levels of a category; more is taken for a mistake, as each is a column.
MAX_LEVELS = 1_000


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "columns to scale", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "columns to encode", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "the vector", TypeConverters.toString)


class FeatureEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the range of each numeric column and the sorted levels of each category."""

    @keyword_only
    def __init__(
        self,
        *,
        numeric: Sequence[str] = ENCODED_NUMERIC,
        categories: Sequence[str] = ENCODED_CATEGORIES,
        outputCol: str = "features",
    ):
        super().__init__()
        self._setDefault(numeric=list(ENCODED_NUMERIC), categories=list(ENCODED_CATEGORIES), outputCol="features")
        self._set(**{name: list(v) if not isinstance(v, str) else v for name, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> FeatureEncoderModel:
        numeric, categories = self.getOrDefault("numeric"), self.getOrDefault("categories")
        found = dataset.agg(
            *[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in numeric for f in (F.min, F.max)],
            *[F.approx_count_distinct(c).alias(f"n_{c}") for c in categories],
        ).first()
        for c in categories:
            if found[f"n_{c}"] > MAX_LEVELS:
                raise ValueError(f"{c} has about {found[f'n_{c}']} levels, more than {MAX_LEVELS}")
        missing = [c for c in numeric if found[f"min_{c}"] is None]
        if missing:
            raise ValueError(f"no values to learn the range of {', '.join(missing)}")
        sets = dataset.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categories]).first() if categories else {}
        return FeatureEncoderModel(
            ranges={c: (found[f"min_{c}"], found[f"max_{c}"]) for c in numeric},
            levels={c: list(sets[c]) for c in categories},
            outputCol=self.getOrDefault("outputCol"),
        )


class FeatureEncoderModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Scales by the stored ranges (a constant column becomes 0), one 0/1 column per stored level (a null or unknown level gives zeros)."""

    ranges = Param(Params._dummy(), "ranges", "JSON: smallest and largest value by column", TypeConverters.toString)
    levels = Param(Params._dummy(), "levels", "JSON: levels by column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the vector", TypeConverters.toString)

    def __init__(
        self,
        ranges: Mapping[str, tuple[float, float]] | None = None,
        levels: Mapping[str, Sequence[str]] | None = None,
        outputCol: str = "features",
    ):
        super().__init__()
        self._set(ranges=json.dumps(ranges or {}), levels=json.dumps(levels or {}), outputCol=outputCol)

    def names(self) -> list[str]:
        """The name of each place of the vector."""
        levels = json.loads(self.getOrDefault("levels"))
        return [*json.loads(self.getOrDefault("ranges")), *[level_name(c, x) for c, own in levels.items() for x in own]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = [
            scaled_column(F.col(c), F.lit(float(low)), F.lit(float(high)))
            for c, (low, high) in json.loads(self.getOrDefault("ranges")).items()
        ]
        hot = [
            hot_column(F.col(c), x).cast("double") for c, own in json.loads(self.getOrDefault("levels")).items() for x in own
        ]
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*scaled, *hot)))
