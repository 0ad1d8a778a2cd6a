"""Exact quantiles by selection against numpy, for values of many shapes and tiny bounds that force rounds."""

import random

import numpy as np
import pytest

from viewtide.operators import metrics, selection

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def shapes():
    rng = random.Random(3)
    yield "distinct", [rng.random() for _ in range(3001)]
    yield "nanoseconds", [float(17 * 10**17 + rng.randrange(10**15)) for _ in range(2000)]
    yield "one value", [4.5] * 900
    yield "ties", [float(rng.choice([1, 1, 1, 1, 2, 7])) for _ in range(2500)]
    yield "decades", [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2600)]
    yield "zeros", [rng.choice([0.0, -0.0, 5e-324, -5e-324]) for _ in range(700)]
    yield "few", [3.0, 1.0]


@pytest.mark.parametrize("splitters", [16, 64])
def test_groups_of_every_shape(spark, splitters):
    data = dict(shapes())
    rows = [(k, v) for k, values in data.items() for v in values]
    rows += [("none", None), ("nan", float("nan")), (None, 1.0), (None, 2.0), ("few", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, x double").repartition(7)
    got = {}
    for r in selection.exact_quantiles(df, "x", PROBABILITIES, ["key"], group_rows=40, splitters=splitters).collect():
        assert (r["key"], r["probability"]) not in got
        got[r["key"], r["probability"]] = (r["rows"], r["quantile"])
    data[None] = [1.0, 2.0]
    assert set(got) == {(k, p) for k in data for p in PROBABILITIES}
    for (key, p), (n, value) in got.items():
        ordered = np.sort(np.array(data[key]))
        place = p * (len(ordered) - 1)
        low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        share = place - np.floor(place)
        assert n == len(ordered)
        assert value == (low if low == high else (1 - share) * low + share * high), (key, p)


def test_without_groups_and_without_rows(spark):
    df = spark.range(10_001).selectExpr("cast((id * 7919) % 10001 as long) as x", "id as rows", "id as v")
    got = selection.exact_quantiles(df, "x", [0.5, 0.25], group_rows=10).collect()
    assert sorted((r["probability"], r["quantile"], r["rows"]) for r in got) == [(0.25, 2500.0, 10001), (0.5, 5000.0, 10001)]
    assert selection.exact_quantiles(df.where("false"), "x", [0.5]).collect() == []


def test_no_task_holds_the_values_of_a_large_group(spark):
    """The rows that a selection sets aside around its rank stay within the bound."""
    df = spark.range(50_000).selectExpr("cast(id * 1000003 % 50021 as double) + id / 1e6 as x")
    seen = []
    settled = selection._settled

    def watch(rows, targets, by):
        seen.append(rows.count())
        return settled(rows, targets, by)

    selection._settled = watch
    try:
        got = selection.exact_quantiles(df, "x", [0.5], group_rows=500, splitters=128).collect()
    finally:
        selection._settled = settled
    values = np.sort([r["x"] for r in df.collect()])
    assert got[0]["quantile"] == (values[24_999] + values[25_000]) / 2
    assert seen[-1] <= 500
    # splitters stand within a tenth of a step, and a rank lies at most two steps from its bounds
    assert seen[0] <= 50_000 * 4.5 / 128


def test_baselines_of_any_label(spark):
    df = spark.range(4001).selectExpr("if(id % 5 = 0, 'test', 'train') as part", "cast(id as double) * 1.25 as label", "concat('s', id % 3) as streamer")
    one = metrics.baseline_values(df, "label").first()
    other = metrics.baseline_values(df, "label", distinct=True, group_rows=64).first()
    assert (one["mean"], one["median"]) == pytest.approx((other["mean"], other["median"]))
    plain = metrics.median_per_streamer(df, "label").orderBy("streamer").collect()
    wide = metrics.median_per_streamer(df, "label", distinct=True, group_rows=64).orderBy("streamer").collect()
    assert plain == wide
