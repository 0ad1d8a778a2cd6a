"""Every operator on eight hand-computed rows: negative time, bin edges, ties, repeats."""

import pytest
from pyspark.sql import functions as F

from viewtide.functions import times
from viewtide.operators import metrics, splits, stats, windows
from viewtide.operators.joins import join_back
from viewtide.operators.skew import HotKeys
from viewtide.plans import features

# Ordinary planning, and everything that can be split is split.
POLICIES = [HotKeys(), HotKeys(max_keys=100, min_rows=1, shard_rows=2)]


def column(df, name, order="row_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_summary(golden):
    assert tuple(stats.summary(golden).first()) == (36, 8, 3, 4)


def test_summary_of_nothing(golden):
    assert tuple(stats.summary(golden.where("false")).first()) == (0, 0, 0, 0)


def test_watch_time(golden):
    assert dict(stats.stream_watch_time(golden).collect()) == {"s1": 16, "s2": 3, "s3": 1, "s4": 16}


def test_most_watched_takes_the_first_of_equals(golden):
    assert [tuple(r) for r in stats.most_watched_stream(golden).collect()] == [("s1", 16)]
    backwards = golden.withColumn("row_id", 7 - F.col("row_id"))
    assert [tuple(r) for r in stats.most_watched_stream(backwards).collect()] == [("s4", 16)]
    assert stats.most_watched_stream(golden.where("false")).collect() == []


def test_user_streams(golden):
    assert dict(stats.user_distinct_streams(golden).collect()) == {1: 3, 2: 2, 3: 1}
    assert stats.user_stream_sets(golden).count() == 6


@pytest.mark.parametrize("policy", POLICIES)
def test_join_backs(golden, policy):
    watch = join_back(golden, stats.streamer_watch_time(golden), "streamer", "rows", policy=policy)
    assert column(watch, "total_watch_time") == [16, 19, 16, 16, 1, 19, 16, 19]
    users = join_back(golden, stats.user_stats(golden), "user_id", "rows", policy=policy)
    assert column(users, "num_streams_watched") == [4, 4, 3, 4, 3, 1, 3, 4]
    assert column(users, "avg_duration") == pytest.approx([6.5, 6.5, 8 / 3, 6.5, 8 / 3, 2.0, 8 / 3, 6.5])
    popular = join_back(golden, stats.streamer_popularity(golden), "streamer", "rows", policy=policy)
    assert column(popular, "popularity") == [4, 3, 4, 4, 1, 3, 4, 3]


@pytest.mark.parametrize("policy", POLICIES)
def test_previous_session(golden, policy):
    by_user = windows.prev_session(golden, "user_id", policy=policy)
    assert column(by_user, "prev_session_duration") == [0, 4, 0, 1, 4, 0, 1, 5]
    by_pair = windows.prev_session(golden, ["user_id", "streamer"], policy=policy)
    assert column(by_pair, "prev_session_duration") == [0, 0, 0, 4, 0, 0, 4, 1]


def test_time_features(golden):
    t = F.col("start_time")
    expected = {
        "ns": ([0, 0, 0, 0, 0, 0, 23, 0], [3, 3, 3, 3, 3, 3, 2, 3]),
        "10min": ([0, 0, 14, 0, 23, 0, 23, 0], [0, 0, 2, 3, 4, 5, 6, 0]),
        "sec": ([0, 0, 1, 6, 23, 0, 23, 0], [0, 0, 0, 0, 0, 1, 6, 0]),
    }
    for unit, (hours, days) in expected.items():
        table = features.time_features(golden, unit)
        assert column(table, "hour_of_day") == hours, unit
        assert column(table, "day_of_week") == days, unit
    labels = golden.select(
        "row_id",
        times.time_of_day(times.hour_of_day(t, "sec")).alias("part"),
        times.day_label(t, "sec").alias("day"),
    )
    assert column(labels, "part") == ["Night"] * 3 + ["Morning", "Evening", "Night", "Evening", "Night"]
    assert column(labels, "day") == ["Sunday"] * 5 + ["Monday", "Saturday", "Sunday"]


def test_time_of_day_edges(spark):
    hours = spark.createDataFrame([(h,) for h in (-1, 0, 5, 6, 11, 12, 17, 18, 23, 24)], "row_id int")
    named = hours.select("row_id", times.time_of_day(F.col("row_id")).alias("part"))
    assert column(named, "part") == [
        None, "Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", None,
    ]
    ranks = hours.select("row_id", times.time_of_day_order(F.col("row_id")).alias("rank"))
    assert column(ranks, "rank") == [None, 0, 0, 1, 1, 2, 2, 3, 3, None]


def test_unknown_unit(golden):
    with pytest.raises(ValueError, match="unit"):
        features.time_features(golden, "week")


def test_baselines(golden):
    split = splits.positional_split(golden)
    assert column(split, "part") == ["train"] * 6 + ["test"] * 2
    mean, median = metrics.baseline_values(split, "duration").first()
    assert (mean, median) == (pytest.approx(17 / 6), 3.0)
    rows = {r["baseline"]: r for r in metrics.baseline_metrics(split, "duration").collect()}
    assert rows["mean"]["mae"] == pytest.approx(20 / 3)
    assert rows["median"]["mae"] == pytest.approx(6.5)
    assert rows["mean"]["mse"] == pytest.approx(86.694444, abs=1e-6)
    assert rows["median"]["mse"] == pytest.approx(84.5)
    assert rows["median"]["rmse"] == pytest.approx(84.5**0.5)


def test_even_median_is_interpolated(spark):
    labels = spark.createDataFrame([(v, "train") for v in (1, 2, 3, 10)], "duration bigint, part string")
    assert metrics.baseline_values(labels, "duration").first()["median"] == 2.5


@pytest.mark.parametrize("block", [2, 3, 100])
def test_rolling_mean(golden, block):
    if block < 3:
        with pytest.raises(ValueError, match="width"):
            windows.rolling_mean(golden, "row_id", ["duration"], width=3, block=block)
        return
    means = column(windows.rolling_mean(golden, "row_id", ["duration"], width=3, block=block), "duration")
    assert means[:2] == [None, None]
    assert means[2:] == pytest.approx([3.0, 10 / 3, 10 / 3, 8 / 3, 2.0, 7.0])


@pytest.mark.parametrize("policy", POLICIES)
def test_feature_tables(golden, policy):
    tree = features.tree_features(golden, policy=policy).orderBy("row_id").collect()
    assert [tuple(r)[1:3] + tuple(r)[4:] for r in tree[:3]] == [
        (16, 4, 0, 0, 0, 4),
        (19, 4, 0, 0, 4, 1),
        (16, 3, 14, 2, 0, 4),
    ]
    encoded = features.encoded_features(golden, unit="sec", policy=policy).orderBy("row_id").collect()
    assert tuple(encoded[3]) == (3, 4, 6.5, 4, 4, "Morning", "Sunday", 5)


def test_cap_comes_before_the_aggregates(golden):
    capped = features.tree_features(golden, cap=4)
    assert column(capped, "total_watch_time") == [13, 1, 13, 13]
    assert column(capped, "num_streams_watched") == [3, 3, 1, 3]


def test_train_scope_never_sees_test_rows(golden):
    marked = splits.positional_split(golden)
    table = features.tree_features(marked, fit_on=F.col("part") == "train")
    assert column(table, "total_watch_time") == [13, 3, 13, 13, 1, 3, 13, 3]
    only_first = features.tree_features(golden, fit_on=F.col("row_id") < 2)
    assert column(only_first, "avg_duration")[2] == 0.0
    assert column(only_first, "total_watch_time")[4] == 0
