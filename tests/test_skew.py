"""Hot keys: split operators against brute force, on data where one key owns a third of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewtide.operators import skew, splits, stats, windows
from viewtide.operators.joins import join_back
from viewtide.operators.skew import HotKeys
from viewtide.plans import features
from viewtide.schema import INTERACTIONS

POLICY = HotKeys(max_keys=50, min_rows=20, shard_rows=37)


@pytest.fixture(autouse=True, params=["10MB", "-1"], ids=["broadcast", "sort-merge"])
def join_kind(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def skewed_rows(n=2_000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        user = None if rng.random() < 0.05 else (1 if hot else rng.randrange(2, 300))
        streamer = None if rng.random() < 0.05 else ("hot" if rng.random() < 0.34 else f"s{rng.randrange(400)}")
        start = rng.randrange(-500, 5_000)
        duration = rng.randrange(1, 40)
        rows.append((i, user, f"v{rng.randrange(60)}", streamer, start, start + duration, duration))
    return rows


@pytest.fixture(scope="module")
def pdf():
    frame = pd.DataFrame(skewed_rows(), columns=INTERACTIONS.fieldNames())
    return frame.astype({"user_id": "Int64"})


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(skewed_rows(), INTERACTIONS).repartition(5)


def by_row(df, name):
    return {r["row_id"]: r[name] for r in df.select("row_id", name).collect()}


def test_shards_bound_the_rows_of_a_hot_key(log):
    sharded = skew.add_shards(log, ["user_id"], "shard", policy=POLICY)
    sizes = sharded.where("user_id = 1").groupBy("shard").count().agg(F.max("count")).first()[0]
    assert sizes <= POLICY.shard_rows
    assert sharded.where("user_id is null and shard = 0").count() == 0
    assert sharded.where("user_id > 1 and shard > 0").count() == 0
    assert sharded.count() == log.count()


def test_the_hot_list_is_bounded(spark):
    # 1,000 keys of equal size: none may count as hot when at most 100 keys can.
    even = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 1_000).alias("k"))
    policy = HotKeys(max_keys=100, min_rows=1, shard_rows=10)
    assert skew.add_shards(even, ["k"], "shard", policy=policy).where("shard > 0").count() == 0


def test_join_back_matches_brute_force(log, pdf):
    joined = join_back(log, stats.user_stats(log), "user_id", "rows", policy=POLICY)
    counts = pdf.groupby("user_id")["stream_id"].count()
    means = pdf.groupby("user_id")["duration"].mean()
    got_n, got_mean = by_row(joined, "num_streams_watched"), by_row(joined, "avg_duration")
    assert len(got_n) == joined.count() == len(pdf)
    for i, user in zip(pdf["row_id"], pdf["user_id"]):
        if user is pd.NA:
            assert got_n[i] is None and got_mean[i] is None
        else:
            assert got_n[i] == counts[user]
            assert got_mean[i] == pytest.approx(means[user])


def previous(pdf, keys):
    last, out = {}, {}
    for row in pdf.to_dict("records"):
        key = tuple(row[k] for k in keys)
        if any(v is None or v is pd.NA for v in key):
            out[row["row_id"]] = 0
            continue
        out[row["row_id"]] = last.get(key, 0)
        last[key] = row["duration"]
    return out


@pytest.mark.parametrize("keys", [["user_id"], ["user_id", "streamer"]])
@pytest.mark.parametrize("policy", [HotKeys(), POLICY, HotKeys(max_keys=10_000, min_rows=0, shard_rows=1)])
def test_previous_session_matches_brute_force(log, pdf, keys, policy):
    got = by_row(windows.prev_session(log, keys, policy=policy), "prev_session_duration")
    assert got == previous(pdf, keys)


def test_feature_tables_do_not_depend_on_the_policy(log, pdf):
    for table in (features.tree_features, features.encoded_features):
        plain = {r["row_id"]: tuple(r) for r in table(log).collect()}
        split = {r["row_id"]: tuple(r) for r in table(log, policy=POLICY).collect()}
        assert len(plain) == len(pdf)
        assert plain == split
    assert by_row(features.encoded_features(log, policy=POLICY), "prev_session_duration") == previous(
        pdf, ["user_id", "streamer"]
    )


def test_results_do_not_depend_on_partitioning(spark, log):
    results = []
    for partitions, pieces in ((1, 1), (4, 7), (16, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            table = features.tree_features(log.repartition(pieces), policy=POLICY)
            results.append(sorted(tuple(r) for r in table.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("policy", [HotKeys(), HotKeys(max_keys=4, min_rows=5, shard_rows=9)], ids=["even", "hot"])
def test_out_of_fold_statistics(spark, policy):
    rng = random.Random(8)
    k = 3
    rows = [
        (i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["s", None]), rng.choice(["a", "a", "b", None]), i, i + rng.randrange(40))
        for i in range(120)
    ]
    rows.append((120, 77, "s", "only here", 1, 5))  # keys of a single fold
    df = spark.createDataFrame([(*r, r[5] - r[4]) for r in rows], INTERACTIONS).repartition(4)
    log = splits.kfold(df, "row_id", k)
    got = {r.row_id: r for r in features.out_of_fold_features(log, k, policy=policy).collect()}
    fold = {r.row_id: r.fold for r in log.collect()}
    assert len(got) == len(rows)
    for i, user, _, streamer, _, _ in rows:
        others = [r for r in rows if fold[r[0]] != fold[i]]
        same_user = [r for r in others if user is not None and r[1] == user]
        watch = sum(r[5] - r[4] for r in others if streamer is not None and r[3] == streamer)
        assert got[i].total_watch_time == watch
        assert got[i].num_streams_watched == sum(r[2] is not None for r in same_user)
        mean = sum(r[5] - r[4] for r in same_user) / len(same_user) if same_user else 0
        assert got[i].avg_duration == pytest.approx(mean)

    # labels of a fold do not reach the features of its own rows, but for the previous session
    changed = log.withColumn("stop_time", F.when(F.col("fold") == 1, F.col("stop_time") + 1_000).otherwise(F.col("stop_time")))
    for r in features.out_of_fold_features(changed, k, policy=policy).where("fold = 1").collect():
        assert (r.total_watch_time, r.avg_duration) == (got[r.row_id].total_watch_time, got[r.row_id].avg_duration)
