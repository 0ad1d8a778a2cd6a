import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewtide.operators.skew import HotKeys
from viewtide.operators.windows import prev_session_by, rolling_mean
from viewtide.sources.order import sorted_order


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_nulls_blank_their_windows(spark, kind):
    values = [(i, None if i in (3, 40) else i * i) for i in range(60)]
    df = spark.createDataFrame(values, "i bigint, v bigint").selectExpr("i", f"cast(v as {kind}) as v")
    got = rolling_mean(df, "i", ["v"], width=4, block=16).orderBy("i").toPandas()
    want = pd.Series([v for _, v in values], dtype=float).rolling(4).mean()
    pd.testing.assert_series_equal(got["v"].astype(float), want, check_names=False)


@pytest.mark.parametrize("width,block,n", [(50, 50, 1_000), (50, 64, 1_001), (7, 100, 350), (1, 5, 20), (50, 64, 30)])
def test_blocks_match_one_window(spark, width, block, n):
    rng = random.Random(n)
    values = [(i, rng.randrange(-50, 100), rng.random()) for i in range(n)]
    df = spark.createDataFrame(values, "i bigint, a bigint, b double").repartition(6)
    got = rolling_mean(df, "i", ["a", "b"], width, block).orderBy("i").toPandas()
    want = pd.DataFrame(values, columns=["i", "a", "b"])
    assert list(got["i"]) == list(range(n))
    for c in ("a", "b"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].rolling(width).mean(), check_names=False)


@pytest.mark.parametrize("policy", [HotKeys(), HotKeys(max_keys=4, min_rows=10, shard_rows=7)], ids=["even", "hot"])
def test_previous_session_in_time_order(spark, policy):
    rng = random.Random(3)
    # a hot user, many equal times, missing users, streamers and times, ids with gaps and out of order
    rows = [
        (i * 3, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "a", "b", None]), rng.choice([None, *range(12)]), rng.randrange(90))
        for i in range(400)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id bigint, user_id bigint, streamer string, start_time bigint, duration bigint").repartition(5)
    for keys in (["user_id"], ["user_id", "streamer"]):
        got = prev_session_by(df, keys, ["start_time", "row_id"], policy=policy)
        assert got.columns == [*df.columns, "prev_session_duration"]
        last: dict = {}
        want = {}
        for i, user, streamer, _, duration in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
            key = (user, streamer)[: len(keys)]
            want[i] = 0 if None in key else last.get(key, 0)
            last[key] = duration
        assert {r.row_id: r.prev_session_duration for r in got.collect()} == want


def test_sorted_order_is_dense(spark):
    df = spark.range(1_000).selectExpr("id", "id % 3 as third").repartition(7)
    rows = sorted(sorted_order(df, [F.desc("third"), "id"], "place").collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1_000))
    assert [(r.third, r.id) for r in rows] == sorted(((i % 3, i) for i in range(1_000)), key=lambda x: (-x[0], x[1]))
    assert sorted_order(df.where("false"), ["id"]).count() == 0
