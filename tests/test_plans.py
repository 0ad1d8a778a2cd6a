"""What the physical plans must look like, for tables too large to broadcast."""

import re

import pytest

from viewtide.catalog import QUERIES


@pytest.fixture
def large_tables(spark):
    """Plan as if no side were small enough for an automatic broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    """Column names of every hash exchange."""
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    return [tuple(re.sub(r"#\d+L?", "", c) for c in columns.split(", ")) for columns in found]


ALL_SQL_QUERIES = [
    "interaction_summary", "user_distinct_streams", "most_watched_stream", "streamer_watch_time_join",
    "user_stats_join", "prev_session_user", "prev_session_user_streamer", "feature_table",
    "encoded_feature_table", "split_positional", "split_shuffled_exact", "kfold_assign", "rolling_mean",
    "baseline_metrics", "baseline_residuals", "baseline_median_per_streamer", "fold_stability",
    "residual_bias", "smoothed_series",
]


@pytest.mark.parametrize("name", ALL_SQL_QUERIES)
def test_no_all_pairs_join(spark, folder, large_tables, name):
    text = plan(spark, folder, name)
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


@pytest.mark.parametrize("name,key", [("streamer_watch_time_join", "streamer"), ("user_stats_join", "user_id")])
def test_rows_of_a_hot_key_spread_over_the_exchange(spark, folder, large_tables, name, key):
    text = plan(spark, folder, name)
    # Both sides of the sort-merge join are hashed on the key and its shard ...
    assert exchanges(text).count((key, "_shard")) == 2
    # ... and the exchanges on the key alone move pre-aggregated rows only.
    single = [line for line in text.splitlines() if f"Exchange hashpartitioning({key}" in line and "_shard" not in line]
    following = [text.splitlines()[text.splitlines().index(line) + 1] for line in single]
    assert following and all("HashAggregate" in line and "partial_" in line for line in following)


@pytest.mark.parametrize("name", ["feature_table", "encoded_feature_table"])
def test_feature_tables_exchange_the_rows_once_per_key(spark, folder, large_tables, name):
    text = plan(spark, folder, name)
    repartitioned = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(repartitioned) == 1 and "_shard" in repartitioned[0]
    # The user statistics join on the same exchange: one more for the statistics, none for the rows.
    left_of_streamer_join = text[: text.index("REPARTITION_BY_COL")]
    assert exchanges(left_of_streamer_join) == [("streamer", "_shard"), ("user_id", "_shard")]


def test_small_statistics_are_broadcast_at_run_time(spark, folder):
    df = QUERIES["streamer_watch_time_join"](spark, folder)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in final


def test_without_hot_keys_nothing_is_scanned_for_their_copies(spark, folder):
    df = QUERIES["prev_session_user"](spark, folder)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "max_by" not in final and "Union" not in final


def test_the_cap_reaches_the_scan(spark, folder):
    assert re.search(r"PushedFilters: \[.*LessThan\(event_id,700\)", plan(spark, folder, "head_rows"))


@pytest.mark.parametrize(
    "name,read",
    [
        ("session_duration", "struct<event_id:bigint,ts:timestamp_ntz,value:double>"),
        ("streamer_popularity", "struct<event_type:string>"),
        ("stream_watch_time", "struct<value:double,props:string>"),
        ("split_shuffled", "struct<event_id:bigint>"),
    ],
)
def test_only_needed_columns_are_read(spark, folder, name, read):
    assert f"ReadSchema: {read}" in plan(spark, folder, name)


def test_record_lines_reach_python_once(spark, folder):
    assert plan(spark, folder, "load_records").count("ArrowEvalPython") == 1


def test_nothing_else_reaches_python(spark, folder):
    for name in ALL_SQL_QUERIES:
        assert "Python" not in plan(spark, folder, name)
