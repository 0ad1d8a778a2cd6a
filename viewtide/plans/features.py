"""Feature tables of the two model families, from a typed interaction table.

Shuffles of the rows: one on (user, shard), shared by the user statistics and the
previous-session lag, and one on (streamer, shard) that disappears when the streamer
statistics are small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.functions import times
from viewtide.operators import stats
from viewtide.operators.joins import join_back
from viewtide.operators.skew import DEFAULT, HotKeys, join_cold, join_hot, row_limit
from viewtide.operators.splits import head_rows
from viewtide.operators.windows import prev_in_shards
from viewtide.schema import ENCODED_CATEGORIES, ENCODED_LABEL, ENCODED_NUMERIC, TREE_FEATURES, TREE_LABEL
from viewtide.sources.interactions import session_duration


def time_features(df: DataFrame, unit: str = "10min") -> DataFrame:
    """Add hour of day and day of week of ``start_time``."""
    t = F.col("start_time")
    return df.withColumns({"hour_of_day": times.hour_of_day(t, unit), "day_of_week": times.day_of_week(t, unit)})


def tree_features(
    df: DataFrame,
    cap: int | None = None,
    unit: str = "10min",
    row_id: str = "row_id",
    fit_on: Column | None = None,
    keep: tuple[str, ...] = (),
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """Features and label of the tree regressors.

    ``cap`` keeps the first rows before anything is aggregated. By default the statistics see
    all rows, the row's own label and later test rows included; ``fit_on`` (a condition, e.g.
    on a ``part`` column) limits them, and keys it never saw get 0.
    """
    log = session_duration(head_rows(df, cap, row_id), TREE_LABEL)
    limit = row_limit(log, policy)
    users = stats.user_stats(log, TREE_LABEL, fit_on=fit_on)
    streamers = stats.streamer_watch_time(log, TREE_LABEL, fit_on=fit_on)

    rows = _add_user_columns(log, users, ["user_id"], TREE_LABEL, limit, row_id, policy)
    rows = join_back(rows, streamers, "streamer", row_id=row_id, policy=policy, limit=limit)
    rows = time_features(rows, unit)
    if fit_on is not None:
        rows = rows.fillna(0, ["total_watch_time", "num_streams_watched", "avg_duration"])
    return rows.select(row_id, *keep, *TREE_FEATURES, TREE_LABEL)


def out_of_fold_features(
    df: DataFrame,
    k: int,
    cap: int | None = None,
    unit: str = "10min",
    row_id: str = "row_id",
    fold: str = "fold",
    keep: tuple[str, ...] = (),
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """``tree_features`` whose user and streamer statistics leave out the row's own fold.

    ``fold`` holds 0..k-1 (see ``splits.kfold``). A row's statistics are the totals over all folds minus its own fold's share,
    so they hold neither its own label nor that of any row scored together with it; a key that occurs in no other fold gets 0.
    All folds come from one aggregation per key, with as many exchanges of the rows as ``tree_features``. The previous
    session is what was known when the session began and stays as it is, whichever fold it lies in.
    """
    log = session_duration(head_rows(df, cap, row_id), TREE_LABEL)
    limit = row_limit(log, policy)
    users = stats.user_stats_by_fold(log, k, fold, TREE_LABEL)
    streamers = stats.streamer_watch_time_by_fold(log, k, fold, TREE_LABEL)

    rows = _add_user_columns(log, users, ["user_id"], TREE_LABEL, limit, row_id, policy)
    rows = join_back(rows, streamers, "streamer", row_id=row_id, policy=policy, limit=limit)
    zero = F.lit(0).cast("bigint")
    mean = F.try_divide(stats.outside("durations", fold), stats.outside("sessions", fold))
    rows = time_features(rows, unit).withColumns(
        {
            "total_watch_time": F.coalesce(stats.outside("watch_time", fold), zero),
            "num_streams_watched": F.coalesce(stats.outside("streams", fold), zero),
            "avg_duration": F.coalesce(mean, F.lit(0.0)),
        }
    )
    return rows.select(row_id, fold, *keep, *TREE_FEATURES, TREE_LABEL)


def _add_user_columns(
    log: DataFrame,
    users: DataFrame,
    session_keys: list[str],
    label: str,
    limit: Column,
    row_id: str,
    policy: HotKeys,
) -> DataFrame:
    """User statistics and previous session, on one exchange of the rows by (user, shard)."""
    rows = join_hot(log, users, ["user_id"], "rows", limit, "_shard", row_id, policy)
    rows = prev_in_shards(rows, session_keys, ["user_id"], "_shard", label, "prev_session_duration", row_id)
    return join_cold(rows, users, ["user_id"], "rows", limit, "_shard").drop("_shard")


def encoded_features(
    df: DataFrame,
    cap: int | None = None,
    unit: str = "10min",
    row_id: str = "row_id",
    fit_on: Column | None = None,
    keep: tuple[str, ...] = (),
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """Features and label of the linear model, before scaling and one-hot encoding.

    The previous session is the last one with the same streamer. A hot pair of user and
    streamer implies a hot user, so the user's shards serve the lag of the pair as well.
    """
    log = session_duration(head_rows(df, cap, row_id), ENCODED_LABEL)
    limit = row_limit(log, policy)
    users = stats.user_stats(log, ENCODED_LABEL, "streams_watched", fit_on)
    popularity = stats.streamer_popularity(log, fit_on)

    rows = _add_user_columns(log, users, ["user_id", "streamer"], ENCODED_LABEL, limit, row_id, policy)
    rows = join_back(rows, popularity, "streamer", row_id=row_id, policy=policy, limit=limit)
    t = F.col("start_time")
    rows = rows.withColumns(
        {
            "time_of_day": times.time_of_day(times.hour_of_day(t, unit)),
            "day_of_week": times.day_label(t, unit),
        }
    )
    if fit_on is not None:
        rows = rows.fillna(0, ["streams_watched", "avg_duration", "popularity"])
    return rows.select(row_id, *keep, *ENCODED_NUMERIC, *ENCODED_CATEGORIES, ENCODED_LABEL)
