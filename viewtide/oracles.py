"""DuckDB SQL that gives the same result as the query of the same name."""

from __future__ import annotations

_START = {
    "10min": "(epoch_us(ts) // 1000000) // 600 - 2840112",
    "sec": "epoch_us(ts) // 1000000",
    "ns": "epoch_us(ts) * 1000",
}


def _log(unit: str = "10min") -> str:
    return f"""log AS (
        SELECT *, start_time + duration AS stop_time FROM (
            SELECT event_id AS row_id, user_id, json_extract_string(props, '$.k') AS stream_id,
                   event_type AS streamer, {_START[unit]} AS start_time,
                   1 + CAST(floor(value / 10) AS BIGINT) AS duration
            FROM events)
    )"""


def _sql(body: str, *tables: str, unit: str = "10min") -> str:
    return "WITH " + ",\n".join([_log(unit), *tables]) + "\n" + body


# Number of ticks in an hour and in a day, per unit.
_HOUR = {"10min": 6, "sec": 3600, "ns": 3600000000000}


def _hour(unit: str) -> str:
    return f"CAST((start_time // {_HOUR[unit]}) % 24 AS INTEGER)"


def _day(unit: str) -> str:
    shift = " + 3" if unit == "ns" else ""
    return f"CAST((start_time // {24 * _HOUR[unit]}{shift}) % 7 AS INTEGER)"


def _day_name(unit: str) -> str:
    names = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"
    return f"list_extract({names}, 1 + {_day(unit)})"


def _day_part(unit: str) -> str:
    h = _hour(unit)
    return (
        f"CASE WHEN {h} < 6 THEN 'Night' WHEN {h} < 12 THEN 'Morning' "
        f"WHEN {h} < 18 THEN 'Afternoon' ELSE 'Evening' END"
    )


_WATCH = "watch AS (SELECT streamer, CAST(sum(duration) AS BIGINT) AS total_watch_time FROM log GROUP BY streamer)"
_USERS = "users AS (SELECT user_id, count(stream_id) AS n, avg(duration) AS mean FROM log GROUP BY user_id)"
_POPULAR = "popular AS (SELECT streamer, count(*) AS popularity FROM log GROUP BY streamer)"
_PREV_USER = "CAST(coalesce(lag(duration) OVER (PARTITION BY user_id ORDER BY row_id), 0) AS BIGINT)"
_PREV_PAIR = "CAST(coalesce(lag(duration) OVER (PARTITION BY user_id, streamer ORDER BY row_id), 0) AS BIGINT)"

_N = "(SELECT count(*) FROM log)"
_FIRST_TEST = f"({_N} - ({_N} + 4) // 5)"
_PARTS = f"parts AS (SELECT *, CASE WHEN row_id < {_FIRST_TEST} THEN 'train' ELSE 'test' END AS part FROM log)"
_KEY = "CAST(concat('0x', substr(md5(concat(row_id, ':42')), 1, 8)) AS BIGINT)"
_SHUFFLED = f"(row_number() OVER (ORDER BY {_KEY}, row_id) - 1)"
_NS = "ns AS (SELECT *, duration * 1000000000 + row_id * 7919 % 1000003 * 997 AS label FROM parts)"


def _quantiles_ns(by: str) -> str:
    columns = " UNION ALL ".join(
        f"SELECT {by}, count(label) AS rows, {p} AS probability, round(quantile_cont(CAST(label AS DOUBLE), {p}), 3) AS quantile FROM ns GROUP BY {by}"
        for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    )
    return _sql(f"SELECT {by}, rows, CAST(probability AS DOUBLE) AS probability, quantile FROM ({columns})", _PARTS, _NS)


_BASE = """base AS (
        SELECT avg(duration) AS mean, median(duration) AS median FROM parts WHERE part = 'train')"""


def _tree(unit: str, time_unit: str | None = None) -> str:
    time_unit = time_unit or unit
    return f"""tree AS (
        SELECT row_id, total_watch_time, n AS num_streams_watched, mean AS avg_duration,
               {_hour(time_unit)} AS hour_of_day, {_day(time_unit)} AS day_of_week,
               {_PREV_USER} AS prev_session_duration, duration AS engagement_duration
        FROM log JOIN watch USING (streamer) JOIN users USING (user_id))"""


def _encoded(unit: str) -> str:
    return f"""encoded AS (
        SELECT row_id, n AS streams_watched, mean AS avg_duration, popularity,
               {_PREV_PAIR} AS prev_session_duration, {_day_part(unit)} AS time_of_day,
               {_day_name(unit)} AS day_of_week, duration
        FROM log JOIN users USING (user_id) JOIN popular USING (streamer))"""


_TREE_ROUNDED = "SELECT * REPLACE (round(avg_duration, 6) AS avg_duration) FROM tree"
_ENCODED_ROUNDED = "SELECT * REPLACE (round(avg_duration, 6) AS avg_duration) FROM encoded"


def _fold(k: int) -> str:
    size, extra = f"({_N} // {k})", f"({_N} % {k})"
    large = f"{extra} * ({size} + 1)"
    return (
        f"CAST(CASE WHEN row_id < {large} THEN row_id // ({size} + 1) "
        f"ELSE {extra} + (row_id - {large}) // {size} END AS INTEGER)"
    )


def _errors(prediction: str, digits: int = 6) -> str:
    e = f"(duration - {prediction})"
    return (
        f"round(avg(abs({e})), {digits}) AS mae, round(avg({e} * {e}), {digits}) AS mse, "
        f"round(sqrt(avg({e} * {e})), {digits}) AS rmse"
    )


_BASELINE_METRICS = f"""
    SELECT 'mean' AS baseline, {_errors('mean', 10)} FROM parts, base WHERE part = 'test'
    UNION ALL
    SELECT 'median' AS baseline, {_errors('median', 10)} FROM parts, base WHERE part = 'test'"""

_FOLD_ERRORS = f"""folds AS (SELECT duration, {_fold(5)} AS fold FROM log),
    fitted AS (
        SELECT h.fold, avg(f.duration) AS mean, median(f.duration) AS median
        FROM (SELECT DISTINCT fold FROM folds) h JOIN folds f ON f.fold <> h.fold GROUP BY h.fold),
    fold_errors AS (
        SELECT fold, count(*) AS rows, avg(abs(duration - mean)) AS mean_mae,
               avg(abs(duration - median)) AS median_mae
        FROM folds JOIN fitted USING (fold) GROUP BY fold)"""

_SCORED = f"""scored AS (
        SELECT row_id, row_id - {_FIRST_TEST} AS test_idx, engagement_duration AS duration,
               avg_duration AS prediction
        FROM tree WHERE row_id >= {_FIRST_TEST})"""

_HISTORY = (_WATCH, _USERS, _tree("10min"), _SCORED)


def _rolled(column: str, order: str) -> str:
    frame = f"OVER (ORDER BY {order} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {frame} = 50 THEN round(avg({column}) {frame}, 6) END"


def _smoothed(condition: str) -> str:
    columns = ", ".join(
        f"{_rolled(c, 'test_idx')} AS {name}"
        for c, name in (
            ("duration", "actual"),
            ("prediction", "predicted"),
            ("mean", "mean_line"),
            ("median", "median_line"),
        )
    )
    return f"SELECT test_idx, {columns} FROM (SELECT * FROM scored, base WHERE {condition})"


def _scaled(column: str, fit_on: str = "TRUE") -> str:
    low, high = (f"{f}({column}) FILTER ({fit_on}) OVER ()" for f in ("min", "max"))
    return (
        f"round(CASE WHEN {low} = {high} THEN 0.0 "
        f"ELSE ({column} - {low}) / CAST({high} - {low} AS DOUBLE) END, 6) AS {column}"
    )


def _one_hot() -> str:
    parts = ("Afternoon", "Evening", "Morning", "Night")
    days = ("Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday")
    return ", ".join(
        [f"CAST({_day_part('10min')} = '{p}' AS INTEGER) AS time_of_day_{p.lower()}" for p in parts]
        + [f"CAST({_day_name('10min')} = '{d}' AS INTEGER) AS day_of_week_{d.lower()}" for d in days]
    )


_ABOVE = " + ".join(f"CAST(duration > bounds[{i}] AS INTEGER)" for i in range(1, 10))
_BIAS = f"""bias AS (
        SELECT streamer, {_hour('10min')} AS hour, duration, duration - mean AS residual,
               1 + {_ABOVE} AS decile
        FROM parts, base,
             (SELECT quantile_cont(duration, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS bounds
              FROM parts WHERE part = 'test')
        WHERE part = 'test')"""


def _bias(grouping: str, level: str) -> str:
    return f"""
        SELECT '{grouping}' AS grouping, CAST({level} AS VARCHAR) AS level, count(*) AS rows,
               round(avg(residual), 6) AS mean_residual, round(stddev_samp(residual), 6) AS std_residual
        FROM bias GROUP BY {level}"""


SQL: dict[str, str] = {
    "interaction_summary": _sql(
        """SELECT CAST(sum(duration) AS BIGINT) AS total_duration, count(*) AS interactions,
                  count(DISTINCT user_id) AS users, count(DISTINCT stream_id) AS streams FROM log"""
    ),
    "stream_watch_time": _sql(
        "SELECT stream_id, CAST(sum(duration) AS BIGINT) AS duration FROM log GROUP BY stream_id"
    ),
    "user_distinct_streams": _sql(
        "SELECT user_id, count(DISTINCT stream_id) AS streams FROM log GROUP BY user_id"
    ),
    "user_stream_sets": _sql("SELECT DISTINCT user_id, stream_id FROM log"),
    "most_watched_stream": _sql(
        """SELECT stream_id, CAST(sum(duration) AS BIGINT) AS duration FROM log
           GROUP BY stream_id ORDER BY sum(duration) DESC, min(row_id) LIMIT 1"""
    ),
    "streamer_watch_time": _sql("SELECT * FROM watch", _WATCH),
    "user_stats": _sql(
        "SELECT user_id, n AS num_streams_watched, round(mean, 6) AS avg_duration FROM users", _USERS
    ),
    "streamer_popularity": _sql("SELECT * FROM popular ORDER BY popularity DESC, streamer", _POPULAR),
    "label_range": _sql(
        "SELECT min(duration) AS min_label, max(duration) AS max_label FROM parts WHERE part = 'test'", _PARTS
    ),
    "session_duration": _sql("SELECT row_id, stop_time - start_time AS engagement_duration FROM log"),
    "streamer_watch_time_join": _sql(
        "SELECT row_id, streamer, duration, total_watch_time FROM log LEFT JOIN watch USING (streamer)", _WATCH
    ),
    "user_stats_join": _sql(
        """SELECT row_id, user_id, n AS num_streams_watched, round(mean, 6) AS avg_duration
           FROM log LEFT JOIN users USING (user_id)""",
        _USERS,
    ),
    "user_history_join": _sql(
        """SELECT row_id, user_id, n AS streams_watched, round(mean, 6) AS avg_duration
           FROM log LEFT JOIN users USING (user_id)""",
        _USERS,
    ),
    "streamer_popularity_join": _sql(
        "SELECT row_id, streamer, popularity FROM log LEFT JOIN popular USING (streamer)", _POPULAR
    ),
    "prev_session_user": _sql(
        f"SELECT row_id, user_id, duration, {_PREV_USER} AS prev_session_duration FROM log"
    ),
    "prev_session_user_streamer": _sql(
        f"SELECT row_id, user_id, streamer, duration, {_PREV_PAIR} AS prev_session_duration FROM log"
    ),
    "prev_session_by_time": _sql(
        """SELECT row_id, user_id, start_time, duration, CAST(coalesce(
               lag(duration) OVER (PARTITION BY user_id ORDER BY start_time, row_id), 0) AS BIGINT) AS prev_session_duration
           FROM log"""
    ),
    "prev_session_pair_by_time": _sql(
        """SELECT row_id, user_id, streamer, start_time, duration, CAST(coalesce(
               lag(duration) OVER (PARTITION BY user_id, streamer ORDER BY start_time, row_id DESC), 0) AS BIGINT)
               AS prev_session_duration
           FROM log"""
    ),
    "time_features_ns": _sql(
        f"""SELECT row_id, start_time, start_time // 1000 AS start_micros,
                   {_hour('ns')} AS hour_of_day, {_day('ns')} AS day_of_week FROM log""",
        unit="ns",
    ),
    "time_features_sec": _sql(
        f"SELECT row_id, start_time, {_hour('sec')} AS hour_of_day, {_day('sec')} AS day_of_week FROM log",
        unit="sec",
    ),
    "time_features_10min": _sql(
        f"SELECT row_id, start_time, {_hour('10min')} AS hour_of_day, {_day('10min')} AS day_of_week FROM log"
    ),
    "time_of_day": _sql(
        f"""SELECT row_id, {_day_part('sec')} AS time_of_day,
                   CAST({_hour('sec')} // 6 AS INTEGER) AS time_of_day_order FROM log""",
        unit="sec",
    ),
    "day_label": _sql(f"SELECT row_id, {_day_name('sec')} AS day_of_week FROM log", unit="sec"),
    "feature_table": _sql(_TREE_ROUNDED, _WATCH, _USERS, _tree("10min")),
    "feature_table_ns": _sql(_TREE_ROUNDED, _WATCH, _USERS, _tree("10min", "ns")),
    "feature_table_sec": _sql(_TREE_ROUNDED, _WATCH, _USERS, _tree("sec"), unit="sec"),
    "feature_table_train_scope": _sql(
        f"""SELECT row_id, part, CAST(coalesce(total_watch_time, 0) AS BIGINT) AS total_watch_time,
                   coalesce(n, 0) AS num_streams_watched, round(coalesce(mean, 0), 6) AS avg_duration,
                   {_hour('10min')} AS hour_of_day, {_day('10min')} AS day_of_week,
                   {_PREV_USER} AS prev_session_duration, duration AS engagement_duration
            FROM parts
            LEFT JOIN (SELECT streamer, sum(duration) AS total_watch_time FROM parts
                       WHERE part = 'train' GROUP BY streamer) USING (streamer)
            LEFT JOIN (SELECT user_id, count(stream_id) AS n, avg(duration) AS mean FROM parts
                       WHERE part = 'train' GROUP BY user_id) USING (user_id)""",
        _PARTS,
    ),
    "feature_table_out_of_fold": _sql(
        f"""SELECT row_id, fold,
                   CAST(coalesce((SELECT sum(duration) FROM folded o WHERE o.streamer = f.streamer AND o.fold <> f.fold), 0)
                        AS BIGINT) AS total_watch_time,
                   coalesce(n, 0) AS num_streams_watched, round(coalesce(mean, 0), 6) AS avg_duration,
                   {_hour('10min')} AS hour_of_day, {_day('10min')} AS day_of_week,
                   CAST(coalesce(lag(duration) OVER (PARTITION BY f.user_id ORDER BY row_id), 0) AS BIGINT)
                       AS prev_session_duration,
                   duration AS engagement_duration
            FROM folded f
            LEFT JOIN (SELECT held_out, user_id, count(stream_id) AS n, avg(duration) AS mean
                       FROM folded, (SELECT unnest(range(5)) AS held_out) WHERE fold <> held_out
                       GROUP BY held_out, user_id) u ON u.user_id = f.user_id AND u.held_out = f.fold""",
        f"folded AS (SELECT *, {_fold(5)} AS fold FROM log)",
    ),
    "encoded_feature_table": _sql(_ENCODED_ROUNDED, _USERS, _POPULAR, _encoded("10min")),
    "encoded_feature_table_sec": _sql(_ENCODED_ROUNDED, _USERS, _POPULAR, _encoded("sec"), unit="sec"),
    "row_order": "SELECT event_id AS row_id, event_id FROM events",
    "head_rows": _sql("SELECT * FROM log WHERE row_id < 700"),
    "split_positional": _sql("SELECT row_id, part FROM parts", _PARTS),
    "split_shuffled": _sql(
        f"SELECT row_id, CASE WHEN {_KEY} < 858993460 THEN 'test' ELSE 'train' END AS part FROM log"
    ),
    "split_shuffled_exact": _sql(
        f"""SELECT row_id, shuffled_idx,
                   CASE WHEN shuffled_idx < {_FIRST_TEST} THEN 'train' ELSE 'test' END AS part
            FROM (SELECT row_id, {_SHUFFLED} AS shuffled_idx FROM log)"""
    ),
    "kfold_assign": _sql(f"SELECT row_id, {_fold(3)} AS fold_of_3, {_fold(5)} AS fold_of_5 FROM log"),
    "validation_tail": _sql(
        f"""SELECT row_id, CASE WHEN row_id >= {_FIRST_TEST} THEN 'test'
                   WHEN row_id >= {_FIRST_TEST} - ({_FIRST_TEST} + 4) // 5 THEN 'validation'
                   ELSE 'train' END AS part FROM log"""
    ),
    "learning_curve_sizes": _sql(
        f"""SELECT held_out, step, count(*) AS train_rows FROM (
                SELECT held_out, CAST(step AS INTEGER) AS step,
                       row_number() OVER (PARTITION BY held_out, step ORDER BY row_id) - 1 AS i
                FROM (SELECT row_id, {_fold(5)} AS fold FROM log),
                     (SELECT CAST(unnest(range(5)) AS INTEGER) AS held_out), (SELECT unnest(range(1, 11)) AS step)
                WHERE fold <> held_out)
            WHERE i < ({_N} - ({_N} + 4) // 5) * step // 10
            GROUP BY held_out, step"""
    ),
    "rolling_mean": _sql(f"SELECT row_id, {_rolled('duration', 'row_id')} AS duration FROM log"),
    "minmax_scale": _sql(
        "SELECT row_id, "
        + ", ".join(_scaled(c) for c in ("streams_watched", "avg_duration", "popularity", "prev_session_duration"))
        + " FROM encoded",
        _USERS,
        _POPULAR,
        _encoded("10min"),
    ),
    "minmax_scale_train": _sql(
        "SELECT row_id, part, "
        + ", ".join(
            _scaled(c, "part = 'train'") for c in ("streams_watched", "avg_duration", "popularity", "prev_session_duration")
        )
        + " FROM encoded JOIN (SELECT row_id, part FROM parts) USING (row_id)",
        _USERS,
        _POPULAR,
        _encoded("10min"),
        _PARTS,
    ),
    "one_hot": _sql(f"SELECT row_id, {_one_hot()} FROM log"),
    "label_quantiles_ns": _quantiles_ns("part"),
    "streamer_quantiles_ns": _quantiles_ns("streamer"),
    "baseline_values_ns": _sql(
        """SELECT round(avg(CAST(label AS DOUBLE)), 3) AS mean, round(median(CAST(label AS DOUBLE)), 3) AS median
           FROM ns WHERE part = 'train'""",
        _PARTS,
        _NS,
    ),
    "baseline_values": _sql("SELECT round(mean, 6) AS mean, round(median, 6) AS median FROM base", _PARTS, _BASE),
    "baseline_metrics": _sql(_BASELINE_METRICS, _PARTS, _BASE),
    "baseline_metrics_shuffled": _sql(
        _BASELINE_METRICS,
        f"parts AS (SELECT *, CASE WHEN {_KEY} < 858993460 THEN 'test' ELSE 'train' END AS part FROM log)",
        _BASE,
    ),
    "baseline_residuals": _sql(
        """SELECT row_id, duration AS actual, round(duration - mean, 6) AS residual_mean,
                  round(duration - median, 6) AS residual_median
           FROM parts, base WHERE part = 'test'""",
        _PARTS,
        _BASE,
    ),
    "baseline_median_per_streamer": _sql(
        """SELECT streamer, round(prediction, 6) AS prediction, count(*) AS test_rows,
                  round(avg(abs(duration - prediction)), 6) AS mae
           FROM (SELECT p.streamer, p.duration, coalesce(m.own, base.median) AS prediction
                 FROM parts p, base LEFT JOIN
                      (SELECT streamer, median(duration) AS own FROM parts WHERE part = 'train'
                       GROUP BY streamer) m ON m.streamer = p.streamer
                 WHERE part = 'test')
           GROUP BY streamer, prediction""",
        _PARTS,
        _BASE,
    ),
    "fold_baselines": _sql(
        """SELECT fold, rows, round(mean_mae, 10) AS mean_mae, round(median_mae, 10) AS median_mae
           FROM fold_errors""",
        _FOLD_ERRORS,
    ),
    "fold_stability": _sql(
        """SELECT 'mean' AS baseline, round(avg(mean_mae), 10) AS mae_mean,
                  round(stddev_samp(mean_mae), 10) AS mae_std FROM fold_errors
           UNION ALL
           SELECT 'median', round(avg(median_mae), 10), round(stddev_samp(median_mae), 10) FROM fold_errors""",
        _FOLD_ERRORS,
    ),
    "residual_bias": _sql(
        " UNION ALL ".join(
            [_bias("streamer", "streamer"), _bias("hour_of_day", "hour"), _bias("decile", "decile")]
        ),
        _PARTS,
        _BASE,
        _BIAS,
    ),
    "history_metrics": _sql(
        f"""SELECT {_errors('prediction')},
                   round(1 - avg((duration - prediction) * (duration - prediction)) / var_pop(duration), 6) AS r2
            FROM scored""",
        *_HISTORY,
    ),
    "metric_report": _sql(
        """SELECT 'Mean Absolute Error (MAE)' AS metric, round(avg(abs(duration - prediction)), 10) AS value
           FROM scored
           UNION ALL
           SELECT 'Root Mean Squared Error (RMSE)',
                  round(sqrt(avg((duration - prediction) * (duration - prediction))), 10) FROM scored
           UNION ALL
           SELECT 'Baseline Mean Engagement Duration (MAE)', round(avg(abs(duration - mean)), 10)
           FROM scored, base
           UNION ALL
           SELECT 'Baseline Median Engagement Duration (MAE)', round(avg(abs(duration - median)), 10)
           FROM scored, base""",
        *_HISTORY,
        _PARTS,
        _BASE,
    ),
    "residual_bins": _sql(
        """SELECT CAST(floor(duration) AS DOUBLE) AS actual_bin, floor(prediction) AS predicted_bin,
                  floor(duration - prediction) AS residual_bin, count(*) AS n
           FROM scored GROUP BY 1, 2, 3""",
        *_HISTORY,
    ),
    "smoothed_series": _sql(_smoothed("true"), *_HISTORY, _PARTS, _BASE),
    "smoothed_sample": _sql(_smoothed("test_idx < 150"), *_HISTORY, _PARTS, _BASE),
    "scan_interactions": _sql("SELECT * FROM log"),
    "scan_empty_fields": _sql(
        """SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN '' ELSE coalesce(stream_id, '') END AS stream_id,
                             CASE WHEN row_id % 5 = 0 THEN '' ELSE coalesce(streamer, '') END AS streamer)
           FROM log"""
    ),
    "scan_rejected_lines": _sql(
        """SELECT row_id, concat(user_id, ',', stream_id, ',', streamer, ',t', start_time, ',', stop_time) AS line
           FROM log WHERE streamer = 'error'"""
    ),
    "scan_quarantine": _sql(
        """SELECT CASE WHEN streamer = 'error' THEN 'quarantined' ELSE 'good' END AS result,
                  count(*) AS rows FROM log GROUP BY 1"""
    ),
    "load_records_mixed": _sql(
        """SELECT CASE WHEN streamer NOT IN ('click', 'error') THEN row_id END AS row_id,
                  CASE streamer WHEN 'click' THEN concat(one, ', ', one)
                                WHEN 'error' THEN concat(one, '} rest') END AS failed_line
           FROM (SELECT *, concat('{''row_id'': ', row_id, '}') AS one FROM log)"""
    ),
    "load_records": _sql(
        """SELECT row_id, streamer, streamer IN ('click', 'error') AS live, CAST(NULL AS VARCHAR) AS note,
                  start_time AS "first", stop_time AS "last" FROM log"""
    ),
    # what SQL can say of fitted models
    "model_roundtrip": _sql(f"SELECT {_N} - {_FIRST_TEST} AS rows, 0 AS different"),
    "rf_tuned_bounds": _sql(f"SELECT {_N} - {_FIRST_TEST} AS rows, 0 AS without_prediction, 0 AS outside_labels"),
    "rf_default_bounds": _sql(f"SELECT {_N} - {_FIRST_TEST} AS rows, 0 AS without_prediction, 0 AS outside_labels"),
    "model_fold_rows": _sql(
        f"""SELECT fold, count(*) AS rows, round(avg(duration), 6) AS mean_label
            FROM (SELECT duration, {_fold(5)} AS fold FROM log) GROUP BY fold"""
    ),
    "linear_without_penalty": _sql(
        """SELECT round(regr_slope(duration, n), 6) AS slope, round(regr_intercept(duration, n), 6) AS intercept
           FROM log JOIN users USING (user_id)""",
        _USERS,
    ),
    "encoder_roundtrip": _sql(
        "SELECT row_id, "
        + ", ".join(_scaled(c) for c in ("streams_watched", "avg_duration", "popularity", "prev_session_duration"))
        + f", {_one_hot()} FROM encoded JOIN (SELECT row_id, start_time FROM log) USING (row_id)",
        _USERS,
        _POPULAR,
        _encoded("10min"),
    ),
}
