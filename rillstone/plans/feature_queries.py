"""Queries on features, statistics, reports, as-of joins, embeddings and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import dedup, embeddings, features, joins, quality, stats
from rillstone.plans import jobs
from rillstone.plans.base import EV, EV_SQL, R, SESSION_SQL, as_of, events, query, ratio_sql, round_columns, session_events, table
from rillstone.streaming import windows

# --- users

_USER = {
    **{f"watch_time_{n}d": R(f"coalesce(sum(value) FILTER (WHERE v AND age <= {n}), 0)") for n in (1, 7, 30)},
    "watch_time_total": R("coalesce(sum(value) FILTER (WHERE v), 0)"),
    **{f"video_count_{n}d": f"count(k) FILTER (WHERE v AND age <= {n})" for n in (1, 7, 30)},
    "video_count_total": "count(k) FILTER (WHERE v)",
    "unique_videos_total": "count(DISTINCT k) FILTER (WHERE v)",
    "category_diversity": "count(DISTINCT category) FILTER (WHERE v)",
    "session_count_7d": "count(DISTINCT session_id) FILTER (WHERE age <= 7)",
    "session_count_30d": "count(DISTINCT session_id) FILTER (WHERE age <= 30)",
    "avg_events_per_session": R(ratio_sql("count(session_id)", "count(DISTINCT session_id)")),
    "completion_rate": R(ratio_sql("count(*) FILTER (WHERE v AND co)", "count(*) FILTER (WHERE v AND st)")),
    "interaction_frequency_7d": R("count(*) FILTER (WHERE age <= 7) / 7.0"),
    "days_since_last_interaction": "min(age)",
}
_TOP = "(SELECT user_id, arg_max(category, (n, -rank)) AS top_category FROM (SELECT user_id, category, count(*) AS n, dense_rank() OVER (ORDER BY category) AS rank FROM ev WHERE v GROUP BY 1, 2) GROUP BY 1)"


def _user_sql(*names: str, base: str = SESSION_SQL, rows: str = "se") -> str:
    return f"WITH {base} SELECT user_id, " + ", ".join(f"{_USER[n]} AS {n}" for n in names) + f" FROM {rows} WHERE user_id IS NOT NULL GROUP BY user_id"


def _user(spark: SparkSession, d: str, *names: str, sessions: bool = False) -> DataFrame:
    df = session_events(spark, d) if sessions else events(spark, d).withColumn("session_id", F.lit(None).cast("string"))
    return round_columns(features.user_features(df, EV, as_of(), list(names)))


_WATCH = ("watch_time_1d", "watch_time_7d", "watch_time_30d", "watch_time_total")
_COUNTS = ("video_count_1d", "video_count_7d", "video_count_30d", "video_count_total", "unique_videos_total", "category_diversity")
_SESSIONS = ("session_count_7d", "session_count_30d", "avg_events_per_session")
_ENGAGED = ("completion_rate", "interaction_frequency_7d", "days_since_last_interaction")


@query(_user_sql(*_WATCH, base=EV_SQL, rows="ev"))
def user_watch_time(spark, d):
    return _user(spark, d, *_WATCH)


@query(_user_sql(*_COUNTS, base=EV_SQL, rows="ev"))
def user_counts(spark, d):
    return _user(spark, d, *_COUNTS)


@query(f"WITH {EV_SQL} SELECT u.user_id, top_category FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN {_TOP} t ON u.user_id = t.user_id")
def user_top_category(spark, d):
    return _user(spark, d, "top_category")


@query(_user_sql(*_SESSIONS))
def user_sessions(spark, d):
    return _user(spark, d, *_SESSIONS, sessions=True)


@query(_user_sql(*_ENGAGED, base=EV_SQL, rows="ev"))
def user_engagement(spark, d):
    return _user(spark, d, *_ENGAGED)


@query(f"WITH {SESSION_SQL} SELECT a.*, top_category FROM (SELECT user_id, " + ", ".join(f"{v} AS {k}" for k, v in _USER.items()) + f" FROM se GROUP BY user_id) a LEFT JOIN {_TOP} t ON a.user_id = t.user_id")
def user_all(spark, d):
    return round_columns(features.user_features(session_events(spark, d), EV, as_of()))


# --- items

_AVG = "coalesce(avg(value) FILTER (WHERE {}), 0)"
_ITEM = {
    **{f"view_count_{n}d": f"count(*) FILTER (WHERE age <= {n})" for n in (1, 7, 30)},
    "view_count_total": "count(*)",
    "unique_users_total": "count(DISTINCT user_id)",
    "start_count": "count(*) FILTER (WHERE st)",
    "completion_count": "count(*) FILTER (WHERE co)",
    "completion_rate": R(ratio_sql("count(*) FILTER (WHERE co)", "count(*) FILTER (WHERE st)")),
    "avg_watch_time": R(_AVG.format("true")),
    "total_watch_time": R("coalesce(sum(value), 0)"),
    "avg_watch_time_7d": R(_AVG.format("age <= 7")),
    "avg_watch_time_30d": R(_AVG.format("age <= 30")),
    "views_last_7d": "count(*) FILTER (WHERE age > 0 AND age <= 7)",
    "views_prev_7d": "count(*) FILTER (WHERE age > 7 AND age <= 14)",
    "growth_rate_7d": R(ratio_sql("(count(*) FILTER (WHERE age > 0 AND age <= 7) - count(*) FILTER (WHERE age > 7 AND age <= 14))", "count(*) FILTER (WHERE age > 7 AND age <= 14)")),
    "popularity_score": R(f"count(*) / 1000.0::DOUBLE * 0.4::DOUBLE + {ratio_sql('count(*) FILTER (WHERE co)', 'count(*)')} * 0.4::DOUBLE + coalesce(avg(value), 0) / 3600.0::DOUBLE * 0.2::DOUBLE"),
    "trending_score": R("CASE WHEN count(*) FILTER (WHERE age > 1) > 0 THEN count(*) FILTER (WHERE age <= 1) / CAST(count(*) FILTER (WHERE age > 1) AS DOUBLE) ELSE count(*) FILTER (WHERE age <= 1) END"),
}
_RETURN = f"(SELECT k, {R('avg(CAST(s AS DOUBLE))')} AS avg_sessions_per_user, {R('count(*) FILTER (WHERE n > 1) / CAST(count(*) AS DOUBLE)')} AS return_user_rate FROM (SELECT k, user_id, count(*) AS n, count(DISTINCT session_id) AS s FROM se WHERE v AND k IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


def _item_sql(*names: str) -> str:
    return f"WITH {EV_SQL} SELECT k AS video_id, " + ", ".join(f"{_ITEM[n]} AS {n}" for n in names) + " FROM ev WHERE v AND k IS NOT NULL GROUP BY k"


def _item(spark, d, *names, sessions=False):
    df = session_events(spark, d) if sessions else events(spark, d).withColumn("session_id", F.lit(None).cast("string"))
    return round_columns(features.item_features(df, EV, as_of(), list(names)))


_VIEWS = ("view_count_1d", "view_count_7d", "view_count_30d", "view_count_total", "unique_users_total")
_COMPLETION = ("start_count", "completion_count", "completion_rate")
_ITEM_WATCH = ("avg_watch_time", "total_watch_time", "avg_watch_time_7d", "avg_watch_time_30d")
_GROWTH = ("views_last_7d", "views_prev_7d", "growth_rate_7d")


@query(_item_sql(*_VIEWS))
def item_views(spark, d):
    return _item(spark, d, *_VIEWS)


@query(_item_sql(*_COMPLETION))
def item_completion(spark, d):
    return _item(spark, d, *_COMPLETION)


@query(_item_sql(*_ITEM_WATCH))
def item_watch(spark, d):
    return _item(spark, d, *_ITEM_WATCH)


@query(f"WITH {SESSION_SQL} SELECT k AS video_id, avg_sessions_per_user, return_user_rate FROM {_RETURN}")
def item_return_rate(spark, d):
    return _item(spark, d, "avg_sessions_per_user", "return_user_rate", sessions=True)


@query(_item_sql(*_GROWTH))
def item_growth(spark, d):
    return _item(spark, d, *_GROWTH)


@query(_item_sql("popularity_score"))
def item_popularity(spark, d):
    return _item(spark, d, "popularity_score")


@query(_item_sql("trending_score"))
def item_trending(spark, d):
    return _item(spark, d, "trending_score")


@query(f"WITH {SESSION_SQL} SELECT a.*, avg_sessions_per_user, return_user_rate FROM (SELECT k AS video_id, " + ", ".join(f"{v} AS {k}" for k, v in _ITEM.items()) + f" FROM ev WHERE v AND k IS NOT NULL GROUP BY k) a JOIN {_RETURN} r ON a.video_id = r.k")
def item_all(spark, d):
    return round_columns(features.item_features(session_events(spark, d), EV, as_of()))


# --- sessions

_SECONDS = "(floor(epoch(max(ts))) - floor(epoch(min(ts))))"
_SESSION = {
    "session_duration_seconds": f"CAST({_SECONDS} AS BIGINT)",
    "avg_time_between_events": R(f"CASE WHEN count(*) > 1 THEN {_SECONDS} / (count(*) - 1) ELSE 0 END"),
    "event_count": "count(*)",
    "unique_event_types": "count(DISTINCT event_type)",
    "video_event_count": "count(*) FILTER (WHERE v)",
    "total_watch_time": R("coalesce(sum(value) FILTER (WHERE v), 0)"),
    "interaction_rate": R(ratio_sql("count(*) FILTER (WHERE v)", "count(*)")),
    "engagement_score": R(f"coalesce(sum(value) FILTER (WHERE v), 0) / 3600.0::DOUBLE * 0.6::DOUBLE + {ratio_sql('count(*) FILTER (WHERE v)', 'count(*)')} * 0.4::DOUBLE"),
    "videos_completed": "count(*) FILTER (WHERE v AND co)",
    "completion_rate": R(ratio_sql("count(*) FILTER (WHERE v AND co)", "count(*) FILTER (WHERE v AND st)")),
    "unique_videos": "count(DISTINCT k) FILTER (WHERE v)",
    "unique_categories": "count(DISTINCT category) FILTER (WHERE v)",
    "session_type": "CASE WHEN coalesce(sum(value) FILTER (WHERE v), 0) > 1800 AND count(DISTINCT k) FILTER (WHERE v) <= 3 THEN 'watching' WHEN coalesce(sum(value) FILTER (WHERE v), 0) < 600 AND count(DISTINCT k) FILTER (WHERE v) > 5 THEN 'browsing' ELSE 'mixed' END",
}


def _session_sql(*names: str) -> str:
    return f"WITH {SESSION_SQL} SELECT session_id, min(user_id) AS user_id, " + ", ".join(f"{_SESSION[n]} AS {n}" for n in names) + " FROM se GROUP BY session_id"


def _session(spark, d, *names):
    return round_columns(features.session_features(session_events(spark, d), EV, as_of(), list(names)))


@query(f"WITH {SESSION_SQL} SELECT event_id, session_id FROM se")
def sessionize_gap(spark, d):
    return session_events(spark, d).select("event_id", "session_id")


@query(_session_sql("session_duration_seconds", "avg_time_between_events", "event_count", "unique_event_types"))
def session_duration(spark, d):
    return _session(spark, d, "session_duration_seconds", "avg_time_between_events", "event_count", "unique_event_types")


@query(_session_sql("video_event_count", "total_watch_time", "interaction_rate", "engagement_score", "videos_completed", "completion_rate"))
def session_engagement(spark, d):
    return _session(spark, d, "video_event_count", "total_watch_time", "interaction_rate", "engagement_score", "videos_completed", "completion_rate")


@query(_session_sql("unique_videos", "unique_categories", "session_type"))
def session_type(spark, d):
    return _session(spark, d, "unique_videos", "unique_categories", "session_type")


@query(_session_sql(*_SESSION))
def session_all(spark, d):
    return _session(spark, d, *_SESSION)


# --- time

_PERIOD = {p: f"count(*) FILTER (WHERE {w})" for p, w in (("morning", "hour(ts) BETWEEN 6 AND 11"), ("afternoon", "hour(ts) BETWEEN 12 AND 17"), ("evening", "hour(ts) BETWEEN 18 AND 21"), ("night", "hour(ts) NOT BETWEEN 6 AND 21"))}
_DAY = {d: f"count(*) FILTER (WHERE dayofweek(ts) = {i})" for i, d in enumerate(features.DAYS)}


def _first(counts: dict[str, str]) -> str:
    most = f"greatest({', '.join(counts.values())})"
    return "CASE " + " ".join(f"WHEN {c} = {most} THEN '{n}'" for n, c in counts.items()) + " END"


_WEEKEND = "count(*) FILTER (WHERE dayofweek(ts) IN (0, 6))"
_TEMPORAL = {
    "days_since_last_event": "min(age)",
    "days_since_first_event": "max(age)",
    "user_age_days": "max(age) - min(age)",
    "total_events": "count(*)",
    "active_days": "count(DISTINCT CAST(ts AS DATE))",
    "events_7d": "count(*) FILTER (WHERE age <= 7)",
    "events_30d": "count(*) FILTER (WHERE age <= 30)",
    "events_per_day": R(ratio_sql("count(*)", "count(DISTINCT CAST(ts AS DATE))")),
    "events_per_day_7d": R("count(*) FILTER (WHERE age <= 7) / 7.0"),
    "events_per_day_30d": R("count(*) FILTER (WHERE age <= 30) / 30.0"),
    **{f"{p}_events": c for p, c in _PERIOD.items()},
    **{f"{p}_activity_pct": R(ratio_sql(c, "count(*)")) for p, c in _PERIOD.items()},
    "preferred_time_period": _first(_PERIOD),
    **{f"{d}_events": c for d, c in _DAY.items()},
    **{f"{d}_activity_pct": R(ratio_sql(c, "count(*)")) for d, c in _DAY.items()},
    "preferred_day_of_week": _first(_DAY),
    "weekend_activity_ratio": R(ratio_sql(_WEEKEND, f"(count(*) - {_WEEKEND})")),
}


def _temporal_sql(*names: str) -> str:
    return f"WITH {EV_SQL} SELECT user_id, " + ", ".join(f"{_TEMPORAL[n]} AS {n}" for n in names) + " FROM ev WHERE user_id IS NOT NULL GROUP BY user_id"


def _temporal(spark, d, *names):
    return round_columns(features.temporal_features(events(spark, d), EV, as_of(), list(names)))


@query("SELECT event_id, hour(ts) AS event_hour, dayofweek(ts) + 1 AS event_day_of_week, day(ts) AS event_day_of_month, month(ts) AS event_month, year(ts) AS event_year, weekofyear(ts) AS event_week_of_year, CAST(ts AS DATE) AS event_date FROM events")
def time_components(spark, d):
    return features.time_components(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


_RECENCY = ("days_since_last_event", "days_since_first_event", "user_age_days")
_FREQUENCY = tuple("total_events active_days events_7d events_30d events_per_day events_per_day_7d events_per_day_30d".split())
_TOD = tuple(n for p in features.PERIODS for n in (f"{p}_events", f"{p}_activity_pct"))
_DOW = tuple(n for p in features.DAYS for n in (f"{p}_events", f"{p}_activity_pct"))


@query(_temporal_sql(*_RECENCY))
def recency(spark, d):
    return _temporal(spark, d, *_RECENCY)


@query(_temporal_sql(*_FREQUENCY))
def frequency(spark, d):
    return _temporal(spark, d, *_FREQUENCY)


@query(_temporal_sql(*_TOD))
def tod_pivot(spark, d):
    return _temporal(spark, d, *_TOD)


@query(_temporal_sql(*_DOW))
def dow_pivot(spark, d):
    return _temporal(spark, d, *_DOW)


@query(_temporal_sql("weekend_activity_ratio"))
def weekend_ratio(spark, d):
    return _temporal(spark, d, "weekend_activity_ratio")


@query(_temporal_sql("preferred_time_period", "preferred_day_of_week"))
def preferred_period(spark, d):
    return _temporal(spark, d, "preferred_time_period", "preferred_day_of_week")


@query(_temporal_sql(*_TEMPORAL))
def temporal_all(spark, d):
    return _temporal(spark, d, *_TEMPORAL)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot_types(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().fillna(0)


# --- statistics

_NUM = ("l_quantity", "l_extendedprice", "l_discount")


def _lineitem(spark, d):
    return table(spark, d, "lineitem")


@query("SELECT l_returnflag, " + ", ".join(f"{R(f'avg({c})')} AS {c}_mean, {R(f'stddev_samp({c})')} AS {c}_stddev, {R(f'min({c})')} AS {c}_min, {R(f'max({c})')} AS {c}_max" for c in _NUM) + " FROM lineitem GROUP BY l_returnflag")
def stats_basic(spark, d):
    return round_columns(stats.basic(_lineitem(spark, d), list(_NUM), ["l_returnflag"]))


@query("SELECT l_linestatus, " + ", ".join(f"{R(f'quantile_cont({c}, {p / 100})')} AS {c}_p{p}" for c in _NUM for p in (25, 50, 75, 95)) + " FROM lineitem GROUP BY l_linestatus")
def stats_percentiles(spark, d):
    return round_columns(stats.percentiles(_lineitem(spark, d), list(_NUM), by=["l_linestatus"]))


_LINE = "l_orderkey, l_linenumber"


@query(f"SELECT {_LINE}, {R('(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)')} AS l_quantity_zscore FROM lineitem")
def zscore(spark, d):
    return round_columns(stats.z_scores(_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).drop("l_quantity"))


@query(f"SELECT {_LINE}, {R('coalesce((l_discount - avg(l_discount) OVER w) / nullif(stddev_samp(l_discount) OVER w, 0), 0)')} AS l_discount_zscore FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def zscore_grouped(spark, d):
    return round_columns(stats.z_scores(_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag"), ["l_discount"], ["l_returnflag"]).drop("l_discount", "l_returnflag"))


@query(f"SELECT {_LINE}, {R('(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem)')} AS l_quantity_normalized FROM lineitem")
def minmax(spark, d):
    return round_columns(stats.normalize(_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "minmax").drop("l_quantity"))


@query(f"SELECT {_LINE}, {R('(l_quantity - (SELECT median(l_quantity) FROM lineitem)) / (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) FROM lineitem)')} AS l_quantity_normalized FROM lineitem")
def robust(spark, d):
    return round_columns(stats.normalize(_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "robust").drop("l_quantity"))


@query("SELECT l_returnflag, " + ", ".join(f"{R(f'(avg({c}) - median({c})) / stddev_samp({c})')} AS {c}_skewness, {R(f'(quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) / stddev_samp({c})')} AS {c}_kurtosis, {R(f'kurtosis_pop({c})')} AS {c}_kurtosis_moment" for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem GROUP BY l_returnflag")
def skew_kurt_proxy(spark, d):
    return round_columns(stats.distribution(_lineitem(spark, d), ["l_quantity", "l_extendedprice"], ["l_returnflag"]))


# --- reports

_HALF = "l_shipdate < TIMESTAMP '1995-06-17'"


def _profile_sql(c: str, where: str = "true") -> str:
    return f"SELECT '{c}' AS feature, count(*) AS n, count({c}) AS present, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS q25, median({c}) AS q50, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95, min({c}) AS low, max({c}) AS high FROM lineitem WHERE {where}"


def _all(f) -> str:
    return " UNION ALL ".join(f(c) for c in _NUM)


_P = f"p AS ({_all(_profile_sql)})"
_IQR = "iqr AS (" + _all(lambda c: f"SELECT '{c}' AS feature, count(*) AS outliers FROM lineitem, p WHERE p.feature = '{c}' AND ({c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25))") + ")"
_HALVES = f"a AS ({_all(lambda c: _profile_sql(c, 'NOT ' + _HALF))}), b AS ({_all(lambda c: _profile_sql(c, _HALF))}), dr AS (SELECT feature, abs(a.mean - b.mean) / abs(b.mean) AS mean_change, abs(a.std - b.std) / abs(b.std) AS std_change, abs(a.q50 - b.q50) / abs(b.q50) AS median_change FROM a JOIN b USING (feature))"


def _halves(spark, d):
    df = _lineitem(spark, d)
    old = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    return df.where(~old), df.where(old)


@query(f"WITH {_P} SELECT feature, n, present, " + ", ".join(f"{R(c)} AS {c}" for c in ("mean", "std", "low", "high", "q25", "q50", "q75", "q95")) + " FROM p")
def feature_profile(spark, d):
    return round_columns(quality.profile(_lineitem(spark, d), list(_NUM), exact=True))


@query()
def quality_report_sketch(spark, d):
    """The report as it is made of large tables: percentiles from sketches."""
    now, before = _halves(spark, d)
    return round_columns(quality.quality_report(now, list(_NUM), before))


@query(f"WITH {_P}, {_IQR} SELECT feature, present, outliers, {R('outliers / CAST(present AS DOUBLE)')} AS share FROM p JOIN iqr USING (feature)")
def outlier_iqr(spark, d):
    return round_columns(quality.anomalies(_lineitem(spark, d), list(_NUM), exact=True))


@query(f"WITH {_P}, z AS (" + _all(lambda c: f"SELECT '{c}' AS feature, count(*) AS outliers FROM lineitem, p WHERE p.feature = '{c}' AND ({c} < mean - 2 * std OR {c} > mean + 2 * std)") + f") SELECT feature, present, outliers, {R('outliers / CAST(present AS DOUBLE)')} AS share FROM p JOIN z USING (feature)")
def anomaly_zscore(spark, d):
    return round_columns(quality.anomalies(_lineitem(spark, d), list(_NUM), "zscore", 2.0, exact=True))


@query(f"WITH {_HALVES} SELECT feature, {R('mean_change')} AS mean_change, {R('std_change')} AS std_change, {R('median_change')} AS median_change, {R('(mean_change + std_change + median_change) / 3')} AS drift, (mean_change + std_change + median_change) / 3 > 0.1 AS drifted FROM dr")
def drift_report(spark, d):
    return round_columns(quality.drift(*_halves(spark, d), list(_NUM), exact=True))


def _steps(x: str, *bounds: float, scores=(1.0, 0.8, 0.6, 0.4), last=0.2) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {s}" for b, s in zip(bounds, scores)) + f" ELSE {last} END"


@query(
    f"WITH {_HALVES.replace('a AS', 'p AS', 1).replace('FROM a JOIN', 'FROM p AS a JOIN')}, iqr AS ("
    + _all(lambda c: f"SELECT '{c}' AS feature, count(*) AS outliers FROM lineitem, p WHERE NOT {_HALF} AND p.feature = '{c}' AND ({c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25))")
    + "), s AS (SELECT feature, greatest(0, 1 - 2 * (1 - present / CAST(n AS DOUBLE))) AS null_score, "
    + _steps("outliers / CAST(present AS DOUBLE)", 0.05, 0.10, 0.20, scores=(1.0, 0.8, 0.5))
    + " AS outlier_score, "
    + _steps("abs(mean - q50) / std", 0.1, 0.5, 1.0, last=0.4)
    + " AS distribution_score, "
    + _steps("(mean_change + std_change) / 2", 0.05, 0.10, 0.20, 0.50)
    + f" AS drift_score FROM p JOIN iqr USING (feature) JOIN dr USING (feature)) SELECT feature, {R('null_score')} AS null_score, {R('outlier_score')} AS outlier_score, {R('distribution_score')} AS distribution_score, {R('drift_score')} AS drift_score, {R('0.3 * null_score + 0.3 * outlier_score + 0.2 * distribution_score + 0.2 * drift_score')} AS overall, 0.3 * null_score + 0.3 * outlier_score + 0.2 * distribution_score + 0.2 * drift_score >= 0.8 AS ok FROM s"
)
def quality_report(spark, d):
    now, before = _halves(spark, d)
    return round_columns(quality.quality_report(now, list(_NUM), before, exact=True))


@query("SELECT feature, " + R("c") + " AS completeness, CASE WHEN c >= 0.95 THEN 'excellent' WHEN c >= 0.9 THEN 'good' WHEN c >= 0.75 THEN 'fair' ELSE 'poor' END AS status FROM (SELECT 'value' AS feature, 1.0::DOUBLE AS c UNION ALL SELECT 'some', count(*) FILTER (WHERE event_type <> 'error') / CAST(count(*) AS DOUBLE) FROM events)")
def completeness(spark, d):
    df = table(spark, d, "events").select("value", F.when(F.col("event_type") != "error", F.col("value")).alias("some"))
    return round_columns(quality.completeness(df, ["value", "some"]))


@query(f"SELECT max(ts) AS latest, {R('(floor(epoch(TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + ')) - floor(epoch(max(ts)))) / 3600.0')} AS age_hours, CASE WHEN (floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts)))) / 3600.0 <= 24 THEN 'fresh' WHEN (floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts)))) / 3600.0 <= 48 THEN 'stale' ELSE 'very_stale' END AS status FROM events")
def freshness(spark, d):
    return round_columns(quality.freshness(table(spark, d, "events"), "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")))


@query(f"WITH {_P}, {_IQR}, m AS (SELECT feature, present / CAST(n AS DOUBLE) AS completeness, outliers / CAST(present AS DOUBLE) AS anomaly_share FROM p JOIN iqr USING (feature)) SELECT feature, {R('completeness')} AS completeness, {R('anomaly_share')} AS anomaly_share, 0.0::DOUBLE AS drift, CASE (CASE WHEN completeness < 0.9 THEN 1 ELSE 0 END + CASE WHEN anomaly_share > 0.1 THEN 1 ELSE 0 END) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status FROM m")
def monitoring_report(spark, d):
    return round_columns(quality.monitor(_lineitem(spark, d), list(_NUM), exact=True))


# --- points in time

_PURCHASES = "(SELECT * FROM events WHERE event_type = 'purchase')"
_VIEWS_SQL = "(SELECT * FROM events WHERE event_type = 'view')"


def _two(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return df.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), df.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), "value")


@query(f"SELECT p.event_id, p.user_id, p.ts, v.ts AS seen_at, v.value FROM {_PURCHASES} p ASOF LEFT JOIN {_VIEWS_SQL} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_training(spark, d):
    return jobs.training_set(*_two(spark, d), ["user_id"], "ts", "seen_at", ["value"])


@query(f"SELECT event_id, user_id, ts, CASE WHEN seen_at >= ts - INTERVAL 1 DAY THEN seen_at END AS seen_at, CASE WHEN seen_at >= ts - INTERVAL 1 DAY THEN value END AS value FROM (SELECT p.event_id, p.user_id, p.ts, v.ts AS seen_at, v.value FROM {_PURCHASES} p ASOF LEFT JOIN {_VIEWS_SQL} v ON p.user_id = v.user_id AND p.ts >= v.ts)")
def asof_tolerance(spark, d):
    return jobs.training_set(*_two(spark, d), ["user_id"], "ts", "seen_at", ["value"], F.expr("INTERVAL 1 DAY"))


@query(f"WITH {EV_SQL} SELECT event_id, {R('sum(CASE WHEN v THEN value END) OVER w')} AS watch_time_7d_rolling, count(*) OVER w AS events_7d_rolling FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)")
def pit_rolling_7d(spark, d):
    columns = {"watch_time_7d_rolling": F.sum(F.when(EV.is_video(), F.col("play_position_seconds"))), "events_7d_rolling": F.count("*")}
    return round_columns(features.rolling(events(spark, d), EV, 7, columns).select("event_id", *columns))


@query(f"WITH {EV_SQL}, pts AS (SELECT DISTINCT user_id, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20 12:00:00']) AS as_of FROM ev) SELECT p.user_id, p.as_of, count(e.ts) AS total_events, {R('coalesce(sum(value) FILTER (WHERE v), 0)')} AS watch_time_total, " + ", ".join(f"{R(f'coalesce(sum(value) FILTER (WHERE v AND o <= {n}), 0)')} AS watch_time_{n}d, count(k) FILTER (WHERE v AND o <= {n}) AS video_count_{n}d" for n in (1, 7, 30)) + " FROM pts p LEFT JOIN (SELECT ev.*, pts.as_of, date_diff('day', CAST(ts AS DATE), CAST(as_of AS DATE)) AS o FROM ev JOIN pts ON ev.user_id = pts.user_id AND ts <= as_of) e ON p.user_id = e.user_id AND p.as_of = e.as_of GROUP BY 1, 2")
def backfill_points(spark, d):
    ev = events(spark, d)
    times = F.array(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return round_columns(jobs.backfill(ev, ev.select("user_id").distinct().withColumn("as_of", F.explode(times)), EV))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def latest_features(spark, d):
    df = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return joins.latest(df, ["user_id"], "ts").drop("event_id")


@query("SELECT event_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS time_since_last_event, hour(ts) AS current_hour, dayofweek(ts) IN (0, 6) AS is_weekend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def online_context(spark, d):
    return features.online_context(events(spark, d), EV).select("event_id", "time_since_last_event", "current_hour", "is_weekend")


# --- embeddings

_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, e.vec_id) AS INTEGER) AS rank, {R(_COS)} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id < 50 AND q.vec_id <> e.vec_id QUALIFY rank <= 10")
def topk_similarity(spark, d):
    df = table(spark, d, "embeddings")
    return round_columns(embeddings.top_k(df, df.where("vec_id < 50")))


@query(f"SELECT vec_id, {R('embedding[1]::DOUBLE')} AS emb_0, {R('embedding[2]::DOUBLE')} AS emb_1, {R('embedding[64]::DOUBLE')} AS emb_63 FROM embeddings")
def embedding_dims(spark, d):
    return round_columns(embeddings.spread(table(spark, d, "embeddings"), keep=["vec_id"]).select("vec_id", "emb_0", "emb_1", "emb_63"))


@query(f"SELECT q.vec_id, {R(_COS)} AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1")
def pair_similarity(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return round_columns(embeddings.similarity(df.join(after, "vec_id"), "embedding", "next").select("vec_id", "similarity"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS video_id, CAST(count(*) AS FLOAT) AS rating FROM events GROUP BY 1, 2")
def implicit_ratings(spark, d):
    return embeddings.ratings(events(spark, d), "user_id", "video_id")


@query()
def als_embeddings(spark, d):
    users, items = embeddings.build(events(spark, d), size=16)
    return users.select(F.lit("user").alias("kind"), F.col("user_id").cast("long").alias("id"), "embedding").unionByName(items.select(F.lit("item").alias("kind"), F.col("video_id").cast("long").alias("id"), "embedding"))


@query()
def co_occurrence_embeddings(spark, d):
    return embeddings.build(events(spark, d), method="simple", size=32)[0]


# --- streams


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import atexit
        import shutil
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """The stream's result once it has taken what there is; each batch is a folder, and a complete one stands for all before it."""
    folder = _folder(spark)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _stream(spark: SparkSession, d: str, path: str | None = None, files: int = 1) -> DataFrame:
    path = path or f"{d}/events.parquet*"
    return spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", files).parquet(path)


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    """Times as they were before they got the session's zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events, {R('sum(value)')} AS total FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark, d):
    df = windows.windowed(_stream(spark, d), "ts", ["event_type"], {"events": F.count("*"), "total": F.sum("value")}, "1 hour", delay="1 hour")
    return round_columns(_naive(_run(spark, df, "complete"), "window_start", "window_end"))


@query("SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    df = windows.windowed(_stream(spark, d), "ts", [], {"events": F.count("*")}, "1 hour", "30 minutes")
    return _naive(_run(spark, df, "complete"), "window_start", "window_end")


@query(f"WITH {SESSION_SQL} SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM se GROUP BY user_id, session_id")
def stream_session(spark, d):
    df = windows.sessions(_stream(spark, d), "ts", ["user_id"], {"events": F.count("*")}, "30 minutes")
    return _naive(_run(spark, df, "complete"), "session_start", "session_end")


@query("SELECT user_id, event_type, count(*) AS rows FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark, d):
    doubled = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = doubled.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got = _run(spark, dedup.within_watermark(doubled, ["event_id"], "ts", "40 days"), "append")
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def stream_late_data(spark, d):
    """The second half of the month comes first; what comes after is later than the watermark allows."""
    folder = _folder(spark)
    df = table(spark, d, "events")
    late = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    df.where(~late).coalesce(1).write.mode("append").parquet(folder + "/in")
    source = _stream(spark, d, folder + "/in")
    counted = windows.windowed(source, "ts", [], {"events": F.count("*")}, "1 day", delay="1 hour")
    out = f"{folder}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in (None, late):
        if part is not None:
            df.where(part).coalesce(1).write.mode("append").parquet(folder + "/in")
        counted.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _naive(spark.read.parquet(out), "window_start").select("window_start", "events")


