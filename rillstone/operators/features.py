"""Feature tables. Each is one pass: conditional aggregates over one shuffle by entity, not a join of many.

Every function takes ``as_of``; rows after it are left out, and recency is
counted in calendar days before it. Entities with a null key are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Events:
    """Names of an event table's columns, and what its types mean."""

    entity: str = "user_id"
    item: str = "video_id"
    category: str = "video_category"
    session: str = "session_id"
    time: str = "event_timestamp"
    watch: str = "play_position_seconds"
    type: str = "event_type"
    video: str = "{type} LIKE '%video%'"
    start: str = "{type} LIKE '%start%'"
    complete: str = "{type} LIKE '%complete%'"

    def is_video(self) -> Column:
        return F.coalesce(F.expr(self.video.format(type=self.type)), F.lit(False))

    def is_start(self) -> Column:
        return F.coalesce(F.expr(self.start.format(type=self.type)), F.lit(False))

    def is_complete(self) -> Column:
        return F.coalesce(F.expr(self.complete.format(type=self.type)), F.lit(False))


def age(time: str | Column, as_of: Column) -> Column:
    """Calendar days before as_of."""
    return F.datediff(F.to_date(as_of), F.to_date(time))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 if b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))


def distinct(value: Column, when: Column | None = None) -> Column:
    """How many different values: for entities of bounded activity, where a set is cheaper than a second shuffle."""
    return F.size(F.collect_set(value if when is None else F.when(when, value)))


def _past(df: DataFrame, ev: Events, key: str, as_of: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(ev.time) <= as_of))


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def user_aggregates(ev: Events, as_of: Column) -> dict[str, Column]:
    """Name and aggregate of each user feature."""
    video, watch, days = ev.is_video(), F.col(ev.watch), age(ev.time, as_of)
    item, session = F.col(ev.item), F.col(ev.session)
    out = {}
    for n in (1, 7, 30):
        out[f"watch_time_{n}d"] = total(watch, video & (days <= n))
    out["watch_time_total"] = total(watch, video)
    for n in (1, 7, 30):
        out[f"video_count_{n}d"] = F.count_if(video & item.isNotNull() & (days <= n))
    out["video_count_total"] = F.count_if(video & item.isNotNull())
    out["unique_videos_total"] = distinct(item, video)
    out["top_category"] = F.mode(F.when(video, F.col(ev.category)), True)
    out["category_diversity"] = distinct(F.col(ev.category), video)
    for n in (7, 30):
        out[f"session_count_{n}d"] = distinct(session, days <= n)
    out["avg_events_per_session"] = ratio(F.count_if(session.isNotNull()), distinct(session))
    out["completion_rate"] = ratio(F.count_if(video & ev.is_complete()), F.count_if(video & ev.is_start()))
    out["interaction_frequency_7d"] = F.count_if(days <= 7) / 7.0
    out["days_since_last_interaction"] = F.min(days)
    return out


def user_features(df: DataFrame, ev: Events = Events(), as_of: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """One row for each user. ``only`` names the features to make; columns that others need aren't read."""
    as_of = _now(as_of)
    made = {k: v for k, v in user_aggregates(ev, as_of).items() if not only or k in only}
    return _past(df, ev, ev.entity, as_of).groupBy(ev.entity).agg(*[v.alias(k) for k, v in made.items()])


def item_features(df: DataFrame, ev: Events = Events(), as_of: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """One row for each item, from its video events.

    Two levels, (item, user) and item: users are counted without collecting
    them, so an item that everybody watched is spread over many tasks.
    """
    as_of = _now(as_of)
    days, watch = age(ev.time, as_of), F.col(ev.watch)
    rows = _past(df, ev, ev.item, as_of).where(ev.is_video())
    sums = {f"n{n}": F.count_if(days <= n) for n in (1, 7, 30)}
    sums |= {"n": F.count("*"), "recent": F.count_if((days > 0) & (days <= 7)), "before": F.count_if((days > 7) & (days <= 14)), "older": F.count_if(days > 1)}
    sums |= {"starts": F.count_if(ev.is_start()), "completes": F.count_if(ev.is_complete())}
    for n, ok in (("7", days <= 7), ("30", days <= 30), ("", F.lit(True))):
        sums |= {f"w{n}": F.sum(F.when(ok, watch)), f"c{n}": F.count(F.when(ok, watch))}
    by_user = rows.groupBy(ev.item, ev.entity).agg(*[v.alias(k) for k, v in sums.items()], distinct(F.col(ev.session)).alias("sessions"))
    user = F.col(ev.entity).isNotNull()
    upper = by_user.groupBy(ev.item).agg(*[F.sum(k).alias(k) for k in sums], F.count_if(user).alias("users"), F.avg(F.when(user, F.col("sessions"))).alias("sessions"), F.count_if(user & (F.col("n") > 1)).alias("returning"))
    c = F.col
    average = F.coalesce(c("w") / F.nullif(c("c"), F.lit(0)), F.lit(0.0))
    out = {
        **{f"view_count_{n}d": c(f"n{n}") for n in (1, 7, 30)},
        "view_count_total": c("n"),
        "unique_users_total": c("users"),
        "start_count": c("starts"),
        "completion_count": c("completes"),
        "completion_rate": ratio(c("completes"), c("starts")),
        "avg_watch_time": average,
        "total_watch_time": F.coalesce(c("w"), F.lit(0.0)),
        "avg_watch_time_7d": F.coalesce(c("w7") / F.nullif(c("c7"), F.lit(0)), F.lit(0.0)),
        "avg_watch_time_30d": F.coalesce(c("w30") / F.nullif(c("c30"), F.lit(0)), F.lit(0.0)),
        "avg_sessions_per_user": F.coalesce(c("sessions"), F.lit(0.0)),
        "return_user_rate": ratio(c("returning"), c("users")),
        "views_last_7d": c("recent"),
        "views_prev_7d": c("before"),
        "growth_rate_7d": ratio(c("recent") - c("before"), c("before")),
        "popularity_score": c("n") / 1000 * 0.4 + ratio(c("completes"), c("n")) * 0.4 + average / 3600 * 0.2,
        "trending_score": F.when(c("older") > 0, c("n1") / c("older")).otherwise(c("n1").cast("double")),
    }
    return upper.select(ev.item, *[v.alias(k) for k, v in out.items() if not only or k in only])


def sessionize(df: DataFrame, ev: Events = Events(), gap: str = "30 minutes", name: str | None = None, tie: str = "event_id") -> DataFrame:
    """df with a session for each event: a new one after a pause longer than the gap. Events at one time are ordered by ``tie``; rows without an entity or time have none."""
    name = name or ev.session
    by = Window.partitionBy(ev.entity).orderBy(ev.time, tie)
    before = F.lag(ev.time).over(by)
    fresh = F.when(F.col(ev.time).isNotNull() & (before.isNull() | (F.col(ev.time) > before + F.expr(f"INTERVAL {gap}"))), 1).otherwise(0)
    number = F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    known = F.col(ev.entity).isNotNull() & F.col(ev.time).isNotNull()
    return df.withColumn("__new", fresh).withColumn(name, F.when(known, F.concat_ws("-", F.col(ev.entity).cast("string"), number.cast("string")))).drop("__new")


def session_features(df: DataFrame, ev: Events = Events(), as_of: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """One row for each session."""
    as_of = _now(as_of)
    video, watch, item = ev.is_video(), F.col(ev.watch), F.col(ev.item)
    seconds = F.col("last_time").cast("timestamp").cast("long") - F.col("first_time").cast("timestamp").cast("long")
    rows = _past(df, ev, ev.session, as_of).groupBy(ev.session)
    agg = rows.agg(
        F.min(ev.entity).alias(ev.entity),
        F.min(ev.time).alias("first_time"),
        F.max(ev.time).alias("last_time"),
        F.count("*").alias("event_count"),
        distinct(F.col(ev.type)).alias("unique_event_types"),
        F.count_if(video).alias("video_event_count"),
        total(watch, video).alias("total_watch_time"),
        F.count_if(video & ev.is_complete()).alias("videos_completed"),
        F.count_if(video & ev.is_start()).alias("starts"),
        distinct(item, video).alias("unique_videos"),
        distinct(F.col(ev.category), video).alias("unique_categories"),
    )
    c = F.col
    rate = ratio(c("video_event_count"), c("event_count"))
    out = {
        "session_duration_seconds": seconds,
        "avg_time_between_events": F.when(c("event_count") > 1, seconds / (c("event_count") - 1)).otherwise(0.0),
        "event_count": c("event_count"),
        "unique_event_types": c("unique_event_types"),
        "video_event_count": c("video_event_count"),
        "total_watch_time": c("total_watch_time"),
        "interaction_rate": rate,
        "engagement_score": c("total_watch_time") / 3600 * 0.6 + rate * 0.4,
        "videos_completed": c("videos_completed"),
        "completion_rate": ratio(c("videos_completed"), c("starts")),
        "unique_videos": c("unique_videos"),
        "unique_categories": c("unique_categories"),
        "session_type": F.when((c("total_watch_time") > 1800) & (c("unique_videos") <= 3), "watching").when((c("total_watch_time") < 600) & (c("unique_videos") > 5), "browsing").otherwise("mixed"),
    }
    return agg.select(ev.session, ev.entity, *[v.alias(k) for k, v in out.items() if not only or k in only])


PERIODS = ("morning", "afternoon", "evening", "night")
DAYS = tuple("sunday monday tuesday wednesday thursday friday saturday".split())


def period(time: str | Column) -> Column:
    h = F.hour(time)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").when(h.isNotNull(), "night")


def time_components(df: DataFrame, time: str = "event_timestamp") -> DataFrame:
    """df with the parts of its event time; day 1 of the week is Sunday, weeks are ISO weeks."""
    parts = {"event_hour": F.hour, "event_day_of_week": F.dayofweek, "event_day_of_month": F.dayofmonth, "event_month": F.month, "event_year": F.year, "event_week_of_year": F.weekofyear, "event_date": F.to_date}
    return df.withColumns({k: f(time) for k, f in parts.items()})


def first_greatest(names: tuple[str, ...], counts: list[Column]) -> Column:
    """The name of the greatest count, the first of equals."""
    most = F.greatest(*counts)
    return reduce(lambda a, nc: a.when(nc[1] == most, nc[0]), list(zip(names, counts))[1:], F.when(counts[0] == most, names[0]))


def temporal_features(df: DataFrame, ev: Events = Events(), as_of: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """One row for each entity: recency, frequency, times of day and days of the week. All buckets are there, empty ones 0."""
    as_of = _now(as_of)
    days = age(ev.time, as_of)
    aggs = [F.min(days).alias("last"), F.max(days).alias("first"), F.count("*").alias("n"), distinct(F.to_date(ev.time)).alias("dates"), F.count_if(days <= 7).alias("n7"), F.count_if(days <= 30).alias("n30")]
    aggs += [F.count_if(period(ev.time) == p).alias(p) for p in PERIODS]
    aggs += [F.count_if(F.dayofweek(ev.time) == i).alias(d) for i, d in enumerate(DAYS, 1)]
    c = F.col
    weekend = c("sunday") + c("saturday")
    out = {
        "days_since_last_event": c("last"),
        "days_since_first_event": c("first"),
        "user_age_days": c("first") - c("last"),
        "total_events": c("n"),
        "active_days": c("dates"),
        "events_7d": c("n7"),
        "events_30d": c("n30"),
        "events_per_day": ratio(c("n"), c("dates")),
        "events_per_day_7d": c("n7") / 7.0,
        "events_per_day_30d": c("n30") / 30.0,
        **{f"{p}_events": c(p) for p in PERIODS},
        **{f"{p}_activity_pct": ratio(c(p), c("n")) for p in PERIODS},
        "preferred_time_period": first_greatest(PERIODS, [c(p) for p in PERIODS]),
        **{f"{d}_events": c(d) for d in DAYS},
        **{f"{d}_activity_pct": ratio(c(d), c("n")) for d in DAYS},
        "preferred_day_of_week": first_greatest(DAYS, [c(d) for d in DAYS]),
        "weekend_activity_ratio": ratio(weekend, c("n") - weekend),
    }
    return _past(df, ev, ev.entity, as_of).groupBy(ev.entity).agg(*aggs).select(ev.entity, *[v.alias(k) for k, v in out.items() if not only or k in only])


def online_context(df: DataFrame, ev: Events = Events(), tie: str = "event_id") -> DataFrame:
    """df with what a request sees at its time: seconds since the entity's event before, the hour, and whether it is a weekend."""
    before = F.lag(ev.time).over(Window.partitionBy(ev.entity).orderBy(ev.time, tie))
    seconds = F.col(ev.time).cast("timestamp").cast("long") - before.cast("timestamp").cast("long")
    return df.withColumns({"time_since_last_event": seconds, "current_hour": F.hour(ev.time), "is_weekend": F.dayofweek(ev.time).isin(1, 7)})


def rolling(df: DataFrame, ev: Events, days: int, columns: dict[str, Column]) -> DataFrame:
    """df with aggregates over each entity's last days up to the row's own second: point-in-time features of all rows in one pass."""
    frame = Window.partitionBy(ev.entity).orderBy(F.col(ev.time).cast("timestamp").cast("long")).rangeBetween(-days * 86400, 0)
    return df.withColumns({k: v.over(frame) for k, v in columns.items()})


def at_times(df: DataFrame, points: DataFrame, ev: Events = Events(), point_time: str = "as_of", days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """User features as of each (entity, point in time), never reading the future.

    points holds the entity's column and point_time. Points without events have
    zeros. Events are summed by day once, so many points don't multiply them:
    two shuffles, by entity and day, and by entity.
    """
    video, watch, day, own = ev.is_video(), F.col(ev.watch), "__day", "__own"
    number = lambda t: F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    values = {"events": F.lit(1).cast("long"), "watch": F.when(video, watch.cast("double")), "videos": F.when(video & F.col(ev.item).isNotNull(), 1).otherwise(0).cast("long")}
    happened = df.where(F.col(ev.entity).isNotNull() & F.col(ev.time).isNotNull()).select(F.col(ev.entity), F.col(ev.time).alias("__t"), F.lit(False).alias("__point"), *[v.alias(f"__{k}") for k, v in values.items()])
    asked = points.select(F.col(ev.entity), F.col(point_time).alias("__t"), F.lit(True).alias("__point")).distinct()
    both = happened.unionByName(asked, allowMissingColumns=True).withColumn(day, number("__t"))
    # a point's own day up to its time, then whole days before: the second window's rows are a day or a point each
    so_far = Window.partitionBy(ev.entity, day).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"{own}_{k}": F.sum(f"__{k}").over(so_far) for k in values})
    daily = both.groupBy(ev.entity, day, F.when(F.col("__point"), F.col("__t")).alias(point_time), "__point").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in values], *[F.max(f"{own}_{k}").alias(f"{own}_{k}") for k in values])
    by_day = Window.partitionBy(ev.entity).orderBy(day)

    def upto(k: str, n: int | None) -> Column:
        before = F.sum(f"__{k}").over(by_day.rangeBetween(Window.unboundedPreceding if n is None else -n, -1))
        return F.coalesce(before, F.lit(0)) + F.coalesce(F.col(f"{own}_{k}"), F.lit(0))

    made = {"total_events": upto("events", None), "watch_time_total": upto("watch", None)}
    for n in days:
        made |= {f"watch_time_{n}d": upto("watch", n), f"video_count_{n}d": upto("videos", n)}
    return daily.withColumns(made).where("__point").select(ev.entity, point_time, *made)
