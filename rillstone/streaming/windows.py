"""Windowed aggregates of streams (and of tables: the same functions serve both)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a time with a zone; one without is taken to be in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, time: str, by: list[str], aggs: dict[str, Column], width: str = "5 minutes", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates by tumbling, or with a slide hopping, windows and keys; rows later than the delay are dropped."""
    df = event_time(df, time)
    if delay:
        df = df.withWatermark(time, delay)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *by).agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def sessions(df: DataFrame, time: str, by: list[str], aggs: dict[str, Column], gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Aggregates by session: a key's events without a pause of the gap."""
    df = event_time(df, time)
    if delay:
        df = df.withWatermark(time, delay)
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def watch_features(stream: DataFrame, time: str = "event_timestamp", delay: str | None = "1 hour") -> DataFrame:
    """Watch time and videos of each user in five minutes."""
    return windowed(stream, time, ["user_id"], {"watch_time_5m": F.sum("play_position_seconds"), "video_count_5m": F.count("video_id")}, delay=delay)
