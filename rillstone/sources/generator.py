"""Synthetic raw events, with the gaps that real ones have; any number, made on the executors, the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.functions.text import iso_time


def events(spark: SparkSession, n: int, seed: int = 42, start_ms: int = 1_704_067_200_000, span_ms: int = 86_400_000, users: int = 1000, items: int = 100) -> DataFrame:
    """n events in the producer's shape."""

    def roll(i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 30))

    def pick(i: int, *values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (roll(i) % len(values)).cast("int") + 1)

    at = F.lit(start_ms) + roll(1) % span_ms
    uuid = F.sha2(F.concat_ws("-", F.lit(seed), "id"), 256)
    device = F.struct(pick(2, None, "tablet", "", "mobile", "desktop").alias("type"), pick(3, "iOS 17.1", "Android 14", "Windows", "").alias("os"), pick(4, "Chrome", "Safari", None).alias("browser"), F.concat(F.lit("dev-"), roll(5) % users).alias("device_id"), F.lit("1920x1080").alias("screen_resolution"), (roll(6) % 101).cast("int").alias("battery_level"))
    content = F.struct(F.concat(F.lit("vid-"), roll(7) % items).alias("content_id"), pick(8, "Title", None).alias("title"), pick(9, "series", "movie").alias("content_type"), pick(10, 1, 2, None).alias("season"), pick(11, 1, 7, None).alias("episode"), (roll(12) % 7200 + 60).alias("duration_seconds"), pick(13, "drama", "comedy", "").alias("genre"), (roll(14) % 40 + 1985).cast("int").alias("release_year"))
    context = F.struct(pick(15, "home", "search", None).alias("page"), pick(16, "direct", "").alias("referrer"), (roll(17) % 3600).cast("int").alias("position"), pick(18, True, False, None).alias("autoplay"), pick(19, "vid-1", None).alias("previous_content"))
    meta = F.struct(F.concat_ws(".", F.lit("10"), roll(20) % 256, roll(21) % 256, roll(22) % 256).alias("ip_address"), pick(23, "Mozilla/5.0", None).alias("user_agent"), pick(24, "US", "DE", "").alias("country"), pick(25, "UTC", None).alias("timezone"), pick(26, "en", "").alias("language"), F.lit("1.0").alias("app_version"))
    request = F.struct(F.lit("POST").alias("http_method"), F.substring(uuid, 33, 16).alias("request_id"), at.alias("server_timestamp"))
    return spark.range(n).select(
        F.substring(uuid, 1, 32).alias("event_id"), F.lit("video_play_start").alias("event_type"), at.alias("timestamp"), iso_time(at).alias("timestamp_iso"),
        F.concat(F.lit("user-"), roll(27) % users).alias("user_id"), F.concat(F.lit("session-"), roll(28) % (users * 4)).alias("session_id"),
        device.cast(schemas.RAW["device"].dataType).alias("device"), content.cast(schemas.RAW["content"].dataType).alias("content"), context.cast(schemas.RAW["context"].dataType).alias("context"), meta.cast(schemas.RAW["metadata"].dataType).alias("metadata"), request.cast(schemas.RAW["raw_data"].dataType).alias("raw_data"),
    )


def messages(spark: SparkSession, n: int, topic: str = "user_events", **how) -> DataFrame:
    """The same as Kafka rows: JSON in a binary value."""
    rows = events(spark, n, **how)
    return rows.select(F.col("user_id").cast("binary").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value"), F.lit(topic).alias("topic"), F.pmod(F.xxhash64("user_id"), F.lit(4)).cast("int").alias("partition"), F.monotonically_increasing_id().alias("offset"), F.timestamp_millis("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))
