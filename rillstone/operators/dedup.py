"""Removal of duplicates, one shuffle on the key whatever the strategy; ties are broken by the whole row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("key", "composite", "exact", "window")
LATEST = "latest"


def _keep(df: DataFrame, keys: list[Column], time: str, keep: str) -> DataFrame:
    if keep not in ("latest", "earliest", "first"):
        raise ValueError(keep)
    rest = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields if f.name != time]  # maps have no order
    order = [F.col(time).desc_nulls_last() if keep == "latest" else F.col(time).asc_nulls_last(), *rest]
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def by_key(df: DataFrame, keys: list[str], time: str, keep: str = LATEST) -> DataFrame:
    """One row for each key. Null keys are a key like others."""
    return _keep(df, [F.col(k) for k in keys], time, keep)


def by_second(df: DataFrame, keys: list[str], time: str, keep: str = LATEST) -> DataFrame:
    """One row for each key and second."""
    return _keep(df, [*[F.col(k) for k in keys], F.date_trunc("second", time)], time, keep)


def by_window(df: DataFrame, keys: list[str], time: str, seconds: int = 300, keep: str = LATEST) -> DataFrame:
    """One row for each key and tumbling window of event time; rows without a time are a window of their own."""
    bucket = F.floor(F.col(time).cast("timestamp").cast("long") / seconds)
    return _keep(df, [*[F.col(k) for k in keys], bucket], time, keep)


def exact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows equal in the columns (all of them by default) once; null equals null and differs from ''."""
    return df.dropDuplicates(columns) if columns else df.dropDuplicates()


def remove_duplicates(df: DataFrame, strategy: str, keys: list[str] | None = None, time: str = "event_timestamp", keep: str = LATEST, seconds: int = 300) -> DataFrame:
    if strategy == "key":
        return by_key(df, keys or ["event_id"], time, keep)
    if strategy == "composite":
        return by_second(df, keys or ["event_id"], time, keep)
    if strategy == "window":
        return by_window(df, keys or ["event_id"], time, seconds, keep)
    if strategy == "exact":
        return exact(df, keys)
    raise ValueError(f"no such strategy: {strategy}")


def duplicate_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys have several rows, the rows beyond one of each, and the most rows of a key."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"))


def within_watermark(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream's first row of each key, as long as repeats come within the delay; state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
