"""Readers of the layers' Parquet tables; conditions stay on raw partition columns, so whole folders are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _dates(name: str, start: str | None, end: str | None) -> list[Column]:
    return ([F.col(name) >= start] if start else []) + ([F.col(name) <= end] if end else [])


def _hours(name: str, hours: list[int] | None) -> list[Column]:
    if hours is None:
        return []
    if bad := [h for h in hours if not 0 <= h <= 23]:
        raise ValueError(f"not hours of a day: {bad}")
    return [F.col(name).isin(*hours)]


def read(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, hours: list[int] | None = None, types: list[str] | None = None, where: str | None = None, date: str = "dt", hour: str = "hr", type_column: str = "event_type") -> DataFrame:
    """A partitioned table, by dates (both included), hours, event types and any SQL condition."""
    df = spark.read.parquet(path)
    conditions = [*_dates(date, start, end), *_hours(hour, hours), *([F.col(type_column).isin(*types)] if types else []), *([F.expr(where)] if where else [])]
    for c in conditions:
        df = df.where(c)
    return df


def read_bronze(spark: SparkSession, path: str, **how) -> DataFrame:
    return read(spark, path, **how)


def read_silver(spark: SparkSession, path: str, **how) -> DataFrame:
    return read(spark, path, **{"date": "event_date", "hour": "event_hour", **how})


def read_partition(spark: SparkSession, path: str, date: str, hour: int | None = None) -> DataFrame:
    return read(spark, path, date, date, None if hour is None else [hour])


def after(date: str = "dt", hour: str = "hr", last_date: str | None = None, last_hour: int | None = None) -> Column:
    """Later than a partition: another hour of its date, or a later date."""
    if last_hour is None:
        return F.col(date) > last_date
    return (F.col(date) > last_date) | ((F.col(date) == last_date) & (F.col(hour) > last_hour))


def read_incremental(spark: SparkSession, path: str, last_date: str | None = None, last_hour: int | None = None, lookback_days: int = 1, date: str = "dt", hour: str = "hr", today: str | None = None) -> DataFrame:
    """What came after the last partition that was processed; without one, the last days."""
    df = spark.read.parquet(path)
    if last_date is None:
        day = F.current_date() if today is None else F.to_date(F.lit(today))
        return df.where(F.col(date) >= F.date_format(F.date_sub(day, lookback_days), "yyyy-MM-dd"))
    return df.where(after(date, hour, last_date, last_hour))


def partitions(spark: SparkSession, path: str, columns: tuple[str, ...] = ("dt", "hr")) -> DataFrame:
    """The partitions that there are, from folder names: no data file is opened."""
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = spark_path.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = path.rstrip("/") + "".join(f"/{c}=*" for c in columns)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []
    rows = [tuple(part.split("=", 1)[1] for part in str(s.getPath().toUri().getPath()).split("/")[-len(columns) :]) for s in found]
    return spark.createDataFrame(sorted(set(rows)), ", ".join(f"{c} STRING" for c in columns))


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, start: str | None = None, date: str = "event_date", format: str = "parquet") -> DataFrame:
    """A folder as a stream; new files come in batches of a bounded number."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)
    return df.where(F.col(date) >= start) if start else df


def lookup(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A lookup table, or None where there isn't one: enrichment then passes it over."""
    if not path:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def read_dead_letters(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, reason: str | None = None) -> DataFrame:
    return read(spark, path, start, end, where=None if reason is None else f"dlq_reason = '{reason.replace(chr(39), chr(39) * 2)}'", date="dlq_date")


def read_manifest(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.format(format).load(path)
