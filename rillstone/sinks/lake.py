"""Writers of the layers' tables: partitioned Parquet, in files of bounded size, without counting rows first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MODES = tuple("append error ignore overwrite".split())
RECORDS_PER_FILE = 1_000_000
FEATURES_PER_FILE = 500_000


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "append", records_per_file: int = RECORDS_PER_FILE, balance: bool = True) -> None:
    """Parquet, a folder for each value of ``by``. ``balance`` lets adaptive execution even out the files, splitting a partition that is too large."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if gone := [c for c in by if c not in df.columns]:
        raise ValueError(f"no such columns to partition by: {gone}")
    out = df.hint("rebalance", *by) if balance and by else df
    out.write.mode(mode).option("maxRecordsPerFile", records_per_file).option("compression", "snappy").partitionBy(*by).parquet(path)


def with_partitions(df: DataFrame, time: str | Column, date: str = "event_date", hour: str | None = "event_hour") -> DataFrame:
    """Adds the columns to partition by from a row's own time, where they are missing."""
    t = F.col(time) if isinstance(time, str) else time
    made = {} if date in df.columns else {date: F.date_format(t, "yyyy-MM-dd")}
    if hour and hour not in df.columns:
        made[hour] = F.hour(t)
    return df.withColumns(made) if made else df


def write_bronze(df: DataFrame, path: str, mode: str = "append", ingested: str = "ingestion_timestamp") -> None:
    write(with_partitions(df, ingested, "dt", "hr"), path, ("dt", "hr"), mode)


def write_silver(df: DataFrame, path: str, mode: str = "append", time: str = "event_timestamp") -> None:
    write(with_partitions(df, time, hour=None), path, ("event_date", "event_type"), mode)


def write_partition(df: DataFrame, path: str, date: str, event_type: str | None = None, column: str = "event_date") -> None:
    """Replaces one date, or one type of it, and nothing else."""
    part = df.where(F.col(column) == date)
    if event_type is not None:
        part = part.where(F.col("event_type") == event_type)
    by = (column, "event_type") if event_type is not None or "event_type" in df.columns else (column,)
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_features(df: DataFrame, path: str, feature_type: str, date: str | None = None, mode: str = "append") -> None:
    """A feature table, by date and kind, stamped with when it was made."""
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else F.lit(date)
    made = df.withColumns({"feature_date": day, "feature_type": F.lit(feature_type), "processing_timestamp": F.current_timestamp()})
    write(made, path, ("feature_date", "feature_type"), mode, FEATURES_PER_FILE)


def write_all_features(tables: dict[str, DataFrame], path: str, date: str | None = None, mode: str = "append") -> None:
    for kind, df in tables.items():
        write_features(df, f"{path}/{kind}", kind, date, mode)


def partition_info(spark: SparkSession, path: str, by: tuple[str, ...] = ("feature_date", "feature_type")) -> DataFrame:
    return spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("rows"))


def delete_partitions(spark: SparkSession, path: str, by: tuple[str, ...], where: str) -> int:
    """Drops the folders of the partitions that the condition, on partition columns, holds for; gives their number."""
    parts = spark.read.parquet(path).select(*by).where(where).distinct().collect()
    jvm = spark._jvm
    for p in parts:
        at = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "".join(f"/{c}={p[c]}" for c in by))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(parts)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, file_size, rows) of a table's real files."""
    df = spark.read.parquet(path)
    return df.select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size").groupBy("file_path", "file_name", "file_size").agg(F.count("*").alias("rows"))


def write_manifest(spark: SparkSession, path: str, to: str, format: str = "json") -> None:
    listed = manifest(spark, path)
    if format == "text":
        listed = listed.select("file_path")
    listed.coalesce(1).write.mode("overwrite").format(format).save(to)


def write_dead_letters(letters: DataFrame, path: str) -> None:
    write(letters, path, ("dlq_date", "dlq_reason"), "append")


def dead_letter_stats(letters: DataFrame) -> DataFrame:
    return letters.groupBy("dlq_reason").agg(F.count("*").alias("rows"))


def stream(df: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = (), every: str | None = "30 seconds") -> DataStreamWriter:
    """An append stream to Parquet; without an interval it takes what there is and ends. Checkpoint and file log make it exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by)
    return writer.trigger(processingTime=interval(every)) if every else writer.trigger(availableNow=True)


def interval(text: str) -> str:
    """30s, 5m, 1h or 500ms as Spark's words; others as they are."""
    units = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours"}
    number = text.rstrip("msh")
    return f"{number} {units[text[len(number):]]}" if number.isdigit() and text[len(number) :] in units else text
