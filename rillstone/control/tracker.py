"""Which partitions have been processed: an append-only table, of which the latest entry of a partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.schemas import ddl

SCHEMA = ddl("date STRING, hour INT, status STRING, processed_at TIMESTAMP, metadata STRING")


class PartitionTracker:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def mark(self, date: str, hour: int | None = None, status: str = "completed", metadata: str | None = None) -> None:
        row = self.spark.createDataFrame([(date, hour, status, metadata)], "date STRING, hour INT, status STRING, metadata STRING")
        row.withColumn("processed_at", F.current_timestamp()).select(*SCHEMA.names).write.mode("append").parquet(self.path)

    def processed(self, start: str | None = None, end: str | None = None, status: str | None = None) -> DataFrame:
        df = latest(self._read())
        for c in ([F.col("date") >= start] if start else []) + ([F.col("date") <= end] if end else []) + ([F.col("status") == status] if status else []):
            df = df.where(c)
        return df

    def unprocessed(self, available: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """Of the available partitions (date, hour), those that aren't completed."""
        for c in ([F.col("date") >= start] if start else []) + ([F.col("date") <= end] if end else []):
            available = available.where(c)
        return remaining(available, self.processed(status="completed"))

    def last(self) -> tuple[str, int | None] | None:
        row = self.processed(status="completed").orderBy(F.desc("date"), F.desc_nulls_last("hour")).first()
        return (row["date"], row["hour"]) if row else None


def latest(entries: DataFrame) -> DataFrame:
    return entries.groupBy("date", "hour").agg(F.max(F.struct("processed_at", "status", "metadata")).alias("e")).select("date", "hour", "e.status", "e.processed_at", "e.metadata")


def remaining(available: DataFrame, done: DataFrame) -> DataFrame:
    """Null-safe on the hour: a partition may be a whole day."""
    return available.alias("a").join(done.alias("d"), (F.col("a.date") == F.col("d.date")) & F.col("a.hour").eqNullSafe(F.col("d.hour")), "left_anti")
