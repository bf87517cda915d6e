"""From Kafka, or any stream of its shape, to the bronze table: one projection, bad rows to dead letters, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from rillstone import schemas
from rillstone.functions import pii
from rillstone.operators import dedup, parse, rules
from rillstone.sinks import lake


def to_bronze(messages: DataFrame, salt: str, schema: StructType = schemas.RAW, event_types=schemas.BRONZE_EVENT_TYPES, scrub: dict[str, str] | None = None) -> DataFrame:
    """Parsed, normalised and validated rows, personal data scrubbed, with a status; works on streams and tables."""
    df = parse.with_ingestion(parse.parse_messages(messages, schema))
    df = parse.normalize_bronze(df)
    checks = {"json": F.col("parse_error").isNull(), **rules.bronze_rules(types=event_types)}
    df = df.withColumn("validation_status", rules.first_failure(checks))
    return pii.scrub(df, scrub or {"user_id": "hash", "session_id": "hash", "metadata.ip_address": "mask", "device.device_id": "hash"}, salt)


def write_bronze(bronze: DataFrame, path: str, dead_letters: str, checkpoint: str, every: str | None = "30 seconds", once_per: str | None = None) -> DataStreamWriter:
    """A stream to the bronze table by ingestion date and hour; invalid rows go to dead letters.

    Each batch is written by its number, so one that runs again after a failure
    replaces what it wrote: readers see it once. ``once_per`` drops repeats of an
    event_id within that delay.
    """
    if once_per:
        bronze = dedup.within_watermark(bronze.withColumn("event_time", F.timestamp_millis("timestamp_ms")), ["event_id"], "event_time", once_per).drop("event_time")

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number)).persist()
        try:
            good, bad = rules.split(batch, "validation_status = 'valid'")
            good.withColumns({"dt": F.col("ingestion_date"), "hr": F.col("ingestion_hour")}).drop("raw_value", "parse_error").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", lake.RECORDS_PER_FILE).partitionBy("dt", "hr", "batch").parquet(path)
            letters = rules.dead_letters(bad, F.col("validation_status")).withColumn("batch", F.lit(number))
            letters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dlq_date", "dlq_reason", "batch").parquet(dead_letters)
        finally:
            batch.unpersist()

    writer = bronze.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=lake.interval(every)) if every else writer.trigger(availableNow=True)


def json_lines(messages: DataFrame, path: str, checkpoint: str, schema: str = "user_id STRING, action STRING, timestamp BIGINT", every: str | None = None) -> DataStreamWriter:
    """The smallest job: JSON messages of a flat schema to JSON lines."""
    text = messages["value"].cast("string")
    rows = messages.select(F.from_json(text, schema).alias("message")).select("message.*")
    writer = rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=lake.interval(every)) if every else writer.trigger(availableNow=True)
