"""Kafka as a source and sink. The connector's jar must be on the class path; the options are made, and tested, without it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.session import setting


def options(servers: str, topics: str | list[str], starting: str | dict = "latest", per_trigger: int | None = None, fail_on_loss: bool = False, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Reader options; starting is latest, earliest, or {topic: {partition: offset}}."""
    names = [topics] if isinstance(topics, str) else list(topics)
    if not names:
        raise ValueError("no topic")
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(names), "startingOffsets": offsets_json(starting) if isinstance(starting, dict) else starting, "failOnDataLoss": str(fail_on_loss).lower()}
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out | (extra or {})


def options_from(config: dict, *topic_keys: str) -> dict[str, str]:
    """Options from configuration: topics by their keys, offsets and rates of the consumer."""
    topics = [setting(config, f"kafka.topics.{k}") for k in topic_keys]
    consumer = setting(config, "kafka.consumer", {"": None})
    names = [t["name"] if isinstance(t, dict) else t for t in topics]
    return options(setting(config, "kafka.bootstrap_servers"), names, consumer.get("starting_offsets", "latest"), consumer.get("max_offsets_per_trigger"), consumer.get("fail_on_data_loss", False))


def read_stream(spark: SparkSession, how: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**how).load()


def read_batch(spark: SparkSession, how: dict[str, str]) -> DataFrame:
    return spark.read.format("kafka").options(**{k: v for k, v in how.items() if k != "maxOffsetsPerTrigger"}).load()


def as_messages(df: DataFrame, key: str | None = None, topic: str | None = None) -> DataFrame:
    """Rows as JSON messages, ready for the Kafka sink."""
    columns = [F.to_json(F.struct("*")).alias("value")]
    if key:
        columns.insert(0, F.col(key).cast("string").alias("key"))
    if topic:
        columns.append(F.lit(topic).alias("topic"))
    return df.select(*columns)


def write_batch(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    as_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def offsets_json(offsets: dict[str, dict[int | str, int]]) -> str:
    return json.dumps({t: {str(p): o for p, o in sorted(parts.items(), key=lambda x: int(x[0]))} for t, parts in offsets.items()})


def check_range(start: int, end: int) -> bool:
    """Whether offsets make a range: not negative and in order."""
    return 0 <= start <= end
