"""Schemas and contracts of the three layers, as data.

Contracts feed the rule operators (``rillstone.operators.rules``); nothing here
touches Spark's session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_SCALARS = {"string": StringType, "bigint": LongType, "long": LongType, "int": IntegerType, "double": DoubleType, "float": FloatType, "boolean": BooleanType, "date": DateType, "timestamp": TimestampType, "binary": BinaryType}


def ddl(text: str) -> StructType:
    """A schema from DDL, read without a session: scalars, STRUCT, MAP, ARRAY and NOT NULL."""
    tokens = re.findall(r"`[^`]*`|\w+|[<>,:]", text)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def kind() -> DataType:
        name = take().lower()
        if name not in ("struct", "map", "array"):
            if name not in _SCALARS:
                raise ValueError(f"no such type: {name}")
            return _SCALARS[name]()
        take()
        if name == "struct":
            out: DataType = fields(">")
        elif name == "array":
            out = ArrayType(kind())
        else:
            key = kind()
            take()
            out = MapType(key, kind())
        take()
        return out

    def fields(end: str | None) -> StructType:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] != end:
            name = take().strip("`")
            if tokens[at] == ":":
                at += 1
            typed = kind()
            nullable = tokens[at : at + 1] == [] or tokens[at].lower() != "not"
            at += 0 if nullable else 2
            out.append(StructField(name, typed, nullable))
            if at < len(tokens) and tokens[at] == ",":
                at += 1
        return StructType(out)

    return fields(None)


def typed(kind: str, names: str) -> str:
    """DDL of several columns of a type."""
    return ", ".join(f"{n} {kind}" for n in names.split())


def struct(name: str, *parts: str) -> str:
    return f"{name} STRUCT<{', '.join(parts)}>"


_IDS = typed("STRING", "user_id session_id event_type event_id")

#: What a producer sends, as JSON.
RAW = ddl(
    ", ".join(
        [
            _IDS,
            typed("BIGINT", "timestamp"),
            typed("STRING", "timestamp_iso"),
            struct("device", typed("STRING", "type os browser device_id screen_resolution"), typed("INT", "battery_level")),
            struct("content", typed("STRING", "content_id title content_type"), typed("INT", "season episode"), typed("BIGINT", "duration_seconds"), typed("STRING", "genre"), typed("INT", "release_year")),
            struct("context", typed("STRING", "page referrer"), typed("INT", "position"), typed("BOOLEAN", "autoplay"), typed("STRING", "previous_content")),
            struct("metadata", typed("STRING", "ip_address user_agent country timezone language app_version")),
            struct("raw_data", typed("STRING", "http_method request_id"), typed("BIGINT", "server_timestamp")),
        ]
    )
)

KAFKA = ddl(", ".join([typed("BINARY", "key value"), typed("STRING", "topic"), typed("INT", "partition"), typed("BIGINT", "offset"), typed("TIMESTAMP", "timestamp"), typed("INT", "timestampType")]))

BRONZE = ddl(
    ", ".join(
        [
            _IDS,
            typed("BIGINT", "timestamp_ms"),
            typed("STRING", "timestamp_iso"),
            struct("event_data", typed("STRING", "action target_type target_id"), "metadata MAP<STRING, STRING>"),
            struct("video_data", typed("STRING", "video_id title quality"), typed("BIGINT", "play_position_seconds duration_seconds")),
            struct("device_info", typed("STRING", "device_type os browser ip_address")),
            struct("processing_metadata", typed("BIGINT", "ingestion_timestamp_ms source_offset"), typed("INT", "ingestion_hour source_partition"), typed("STRING", "ingestion_date source_topic validation_status deduplication_key"), typed("BOOLEAN", "pii_scrubbed")),
        ]
    )
)

SILVER = ddl(
    ", ".join(
        [
            typed("STRING NOT NULL", "event_id event_type"),
            typed("TIMESTAMP NOT NULL", "event_timestamp"),
            typed("DATE NOT NULL", "event_date"),
            typed("INT NOT NULL", "event_hour"),
            typed("STRING", "user_id session_id user_segment action target_type target_id video_id video_title video_category video_quality"),
            typed("BIGINT", "play_position_seconds video_duration_seconds"),
            typed("STRING", "os browser device_type ip_address timezone region country"),
            struct("silver_processing_metadata", typed("STRING", "bronze_ingestion_date validation_status"), typed("INT", "bronze_ingestion_hour"), typed("TIMESTAMP", "silver_processing_timestamp"), typed("DATE", "silver_processing_date"), typed("DOUBLE", "data_quality_score"), typed("ARRAY<STRING>", "enrichment_applied transformation_applied validation_errors")),
        ]
    )
)

LOOKUPS = {name: ddl(typed("STRING", columns)) for name, columns in (("user_segments", "user_id user_segment"), ("video_catalog", "video_id video_category"), ("geo_ip", "ip_address country region timezone"))}

LOWERCASE = frozenset("action browser device_type event_type os target_type user_segment video_category video_quality".split())
UPPERCASE = frozenset(["country"])

#: Synonyms, after lower-casing.
ENUMS: dict[str, dict[str, str]] = {
    "device_type": dict.fromkeys(("phone", "smartphone"), "mobile") | {"ipad": "tablet"} | dict.fromkeys(("laptop", "computer"), "desktop") | dict.fromkeys(("smart-tv", "smart tv"), "smart_tv"),
    "os": dict.fromkeys(("darwin", "mac"), "macos") | {"iphone os": "ios"},
    "video_quality": {q: q + "p" for q in ("240", "360", "480", "720", "1080", "1440", "2160")} | dict.fromkeys(("uhd", "4k"), "4K"),
}

DEFAULTS = dict.fromkeys("os device_type video_quality".split(), "unknown")
REQUIRED_SILVER = tuple(f.name for f in SILVER.fields if not f.nullable)
#: What events of some types need besides an id and a time.
REQUIRED_BY_TYPE = {kind: ("event_id", "event_timestamp", *more.split()) for kind, more in (("purchase", "target_type target_id"), ("post_like", "target_id"), ("video_play_complete", "play_position_seconds video_id"), ("video_play_start", "video_id"))}
BRONZE_EVENT_TYPES = tuple("add_to_cart page_view post_like video_play_pause video_play_start video_play_stop".split())
PII_FIELDS = tuple("device_id email ip_address phone_number session_id user_id".split())


@dataclass(frozen=True)
class Contract:
    """What a table must look like: its schema, the columns that may not be null, and rules as SQL conditions by name."""

    schema: StructType
    required: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)


SILVER_CONTRACT = Contract(
    SILVER,
    REQUIRED_SILVER,
    {
        "play_position_within_duration": "play_position_seconds IS NULL OR video_duration_seconds IS NULL OR play_position_seconds <= video_duration_seconds",
        "event_not_in_the_future": "event_timestamp <= current_timestamp()",
        "video_events_have_a_video": "event_type NOT LIKE 'video\\_%' OR video_id IS NOT NULL",
    },
)


def paths(schema: DataType, prefix: str = "") -> list[str]:
    """All dotted field names, those of structs within arrays and map values too."""
    if isinstance(schema, ArrayType):
        return paths(schema.elementType, prefix)
    if isinstance(schema, MapType):
        return paths(schema.valueType, prefix)
    if not isinstance(schema, StructType):
        return []
    out = []
    for f in schema.fields:
        out += [prefix + f.name, *paths(f.dataType, f"{prefix}{f.name}.")]
    return out


_AVRO = {"string": "STRING", "long": "BIGINT", "int": "INT", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN", "bytes": "BINARY"}


def _avro_type(kind) -> tuple[str, bool]:
    if isinstance(kind, list):
        inner = [k for k in kind if k != "null"]
        if len(inner) != 1:
            raise ValueError(f"a union of several types: {kind}")
        return _avro_type(inner[0])[0], True
    if isinstance(kind, str):
        return _AVRO[kind], False
    if kind["type"] == "record":
        return "STRUCT<" + ", ".join(f"`{f['name']}`: {_avro_type(f['type'])[0]}" for f in kind["fields"]) + ">", False
    if kind["type"] == "array":
        return f"ARRAY<{_avro_type(kind['items'])[0]}>", False
    if kind["type"] == "map":
        return f"MAP<STRING, {_avro_type(kind['values'])[0]}>", False
    return _avro_type(kind["type"])


def from_avro(record: dict) -> StructType:
    """The schema of an Avro record, given as parsed JSON; unions with null are nullable."""
    parts = []
    for f in record["fields"]:
        kind, nullable = _avro_type(f["type"])
        parts.append(f"`{f['name']}` {kind}" + ("" if nullable else " NOT NULL"))
    return ddl(", ".join(parts))
