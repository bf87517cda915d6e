"""From raw messages to flat, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, IntegralType, MapType, NumericType, StringType, StructField, StructType, TimestampType

from rillstone import schemas
from rillstone.functions import text
from rillstone.schemas import ddl

CORRUPT = "_corrupt_record"

_DIGITS = r"\d+(?:_\d+)*"
#: Text that SQL reads as an integer: 12, 1_000, 56., .5, 1e3, 0x1F, 0b11; white space around it is passed over.
_INTEGER = rf"\A[ \t\n\x0B\f\r]*([+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?\d{{1,4}})?|0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*)[ \t\n\x0B\f\r]*\z"


def parse_messages(df: DataFrame, schema: StructType = schemas.RAW, value: str = "value") -> DataFrame:
    """Kafka rows as columns of their JSON, with where they came from; ``parse_error`` says what a bad one lacks.

    An empty or null value, and JSON that the schema can't read, keep the raw
    text in ``raw_value`` and null columns.
    """
    raw = F.col(value).cast("string")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = df.withColumns({"raw_value": raw, "_data": F.from_json(raw, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})})
    error = F.when(text.blank_to_null(F.col("raw_value")).isNull(), "empty").when(F.col(f"_data.{CORRUPT}").isNotNull(), "malformed JSON")
    origin = [F.col(c).alias(n) for c, n in (("topic", "source_topic"), ("partition", "source_partition"), ("offset", "source_offset"), ("timestamp", "kafka_timestamp")) if c in df.columns]
    fields = [F.col(f"_data.`{f.name}`").alias({"timestamp": "timestamp_ms"}.get(f.name, f.name)) for f in schema.fields]
    return parsed.select(*fields, *origin, "raw_value", error.alias("parse_error"))


def with_ingestion(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds when a row was taken in: a timestamp, its date and its hour."""
    at = F.current_timestamp() if at is None else at
    return df.withColumns({"ingestion_timestamp": at, "ingestion_date": F.date_format(at, "yyyy-MM-dd"), "ingestion_hour": F.hour(at)})


def as_struct(df: DataFrame, name: str, target: StructType) -> Column:
    """A column that is JSON text, a map or a struct, as a struct of the target's fields; what is missing is null."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return F.from_json(F.col(name), target)
    if isinstance(kind, MapType):
        return F.when(F.col(name).isNotNull(), F.struct(*[safe_cast(F.element_at(name, F.lit(f.name)), kind.valueType, f.dataType).alias(f.name) for f in target.fields]))
    if isinstance(kind, StructType):
        return F.when(F.col(name).isNotNull(), F.struct(*[(safe_cast(F.col(f"{name}.`{f.name}`"), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]))
    raise TypeError(f"{name} is {kind.simpleString()}")


def flatten(df: DataFrame, columns: dict[str, dict[str, str]]) -> DataFrame:
    """Fields of structs or maps as columns: {column: {field: new name}}; blank text becomes null, the nested columns go."""
    added = {}
    for name, fields in columns.items():
        kind = df.schema[name].dataType
        for f, new in fields.items():
            value = F.element_at(name, F.lit(f)) if isinstance(kind, MapType) else F.col(f"{name}.`{f}`")
            is_text = isinstance(kind.valueType if isinstance(kind, MapType) else kind[f].dataType, StringType)
            added[new] = text.blank_to_null(value) if is_text else value
    return df.withColumns(added).drop(*[c for c in columns if c not in added])


def map_columns(df: DataFrame, name: str, keys: list[str], prefix: str = "") -> DataFrame:
    """One column for each key of a map; the map goes."""
    return df.withColumns({f"{prefix}{k}": F.element_at(name, F.lit(k)) for k in keys}).drop(name)


def _integer(c: Column, target: DataType) -> Column:
    """Text as an integer, as SQL reads it: fractions are rounded, halves away from zero; null beyond the type's range."""
    plain = F.replace(F.regexp_extract(c, _INTEGER, 1), F.lit("_"))
    base = lambda prefix, digits, base, most: F.conv(F.nullif(F.regexp_extract(plain, rf"\A0[{prefix}]0*([{digits}]{{1,{most}}})\z", 1), F.lit("")), base, 10)
    number = F.when(plain.rlike(r"\A0[xX]"), base("xX", "0-9a-fA-F", 16, 16)).when(plain.rlike(r"\A0[bB]"), base("bB", "01", 2, 64)).otherwise(plain)
    return number.try_cast("decimal(38,0)").try_cast(target)


def safe_cast(c: Column, source: DataType, target: DataType) -> Column:
    """A cast that gives null for what can't be read. Digits read as epoch milliseconds where a time is wanted; NaN becomes null; fields of structs are matched by name."""
    if source == target:
        return c
    if isinstance(source, StructType) and isinstance(target, StructType):  # by name: fields may stand in another order, or be missing
        fields = [(safe_cast(c.getField(f.name), source[f.name].dataType, f.dataType) if f.name in source.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(target, (TimestampType, DateType)):
        if isinstance(source, NumericType):
            t = F.timestamp_millis(c.cast("long"))
        elif isinstance(source, StringType):
            t = F.when(F.trim(c).rlike(r"^\d{11,}$"), F.timestamp_millis(F.trim(c).try_cast("long"))).otherwise(F.trim(c).try_cast("timestamp"))
        else:
            t = c.try_cast("timestamp")
        return t.cast(target)
    if isinstance(source, (StructType, ArrayType, MapType)) and isinstance(target, StringType):
        return F.to_json(c)
    if isinstance(source, StringType):
        return _integer(c, target) if isinstance(target, IntegralType) else F.trim(c).try_cast(target)
    if source.simpleString() in ("double", "float") and isinstance(target, NumericType):
        return F.when(~F.isnan(c), c).try_cast(target)
    return c.try_cast(target)


def cast_columns(df: DataFrame, types: dict[str, str | DataType]) -> DataFrame:
    """Columns cast safely; names that df lacks are passed over."""
    made = {}
    for name, kind in types.items():
        if name in df.columns:
            target = ddl(f"x {kind}")["x"].dataType if isinstance(kind, str) else kind
            made[name] = safe_cast(F.col(f"`{name}`"), df.schema[name].dataType, target)
    return df.withColumns(made) if made else df


def conform(df: DataFrame, schema: StructType, drop_extra: bool = True) -> DataFrame:
    """df in the schema's shape: its columns in its order, cast safely; missing ones are nulls of the right type."""
    fields = []
    for f in schema.fields:
        value = safe_cast(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        fields.append(value.alias(f.name))
    extra = [] if drop_extra else [F.col(f"`{c}`") for c in df.columns if c not in schema.names]
    return df.select(*fields, *extra)


def missing_columns(df: DataFrame, required: list[str] | tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def normalize_bronze(df: DataFrame) -> DataFrame:
    """Ids as text, types in lower case, white space collapsed, blanks null, ISO time rebuilt from milliseconds where it isn't one; all in one projection."""
    c = F.col
    made = {
        "event_id": text.collapse(c("event_id").cast("string")),
        "event_type": text.collapse(F.lower(c("event_type"))),
        "timestamp_ms": c("timestamp_ms").try_cast("long"),
        "user_id": text.blank_to_null(text.collapse(c("user_id").cast("string"))),
        "session_id": text.blank_to_null(c("session_id").cast("string")),
    }
    ms = c("timestamp_ms").try_cast("long")
    iso = text.blank_to_null(c("timestamp_iso")) if "timestamp_iso" in df.columns else F.lit(None).cast("string")
    made["timestamp_iso"] = F.when(text.is_iso_time(iso), iso).otherwise(text.iso_time(ms))
    return df.withColumns({k: v for k, v in made.items() if k in df.columns or k == "timestamp_iso"})


def normalize_silver(df: DataFrame) -> DataFrame:
    """All text trimmed; case and synonyms made standard."""
    made = {}
    for f in df.schema.fields:
        if not isinstance(f.dataType, StringType):
            continue
        value = F.trim(F.col(f"`{f.name}`"))
        if f.name in schemas.LOWERCASE:
            value = F.lower(value)
        if f.name in schemas.UPPERCASE:
            value = F.upper(value)
        if f.name in schemas.ENUMS:
            value = text.replace_values(value, schemas.ENUMS[f.name])
        made[f.name] = value
    return df.withColumns(made) if made else df


def fill_defaults(df: DataFrame, defaults: dict[str, object] = schemas.DEFAULTS) -> DataFrame:
    made = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in defaults.items() if c in df.columns}
    return df.withColumns(made) if made else df


def to_silver(bronze: DataFrame) -> DataFrame:
    """Parsed raw events, flat: event time, action, video and device columns. Placeholders for what enrichment adds aren't made."""
    flat = flatten(
        bronze,
        {
            "device": {"type": "device_type", "os": "os", "browser": "browser"},
            "content": {"content_id": "video_id", "title": "video_title", "content_type": "video_category", "duration_seconds": "video_duration_seconds"},
            "context": {"position": "play_position_seconds", "page": "target_type", "previous_content": "target_id"},
            "metadata": {"ip_address": "ip_address", "country": "country", "timezone": "timezone"},
        },
    )
    time = F.timestamp_millis("timestamp_ms")
    return flat.withColumns(
        {
            "event_timestamp": time,
            "event_date": F.to_date(time),
            "event_hour": F.hour(time),
            "action": text.action(F.col("event_type")),
            "video_category": text.category(F.col("video_category")),
            "play_position_seconds": F.col("play_position_seconds").cast("long"),
        }
    ).drop("raw_data", "timestamp_ms", "timestamp_iso", "raw_value", "parse_error")
