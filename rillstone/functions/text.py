"""Column functions for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


ISO_TIME = "yyyy-MM-dd" + "'T'" + "HH:mm:ss.SSS" + "'Z'"


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Trimmed, with every run of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def replace_values(c: Column, values: dict[str, str]) -> Column:
    """A synonym's standard value; other values stay."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def action(event_type: Column) -> Column:
    """What an event does: its type in lower case without ``video_`` before and the phase after it, so play_start and play_pause are both ``play``."""
    plain = F.regexp_replace(F.lower(event_type), "^video_", "")
    return F.regexp_replace(plain, "_(start|end|pause|resume|stop)$", "")


def category(content_type: Column) -> Column:
    """Words with capitals; null for a blank one."""
    return F.initcap(blank_to_null(content_type))


def iso_time(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 in the session's time zone, to the millisecond."""
    return F.date_format(F.timestamp_millis(ms), ISO_TIME)


def is_iso_time(c: Column) -> Column:
    return c.rlike("^[0-9]{4}(-[0-9]{2}){2}T")
