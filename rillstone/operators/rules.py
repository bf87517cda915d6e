"""Validation: rules are named boolean columns, evaluated in one pass and never silently skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone import schemas

Rules = dict[str, Column | str]


def condition(rule: Column | str) -> Column:
    """The rule as a column; what it can't decide (null) counts as failed."""
    return F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def required(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names], F.lit(True))


def between(name: str, low=None, high=None) -> Column:
    """Within the bounds; null passes."""
    c = F.col(name)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return c.isNull() | ok


def matches(name: str, pattern: str) -> Column:
    """Wholly of the pattern; null passes."""
    c = F.col(name)
    return c.isNull() | c.rlike(f"^(?:{pattern})$")


def one_of(name: str, values) -> Column:
    c = F.col(name)
    return c.isNull() | c.isin(*values)


def required_by_type(by: dict[str, tuple[str, ...]] = schemas.REQUIRED_BY_TYPE, type_column: str = "event_type") -> Column:
    """What an event of its type must have; other types need nothing."""
    out = None
    for kind, names in by.items():
        out = (F if out is None else out).when(F.col(type_column) == kind, required(*names))
    return F.lit(True) if out is None else out.otherwise(True)


def bronze_rules(now: Column | None = None, types=schemas.BRONZE_EVENT_TYPES, id_length: int = 32) -> Rules:
    now_ms = F.unix_millis(F.current_timestamp() if now is None else now)
    return {
        "required": required("event_id", "event_type", "timestamp_ms"),
        "range": F.col("timestamp_ms") > 0,
        "format": (F.length("event_id") >= id_length) & (F.trim("event_type") != ""),
        "iso": F.col("timestamp_iso").isNull() | (F.contains(F.col("timestamp_iso"), F.lit("T")) & (F.length("timestamp_iso") >= 19)),
        "type": F.col("event_type").isin(*types),
        "future": F.col("timestamp_ms").isNull() | (F.col("timestamp_ms") <= now_ms + 3_600_000),
    }


def validate(df: DataFrame, rules: Rules, warn: float | None = None, accept: float = 1.0) -> DataFrame:
    """Adds ``validation_errors`` (names of failed rules, in order), ``data_quality_score`` (share of rules passed) and ``validation_status``.

    The status is ``valid`` from ``accept`` on, ``warning`` from ``warn`` on, else ``invalid``.
    """
    passed = {name: condition(rule) for name, rule in rules.items()}
    errors = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    score = F.lit(1.0) - F.size(errors) / F.lit(float(max(1, len(rules))))
    out = df.withColumn("validation_errors", errors).withColumn("data_quality_score", F.round(score, 6))
    status = F.when(F.col("data_quality_score") >= accept, "valid")
    if warn is not None:
        status = status.when(F.col("data_quality_score") >= warn, "warning")
    return out.withColumn("validation_status", status.otherwise("invalid"))


def first_failure(rules: Rules) -> Column:
    """``valid``, or ``invalid_`` and the name of the first rule that fails."""
    out = None
    for name, rule in rules.items():
        out = (F if out is None else out).when(~condition(rule), F.lit(f"invalid_{name}"))
    return F.lit("valid") if out is None else out.otherwise("valid")


def split(df: DataFrame, ok: Column | str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and the others; every row is in exactly one."""
    ok = condition(ok)
    return df.where(ok), df.where(~ok)


def validation_stats(df: DataFrame) -> DataFrame:
    """By status: rows, their share of all, and their mean score."""
    by = df.groupBy("validation_status").agg(F.count("*").alias("rows"), F.sum("data_quality_score").alias("scores"))
    total = by.agg(F.sum("rows").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("validation_status", "rows", F.round(F.col("rows") / F.col("total"), 6).alias("share"), F.round(F.col("scores") / F.col("rows"), 6).alias("mean_score"))  # total is one row


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, nulls, rows): one pass over the table."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)]))
    return one.select(pairs.alias("x"), "rows").select("x.column_name", "x.nulls", "rows")


def require_no_nulls(df: DataFrame, columns) -> DataFrame:
    """df itself; raises if one of the columns has nulls (one pass)."""
    bad = {r["column_name"]: r["nulls"] for r in null_counts(df, list(columns)).collect() if r["nulls"]}
    if bad:
        raise ValueError(f"nulls in required columns: {bad}")
    return df


def check_contract(df: DataFrame, contract: schemas.Contract, warn: float = 0.5, accept: float = 0.7) -> DataFrame:
    """df validated by the contract's required columns and rules; columns that are missing altogether raise."""
    gone = [c for c in contract.required if c not in df.columns and c != "silver_processing_metadata"]
    if gone:
        raise ValueError(f"the contract's columns are missing: {gone}")
    present = [c for c in contract.required if c in df.columns]
    return validate(df, {"required": required(*present), **contract.rules}, warn, accept)


def dead_letters(df: DataFrame, reason: Column | str, at: Column | None = None, kind: str | None = None) -> DataFrame:
    """Rows as dead letters: the row as JSON, why and when, and the columns to partition by."""
    at = F.current_timestamp() if at is None else at
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(F.to_json(F.struct("*")).alias("payload"), reason.alias("dlq_reason"), F.lit(kind).cast("string").alias("error_type"), at.alias("dlq_timestamp"), F.date_format(at, "yyyy-MM-dd").alias("dlq_date"), F.hour(at).alias("dlq_hour"))
