"""The layers' jobs, put together from operators; each reads its input once for each table it writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.functions import pii
from rillstone.operators import dedup, features, joins, parse, quality, rules
from rillstone.sinks import lake as sink
from rillstone.sources import lake


@dataclass
class SilverPlan:
    """How bronze becomes silver. Lookups are joined before anything is masked."""

    lookups: dict[str, DataFrame | None] = field(default_factory=dict)
    mask: dict[str, str] = field(default_factory=lambda: {"ip_address": "anonymize"})
    salt: str = ""
    contract: schemas.Contract = schemas.SILVER_CONTRACT
    strategy: str | None = "key"

    def transform(self, bronze: DataFrame) -> DataFrame:
        """Validated silver rows, still with the invalid ones. Without ``strategy`` it runs on streams too."""
        df = parse.to_silver(bronze)
        df = parse.fill_defaults(parse.normalize_silver(df))
        if self.strategy:
            df = dedup.remove_duplicates(df, self.strategy)
        df = joins.enrich_all(df, self.lookups)
        df = pii.scrub(df, self.mask, self.salt, mark="pii_masked")
        return rules.check_contract(df, self.contract)

    def shape(self, df: DataFrame) -> DataFrame:
        """Rows in the contract's schema."""
        meta = F.struct(
            F.col("ingestion_date").cast("string").alias("bronze_ingestion_date"), F.col("ingestion_hour").cast("int").alias("bronze_ingestion_hour"), F.current_timestamp().alias("silver_processing_timestamp"), F.current_date().alias("silver_processing_date"),
            F.col("data_quality_score"), F.array(*[F.lit(k) for k, v in self.lookups.items() if v is not None]).cast("array<string>").alias("enrichment_applied"), F.array(*map(F.lit, ("flatten", "normalize", "defaults"))).alias("transformation_applied"), F.col("validation_status"), F.col("validation_errors"),
        )
        return parse.conform(df.withColumn("silver_processing_metadata", meta), self.contract.schema)

    def run(self, bronze: DataFrame, path: str, dead_letters: str) -> None:
        checked = self.transform(bronze).persist()
        try:
            good, bad = rules.split(checked, "validation_status <> 'invalid'")
            sink.write_silver(self.shape(good), path)
            sink.write_dead_letters(rules.dead_letters(bad, F.array_join("validation_errors", ",")), dead_letters)
        finally:
            checked.unpersist()


def run_incremental(spark: SparkSession, plan: SilverPlan, bronze: str, path: str, dead_letters: str, last_date: str | None, last_hour: int | None, lookback_days: int = 1) -> None:
    """Only what came after the last partition."""
    plan.run(lake.read_incremental(spark, bronze, last_date, last_hour, lookback_days), path, dead_letters)


FEATURES = {"user": features.user_features, "item": features.item_features, "session": features.session_features, "temporal": features.temporal_features}


def gold(silver: DataFrame, kinds: tuple[str, ...] = tuple(FEATURES), ev: features.Events = features.Events(), as_of: Column | None = None) -> dict[str, DataFrame]:
    """The feature tables by kind; user features carry the recency of the temporal ones if both are made."""
    out = {k: FEATURES[k](silver, ev, as_of) for k in kinds}
    if {"user", "temporal"} <= out.keys():
        recency = out["temporal"].select(ev.entity, "days_since_last_event", "events_per_day")
        out["user"] = out["user"].join(recency, ev.entity, "left")
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def run_gold(silver: DataFrame, path: str, date: str | None = None, as_of: Column | None = None, threshold: float = 0.8, mode: str = "append", kinds: tuple[str, ...] = tuple(FEATURES), ev: features.Events = features.Events()) -> dict[str, DataFrame]:
    """Writes the feature tables, and gives a quality report of each."""
    reports = {}
    for kind, df in gold(silver, kinds, ev, as_of).items():
        sink.write_features(df, f"{path}/{kind}", kind, date, mode)
        stored = silver.sparkSession.read.parquet(f"{path}/{kind}")
        reports[kind] = quality.quality_report(stored, numeric_columns(df), threshold=threshold)
    return reports


def backfill(events: DataFrame, points: DataFrame, ev: features.Events = features.Events(), point_time: str = "as_of", entities: DataFrame | None = None) -> DataFrame:
    """User features at many points in time; all entities, or those of a table."""
    if entities is not None:
        points, events = joins.known(points, entities, [ev.entity]), joins.known(events, entities, [ev.entity])
    return features.at_times(events, points, ev, point_time)


def backfill_incremental(events: DataFrame, path: str, until: str, start: str | None = None, ev: features.Events = features.Events()) -> int:
    """Appends user features as of each day's beginning, from the day after the last one stored (or from ``start``, else the first event's day) until ``until``; gives the number of days.

    Days are stored in their order of partitions, so a run that broke off goes on after the last whole day.
    """
    spark = events.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    last = spark.read.parquet(path).agg(F.max("as_of").cast("date")).first()[0] if stored else None
    if last is None and start is None:
        start = events.agg(F.min(ev.time).cast("date").cast("string")).first()[0]
    first = F.date_add(F.lit(last).cast("date"), 1) if last is not None else F.lit(start).cast("date")
    days = spark.range(1).select(F.explode(F.when(first <= F.lit(until).cast("date"), F.sequence(first, F.lit(until).cast("date"))).otherwise(F.array().cast("array<date>"))).alias("as_of")).select(F.col("as_of").cast("timestamp_ntz"))
    count = days.count()
    if count:
        points = events.select(ev.entity).where(F.col(ev.entity).isNotNull()).distinct().crossJoin(F.broadcast(days))  # a row a day
        sink.write(backfill(events, points, ev).withColumn("as_of_date", F.to_date("as_of")), path, ("as_of_date",))
    return count


def training_set(labelled: DataFrame, feature_table: DataFrame, on: list[str], label_time: str, feature_time: str, columns: list[str], tolerance: Column | None = None) -> DataFrame:
    """Labelled events with the features that were known at their time."""
    return joins.as_of(labelled, feature_table, on, label_time, feature_time, columns, tolerance)


class FeatureStore:
    """An offline table of feature rows over time, and the online view of the latest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, df: DataFrame, time: str = "event_timestamp") -> None:
        sink.write(df.withColumn("feature_date", F.to_date(time)), f"{self.path}/{name}", ("feature_date",))

    def offline(self, name: str, entities: DataFrame, on: list[str], columns: list[str], time: str = "event_timestamp", tolerance: Column | None = None) -> DataFrame:
        return joins.as_of(entities, self.spark.read.parquet(f"{self.path}/{name}"), on, time, time, columns, tolerance, prefix=f"{name}_")

    def materialize(self, name: str, on: list[str], start: str, end: str, time: str = "event_timestamp") -> None:
        """The latest rows within dates become the online table: a new version beside the one that is served, which readers take once it is whole."""
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("feature_date").between(start, end))
        sink.write(joins.latest(rows, on, time), f"{self.path}/{name}__online/version={len(self._versions(name)):08d}")

    def _versions(self, name: str) -> list[str]:
        """The versions that are whole, oldest first; Spark marks a whole table with _SUCCESS."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}__online/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(str(s.getPath().getParent()) for s in found)

    def online(self, name: str, keys: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
        return keys.join(self.spark.read.parquet(self._versions(name)[-1]).select(*on, *columns), on, "left")
