"""What the catalogue's queries share: the fixture tables as events, rounding that two engines agree on, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.features import Events, sessionize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The fixtures' events: a view starts and a purchase completes; these and clicks are of a video.
EV = Events(video="{type} IN ('view', 'click', 'purchase')", start="{type} = 'view'", complete="{type} = 'purchase'")
AS_OF = "2024-01-31"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF + " 23:59:59").cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the silver layer's names."""
    df = table(spark, sf_dir, "events")
    k = F.from_json("props", "k INT")["k"]
    return df.select("event_id", "user_id", "event_type", F.col("ts").alias("event_timestamp"), F.col("value").alias("play_position_seconds"), k.alias("video_id"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("video_category"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(events(spark, sf_dir), EV)


def rounded(c: Column | str) -> Column:
    """To 6 places, with halves surely up although sums come in any order."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5001) / 1e6


def round_columns(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def R(sql: str) -> str:
    return f"(floor(({sql}) * 1000000 + 0.5001) / 1000000)"


EV_SQL = f"""ev AS (
  SELECT event_id, user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    'c' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS category,
    event_type IN ('view', 'click', 'purchase') AS v, event_type = 'view' AS st, event_type = 'purchase' AS co,
    date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') AS age
  FROM events)"""
SESSION_SQL = (
    EV_SQL
    + """, s0 AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), se AS (
  SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS session_id
  FROM s0)"""
)


def ratio_sql(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
