"""Queries that write tables by the library's sinks and read them again by its sources, and run jobs from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.control.registry import FeatureRegistry
from rillstone.operators import quality, rules
from rillstone.plans import jobs
from rillstone.plans.base import EV, EV_SQL, SESSION_SQL, R, events, query, round_columns, session_events, table
from rillstone.plans.feature_queries import _folder
from rillstone.sinks import lake as sink
from rillstone.sources import lake as source

_DT = "strftime(ts, '%Y-%m-%d')"


def _bronze(spark: SparkSession, d: str) -> str:
    """The events as a bronze table, by the day and hour of their time."""
    path = _folder(spark) + "/bronze"
    sink.write_bronze(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").alias("ingestion_timestamp")), path)
    return path


def _silver(spark: SparkSession, d: str) -> str:
    path = _folder(spark) + "/silver"
    sink.write_silver(events(spark, d).select("event_id", "user_id", "event_type", "event_timestamp", "play_position_seconds"), path)
    return path


@query(f"SELECT event_id, user_id, event_type, value, {_DT} AS dt, CAST(hour(ts) AS INTEGER) AS hr FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND hour(ts) IN (8, 9, 10) AND event_type IN ('view', 'purchase') AND value > 10")
def bronze_write_read(spark, d):
    got = source.read_bronze(spark, _bronze(spark, d), start="2024-01-05", end="2024-01-09", hours=[8, 9, 10], types=["view", "purchase"], where="value > 10")
    return got.select("event_id", "user_id", "event_type", "value", F.date_format("ingestion_timestamp", "yyyy-MM-dd").alias("dt"), "hr")


@query(f"SELECT event_id, value FROM events WHERE {_DT} = '2024-01-07' AND hour(ts) = 13")
def bronze_read_partition(spark, d):
    return source.read_partition(spark, _bronze(spark, d), "2024-01-07", 13).select("event_id", "value")


@query(f"SELECT event_id, 'after' AS part FROM events WHERE {_DT} > '2024-01-20' OR ({_DT} = '2024-01-20' AND hour(ts) > 15) UNION ALL SELECT event_id, 'last days' FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28'")
def bronze_read_incremental(spark, d):
    """After the last processed partition; and, where there is none, the last days."""
    path = _bronze(spark, d)
    one = source.read_incremental(spark, path, "2024-01-20", 15).select("event_id", F.lit("after").alias("part"))
    return one.unionByName(source.read_incremental(spark, path, lookback_days=2, today="2024-01-30").select("event_id", F.lit("last days").alias("part")))


@query(f"SELECT DISTINCT {_DT} AS dt, CAST(hour(ts) AS VARCHAR) AS hr FROM events")
def bronze_partitions_listed(spark, d):
    return source.partitions(spark, _bronze(spark, d))


@query("SELECT event_id, user_id, event_type, value AS play_position_seconds, strftime(ts, '%Y-%m-%d') AS event_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' AND event_type = 'click'")
def silver_write_read(spark, d):
    got = source.read_silver(spark, _silver(spark, d), start="2024-01-20", types=["click"])
    return got.select("event_id", "user_id", "event_type", "play_position_seconds", F.date_format("event_timestamp", "yyyy-MM-dd").alias("event_date"))


@query("SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-11' AND event_type = 'view' THEN -1.0 ELSE value END AS play_position_seconds FROM events WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-11' AND event_type = 'view' AND event_id % 2 = 1)")
def silver_overwrite_partition(spark, d):
    """One day's views are written anew, the odd ones left out; all else stays."""
    path = _silver(spark, d)
    part = events(spark, d).where("event_id % 2 = 0").select("event_id", "user_id", "event_type", "event_timestamp", F.lit(-1.0).alias("play_position_seconds"))
    sink.write_partition(sink.with_partitions(part, "event_timestamp", hour=None), path, "2024-01-11", "view")
    return spark.read.parquet(path).select("event_id", "play_position_seconds")


def _features(spark: SparkSession, d: str) -> str:
    path = _folder(spark) + "/features"
    df = events(spark, d)
    by_user = df.groupBy("user_id").agg(F.count("*").alias("events"))
    for kind in ("user", "buyer"):
        sink.write_features(by_user if kind == "user" else df.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("events")), path, kind, "2024-01-31")
    return path


@query("SELECT user_id, count(*) AS events, 'user' AS feature_type, '2024-01-31' AS feature_date FROM events GROUP BY 1 UNION ALL SELECT user_id, count(*), 'buyer', '2024-01-31' FROM events WHERE event_type = 'purchase' GROUP BY 1")
def features_write_read(spark, d):
    got = spark.read.parquet(_features(spark, d)).where(F.col("processing_timestamp").isNotNull())
    return got.select("user_id", "events", "feature_type", F.date_format(F.col("feature_date").cast("date"), "yyyy-MM-dd").alias("feature_date"))


@query("SELECT 'user' AS feature_type, count(DISTINCT user_id) AS rows FROM events UNION ALL SELECT 'buyer', count(DISTINCT user_id) FROM events WHERE event_type = 'purchase'")
def features_partition_info(spark, d):
    return sink.partition_info(spark, _features(spark, d)).select("feature_type", "rows")


@query("SELECT 'user' AS feature_type, count(DISTINCT user_id) AS rows FROM events")
def features_delete_partition(spark, d):
    path = _features(spark, d)
    sink.delete_partitions(spark, path, ("feature_date", "feature_type"), "feature_type = 'buyer'")
    return sink.partition_info(spark, path).select("feature_type", "rows")


@query("SELECT event_id, 'low' AS dlq_reason FROM events WHERE value < 5")
def dead_letters_write_read(spark, d):
    path = _folder(spark) + "/dead"
    df = table(spark, d, "events")
    for reason, where in (("low", "value < 5"), ("high", "value > 90")):
        sink.write_dead_letters(df.where(where).select("event_id", F.lit(reason).alias("dlq_reason"), F.date_format("ts", "yyyy-MM-dd").alias("dlq_date")), path)
    return source.read_dead_letters(spark, path, reason="low").select("event_id", "dlq_reason")


@query("SELECT count(*) AS rows, true AS sized FROM events")
def manifest_write_read(spark, d):
    path, to = _silver(spark, d), _folder(spark) + "/manifest"
    sink.write_manifest(spark, path, to)
    return source.read_manifest(spark, to).agg(F.sum("rows").alias("rows"), (F.min("file_size") > 0).alias("sized"))


@query("SELECT user_id, event_type, count(*) AS rows FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1, 2")
def silver_stream_write_read(spark, d):
    """The silver table as a stream, in two files at a time, written by the stream sink."""
    path, to = _silver(spark, d), _folder(spark)
    stream = source.read_stream(spark, path, spark.read.parquet(path).schema, 40, "2024-01-10")
    sink.stream(stream, to + "/out", to + "/checkpoint", ("event_type",), None).start().awaitTermination()
    return spark.read.parquet(to + "/out").groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))


def _store(spark: SparkSession, d: str) -> jobs.FeatureStore:
    """Each user's daily number of events so far, stamped with the day's end."""
    store = jobs.FeatureStore(spark, _folder(spark) + "/store")
    daily = events(spark, d).groupBy("user_id", F.to_date("event_timestamp").alias("day")).agg(F.count("*").alias("n"))
    running = daily.select("user_id", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")).alias("events"), (F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("event_timestamp"))
    store.write("activity", running)
    return store


_DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) + INTERVAL 1 DAY AS t, sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS events FROM events GROUP BY user_id, CAST(ts AS DATE))"


@query(f"WITH {_DAILY} SELECT e.event_id, CAST(max_by(daily.events, daily.t) AS BIGINT) AS activity_events FROM events e LEFT JOIN daily ON daily.user_id = e.user_id AND daily.t <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def feature_store_offline(spark, d):
    asked = events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "event_timestamp")
    return _store(spark, d).offline("activity", asked, ["user_id"], ["events"]).select("event_id", F.col("activity_events"))


@query(f"WITH {_DAILY} SELECT u.user_id, CAST(max_by(daily.events, daily.t) AS BIGINT) AS events FROM (SELECT DISTINCT user_id FROM events UNION SELECT -1) u LEFT JOIN daily ON daily.user_id = u.user_id AND daily.t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1")
def feature_store_online(spark, d):
    store = _store(spark, d)
    store.materialize("activity", ["user_id"], "2024-01-05", "2024-01-20")
    keys = events(spark, d).select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id")))
    return store.online("activity", keys, ["user_id"], ["events"])


@query(f"WITH {SESSION_SQL} SELECT 'user' AS kind, count(DISTINCT user_id) AS rows FROM se UNION ALL SELECT 'item', count(DISTINCT k) FROM se WHERE v UNION ALL SELECT 'session', count(DISTINCT session_id) FROM se UNION ALL SELECT 'temporal', count(DISTINCT user_id) FROM se")
def gold_job(spark, d):
    """All feature tables are written and read again."""
    path = _folder(spark) + "/gold"
    reports = jobs.run_gold(session_events(spark, d), path, "2024-01-31", F.lit("2024-01-31 23:59:59").cast("timestamp_ntz"), ev=EV)
    out = None
    for kind in reports:
        one = spark.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


_DAY = "CAST(ts AS DATE)"


@query(f"WITH p AS (SELECT DISTINCT user_id, CAST(t AS TIMESTAMP) AS as_of FROM events, (SELECT unnest(range(TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-21', INTERVAL 1 DAY)) AS t)) SELECT p.user_id, p.as_of, count(e.ts) AS total_events, count_if(e.event_type IN ('view', 'click', 'purchase') AND e.props IS NOT NULL AND date_diff('day', CAST(e.ts AS DATE), CAST(p.as_of AS DATE)) <= 7) AS video_count_7d FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts <= p.as_of GROUP BY 1, 2")
def backfill_incremental(spark, d):
    """Ten days of features, then those that are missing until the twentieth; what the second run wrote."""
    path = _folder(spark) + "/backfill"
    df = events(spark, d)
    for until in ("2024-01-12", "2024-01-20"):
        jobs.backfill_incremental(df, path, until, "2024-01-03", EV)
    return spark.read.parquet(path).where("as_of > TIMESTAMP_NTZ '2024-01-12'").select("user_id", "as_of", "total_events", "video_count_7d")


@query(
    f"""WITH p AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS null_share, CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END AS outlier_share, {R("1 - 0.5 * (CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) - 0.5 * (CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END)")} AS row_quality FROM events, p"""
)
def row_quality(spark, d):
    return round_columns(quality.score_rows(table(spark, d, "events"), ["value"], exact=True).select("event_id", "null_share", "outlier_share", "row_quality"))


@query("SELECT feature, violations, violations = 0 AS valid FROM (SELECT 'value' AS feature, count_if(value > 90) + count_if(value < 1) AS violations FROM events UNION ALL SELECT 'event_type', count_if(event_type NOT IN ('view', 'click', 'purchase')) FROM events UNION ALL SELECT 'user_id', count_if(user_id IS NULL) FROM events)")
def registry_validate(spark, d):
    r = FeatureRegistry()
    r.register("value", "DOUBLE", {"min": 1, "max": 90})
    r.register("event_type", "STRING", {"allowed_values": ["view", "click", "purchase"]})
    r.register("user_id", "BIGINT", {"nullable": False})
    return r.validate(table(spark, d, "events")).select("feature", "violations", "valid")


@query("SELECT 'value' AS feature, 'completeness' AS metric, count(value) / count(*)::DOUBLE AS value, 0.9 AS threshold FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events) HAVING count(value) / count(*)::DOUBLE < 0.9")
def monitoring_alerts(spark, d):
    df = table(spark, d, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return quality.alerts(quality.monitor(df, ["value"]), {"completeness": ("<", 0.9)})


@query("SELECT 'value' AS feature, ['fill or drop missing values'] AS recommendations")
def quality_recommendations(spark, d):
    df = table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return quality.recommendations(quality.quality_report(df, ["value"])).select("feature", "recommendations")


@query("SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT 'no table', 0")
def lookup_tables(spark, d):
    """A lookup table that there is, and one that there isn't."""
    path = _folder(spark) + "/nation"
    table(spark, d, "nation").write.parquet(path)
    found = source.lookup(spark, path).join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))
    return found if source.lookup(spark, path + "-none") is not None else found.unionByName(spark.range(1).select(F.lit("no table").alias("n_name"), F.lit(0).cast("long").alias("customers")))


@query("SELECT event_id, event_type, value, ts, fmt FROM events, (VALUES ('csv'), ('json'), ('orc')) t(fmt) WHERE event_id % 10 = 0")
def other_formats(spark, d):
    """CSV, JSON and ORC, written and read."""
    df = table(spark, d, "events").where("event_id % 10 = 0").select("event_id", "event_type", "value", F.col("ts").cast("string").alias("ts"))
    out = None
    for fmt in ("csv", "json", "orc"):
        path = f"{_folder(spark)}/{fmt}"
        df.write.format(fmt).save(path)
        one = spark.read.schema(df.schema).format(fmt).load(path).withColumns({"fmt": F.lit(fmt), "ts": F.col("ts").cast("timestamp_ntz")})
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2, count(*) AS rows FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("rows"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    df = table(spark, d, "lineitem")
    return df.groupingSets([[df.l_returnflag], [df.l_linestatus], []], df.l_returnflag, df.l_linestatus).agg(F.count("*").alias("rows"))


@query("SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS nt, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
def window_ranks(spark, d):
    w, v = Window.partitionBy("c_nationkey").orderBy("c_mktsegment"), Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", *[x.cast("long").alias(n) for x, n in ((F.rank().over(w), "r"), (F.dense_rank().over(w), "dr"), (F.ntile(4).over(v), "nt"), (F.row_number().over(v), "rn"))])


@query("SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
def right_join(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")
