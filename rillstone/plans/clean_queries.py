"""Queries on reading, parsing, cleaning, validation, duplicates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.control import tracker
from rillstone.functions import pii, text
from rillstone.operators import dedup, joins, parse, rules
from rillstone.plans.base import EV_SQL, R, events, query, rounded, table


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' AND hour(ts) IN (8, 9, 10) AND event_type IN ('view', 'purchase') AND event_id IS NOT NULL AND event_type <> ''")
def scan_filter_partition(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-08' AND event_id IS NOT NULL AND event_type <> ''")
    return df.where(F.hour("ts").isin(8, 9, 10) & F.col("event_type").isin("view", "purchase")).select("event_id", "user_id", "event_type", "ts")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS dt, hour(ts) AS hr FROM events")
def available_partitions(spark, d):
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.hour("ts").alias("hr")).distinct()


@query("SELECT event_id, ts FROM events WHERE strftime(ts, '%Y-%m-%d') > '2024-01-20' OR (strftime(ts, '%Y-%m-%d') = '2024-01-20' AND hour(ts) > 15)")
def incremental_read(spark, d):
    from rillstone.sources.lake import after

    df = table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20'")
    return df.withColumns({"dt": F.date_format("ts", "yyyy-MM-dd"), "hr": F.hour("ts")}).where(after("dt", "hr", "2024-01-20", 15)).select("event_id", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_parse_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT event_id, user_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp_ms, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS parse_error, 'user_events' AS source_topic FROM (SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS event_id) FROM events)")
def kafka_parse(spark, d):
    """Events as Kafka messages, and back."""
    df = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.unix_millis(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))).alias("timestamp"), "event_type", F.struct(F.from_json("props", "k INT")["k"].alias("position")).alias("context"))
    messages = df.select(F.to_json(F.struct("*")).cast("binary").alias("value"), F.lit("user_events").alias("topic"))
    got = parse.parse_messages(messages)
    return got.select("event_id", "user_id", "timestamp_ms", "event_type", F.col("context.position").cast("long").alias("position"), "parse_error", "source_topic")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, upper(event_type) AS kind, CASE WHEN value > 100 THEN CAST(user_id AS VARCHAR) END AS who FROM events")
def flatten_struct_map(spark, d):
    nested = table(spark, d, "events").select("event_id", F.from_json("props", "k INT").alias("p"), F.create_map(F.lit("kind"), F.upper("event_type"), F.lit("who"), F.when(F.col("value") > 100, F.col("user_id").cast("string")).otherwise("  ")).alias("m"))
    return parse.flatten(nested, {"p": {"k": "k"}, "m": {"kind": "kind", "who": "who"}})


@query("SELECT event_id, CASE WHEN full_type LIKE '%_pause' THEN event_type ELSE event_type END AS action FROM (SELECT event_id, event_type, 'VIDEO_' || event_type || CASE WHEN event_id % 2 = 0 THEN '_start' ELSE '_pause' END AS full_type FROM events)")
def action_derivation(spark, d):
    full = F.concat(F.lit("VIDEO_"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "_start").otherwise("_pause"))
    return table(spark, d, "events").select("event_id", text.action(full).alias("action"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(CAST(value AS BIGINT) AS BIGINT) AS play_position_seconds, CAST(NULL AS VARCHAR) AS user_segment FROM (SELECT event_id, event_type, trunc(value) AS value FROM events)")
def schema_conform(spark, d):
    target = schemas.ddl("event_id STRING, event_type STRING, play_position_seconds BIGINT, user_segment STRING")
    return parse.conform(table(spark, d, "events").withColumnRenamed("value", "play_position_seconds"), target)


@query("SELECT doc_id, TRY_CAST(trim(left(text, 4)) AS INTEGER) AS number, TRY_CAST(source[4:] AS BIGINT) AS source_number, TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN '2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) ELSE lang END AS DATE) AS day FROM documents")
def safe_casts(spark, d):
    start = F.regexp_replace(F.substring("text", 1, 4), r"^\p{Zs}+|\p{Zs}+$", "")
    df = table(spark, d, "documents").select("doc_id", start.alias("number"), F.expr("substring(source, 4)").alias("source_number"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))).otherwise(F.col("lang")).alias("day"))
    return parse.cast_columns(df, {"number": "INT", "source_number": "BIGINT", "day": "DATE"})


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS digest, length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS size FROM documents")
def normalize_strings(spark, d):
    clean = text.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower(clean)).alias("digest"), F.length(clean).alias("size"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'mobile' WHEN 'click' THEN 'tablet' WHEN 'purchase' THEN 'desktop' WHEN 'signup' THEN 'smart_tv' ELSE 'error' END AS device_type, CASE WHEN event_id % 3 = 0 THEN '4K' WHEN event_id % 3 = 1 THEN '720p' ELSE 'unknown' END AS video_quality, 'c1' AS country FROM events")
def enum_map(spark, d):
    names = {"view": " Phone", "click": "iPad", "purchase": "LAPTOP ", "signup": "Smart TV"}
    df = table(spark, d, "events").select("event_id", text.replace_values(F.col("event_type"), names).alias("device_type"), F.when(F.col("event_id") % 3 == 0, "4K").when(F.col("event_id") % 3 == 1, "720").alias("video_quality"), F.lit(" c1 ").alias("country"))
    return parse.fill_defaults(parse.normalize_silver(df)).withColumn("country", F.lower("country"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS os, CASE WHEN value > 50 THEN 'x' ELSE 'unknown' END AS video_quality FROM events")
def null_defaults(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("os"), F.when(F.col("value") > 50, "x").alias("video_quality"))
    return parse.fill_defaults(df)


@query("SELECT * FROM (SELECT 'l_orderkey' AS column_name, count(*) FILTER (WHERE l_orderkey IS NULL) AS nulls, count(*) AS rows FROM lineitem UNION ALL SELECT 'late', count(*) FILTER (WHERE NOT l_shipdate > TIMESTAMP '1996-01-01'), count(*) FROM lineitem UNION ALL SELECT 'l_returnflag', count(*) FILTER (WHERE l_returnflag IS NULL), count(*) FROM lineitem)")
def null_counts(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"), 1).alias("late"), "l_returnflag")
    return rules.null_counts(df)


@query("SELECT c_custkey, sha256('salt' || c_name) AS c_name, CAST(NULL AS VARCHAR) AS c_mktsegment, true AS pii_scrubbed FROM customer")
def pii_hash(spark, d):
    return pii.scrub(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "hash", "c_mktsegment": "remove", "no_such": "hash"}, "salt")


@query("SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN left(c_name, 2) || 'XXX' || right(c_name, 2) ELSE 'XXX' END AS user_id, 'u' || CAST(c_custkey AS VARCHAR) || '@XXX.com' AS email, '+1-555-01' || CAST(c_custkey % 10 AS VARCHAR) || '-XXXX' AS phone_number, true AS pii_scrubbed FROM customer")
def pii_mask(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("user_id"), F.concat(F.lit("u"), k, F.lit("@mail.example")).alias("email"), F.concat(F.lit("+1-555-01"), k % 10, F.lit("-1234")).alias("phone_number"))
    return pii.scrub(df, {"user_id": "mask", "email": "mask", "phone_number": "mask"})


@query("SELECT event_id, '10.' || CAST(user_id % 256 AS VARCHAR) || '.7.XXX' AS masked, '10.' || CAST(user_id % 256 AS VARCHAR) || '.7.0' AS anonymous FROM events")
def pii_mask_ip(spark, d):
    ip = F.concat(F.lit("10."), F.col("user_id") % 256, F.lit(".7."), F.col("event_id") % 256)
    return table(spark, d, "events").select("event_id", pii.masked_ip(ip).alias("masked"), pii.anonymous_ip(ip).alias("anonymous"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{pii.EMAIL}', '[email]', 'g'), '{pii.IPV4}', '[ip]', 'g'), '{pii.PHONE}', '[phone]', 'g')) AS digest FROM documents")
def pii_mask_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(pii.masked_text(F.col("text"))).alias("digest"))


_RULES = {"positive": "value > 20", "type": "event_type IN ('view', 'click', 'purchase', 'signup')", "user": "user_id IS NOT NULL AND user_id % 10 <> 3", "month": "ts < TIMESTAMP_NTZ '2024-01-25'"}
_FLAGS = "(CASE WHEN value > 20 THEN 0 ELSE 1 END) AS a, (CASE WHEN event_type IN ('view', 'click', 'purchase', 'signup') THEN 0 ELSE 1 END) AS b, (CASE WHEN user_id IS NOT NULL AND user_id % 10 <> 3 THEN 0 ELSE 1 END) AS c, (CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 0 ELSE 1 END) AS d"
_STATUS = "CASE WHEN 1 - (a + b + c + d) / 4.0 >= 0.7 THEN 'valid' WHEN 1 - (a + b + c + d) / 4.0 >= 0.5 THEN 'warning' ELSE 'invalid' END"


@query(f"SELECT event_id, CASE WHEN a = 1 THEN 'invalid_positive' WHEN b = 1 THEN 'invalid_type' WHEN c = 1 THEN 'invalid_user' WHEN d = 1 THEN 'invalid_month' ELSE 'valid' END AS status FROM (SELECT event_id, {_FLAGS} FROM events)")
def validate_rules(spark, d):
    return table(spark, d, "events").select("event_id", rules.first_failure(_RULES).alias("status"))


@query(f"SELECT event_id, CAST(1 - (a + b + c + d) / 4.0 AS DOUBLE) AS data_quality_score, {_STATUS} AS validation_status, concat_ws(',', CASE WHEN a = 1 THEN 'positive' END, CASE WHEN b = 1 THEN 'type' END, CASE WHEN c = 1 THEN 'user' END, CASE WHEN d = 1 THEN 'month' END) AS validation_errors FROM (SELECT event_id, {_FLAGS} FROM events)")
def validation_score(spark, d):
    df = rules.validate(table(spark, d, "events"), _RULES, warn=0.5, accept=0.7)
    return df.select("event_id", "data_quality_score", "validation_status", F.array_join("validation_errors", ",").alias("validation_errors"))


@query(f"SELECT validation_status, count(*) AS rows, CAST(round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events), 6) AS DOUBLE) AS share, CAST(round(avg(score), 6) AS DOUBLE) AS mean_score FROM (SELECT {_STATUS} AS validation_status, CAST(1 - (a + b + c + d) / 4.0 AS DOUBLE) AS score FROM (SELECT {_FLAGS} FROM events)) GROUP BY 1")
def validation_stats(spark, d):
    return rules.validation_stats(rules.validate(table(spark, d, "events"), _RULES, warn=0.5, accept=0.7))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN value > 30 WHEN 'view' THEN user_id % 2 = 0 ELSE true END AS complete FROM events")
def required_by_type(spark, d):
    df = table(spark, d, "events").withColumns({"target_id": F.when(F.col("value") > 30, 1), "video_id": F.when(F.col("user_id") % 2 == 0, 1)})
    return df.select("event_id", rules.required_by_type({"purchase": ("event_id", "target_id"), "view": ("event_id", "video_id")}).alias("complete"))


@query("SELECT dlq_reason, count(*) AS rows, min(CAST(event_id AS BIGINT)) AS least, max(CAST(event_id AS BIGINT)) AS greatest FROM (SELECT event_id, CASE WHEN value <= 20 THEN 'invalid_positive' ELSE 'invalid_type' END AS dlq_reason FROM events WHERE value <= 20 OR event_type NOT IN ('view', 'click', 'purchase', 'signup')) GROUP BY 1")
def dq_split_dlq(spark, d):
    mine = {k: _RULES[k] for k in ("positive", "type")}
    df = table(spark, d, "events").withColumn("status", rules.first_failure(mine))
    letters = rules.dead_letters(rules.split(df, "status = 'valid'")[1], F.col("status"))
    return letters.groupBy("dlq_reason").agg(F.count("*").alias("rows"), F.min(F.get_json_object("payload", "$.event_id").cast("long")).alias("least"), F.max(F.get_json_object("payload", "$.event_id").cast("long")).alias("greatest"))


def _dedup(keep: str):
    return f"SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {keep}, event_id) = 1"


@query(_dedup("DESC"))
def dedup_key_latest(spark, d):
    return dedup.by_key(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").drop("ts")


@query(_dedup("ASC"))
def dedup_key_earliest(spark, d):
    return dedup.by_key(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "earliest").drop("ts")


@query("SELECT user_id, count(*) AS rows FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS s FROM events) GROUP BY 1")
def dedup_composite(spark, d):
    return dedup.by_second(table(spark, d, "events"), ["user_id"], "ts").groupBy("user_id").agg(F.count("*").alias("rows"))


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_exact(spark, d):
    return dedup.exact(table(spark, d, "documents").select("text", "lang"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 300) ORDER BY ts DESC, event_id) = 1")
def dedup_window5m(spark, d):
    return dedup.by_window(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts").drop("ts")


@query("SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, coalesce(max(n), 0) AS largest_group FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_stats(spark, d):
    return dedup.duplicate_stats(table(spark, d, "documents"), ["text"])


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enrich_regular(spark, d):
    lookup = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.enrich(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lookup, "o_custkey", limit=0)


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def enrich_broadcast(spark, d):
    lookup = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.enrich(table(spark, d, "customer").select("c_custkey", "c_nationkey").withColumn("n_name", F.lit(None).cast("string")), lookup, "c_nationkey")


@query("SELECT o_orderkey, c_mktsegment AS user_segment, n_name AS video_category, r_name AS country FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_geo_chain(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    df = joins.enrich(df, c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_segment"), F.col("c_nationkey").alias("video_id")), "user_id")
    df = joins.enrich(df, n.select(F.col("n_nationkey").alias("video_id"), F.col("n_name").alias("video_category"), F.col("n_regionkey").alias("ip_address")), "video_id")
    df = joins.enrich(df, r.select(F.col("r_regionkey").alias("ip_address"), F.col("r_name").alias("country")), "ip_address")
    return df.select("o_orderkey", "user_segment", "video_category", "country")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_known_entities(spark, d):
    return joins.known(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_unknown_entities(spark, d):
    return joins.unknown(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour FROM events WHERE NOT (day(ts) % 2 = 0 AND hour(ts) < 12)")
def anti_unprocessed(spark, d):
    available = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day")).distinct()
    return tracker.remaining(available, available.where("day % 2 = 0 AND hour < 12")).select("date", "hour")


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS processed_at FROM events GROUP BY 1, 2")
def partition_tracker_latest(spark, d):
    entries = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"), F.col("event_type").alias("status"), F.col("ts").alias("processed_at"), F.lit("").alias("metadata"))
    return tracker.latest(entries).drop("metadata")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, a.views, b.purchases FROM (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS purchases FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0 GROUP BY 1) b ON a.user_id = b.user_id")
def combine_features(spark, d):
    df = table(spark, d, "events")
    return joins.combine([df.where("event_type = 'view' AND user_id % 3 <> 0").groupBy("user_id").agg(F.count("*").alias("views")), df.where("event_type = 'purchase' AND user_id % 5 <> 0").groupBy("user_id").agg(F.count("*").alias("purchases"))], ["user_id"])


@query("SELECT user_id, ts, value, CAST(NULL AS VARCHAR) AS event_type FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts, NULL, event_type FROM events WHERE event_type = 'error'")
def union_by_name(spark, d):
    df = table(spark, d, "events")
    return df.where("event_type = 'view'").select("user_id", "ts", "value").unionByName(df.where("event_type = 'error'").select("event_type", "ts", "user_id"), allowMissingColumns=True)


@query("SELECT DISTINCT user_id FROM events")
def distinct_entities(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def intersect_entities(spark, d):
    df = table(spark, d, "events")
    return df.where("event_type = 'view'").select("user_id").intersect(df.where("event_type = 'purchase' AND value > 100").select("user_id"))


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 150")
def except_entities(spark, d):
    df = table(spark, d, "events")
    return df.select("user_id").subtract(df.where("value > 150").select("user_id"))


@query(f"WITH {EV_SQL} SELECT event_type, category, count(*) AS rows, {R('sum(value)')} AS total, CAST(grouping(event_type) AS INTEGER) AS g FROM ev GROUP BY ROLLUP (event_type, category)")
def rollup_totals(spark, d):
    df = events(spark, d).rollup("event_type", F.col("video_category").alias("category")).agg(F.count("*").alias("rows"), rounded(F.sum("play_position_seconds")).alias("total"), F.grouping("event_type").cast("int").alias("g"))
    return df


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("SELECT CAST(count(DISTINCT file) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT 'events.parquet' AS file, count(*) AS n FROM events)")
def manifest(spark, d):
    from rillstone.sinks.lake import manifest as listed

    return listed(spark, f"{d}/events.parquet").agg(F.count_distinct("file_name").alias("files"), F.sum("rows").alias("rows"))


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, CAST(20000 AS BIGINT) AS expected FROM range(20000) t(event_id)")
def generate_events(spark, d):
    from rillstone.sources.generator import events as made

    return made(spark, 20_000).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"), F.lit(20000).cast("long").alias("expected"))


