"""Edge rows of the layers, built by hand, with the results they must have."""

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillstone import schemas
from rillstone.functions import pii, text, vectors
from rillstone.operators import dedup, embeddings, features, joins, parse, quality, rules, stats
from rillstone.schemas import ddl


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- parsing and shaping


def test_bad_messages_are_told_apart(spark):
    values = ['{"event_id": "a", "timestamp": 5, "extra": 1, "device": {"os": "x"}}', "{broken", "", None, "  ", '{"timestamp": "no number"}']
    df = spark.createDataFrame([(v,) for v in values], "value STRING")
    got = parse.parse_messages(df).select("event_id", "timestamp_ms", "device.os", "parse_error").collect()
    assert [tuple(r) for r in got] == [("a", 5, "x", None), (None, None, None, "malformed JSON"), (None, None, None, "empty"), (None, None, None, "empty"), (None, None, None, "empty"), (None, None, None, "malformed JSON")]


def test_nested_columns_from_json_map_or_struct(spark):
    target = ddl("os STRING, position INT")
    df = spark.sql("SELECT '{\"os\": \"x\", \"position\": 3}' AS j, map('os', 'y', 'position', '4') AS m, named_struct('os', 'z', 'other', 1) AS s, CAST(NULL AS MAP<STRING, STRING>) AS n")
    got = df.select(*[parse.as_struct(df, c, target).alias(c) for c in "jmsn"]).first()
    assert [got[c] and tuple(got[c]) for c in "jmsn"] == [("x", 3), ("y", 4), ("z", None), None]
    flat = parse.flatten(spark.sql("SELECT 1 AS id, named_struct('a', ' ', 'b', 2) AS s, map('k', 'v') AS m"), {"s": {"a": "a", "b": "b"}, "m": {"k": "k", "gone": "gone"}})
    assert rows(flat) == [(1, None, 2, "v", None)] and flat.columns == ["id", "a", "b", "k", "gone"]
    with pytest.raises(TypeError):
        parse.as_struct(df.withColumn("x", F.lit(1)), "x", target)


@pytest.mark.parametrize("value,kind,target,want", [("' 12 '", "string", "INT", 12), ("'x'", "string", "INT", None), ("double('NaN')", "double", "INT", None), ("1704067200123", "bigint", "TIMESTAMP", datetime(2024, 1, 1, 0, 0, 0, 123000)), ("'1704067200000'", "string", "TIMESTAMP", datetime(2024, 1, 1)), ("'2024-01-01T10:00:00'", "string", "TIMESTAMP", datetime(2024, 1, 1, 10)), ("'2024-02-30'", "string", "DATE", None), ("'2024-02-03'", "string", "DATE", date(2024, 2, 3)), ("300", "int", "STRING", "300")])
def test_safe_casts(spark, value, kind, target, want):
    df = spark.sql(f"SELECT {value} AS x")
    assert parse.cast_columns(df, {"x": target, "missing": "INT"}).first()["x"] == want


@pytest.mark.parametrize("start,source,want", [("56.187", "web12", (56, 12)), ("-2.5", "web1e3", (-3, 1000)), (".4", "web0x1F", (0, 31)), ("\u00a01_0\n", "web\u00a01", (10, None)), ("1e-1", "web" + "0" * 30 + "7", (0, 7)), ("0b11", "web0xffffffffffffffffff", (3, None)), ("1e99", "web9223372036854775807.5", (None, None)), ("\x001", "web1__0", (None, None))])
def test_safe_casts_read_numbers_as_sql_does(spark, tmp_path, start, source, want):
    spark.createDataFrame([(1, start, source, "en")], "doc_id BIGINT, text STRING, source STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    oracle = duckdb.sql(entry.oracle_sql()["safe_casts"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert rows(entry.queries()["safe_casts"](spark, str(tmp_path))) == oracle == [(1, *want, None)]


def test_conform_makes_typed_nulls(spark):
    out = parse.conform(spark.sql("SELECT '5' AS a, 1 AS extra"), ddl("a INT, s STRUCT<x: STRING>, l ARRAY<STRING>"))
    assert out.schema.simpleString() == "struct<a:int,s:struct<x:string>,l:array<string>>" and rows(out) == [(5, None, None)]
    assert parse.conform(spark.sql("SELECT 1 AS b"), ddl("a INT"), drop_extra=False).columns == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([("video_play_start",), ("VIDEO_play_pause",), ("post_like",), (None,), ("video_end_end",)], "x STRING")
    assert [r[0] for r in df.select(text.action(F.col("x"))).collect()] == ["play", "play", "post_like", None, "end"]
    assert spark.range(1).select(text.category(F.lit(" tv show ")), text.category(F.lit("  ")), text.collapse(F.lit(" a \n\t b ")), text.iso_time(F.lit(1704067200123))).first()[:] == ("Tv Show", None, "a b", "2024-01-01T00:00:00.123Z")


def test_silver_normalization(spark):
    df = spark.createDataFrame([(" PHONE ", "4K", "Darwin", "us", None), ("Smart TV", None, "", "DE ", "X")], "device_type STRING, video_quality STRING, os STRING, country STRING, browser STRING")
    assert rows(parse.fill_defaults(parse.normalize_silver(df))) == [("mobile", "4K", "macos", "US", None), ("smart_tv", "unknown", "", "DE", "x")]


def test_schema_helpers():
    assert "processing_metadata.source_offset" in schemas.paths(schemas.BRONZE) and "silver_processing_metadata.data_quality_score" in schemas.paths(schemas.SILVER)
    field = lambda name, kind: {"name": name, "type": kind}
    record = dict(type="record", name="R", fields=[field("c", ["null", "int"])])
    avro = {"fields": [field("a", "string"), field("b", ["null", record]), field("m", {"type": "map", "values": "long"}), field("l", {"type": "array", "items": "double"})]}
    assert schemas.from_avro(avro).simpleString() == "struct<a:string,b:struct<c:int>,m:map<string,bigint>,l:array<double>>"
    assert [f.nullable for f in schemas.from_avro(avro).fields] == [False, True, False, False]
    with pytest.raises(ValueError):
        ddl("a WHATEVER")


# --- personal data


def test_masks(spark):
    one = spark.sql("SELECT '10.1.2.3' AS ip_address, 'fe80::1' AS v6_ip, '' AS email, 'abcd' AS id4, 'abcde' AS description, CAST(NULL AS STRING) AS user_id, named_struct('ip_address', '1.2.3.4', 'os', 'x') AS device, 'a@b.cc 1.2.3.4 +49 (30) 1234567' AS t")
    out = pii.scrub(one, {"ip_address": "mask", "v6_ip": "mask", "email": "mask", "id4": "mask", "description": "mask", "user_id": "hash", "device.ip_address": "mask", "device.nothing": "mask", "gone": "remove"}, "s").first()
    assert out["ip_address"] == "10.1.2.XXX" and out["v6_ip"] == "fe80::1" and out["email"] == "" and out["id4"] == "XXX" and out["user_id"] is None
    assert out["description"] == "abXXXde"  # a name that merely contains "ip"
    assert tuple(out["device"]) == ("1.2.3.XXX", "x") and out["pii_scrubbed"] is True
    assert one.select(pii.masked_text(F.col("t"))).first()[0] == "[email] [ip] [phone]"
    with pytest.raises(ValueError):
        pii.scrub(one, {"user_id": "hash"})
    removed = pii.scrub(one, {"device": "remove"})
    assert removed.schema["device"].dataType == one.schema["device"].dataType and removed.first()["device"] is None


# --- rules


def test_rules_decide_every_row(spark):
    df = spark.createDataFrame([("e" * 32, "page_view", 1000, "2024-01-01T00:00:00"), (None, "page_view", 1000, None), ("e" * 32, " ", 0, "x"), ("e", "page_view", None, None), ("e" * 32, "page_view", 10**15, None)], "event_id STRING, event_type STRING, timestamp_ms BIGINT, timestamp_iso STRING")
    now = F.lit("2024-01-02").cast("timestamp")
    out = df.select(rules.first_failure(rules.bronze_rules(now)).alias("s"))
    assert [r[0] for r in out.collect()] == ["valid", "invalid_required", "invalid_range", "invalid_required", "invalid_future"]
    good, bad = rules.split(df, "timestamp_ms > 0")
    assert good.count() == 3 and bad.count() == 2  # null fails
    checked = rules.validate(df, {"a": "timestamp_ms > 0", "b": F.col("event_id").isNotNull()}, warn=0.5).select("validation_errors", "data_quality_score", "validation_status")
    assert rows(checked)[1:4] == [(["b"], 0.5, "warning"), (["a"], 0.5, "warning"), (["a"], 0.5, "warning")]
    with pytest.raises(Exception):
        rules.validate(df, {"bad": "no_such_column > 1"}).collect()


def test_rule_makers(spark):
    df = spark.createDataFrame([(5, "US", "purchase", "x"), (24, "usa", "purchase", None), (None, None, None, None)], "h INT, c STRING, event_type STRING, target_id STRING")
    made = df.select(rules.between("h", 0, 23), rules.matches("c", "[A-Z]{2}"), rules.one_of("c", ["US"]), rules.required_by_type({"purchase": ("target_id",)}))
    assert rows(made) == [(True, True, True, True), (False, False, False, False), (True, True, True, True)]


def test_reports_and_letters(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a INT, b STRING")
    assert rows(rules.null_counts(df), "column_name") == [("a", 0, 2), ("b", 1, 2)]
    assert rules.require_no_nulls(df, ["a"]) is df
    with pytest.raises(ValueError, match="b"):
        rules.require_no_nulls(df, ["a", "b"])
    letter = rules.dead_letters(df, "bad", F.lit("2024-01-02 03:00:00").cast("timestamp")).first()
    assert letter["payload"] == '{"a":1}' and letter["dlq_date"] == "2024-01-02" and letter["dlq_hour"] == 3


# --- duplicates


@pytest.fixture(scope="module")
def repeats(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([("a", t.replace(second=1), 1), ("a", t.replace(second=1, microsecond=5), 2), ("a", t.replace(minute=6), 3), ("b", t, 4), ("b", t, 5), (None, t, 6), (None, None, 7), ("b", None, 8)], "k STRING, t TIMESTAMP, n INT")


@pytest.mark.parametrize("strategy,keep,want", [("key", "latest", [3, 4, 6]), ("key", "earliest", [1, 4, 6]), ("composite", "latest", [2, 3, 4, 6, 7, 8]), ("window", "latest", [2, 3, 4, 6, 7, 8]), ("exact", "latest", [1, 2, 3, 4, 5, 6, 7, 8])])
def test_strategies(repeats, strategy, keep, want):
    out = dedup.remove_duplicates(repeats, strategy, None if strategy == "exact" else ["k"], "t", keep)
    assert sorted(r["n"] for r in out.collect()) == want
    again = dedup.remove_duplicates(out, strategy, None if strategy == "exact" else ["k"], "t", keep)
    assert sorted(r["n"] for r in again.collect()) == want


def test_exact_tells_null_from_blank(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("x", None), ("x", None)], "a STRING, b STRING")
    assert dedup.exact(df).count() == 3
    assert rows(dedup.duplicate_stats(df, ["b"])) == [(2, 2, 2)]
    assert rows(dedup.duplicate_stats(df.limit(1), ["b"])) == [(0, 0, 0)]


# --- joins


def test_enrichment_never_multiplies(spark):
    df = spark.createDataFrame([(1, "u1", None), (2, "u2", None), (3, None, None)], "id INT, user_id STRING, user_segment STRING")
    lookup = spark.createDataFrame([("u1", "b"), ("u1", "a"), (None, "n")], "user_id STRING, user_segment STRING")
    for limit in (0, 10 << 20):
        out = joins.enrich(df, lookup, "user_id", limit=limit)
        assert sorted((r["id"], r["user_segment"]) for r in out.collect()) == [(1, "a"), (2, None), (3, None)]
    assert joins.enrich(df, None, "user_id") is df


def test_broadcast_depends_on_size(spark, data):
    orders, nation = spark.read.parquet(f"{data}/orders.parquet"), spark.read.parquet(f"{data}/nation.parquet")
    assert "ResolvedHint" in joins.if_small(nation)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.if_small(orders, 10)._jdf.queryExecution().analyzed().toString()


def test_as_of_never_reads_the_future(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, "u", at(5)), (2, "u", at(1)), (3, "v", at(9)), (4, None, at(9)), (5, "u", None), (6, "u", at(5))], "id INT, k STRING, t TIMESTAMP")
    right = spark.createDataFrame([("u", at(5), 50), ("u", at(3), 30), ("u", at(5), 49), ("u", at(8), 80), (None, at(1), 1), ("u", None, 2)], "k STRING, ft TIMESTAMP, f INT")
    out = joins.as_of(left, right, ["k"], "t", "ft", ["f"])
    assert sorted((r["id"], r["f"]) for r in out.collect()) == [(1, 50), (2, None), (3, None), (4, None), (5, None), (6, 50)]
    assert all(r["ft"] is None or r["ft"] <= r["t"] for r in out.collect())
    near = joins.as_of(left.withColumn("t", F.col("t") + F.expr("INTERVAL 2 HOURS")), right, ["k"], "t", "ft", ["f"], F.expr("INTERVAL 1 HOUR"), "x_")
    assert {r["x_f"] for r in near.collect()} == {None, 30}


# --- features

EV = features.Events()
AS_OF = datetime(2024, 1, 31, 12)


@pytest.fixture(scope="module")
def watched(spark):
    d = lambda day, h=10: datetime(2024, 1, day, h)
    data = [
        ("u1", "v1", "c1", "s1", d(31), 100.0, "video_play_start", 1),
        ("u1", "v1", "c2", "s1", d(31, 11), 50.0, "video_play_complete", 2),
        ("u1", "v2", "c2", "s2", d(1), None, "video_play_start", 3),
        ("u1", "v2", "c1", None, d(2), 10.0, "page_view", 4),
        ("u1", "v9", "c9", "s9", datetime(2024, 2, 5), 999.0, "video_play_start", 5),
        ("u2", None, None, "s3", d(10, 22), None, "page_view", 6),
        (None, "v1", "c1", "s4", d(30), 5.0, "video_play_start", 7),
    ]
    return spark.createDataFrame(data, "user_id STRING, video_id STRING, video_category STRING, session_id STRING, event_timestamp TIMESTAMP, play_position_seconds DOUBLE, event_type STRING, event_id INT")


def test_user_features(watched):
    got = {r["user_id"]: r.asDict() for r in features.user_features(watched, EV, F.lit(AS_OF)).collect()}
    assert set(got) == {"u1", "u2"}  # no null key; the future is left out
    u = got["u1"]
    assert (u["watch_time_1d"], u["watch_time_30d"], u["watch_time_total"], u["video_count_30d"], u["unique_videos_total"], u["category_diversity"]) == (150.0, 150.0, 150.0, 3, 2, 2)
    assert u["top_category"] == "c2" and u["completion_rate"] == 0.5 and u["avg_events_per_session"] == 1.5 and u["session_count_7d"] == 1 and u["days_since_last_interaction"] == 0
    v = got["u2"]
    assert (v["watch_time_total"], v["completion_rate"], v["top_category"], v["days_since_last_interaction"], v["interaction_frequency_7d"]) == (0.0, 0.0, None, 21, 0.0)


def test_item_features(watched):
    got = {r["video_id"]: r.asDict() for r in features.item_features(watched, EV, F.lit(AS_OF)).collect()}
    assert set(got) == {"v1", "v2"}
    v = got["v1"]
    assert (v["view_count_total"], v["unique_users_total"], v["start_count"], v["completion_count"], v["completion_rate"]) == (3, 1, 2, 1, 0.5)
    assert v["avg_watch_time"] == pytest.approx(155 / 3) and v["return_user_rate"] == 1.0 and v["views_last_7d"] == 1 and v["growth_rate_7d"] == 0.0
    assert got["v2"]["avg_watch_time"] == 0.0 and got["v2"]["trending_score"] == 0.0 and got["v1"]["trending_score"] == 3.0


def test_sessions(spark, watched):
    got = {r["session_id"]: r.asDict() for r in features.session_features(watched, EV, F.lit(AS_OF)).collect()}
    assert got["s1"]["session_duration_seconds"] == 3600 and got["s1"]["avg_time_between_events"] == 3600 and got["s3"]["avg_time_between_events"] == 0 and got["s3"]["session_type"] == "mixed"
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t, 1), ("u", t.replace(minute=30), 2), ("u", t.replace(hour=1, minute=0, second=1), 3), ("w", t, 4), (None, t, 5), ("u", None, 6)], "user_id STRING, event_timestamp TIMESTAMP, event_id INT")
    made = {r["event_id"]: r["session_id"] for r in features.sessionize(df).collect()}
    assert made == {1: "u-1", 2: "u-1", 3: "u-2", 4: "w-1", 5: None, 6: None}


def test_temporal_features(watched):
    u = features.temporal_features(watched, EV, F.lit(AS_OF)).where("user_id = 'u2'").first()
    assert u["night_events"] == 1 and u["morning_events"] == 0 and u["preferred_time_period"] == "night" and u["weekend_activity_ratio"] == 0
    one = features.temporal_features(watched, EV, F.lit(AS_OF)).where("user_id = 'u1'").first()
    assert sum(one[f"{p}_activity_pct"] for p in features.PERIODS) == pytest.approx(1) and sum(one[f"{d}_events"] for d in features.DAYS) == one["total_events"] == 4
    assert one["preferred_time_period"] == "morning"


def test_points_in_time(watched, spark):
    points = spark.createDataFrame([("u1", datetime(2024, 1, 1, 12)), ("u1", datetime(2024, 1, 31, 10, 30)), ("nobody", datetime(2024, 1, 5))], "user_id STRING, as_of TIMESTAMP")
    got = {(r["user_id"], r["as_of"].day): (r["total_events"], r["watch_time_total"], r["watch_time_1d"]) for r in features.at_times(watched, points).collect()}
    assert got == {("u1", 1): (1, 0.0, 0.0), ("u1", 31): (3, 100.0, 100.0), ("nobody", 5): (0, 0.0, 0.0)}


def test_features_are_one_shuffle(watched):
    plan = features.user_features(watched, EV, F.lit(AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


# --- statistics and reports


def test_degenerate_columns_score_zero(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "a"), (None, 5.0, "b")], "x INT, c DOUBLE, g STRING")
    assert {r["c_zscore"] for r in stats.z_scores(df, ["c"]).collect()} == {0.0} == {r["c_normalized"] for m in ("zscore", "minmax", "robust") for r in stats.normalize(df, ["c"], m).collect()}
    assert sorted(r["x_zscore"] for r in stats.z_scores(df, ["x"], ["g"]).collect()) == pytest.approx([-(0.5**0.5), 0.0, 0.5**0.5])
    lo = spark.createDataFrame([(-2.0,), (0.0,)], "x DOUBLE")
    assert sorted(r[1] for r in stats.normalize(lo, ["x"], "minmax").collect()) == [0.0, 1.0]  # a maximum of 0 isn't degenerate
    assert stats.percentiles(df, ["x"], by=["g"], exact=False).count() == 2
    with pytest.raises(ValueError):
        stats.normalize(df, ["c"], "other")


def test_scores_of_large_groups_leave_no_group_to_one_task(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * i % 101), "large" if i % 3 else None) for i in range(300)] + [(300 + i, 7.0 + i % 2, "small") for i in range(5)] + [(305, 1.0, "one"), (306, None, "small")], "id INT, x DOUBLE, g STRING")
    want = rows(stats.z_scores(df, ["x"], ["g"]), "id")
    monkeypatch.setattr(stats, "GROUP", 50)
    got = stats.z_scores(df, ["x"], ["g"])
    assert got.columns == ["id", "x", "g", "x_zscore"] and [r[:3] for r in rows(got, "id")] == [r[:3] for r in want] and [r[3] for r in rows(got, "id")] == pytest.approx([r[3] for r in want])
    large, rest = stats.by_size(df, ["g"])
    assert large.groupBy("g").count().count() == 2 and large.count() == 300 and rest.count() == 7
    monkeypatch.setattr(stats, "GROUP", 0)
    assert [r[3] for r in rows(stats.z_scores(df, ["x"], ["g"]), "id")] == pytest.approx([r[3] for r in want])


def test_exact_quantiles_hold_no_count_of_all_values(spark):
    spike = lambda i: 5.0 if i % 10 < 6 else float(i)
    data = [(f"g{i % 3}" if i % 3 else None, float(i * 7919 % 6007) / 4 - 500, spike(i), None if i % 2 else -float(i % 4), float("nan") if i % 5 == 0 else float("inf") if i % 7 == 0 else float(i), None) for i in range(6000)]
    df = spark.createDataFrame([*data, ("single", -0.5, 1e300, -1e-300, 2.0, None), ("empty", None, None, None, None, None)], "g STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE")
    points, columns = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0), "abcde"
    for by in ([], ["g"]):
        for table in (df, df.where("a IS NULL"), df.where("false")):
            want = table.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, points))).alias(c) for c in columns])
            got = stats.quantiles(table, {c: F.col(c) for c in columns}, points, by)
            assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
            key = lambda r: repr(r[0])
            for a, b in zip(sorted(rows(got), key=key), sorted(rows(want), key=key), strict=True):
                assert a[: len(by)] == b[: len(by)]
                for x, y in zip(a[len(by) :], b[len(by) :]):
                    assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, nan_ok=True))


def test_exact_quantiles_are_right_whatever_the_sketch_says(spark, monkeypatch):
    monkeypatch.setattr(stats, "ACCURACY", 2)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("x"))
    assert stats.quantiles(df, {"x": F.col("x")}, (0.1, 0.5, 0.99)).first() == df.agg(F.percentile("x", F.array(*map(F.lit, (0.1, 0.5, 0.99))))).first()


def test_statistics_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 977), i % 3 and "large" or None) for i in range(600)] + [(1.0, "small"), (4.0, "small"), (None, "none")], "x DOUBLE, g STRING")
    made = [lambda: stats.percentiles(df, ["x"], by=["g"]), lambda: stats.distribution(df, ["x"], ["g"])]
    want = [sorted(rows(f()), key=repr) for f in made]
    monkeypatch.setattr(stats, "GROUP", 100)
    for f, before in zip(made, want):
        for a, b in zip(sorted(rows(f()), key=repr), before, strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


REPORTS = {
    "profile": lambda df, old: quality.profile(df, ["x"], exact=True),
    "iqr": lambda df, old: quality.anomalies(df, ["x"], exact=True),
    "zscore": lambda df, old: quality.anomalies(df, ["x"], "zscore", exact=True),
    "drift": lambda df, old: quality.drift(df, old, ["x"], exact=True),
    "quality": lambda df, old: quality.quality_report(df, ["x"], old, exact=True),
    "monitor": lambda df, old: quality.monitor(df, ["x"], exact=True),
    "rows": lambda df, old: quality.score_rows(df, ["x"], exact=True),
}


@pytest.mark.parametrize("name,scans", [("profile", 4), ("iqr", 5), ("zscore", 2), ("drift", 8), ("quality", 6), ("monitor", 6), ("rows", 5)])
def test_exact_reports_make_a_profile_once_and_count_no_values_in_one_task(spark, data, name, scans):
    df = spark.read.parquet(f"{data}/lineitem.parquet").select(F.col("l_extendedprice").alias("x"))
    plan = REPORTS[name](df, df)._jdf.queryExecution()
    assert "percentile(" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("FileScan") <= scans
    if name == "zscore":
        assert "percentile" not in plan.optimizedPlan().toString()


def test_reports(spark):
    df = spark.createDataFrame([(float(i % 10), 1.0, None if i < 30 else 2.0) for i in range(100)] + [(1000.0, 1.0, float("nan"))], "a DOUBLE, b DOUBLE, c DOUBLE")
    report = {r["feature"]: r for r in quality.quality_report(df, ["a", "b", "c"], df).collect()}
    assert report["a"]["outlier_score"] == 1.0 and report["b"]["distribution_score"] == 0.3 and report["c"]["null_score"] == pytest.approx(1 - 2 * 31 / 101) and report["a"]["drift_score"] == 1.0
    assert {r["feature"]: r["outliers"] for r in quality.anomalies(df, ["a", "b"]).collect()} == {"a": 1, "b": 0}
    assert {r["feature"]: r["drifted"] for r in quality.drift(df, df.withColumn("a", F.col("a") * 2), ["a", "b"]).collect()} == {"a": True, "b": False}
    monitored = quality.monitor(df, ["a", "c"])
    assert {r["feature"]: r["status"] for r in monitored.collect()} == {"a": "healthy", "c": "degraded"}
    assert [(r["feature"], r["metric"]) for r in quality.alerts(monitored).collect()] == [("c", "completeness")]
    assert quality.recommendations(quality.quality_report(df, ["b"])).first()["recommendations"]
    assert quality.quality_report(df.where("false"), ["a"]).first()["null_score"] == 0.0
    assert quality.freshness(df.withColumn("t", F.lit(None).cast("timestamp")), "t").first()["status"] == "very_stale"


# --- vectors


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    top = embeddings.top_k(df, k=1)
    assert sorted((r["query_id"], r["neighbor_id"], round(r["similarity"], 6)) for r in top.collect()) == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)]
    wide = embeddings.spread(df, size=2).orderBy("vec_id").collect()
    assert tuple(wide[3]) == (4, 0.0, 0.0) and tuple(wide[5]) == (6, 1.0, None)
    assert df.select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(1.0)))).collect()[4][0] is None


def test_embeddings_from_events(spark):
    df = spark.createDataFrame([(f"u{i % 7}", f"v{i % 5}", float(i % 3)) for i in range(60)] + [(None, "v1", 1.0)], "user_id STRING, video_id STRING, score DOUBLE")
    for how in ({"method": "als"}, {"method": "als", "rating": "score"}, {"method": "weighted"}, {"method": "simple"}):
        users, items = embeddings.build(df, size=6, **how)
        assert users.count() == 7 and items.count() == 5 and {len(r["embedding"]) for r in users.collect()} == {6}
    out = embeddings.add_embeddings(df, users, items)
    assert out.count() == 61 and out.where("user_embedding IS NULL").count() == 1
    with pytest.raises(ValueError):
        embeddings.build(df, method="other")
