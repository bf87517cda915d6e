"""Sources, sinks, jobs, control and streams, through real folders."""

import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone import schemas, session
from rillstone.control import launch, observe
from rillstone.control.registry import FeatureRegistry, compatible, missing_fields
from rillstone.control.tracker import PartitionTracker
from rillstone.operators import features
from rillstone.plans import jobs
from rillstone.sinks import lake as sink
from rillstone.sources import generator, kafka, lake
from rillstone.streaming import bronze, progress, windows


@pytest.fixture(scope="module")
def events(spark):
    return generator.events(spark, 500, span_ms=3 * 86_400_000)


def test_generator_is_the_same_for_a_seed(spark, events):
    again = generator.events(spark, 500, span_ms=3 * 86_400_000)
    assert events.exceptAll(again).count() == 0 and events.select("event_id").distinct().count() == 500
    assert events.where("device.type = ''").count() and events.where("device.type IS NULL").count()
    assert generator.events(spark, 10, seed=1).exceptAll(generator.events(spark, 10, seed=2)).count() == 10


def test_partitioned_reads_skip_folders(spark, tmp_path):
    path = str(tmp_path / "bronze")
    df = spark.range(96).select(F.col("id"), F.format_string("2024-01-%02d", (F.col("id") / 24 + 1).cast("int")).alias("dt"), (F.col("id") % 24).cast("int").alias("hr"), F.lit("view").alias("event_type"))
    sink.write(df, path, ("dt", "hr"))
    part = lake.read_bronze(spark, path, start="2024-01-02", end="2024-01-03", hours=[0, 5], where="id > 30")
    assert sorted(r["id"] for r in part.collect()) == [48, 53]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,30)]" in plan
    assert lake.read_partition(spark, path, "2024-01-01", 3).count() == 1
    assert lake.read_incremental(spark, path, "2024-01-03", 22).count() == 1 + 24  # later hours of the day, and all of the next
    assert lake.read_incremental(spark, path, lookback_days=1, today="2024-01-05").count() == 24
    assert lake.partitions(spark, path).count() == 96
    with pytest.raises(ValueError):
        lake.read_bronze(spark, path, hours=[24])
    listed = sink.manifest(spark, path).collect()
    assert len(listed) == 96 and all(r["rows"] == 1 and r["file_size"] > 0 for r in listed)
    sink.write_manifest(spark, path, str(tmp_path / "m"))
    assert lake.read_manifest(spark, str(tmp_path / "m")).count() == 96
    assert sink.delete_partitions(spark, path, ("dt", "hr"), "dt = '2024-01-01' AND hr < 4") == 4
    assert spark.read.parquet(path).count() == 92
    assert lake.lookup(spark, str(tmp_path / "none")) is None and lake.lookup(spark, path) is not None


def test_writing_one_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "silver")
    df = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3)], "event_date STRING, event_type STRING, n INT")
    sink.write(df, path, ("event_date", "event_type"))
    sink.write_partition(df.withColumn("n", F.col("n") * 10), path, "2024-01-01", "a")
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 3, 10]
    with pytest.raises(ValueError):
        sink.write(df, path, ("gone",))
    with pytest.raises(ValueError):
        sink.write(df, path, mode="other")


def silver_plan(spark):
    segments = spark.createDataFrame([(f"user-{i}", "gold") for i in range(500)], schemas.LOOKUPS["user_segments"])
    return jobs.SilverPlan({"user_segments": segments, "geo_ip": None})


def test_bronze_to_gold(spark, events, tmp_path):
    from rillstone.operators import parse

    messages = generator.messages(spark, 500, span_ms=3 * 86_400_000)
    raw = parse.normalize_bronze(parse.with_ingestion(parse.parse_messages(messages), F.lit("2024-01-04 05:00:00").cast("timestamp")))
    bad = raw.limit(5).withColumn("event_id", F.concat(F.lit("bad"), F.monotonically_increasing_id())).withColumn("content", F.lit(None).cast(raw.schema["content"].dataType)).withColumn("timestamp_ms", F.lit(None).cast("long"))
    plan = silver_plan(spark)
    plan.run(raw.unionByName(bad), str(tmp_path / "silver"), str(tmp_path / "dlq"))
    silver = lake.read_silver(spark, str(tmp_path / "silver"))
    assert silver.count() == 500 and set(silver.columns) == set(schemas.SILVER.names)
    assert silver.where("user_segment = 'gold'").count() > 0 and silver.where("ip_address NOT LIKE '%.0'").count() == 0
    letters = lake.read_dead_letters(spark, str(tmp_path / "dlq"))
    assert letters.count() == 5 and sink.dead_letter_stats(letters).count() >= 1
    assert lake.read_dead_letters(spark, str(tmp_path / "dlq"), reason="it's none").count() == 0
    as_of = F.lit("2024-01-05").cast("timestamp")
    reports = jobs.run_gold(silver, str(tmp_path / "gold"), "2024-01-05", as_of)
    assert set(reports) == {"user", "item", "session", "temporal"} and reports["user"].count() > 15
    users = spark.read.parquet(str(tmp_path / "gold" / "user"))
    assert users.count() == silver.select("user_id").distinct().count() and users.where("feature_type <> 'user'").count() == 0
    assert sink.partition_info(spark, str(tmp_path / "gold" / "user")).first()["rows"] == users.count()


def test_feature_store(spark, tmp_path):
    store = jobs.FeatureStore(spark, str(tmp_path / "store"))
    t = lambda d: datetime(2024, 1, d)
    store.write("watch", spark.createDataFrame([("u", t(1), 1.0), ("u", t(3), 3.0), ("v", t(2), 2.0)], "user_id STRING, event_timestamp TIMESTAMP, w DOUBLE"))
    asked = spark.createDataFrame([("u", t(2)), ("u", t(4)), ("w", t(4))], "user_id STRING, event_timestamp TIMESTAMP")
    assert sorted((r["user_id"], r["event_timestamp"].day, r["watch_w"]) for r in store.offline("watch", asked, ["user_id"], ["w"]).collect()) == [("u", 2, 1.0), ("u", 4, 3.0), ("w", 4, None)]
    store.materialize("watch", ["user_id"], "2024-01-01", "2024-01-02")
    keys = spark.createDataFrame([("u",), ("x",)], "user_id STRING")
    assert sorted((r["user_id"], r["w"]) for r in store.online("watch", keys, ["user_id"], ["w"]).collect()) == [("u", 1.0), ("x", None)]


def test_tracker(spark, tmp_path):
    tracker = PartitionTracker(spark, str(tmp_path / "t"))
    available = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", None)], "date STRING, hour INT")
    assert tracker.last() is None and tracker.unprocessed(available).count() == 3
    tracker.mark("2024-01-01", 1)
    tracker.mark("2024-01-01", 2, "failed")
    tracker.mark("2024-01-02")
    assert [tuple(r) for r in tracker.unprocessed(available).collect()] == [("2024-01-01", 2)]
    time.sleep(0.01)
    tracker.mark("2024-01-01", 2)
    assert tracker.unprocessed(available).count() == 0 and tracker.last() == ("2024-01-02", None) and tracker.processed(end="2024-01-01").count() == 2


def test_registry(spark, tmp_path):
    registry = FeatureRegistry(tmp_path / "r.json")
    registry.register("age", "INT", {"min": 0, "max": 120, "nullable": False})
    registry.register("kind", "STRING", {"allowed_values": ["a", "b"], "pattern": "[a-z]"})
    assert registry.register("age", "INT", {"min": 0, "max": 120, "nullable": False}).version == 1
    assert registry.register("age", "INT", {"min": 1}).version == 2
    assert registry.compare("age", 1, 2) == {"type": None, "rules": {"min": (0, 1), "max": (120, None), "nullable": (False, None)}, "compatible": True}
    again = FeatureRegistry(tmp_path / "r.json")
    df = spark.createDataFrame([(0, "a"), (5, "Z"), (None, None)], "age INT, kind STRING")
    got = {r["feature"]: r for r in again.validate(df).collect()}
    assert not got["age"]["valid"] and got["age"]["errors"] == ["min: 1"] and got["kind"]["errors"] == ["allowed_values: 1", "pattern: 1"]
    missing = FeatureRegistry()
    missing.register("gone", "ARRAY<FLOAT>")
    assert missing.validate(df).first()["errors"] == ["column is missing"]
    assert compatible(schemas.ddl("a INT, b STRING"), schemas.ddl("a BIGINT, c STRING")) == [] and len(compatible(schemas.ddl("a INT"), schemas.ddl("a STRING, b INT NOT NULL"))) == 2
    assert missing_fields({"a": {"b": None}}, schemas.ddl("a STRUCT<b: INT NOT NULL>, c INT NOT NULL")) == ["a.b", "c"]


def test_metrics_alerts_limits_and_retries():
    m = observe.Metrics()
    for i in range(1200):
        m.time("batch", i)
    m.count("rows", 5), m.count("rows"), m.gauge("lag", 2)
    s = m.summary()
    assert s["counters"] == {"rows": 6} and s["timers"]["batch"]["count"] == 1000 and s["timers"]["batch"]["min"] == 200 and s["timers"]["batch"]["p95"] == 1150
    assert json.loads(m.export("json")) and 'batch{quantile="0.99"}' in m.export("prometheus")
    assert [a["alert"] for a in observe.check_alerts({"error_rate": 0.06, "rows_per_second": 50, "batch_ms": 10})] == ["high error rate", "low throughput"]
    assert observe.check_alerts({}) == [] and observe.check_alerts({"quality_score": 0.6}, observe.SILVER_ALERTS)[0]["bound"] == 0.7
    now = [0.0]
    limit = observe.RateLimiter(2, 3, lambda: now[0])
    assert [limit.acquire() for _ in range(3)] == [True, True, False]
    now[0] = 1.0
    assert [limit.acquire() for _ in range(2)] == [True, False]  # the minute is used up
    tries, slept, failed = [], [], []

    def job():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("no")
        return "done"

    assert observe.with_retries(job, 3, 1, 2, sleep=slept.append) == "done" and slept == [1, 2]
    with pytest.raises(ZeroDivisionError):
        observe.with_retries(lambda: 1 / 0, 1, sleep=slept.append, on_failure=failed.append)
    assert len(failed) == 1


def test_kafka_options_and_messages(spark):
    config = {"kafka": {"bootstrap_servers": "h:1", "topics": {"a": {"name": "ta"}, "b": "tb"}, "consumer": {"starting_offsets": "earliest", "max_offsets_per_trigger": 7}}}
    assert kafka.options_from(config, "a", "b") == {"kafka.bootstrap.servers": "h:1", "subscribe": "ta,tb", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "7"}
    assert kafka.options("h", "t", {"t": {1: 5, 0: 2}})["startingOffsets"] == '{"t": {"0": 2, "1": 5}}'
    assert kafka.check_range(0, 5) and not kafka.check_range(5, 4) and not kafka.check_range(-1, 4)
    row = kafka.as_messages(spark.sql("SELECT 1 AS a, 'k' AS b"), "b", "t").first()
    assert (row["key"], row["value"], row["topic"]) == ("k", '{"a":1,"b":"k"}', "t")
    with pytest.raises(ValueError):
        kafka.options("h", [])


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a: {b: 1, c: 2}\n")
    (tmp_path / "environments.yaml").write_text("prod: {a: {b: 9}}\n")
    c = session.load_config(tmp_path / "c.yaml", "prod")
    assert c == {"a": {"b": 9, "c": 2}} and session.setting(c, "a.b") == 9 and session.setting(c, "a.x", 5) == 5
    with pytest.raises(KeyError):
        session.setting(c, "a.x")
    with pytest.raises(FileNotFoundError):
        session.load_config(tmp_path / "none.yaml")
    assert sink.interval("30s") == "30 seconds" and sink.interval("500ms") == "500 milliseconds" and sink.interval("1 minute") == "1 minute"


# --- streams


def files(df, path, n=1):
    df.repartition(n).write.mode("append").parquet(str(path))


def test_bronze_stream_is_exactly_once(spark, tmp_path):
    messages = generator.messages(spark, 300)
    broken = messages.limit(4).withColumn("value", F.lit("{broken").cast("binary"))
    files(messages.unionByName(broken), tmp_path / "in", 3)
    heard = []
    monitor = progress.Monitor(observe.Metrics(), (observe.AlertRule("rows", "rows", ">", 10),), heard.append)
    spark.streams.addListener(monitor)

    def run():
        source = lake.read_stream(spark, str(tmp_path / "in"), schemas.KAFKA, 1)
        q = bronze.write_bronze(bronze.to_bronze(source, "salt"), str(tmp_path / "bronze"), str(tmp_path / "dlq"), str(tmp_path / "ck"), every=None).start()
        q.awaitTermination()
        return q

    q = run()
    got = spark.read.parquet(str(tmp_path / "bronze"))
    assert got.count() == 300 and got.where("length(user_id) <> 64").count() == 0 and got.where("metadata.ip_address NOT LIKE '%.XXX'").count() == 0
    assert spark.read.parquet(str(tmp_path / "dlq")).groupBy("dlq_reason").count().collect()[0][:] == ("invalid_json", 4)
    run()
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 300
    assert progress.committed_batches(spark, str(tmp_path / "ck")) == [0, 1, 2] and progress.last_offsets(spark, str(tmp_path / "ck")) and progress.offsets(q) and progress.checkpoint_stats(q)["active"] is False
    for _ in range(50):
        if heard:
            break
        time.sleep(0.1)
    spark.streams.removeListener(monitor)
    assert heard and monitor.metrics.summary()["counters"]["rows"] >= 304
    assert progress.last_offsets(spark, str(tmp_path / "none")) is None and progress.starting_offset("checkpoint", fallback="earliest") == "earliest" and progress.stop_all(spark) == []


def test_windows_are_the_same_for_tables_and_streams(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/events.parquet").withColumnsRenamed({"ts": "event_timestamp", "value": "play_position_seconds"}).withColumn("video_id", F.col("event_id") % 5)
    files(df, tmp_path / "in", 2)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.watch_features(stream, delay=None).writeStream.format("memory").queryName("watch").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.watch_features(df, delay=None)
    assert spark.table("watch").exceptAll(batch).count() == 0 == batch.exceptAll(spark.table("watch")).count()


def test_append_stream_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([('{"user_id": "u", "action": "a", "timestamp": 5}',)], "value STRING")
    files(df, tmp_path / "in")
    bronze.json_lines(spark.readStream.schema("value STRING").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first()["timestamp"] == 5
    sink.stream(spark.readStream.schema("value STRING").parquet(str(tmp_path / "in")).withColumn("d", F.lit(1)), str(tmp_path / "o2"), str(tmp_path / "c2"), ("d",), None).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 1


def test_silver_transforms_run_on_streams(spark, tmp_path):
    files(generator.messages(spark, 50), tmp_path / "in")
    raw = bronze.to_bronze(lake.read_stream(spark, str(tmp_path / "in"), schemas.KAFKA), "salt")
    plan = silver_plan(spark)
    plan.strategy = None
    q = plan.shape(plan.transform(raw)).writeStream.format("memory").queryName("silver").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("silver").count() == 50


def test_backfill_for_some_entities(spark):
    df = spark.createDataFrame([("u", "v", datetime(2024, 1, 1), 5.0, "video_play_start"), ("w", "v", datetime(2024, 1, 1), 5.0, "video_play_start")], "user_id STRING, video_id STRING, event_timestamp TIMESTAMP, play_position_seconds DOUBLE, event_type STRING")
    points = df.select("user_id", F.lit(datetime(2024, 1, 2)).alias("as_of"))
    out = jobs.backfill(df, points, features.Events(), entities=points.where("user_id = 'u'").select("user_id"))
    assert [(r["user_id"], r["watch_time_7d"]) for r in out.collect()] == [("u", 5.0)]


def test_old_checkpoints_go_and_offsets_are_resumed(spark, tmp_path):
    for name in ("old", "new"):
        (tmp_path / name / "offsets").mkdir(parents=True)
        (tmp_path / name / "offsets" / "3").write_text('v1\n{"batchWatermarkMs":0}\n{"t":{"0":7}}')
    assert progress.starting_offset("checkpoint", str(tmp_path / "old"), spark=spark) == '{"t": {"0": 7}}'
    assert progress.starting_offset("checkpoint", str(tmp_path / "none"), "earliest", spark) == "earliest"
    assert progress.clean_checkpoints(spark, str(tmp_path), 7) == []
    for p in (*(tmp_path / "old").rglob("*"), tmp_path / "old"):
        os.utime(p, (1, 1))
    assert [x.rsplit("/", 1)[1] for x in progress.clean_checkpoints(spark, str(tmp_path), 7)] == ["old"] and (tmp_path / "new").exists()


def test_launcher(spark, tmp_path):
    silver = spark.sql("SELECT * FROM VALUES ('e1', 'video_play_start', 'u1', TIMESTAMP '2024-01-03 10:00:00', 5.0, 'v1'), ('e2', 'video_play_start', 'u1', TIMESTAMP '2024-01-04 11:00:00', 6.0, 'v2') AS t(event_id, event_type, user_id, event_timestamp, play_position_seconds, video_id)")
    silver = silver.withColumns({"event_date": F.date_format("event_timestamp", "yyyy-MM-dd"), "event_hour": F.hour("event_timestamp")})
    silver.write.partitionBy("event_date", "event_type").parquet(str(tmp_path / "silver"))
    assert launch.launch(["backfill", "--input", str(tmp_path / "silver"), "--output", str(tmp_path / "points"), "--start", "2024-01-04", "--end", "2024-01-05"], spark) == 2
    assert launch.launch(["backfill", "--input", str(tmp_path / "silver"), "--output", str(tmp_path / "points"), "--end", "2024-01-05", "--attempts", "2"], spark) == 0
    assert [(str(x["as_of"])[:10], x["total_events"]) for x in spark.read.parquet(str(tmp_path / "points")).orderBy("as_of").collect()] == [("2024-01-04", 1), ("2024-01-05", 2)]
    for bad in (["gold", "--input", "x"], ["none"]):
        with pytest.raises(SystemExit):
            launch.parser().parse_args(bad)
    assert launch.parser().parse_args(["silver", "--input", "a", "--output", "b", "--dead-letters", "c", "--last-date", "2024-01-01"]).last_hour is None
