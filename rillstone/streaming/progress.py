"""What a running stream tells: progress, offsets, checkpoints; and an orderly end."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rillstone.control.observe import AlertRule, BRONZE_ALERTS, Metrics, check_alerts


def measures(progress: dict) -> dict[str, float]:
    """Rows, rates and times of a batch, from a progress report."""
    rows = progress.get("numInputRows") or 0
    dropped = sum(s.get("numRowsDroppedByWatermark") or 0 for s in progress.get("stateOperators") or [])
    return {"rows": rows, "rows_per_second": progress.get("processedRowsPerSecond") or 0.0, "batch_ms": (progress.get("durationMs") or {}).get("triggerExecution", 0), "late_rows": dropped, "state_rows": sum(s.get("numRowsTotal") or 0 for s in progress.get("stateOperators") or [])}


class Monitor(StreamingQueryListener):
    """Keeps metrics of all streams of a session, and hands alerts on; no thread polls."""

    def __init__(self, metrics: Metrics, rules: tuple[AlertRule, ...] = BRONZE_ALERTS, notify=print):
        self.metrics, self.rules, self.notify = metrics, rules, notify

    def onQueryStarted(self, event) -> None:
        self.metrics.count("streams_started")

    def onQueryProgress(self, event) -> None:
        m = measures(json.loads(event.progress.json))
        self.metrics.count("rows", m["rows"])
        self.metrics.count("late_rows", m["late_rows"])
        self.metrics.time("batch_ms", m["batch_ms"])
        if m["rows"]:
            for a in check_alerts(m, self.rules):
                self.notify(a)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.count("streams_failed" if event.exception else "streams_ended")


def offsets(query: StreamingQuery) -> list[dict]:
    """Start and end offset of each source in the last batch."""
    p = query.lastProgress
    return [{"source": s["description"], "start": s["startOffset"], "end": s["endOffset"]} for s in p["sources"]] if p else []


def checkpoint_path(base: str, job: str) -> str:
    return f"{base.rstrip('/')}/{job}"


def _batches(spark: SparkSession, checkpoint: str, kind: str) -> tuple[object, dict[int, object]]:
    """The file system of a checkpoint, and the files of a folder of it by batch; whatever file system Hadoop knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/{kind}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return fs, {int(s.getPath().getName()): s.getPath() for s in found if s.getPath().getName().isdigit()}


def committed_batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the batches that a checkpoint says are done."""
    return sorted(_batches(spark, checkpoint, "commits")[1])


def last_offsets(spark: SparkSession, checkpoint: str) -> list[dict] | None:
    """Source offsets of the last batch that a checkpoint planned; None where there is none."""
    fs, files = _batches(spark, checkpoint, "offsets")
    if not files:
        return None
    stream = fs.open(files[max(files)])
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return [json.loads(x) for x in text.split("\n")[2:] if x and x != "-"]


def starting_offset(strategy: str, checkpoint: str | None = None, fallback: str = "latest", spark: SparkSession | None = None) -> str:
    """Spark's startingOffsets: earliest, latest, or, by ``checkpoint``, the last offsets of a checkpoint as JSON; where it has none (or isn't given) the fallback holds."""
    if strategy in ("earliest", "latest"):
        return strategy
    if strategy != "checkpoint":
        raise ValueError(f"no such strategy: {strategy}")
    found = last_offsets(spark, checkpoint) if spark is not None and checkpoint else None
    return json.dumps(found[0]) if found else fallback


def clean_checkpoints(spark: SparkSession, base: str, older_than_days: float, now_ms: int | None = None) -> list[str]:
    """Removes the checkpoints under a folder that nothing has been written to for so many days, and gives their paths; none of a running stream may be among them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = (int(time.time() * 1000) if now_ms is None else now_ms) - older_than_days * 86_400_000
    gone = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        parts = fs.listStatus(s.getPath()) if s.isDirectory() else []
        files = [f for p in parts for f in (fs.listStatus(p.getPath()) if p.isDirectory() else [p])]
        if parts and max([s.getModificationTime(), *(f.getModificationTime() for f in files)]) < limit:
            fs.delete(s.getPath(), True)
            gone.append(str(s.getPath()))
    return sorted(gone)


def checkpoint_stats(query: StreamingQuery) -> dict:
    p = query.lastProgress
    return {"id": str(query.id), "run_id": str(query.runId), "batch": p["batchId"] if p else None, "rows": p["numInputRows"] if p else 0, "active": query.isActive}


def retain(spark: SparkSession, batches: int) -> None:
    """How many batches checkpoints keep; Spark removes older ones."""
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", batches)


def stop_all(spark: SparkSession, seconds: int = 60) -> list[str]:
    """Stops the session's streams, waits for each, and gives the names of those that didn't end."""
    late = []
    for q in spark.streams.active:
        q.stop()
        if not q.awaitTermination(seconds):
            late.append(q.name or str(q.id))
    return late
