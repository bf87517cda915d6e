"""Sessions and configuration."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: For a cluster; sizes that depend on the data are left to adaptive execution.
CLUSTER = {
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.files.maxRecordsPerFile": "1000000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.dynamicAllocation.enabled": "true",
    "spark.dynamicAllocation.shuffleTracking.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
LOCAL = CLUSTER | {"spark.dynamicAllocation.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}


def session(app: str = "rillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names have ``__`` for dots."""
    settings = (LOCAL if (master or "").startswith("local") else CLUSTER) | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | Path, environment: str | None = None) -> dict:
    """A YAML file, overlaid with the part of ``environments.yaml`` beside it that bears the environment's name. A missing file is an error."""
    import yaml

    path = Path(path)
    config = yaml.safe_load(path.read_text()) or {}
    if environment:
        overlay = yaml.safe_load((path.parent / "environments.yaml").read_text()) or {}
        if environment not in overlay:
            raise KeyError(f"environments.yaml has no {environment}")
        config = merge(config, overlay[environment] or {})
    return config


def setting(config: dict, dotted: str, default=None):
    """The value at a dotted path; a missing path gives the default, and raises if there is none."""
    at = config
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            if default is None:
                raise KeyError(dotted)
            return default
        at = at[part]
    return at
