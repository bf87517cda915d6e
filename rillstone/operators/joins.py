"""Enrichment, known and unknown keys, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup goes to all executors if Spark's estimate of it is at most this; else the join shuffles, and adaptive execution handles skew.
BROADCAST_BYTES = 10 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate, from file sizes and statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint only where its size is known to be small."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def enrich(df: DataFrame, lookup: DataFrame | None, on: str | list[str], columns: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with the lookup's columns, by left join. Rows never multiply: of several lookup rows with a key the least counts.

    Columns of these names that df has already (placeholders) are replaced. A
    null key finds nothing. Without a lookup df stays as it is.
    """
    if lookup is None:
        return df
    on = [on] if isinstance(on, str) else on
    columns = [c for c in (columns or lookup.columns) if c not in on]
    one = lookup.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)).groupBy(*on).agg(F.min(F.struct(*columns)).alias("__row")).select(*on, "__row.*")
    return df.drop(*columns).join(if_small(one, limit), on, "left")


def enrich_all(df: DataFrame, lookups: dict[str, DataFrame | None], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Segments by user, categories by video, places by IP address; those that are given."""
    for name, on in (("user_segments", "user_id"), ("video_catalog", "video_id"), ("geo_ip", "ip_address")):
        df = enrich(df, lookups.get(name), on, limit=limit)
    return df


def known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def unknown(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def combine(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Feature tables of the same entity side by side, by full outer join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, "full_outer")
    return out


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], tolerance: Column | None = None, prefix: str = "") -> DataFrame:
    """left with the columns of the latest right row of the same key that isn't later; never reads the future.

    Both sides are put together, shuffled once by key and sorted by time; the
    last right row seen is carried along. No row is multiplied. Of right rows
    with the same time, the greatest (by the columns) counts. ``tolerance``, an
    interval, bounds how old it may be. Left rows with a null key or time get
    nulls. prefix is put before the columns' names and before right_time.
    """
    mine, theirs = "__left", "__right"
    a = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias(mine))
    row = F.struct(F.col(right_time).alias("__at"), *[F.col(f"`{c}`") for c in columns])
    b = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), row.alias(theirs))
    keys = [f"__k{i}" for i in range(len(on))]
    both = a.unionByName(b, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("__t", "__side", theirs).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last(theirs, ignorenulls=True).over(past)).where("__side = 1")
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    if tolerance is not None:
        usable = usable & (F.col("__seen.__at") >= F.col("__t") - tolerance)
    found = F.when(usable, F.col("__seen"))
    return seen.withColumn("__seen", found).select(f"{mine}.*", F.col("__seen.__at").alias(f"{prefix}{right_time}"), *[F.col(f"__seen.`{c}`").alias(f"{prefix}{c}") for c in columns])


def latest(df: DataFrame, on: list[str], time: str) -> DataFrame:
    """The latest row of each key (of equals the greatest), as an online store serves it."""
    rest = [c for c in df.columns if c not in on]
    return df.groupBy(*on).agg(F.max(F.struct(time, *[F.col(f"`{c}`") for c in rest if c != time])).alias("__row")).select(*on, *[f"__row.`{c}`" for c in rest])
