"""Sharding by jump consistent hashing.

A key's shard follows from its hash alone, without a table of the ring; if
shards are appended, a key either stays or moves to one of the new shards, and
only the share that these need moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach's algorithm), for all keys at once."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(todo):
        out[todo] = at
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = np.floor((out[todo] + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = at < shards
        todo, key, at = todo[on], key[on], at[on]
    return out


def key_hash(*keys: Column) -> Column:
    """64 bits of the md5 of the keys' text; a null key counts as an empty one."""
    text = F.concat_ws("\u0001", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def shard(hashed: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit hash; only the hash goes to Python, in Arrow batches."""

    @F.pandas_udf("int")
    def jumped(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64), shards).astype(np.int32))

    return jumped(hashed)


def assign(df: DataFrame, keys: list[str], shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """df with a shard for each row. Rows of equal keys share a shard; null keys count as empty; all rows and columns stay (a column of that name is replaced); an empty table gives an empty one."""
    return df.withColumn(name, shard(key_hash(*(F.col(f"`{k}`") for k in keys)), shards))


def write_shards(df: DataFrame, path: str, keys: list[str], shards: int = SHARDS) -> None:
    """Writes df as Parquet, one folder for each shard; rows are moved once, to the task that writes their shard.

    Null keys count as empty, so their rows share a shard; repeated rows are all written; an empty table writes no shard.
    """
    assign(df, keys, shards).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
