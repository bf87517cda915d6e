"""URL filters as cascades of Bloom filters: exact membership over a known universe of keys.

Level 1 encodes the listed keys; level 2 the keys of the universe that level 1
takes for listed though they aren't; level 3 the listed keys that level 2 takes
for those; and so on until a level has no false positives. A key of the
universe is then listed or not by the parity of the first level that lacks it.

Keys are spread over buckets by hash, each with its own cascade, so building is
one shuffle of two 64-bit hashes per key at any number of keys. Testing doesn't
join: filters of up to BROADCAST_MB go to all executors and keys are tested
where they are; beyond that, rows go to the task that holds their bucket's
cascade, once, and are tested as they pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rillstone.llm import _tokens as T
from rillstone.llm._common import cut, fresh

KEYS_PER_BUCKET, BROADCAST_MB = 200_000, 32
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*"
_LEVELS = "bucket int, level int, m long, k int, bits binary"


def url_key(url: Column) -> Column:
    """A URL without blanks around it and without its fragment, its scheme and host in lower case; null stays null."""
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_extract(base, _HOST, 0)
    return F.concat(F.lower(host), F.substring(base, F.length(host) + 1, F.length(base)))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    a = T.mix(h1 + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    b = T.mix(h2 + np.uint64(level * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(m)


class Bloom:
    def __init__(self, level: int, m: int, k: int, bits: bytes | np.ndarray):
        self.level, self.m, self.k = level, m, k
        self.bits = np.frombuffer(bits, np.uint8) if isinstance(bits, bytes) else bits

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, level: int, rate: float) -> Bloom:
        k = max(1, round(-np.log2(rate)))
        m = max(8, int(np.ceil(len(h1) * -np.log(rate) / np.log(2) ** 2)))
        made = cls(level, m, k, np.zeros((m + 7) // 8, np.uint8))
        at = _places(h1, h2, level, m, k).ravel()
        np.bitwise_or.at(made.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return made

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = _places(h1, h2, self.level, self.m, self.k)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build(listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> list[Bloom]:
    """The cascade of disjoint sets of keys, each as two arrays of 64-bit hashes."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while len(inside[0]):
        n = len(levels) + 1
        rate = min(0.5, max(1e-6, len(inside[0]) * 0.5**0.5 / max(1, len(outside[0])))) if n == 1 else 0.5
        levels.append(Bloom.of(*inside, n, rate))
        wrong = levels[-1].has(*outside)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
        if n > 200:
            raise ValueError("a key is both listed and not: two keys share 128 bits of hash")
    return levels


def test(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys are listed, by the first level that lacks them."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    todo = np.arange(len(h1))
    for n, level in enumerate(levels, 1):
        has = level.has(h1[todo], h2[todo])
        out[todo[~has]] = n % 2 == 0
        todo = todo[has]
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _bucket(h1: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(h1, 32), F.lit(buckets)).cast("int")


def _u64(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def _build(table: pa.Table) -> pa.Table:
    h1, h2, listed = table["h1"].to_numpy(), table["h2"].to_numpy(), table["listed"].to_numpy()
    order = np.lexsort((-listed, h2, h1))
    h1, h2, listed = h1[order], h2[order], listed[order].astype(bool)
    first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    a, b = first & listed, first & ~listed
    levels = build((_u64(h1[a]), _u64(h2[a])), (_u64(h1[b]), _u64(h2[b])))
    bucket = table["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket] * len(levels), pa.int32()), "level": pa.array([x.level for x in levels], pa.int32()), "m": pa.array([x.m for x in levels], pa.int64()), "k": pa.array([x.k for x in levels], pa.int32()), "bits": pa.array([x.bits.tobytes() for x in levels], pa.binary())})


class Cascade:
    """The filters as a table in the shared folder."""

    def __init__(self, filters: DataFrame, buckets: int):
        self.filters, self.buckets = filters, buckets

    @classmethod
    def of(cls, universe: DataFrame, listed: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> Cascade:
        """From one-column tables: all keys that will be asked for, and the listed ones (which belong to the universe too). Null keys are left out, repeats don't matter."""
        parts = [df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("key")).where("key IS NOT NULL").select(*_hashes(F.col("key")), F.lit(flag).alias("listed")) for df, flag in ((universe, 0), (listed, 1))]
        keys = parts[0].unionByName(parts[1])
        buckets = max(1, -(-universe.count() // keys_per_bucket))
        made = keys.withColumn("bucket", _bucket(F.col("h1"), buckets)).groupBy("bucket").applyInArrow(_build, _LEVELS)
        return cls(cut(made, "cascade"), buckets)

    def mark(self, df: DataFrame, key: Column, name: str = "listed", broadcast_mb: float = BROADCAST_MB) -> DataFrame:
        """df with a column that says whether the row's key is listed; a null key isn't.

        All rows and columns stay (a column of that name is replaced), repeated rows too; exact for keys of the universe;
        an empty table gives an empty one, and with no listed keys nothing is.
        """
        size = self.filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        h1, h2, bucket = fresh(df, "__h1", "__h2", "__bucket")
        hashed = [x.alias(n) for x, n in zip(_hashes(key.cast("string")), (h1, h2))]
        if size <= broadcast_mb * (1 << 20):
            held = [(r["bucket"], Bloom(r["level"], r["m"], r["k"], bytes(r["bits"]))) for r in self.filters.orderBy("bucket", "level").collect()]
            cascades: dict[int, list[Bloom]] = {}
            for b, bloom in held:
                cascades.setdefault(b, []).append(bloom)

            @F.pandas_udf("boolean")
            def listed(b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
                return pd.Series(_test_all(cascades, b.to_numpy(), _u64(x), _u64(y)))

            return df.withColumn(name, F.coalesce(key.isNotNull() & listed(_bucket(hashed[0], self.buckets), *hashed), F.lit(False)))
        # beyond that, rows go to their bucket's task, where its filters come before them: one shuffle, no join
        row, at, bits = fresh(df, "__row", "__at", "__bits")
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(self.buckets)).cast("int")  # a null key asks nothing, so any bucket will do
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != name)).alias(row), *hashed, key.isNotNull().alias(at))
        rows = rows.select(row, F.when(F.col(at), _bucket(F.col(h1), self.buckets)).otherwise(spread).alias(bucket), F.when(F.col(at), F.col(h1)).alias(h1), F.col(h2), F.lit(1).alias(at), F.lit(None).cast("binary").alias(bits))
        filters = self.filters.select(F.lit(None).cast(rows.schema[row].dataType).alias(row), F.col("bucket").alias(bucket), F.col("m").alias(h1), F.col("k").cast("long").alias(h2), (F.col("level") - 1000).alias(at), F.col("bits").alias(bits))
        both = filters.unionByName(rows).repartition(bucket).sortWithinPartitions(bucket, at)
        tested = both.mapInArrow(lambda it: _routed(it, row, bucket, h1, h2, at, bits, name), StructType([StructField(row, rows.schema[row].dataType), StructField(name, BooleanType())]))
        return tested.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in df.columns if c != name], name)


def _routed(batches: Iterator[pa.RecordBatch], row: str, bucket: str, h1: str, h2: str, at: str, bits: str, name: str) -> Iterator[pa.RecordBatch]:
    """Rows with their answers, from rows sorted by bucket, a bucket's filters first; at is 1 for a row, the level less 1000 for a filter."""
    now, levels = None, []
    for batch in batches:
        owner, kinds = batch[bucket].to_numpy(), batch[at].to_numpy()
        out = np.zeros(batch.num_rows, bool)
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if owner[a] != now:
                now, levels = owner[a], []
            for i in (a + np.flatnonzero(kinds[a:b] != 1)).tolist():
                levels.append(Bloom(int(kinds[i]) + 1000, batch[h1][i].as_py(), batch[h2][i].as_py(), batch[bits][i].as_py()))
            ask = a + np.flatnonzero((kinds[a:b] == 1) & batch[h1].slice(a, b - a).is_valid().to_numpy(zero_copy_only=False))
            if len(ask) and levels:
                keys = pa.array(ask)
                out[ask] = test(levels, _u64(batch[h1].take(keys)), _u64(batch[h2].take(keys)))
        rows = pa.array(np.flatnonzero(kinds == 1))
        yield pa.RecordBatch.from_arrays([batch[row].take(rows), pa.array(out).take(rows)], [row, name])


def _test_all(cascades: dict[int, list[Bloom]], bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), bool)
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        out[at] = test(cascades.get(int(b), []), h1[at], h2[at])
    return out
