"""Embeddings: from ALS or co-occurrence, their use as features, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import vectors
from rillstone.operators.joins import enrich

#: Queries are sent to the executors in blocks of at most so many numbers (32 MB).
BLOCK_NUMBERS = 1 << 22


def ratings(df: DataFrame, user: str, item: str, rating: str | None = None) -> DataFrame:
    """(user, item, rating): the mean rating, or how often they met."""
    value = F.avg(rating) if rating else F.count("*").cast("double")
    return df.where(F.col(user).isNotNull() & F.col(item).isNotNull()).groupBy(user, item).agg(value.cast("float").alias("rating"))


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """Each value with an integer, by its place in its partition after sorting; no single task sees them all."""
    values = df.select(F.col(column).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    counted = values.withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    starts = counted.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    return counted.join(F.broadcast(starts.select("part", "start")), "part").select("value", (F.col("start") + F.col("at") - 1).cast("int").alias("number"))


def als(df: DataFrame, user: str, item: str, rating: str | None = None, size: int = 50, iterations: int = 10, regularization: float = 0.1, seed: int = 42, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """User and item embeddings (id, embedding) by alternating least squares; implicit if there is no rating column."""
    from pyspark.ml.recommendation import ALS

    met = ratings(df, user, item, rating)
    users, items = _numbered(met, user).persist(), _numbered(met, item).persist()
    numbered = met.join(users.withColumnsRenamed({"value": user, "number": "u"}), user).join(items.withColumnsRenamed({"value": item, "number": "i"}), item).select("u", "i", "rating")
    model = ALS(rank=size, maxIter=iterations, regParam=regularization, implicitPrefs=rating is None, alpha=alpha, seed=seed, userCol="u", itemCol="i", ratingCol="rating", coldStartStrategy="drop").fit(numbered)
    named = [f.join(n, f["id"] == n["number"]).select(F.col("value").alias(k), F.col("features").alias("embedding")) for f, n, k in ((model.userFactors, users, user), (model.itemFactors, items, item))]
    return named[0], named[1]


def co_occurrence(df: DataFrame, user: str, item: str, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """Embeddings without training: counts of partners, hashed to ``size`` signed places, of unit length."""
    met = ratings(df, user, item)

    def of(key: str, other: str) -> DataFrame:
        h = F.xxhash64(F.col(other).cast("string"))
        signed = F.when(h >= 0, 1.0).otherwise(-1.0) * F.log1p("rating")
        by = met.groupBy(key, F.pmod(F.shiftrightunsigned(h, 8), F.lit(size)).alias("at")).agg(F.sum(signed).alias("v"))
        out = by.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0)))
        raw = out.select(key, vector.alias("v"))
        return raw.select(key, F.transform("v", lambda x: F.coalesce(F.try_divide(x, vectors.norm(F.col("v"))), F.lit(0.0)).cast("float")).alias("embedding"))

    return of(user, item), of(item, user)


def build(df: DataFrame, user: str = "user_id", item: str = "video_id", rating: str | None = None, method: str = "als", size: int = 50) -> tuple[DataFrame, DataFrame]:
    if method == "als":
        return als(df, user, item, rating, size)
    if method == "weighted":
        return als(df, user, item, None, size, alpha=40.0)
    if method == "simple":
        return co_occurrence(df, user, item, size)
    raise ValueError(f"no such method: {method}")


def add_embeddings(df: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "video_id") -> DataFrame:
    """df with user_embedding and item_embedding; null where there is none."""
    df = enrich(df, users.withColumnRenamed("embedding", "user_embedding"), user)
    return enrich(df, items.withColumnRenamed("embedding", "item_embedding"), item)


def spread(df: DataFrame, vector: str = "embedding", size: int = 64, prefix: str = "emb_", keep: list[str] | None = None) -> DataFrame:
    """df with the vector's numbers as columns, without a UDF."""
    return df.select(*(keep or [c for c in df.columns if c != vector]), *vectors.dimensions(F.col(vector), size, prefix))


def _nearest(batches: Iterator[pa.RecordBatch], ids: list, matrix: np.ndarray, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    width = matrix.shape[1] if len(matrix) else 0
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object)) for _ in ids]
    numbers = {x: i for i, x in enumerate(ids)}
    for batch in batches:
        good = [(i, v) for i, v in zip(batch["id"].to_pylist(), batch["vector"].to_pylist()) if v is not None and len(v) == width and None not in v]
        if not good or not width:
            continue
        rows = np.array([v for _, v in good], np.float64)
        length = np.linalg.norm(rows, axis=1)
        rows, own = rows[length > 0] / length[length > 0, None], np.array([i for (i, _), n in zip(good, length) if n > 0], object)
        scores = matrix @ rows.T
        if same:
            for j, i in enumerate(own):
                if i in numbers:
                    scores[numbers[i], j] = -np.inf
        for q in range(len(ids)):
            s, n = np.concatenate([best[q][0], scores[q]]), np.concatenate([best[q][1], own])
            if len(s) > k:
                keep = np.lexsort((n, -np.round(s, 12)))[:k]
                s, n = s[keep], n[keep]
            best[q] = (s, n)
    out = [(ids[q], n, float(s)) for q, (ss, ns) in enumerate(best) for s, n in zip(ss, ns) if s > -np.inf]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "neighbor_id", "similarity"])


def top_k(embeddings: DataFrame, queries: DataFrame | None = None, id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity): each query's k nearest vectors by cosine, exactly; equals by id.

    Every task keeps the k best of its rows for each query, so only k rows per
    query and task are shuffled. Queries (all vectors by default, never paired
    with themselves) go out in blocks of bounded size.
    """
    same = queries is None
    asked = (embeddings if same else queries).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    width, count = asked.agg(F.max(F.size("vector")), F.count("*")).first()
    blocks = max(1, -(-(count or 0) * (width or 1) // BLOCK_NUMBERS))
    rows = embeddings.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    out = None
    for b in range(blocks):
        block = [(r["id"], r["vector"]) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect() if len(r["vector"]) == width and None not in r["vector"]]
        matrix = np.array([v for _, v in block], np.float64).reshape(len(block), width or 0)
        length = np.linalg.norm(matrix, axis=1)
        ids, matrix = [i for (i, _), n in zip(block, length) if n > 0], matrix[length > 0] / length[length > 0, None]
        part = rows.mapInArrow(_finder(ids, matrix, k), "query_id long, neighbor_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "neighbor_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "similarity")


def _finder(ids: list, matrix: np.ndarray, k: int):
    return lambda batches: _nearest(batches, ids, matrix, k, True)


def similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    return df.withColumn(name, vectors.cosine(F.col(a), F.col(b)))


def score(a: Column, b: Column) -> Column:
    return vectors.dot(a, b)
