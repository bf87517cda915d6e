"""One query for each operator of this subpackage, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontaminate, license_scan, line_dedup, ngram_join, packing, quotation, sharding, tiff, tiff_writer, toxicity, url_filter
from rillstone.llm._common import table

#: op1 shows the shards before and after this many are appended.
SHARDS, APPENDED = 1024, 64


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 1024, and where it is once 64 shards are appended."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    hashed = docs.withColumn("hash", sharding.key_hash(F.col("doc_id")))
    return hashed.select("doc_id", "source", sharding.shard(F.col("hash"), SHARDS).alias("shard"), sharding.shard(F.col("hash"), SHARDS + APPENDED).alias("shard_grown"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with whether its URL is listed. The tables hold no block list: the URLs whose md5 begins with 0 or 1 stand for one."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.url_key(F.col("url")).alias("url"))
    keys = pages.select("url").distinct()
    cascade = url_filter.Cascade.of(keys, keys.where(F.substring(F.md5("url"), 1, 1).isin("0", "1")))
    return cascade.mark(pages, F.col("url"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), short=True)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ways = ((tiff_writer.NONE, 1, 0), (tiff_writer.PACKBITS, 1, 0), (tiff_writer.LZW, 2, 0), (tiff_writer.DEFLATE, 2, 16))
    for batch in batches:
        files = []
        flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch["embedding"]), 0).to_numpy(zero_copy_only=False))
        for key, start, end in zip(batch["vec_id"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            width = max(1, int((end - start) ** 0.5))
            values = flat[start : start + (end - start) // width * width].reshape(-1, width)
            if not values.size:
                files.append(None)
                continue
            scaled = np.clip((values + 1) / 2, 0, 1)
            method, predictor, tile = ways[key % 4]
            files.append(tiff_writer.write([np.floor(scaled * 255).astype(np.uint8), np.floor(scaled * 65535).astype(np.uint16)], method, predictor, tile, order="<>"[key // 4 % 2]))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(files, pa.binary())], ["vec_id", "media"])


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one TIFF file for each embedding. The tables hold no images: an embedding is drawn as a page of 8-bit and one of 16-bit samples, in four kinds of compression."""
    files = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(_drawn, "vec_id long, media binary")
    found = tiff.pages(files, "media")
    return found.select("vec_id", "page", "width", "height", "samples", "bits", "compression", "predictor", F.lower(F.hex("pixels")).alias("pixels"), "error")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from mail threads. The table's messages hold no quotes, so they are first written as threads that quote what they answer."""
    return quotation.link(quotation.with_quotes(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_jump_sharding, op2_url_filter, op3_toxicity, op4_decontaminate, op5_ngram_jaccard_join, op6_best_fit_packing, op7_tiff_pages, op8_line_dedup, op9_license_scan, op10_quotation_linking)}

_KEY = "(lower(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || substr(base, length(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1))"
ORACLE_SQL: dict[str, str] = {
    "op1_jump_sharding": f"""
WITH RECURSIVE k AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS key FROM documents),
walk AS (
  SELECT doc_id, n, key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM k, (VALUES ({SHARDS}), ({SHARDS + APPENDED})) t(n)
  UNION ALL
  SELECT doc_id, n, k2 AS key, j AS b, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592 AS DOUBLE) + 1))) AS BIGINT) AS j
  FROM (SELECT doc_id, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n)),
ends AS (SELECT doc_id, n, max(b) AS b FROM walk WHERE j >= n GROUP BY doc_id, n)
SELECT d.doc_id, d.source, CAST(a.b AS INTEGER) AS shard, CAST(g.b AS INTEGER) AS shard_grown
FROM documents d JOIN ends a ON a.doc_id = d.doc_id AND a.n = {SHARDS} JOIN ends g ON g.doc_id = d.doc_id AND g.n = {SHARDS + APPENDED}""",
    "op2_url_filter": f"""
SELECT page_id, {_KEY} AS url, substr(md5({_KEY}), 1, 1) IN ('0', '1') AS listed
FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS base FROM pages)""",
    "op7_tiff_pages": """
WITH p AS (SELECT vec_id, embedding, unnest([0, 1]) AS page FROM embeddings)
SELECT vec_id, CAST(page AS INTEGER) AS page, 8 AS width, 8 AS height, 1 AS samples, CASE page WHEN 0 THEN 8 ELSE 16 END AS bits,
  CAST(CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 32773 WHEN 2 THEN 5 ELSE 8 END AS INTEGER) AS compression,
  CASE WHEN vec_id % 4 < 2 THEN 1 ELSE 2 END AS predictor,
  array_to_string(list_transform(embedding, lambda x: CASE page
    WHEN 0 THEN format('{:02x}', CAST(floor(least(1, greatest(0, (x::DOUBLE + 1) / 2)) * 255) AS INTEGER))
    ELSE format('{:02x}', CAST(floor(least(1, greatest(0, (x::DOUBLE + 1) / 2)) * 65535) AS INTEGER) % 256) || format('{:02x}', CAST(floor(least(1, greatest(0, (x::DOUBLE + 1) / 2)) * 65535) AS INTEGER) // 256) END), '') AS pixels,
  CAST(NULL AS VARCHAR) AS error
FROM p""",
    "op10_quotation_linking": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
    CASE WHEN turn = 0 THEN NULL WHEN (conv_id + turn) % 3 = 0 AND turn >= 2 THEN turn - 2 ELSE turn - 1 END AS parent
  FROM conversations),
tree AS (
  SELECT conv_id, turn, 0 AS depth, lpad(CAST(turn AS VARCHAR), 8, '0') AS path FROM m WHERE parent IS NULL
  UNION ALL
  SELECT m.conv_id, m.turn, t.depth + 1, t.path || '.' || lpad(CAST(m.turn AS VARCHAR), 8, '0') FROM m JOIN tree t ON m.conv_id = t.conv_id AND m.parent = t.turn)
SELECT m.conv_id, CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY t.path) - 1 AS INTEGER) AS position, m.turn, m.parent AS parent_turn, CAST(t.depth AS INTEGER) AS depth, m.role, m.text
FROM m JOIN tree t USING (conv_id, turn)""",
}
