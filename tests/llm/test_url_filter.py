import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import url_filter as U


def hashes(n, seed):
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, n, dtype=np.uint64), r.integers(0, 2**63, n, dtype=np.uint64)


@pytest.mark.parametrize("listed,others", [(0, 0), (0, 50), (50, 0), (1, 1), (300, 20_000), (20_000, 300), (5000, 5000)])
def test_cascade_is_exact_over_its_universe(listed, others):
    a, b = hashes(listed, 1), hashes(others, 2)
    levels = U.build(a, b)
    assert U.test(levels, *a).all() and not U.test(levels, *b).any()
    if listed == 300:
        assert sum(len(x.bits) for x in levels) * 8 < 20_000 * 2  # far less than a bit for each pair of hashes


def test_same_key_on_both_sides_is_refused():
    a = hashes(3, 1)
    with pytest.raises(ValueError):
        U.build(a, a)


@pytest.mark.parametrize("broadcast_mb,per_bucket", [(32, 200_000), (32, 100), (0, 100), (0, 200_000)])
def test_both_ways_give_what_a_join_gives(spark, broadcast_mb, per_bucket):
    urls = [(f"https://h{i % 37}.example/{i}",) for i in range(1500)]
    universe = spark.createDataFrame(urls + urls[:100], "url STRING")
    listed = universe.where(F.pmod(F.hash("url"), F.lit(9)) == 0).limit(10_000)
    cascade = U.Cascade.of(universe, listed.unionByName(listed), per_bucket)
    pages = universe.withColumns({"listed_": F.lit(5), "__h1": F.lit(1), "__bucket": F.lit("x"), "bucket": F.lit(2)}).unionByName(spark.createDataFrame([(None,)], "url STRING"), allowMissingColumns=True)
    if broadcast_mb == 0:
        pages = pages.drop("listed_")
    out = cascade.mark(pages, F.col("url"), broadcast_mb=broadcast_mb)
    assert out.columns == [*pages.columns, "listed"] and out.count() == 1601
    want = {x["url"] for x in listed.collect()}
    assert all(x["listed"] == (x["url"] in want) for x in out.collect())


def test_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(" HTTP://Ex.COM:80/Path?q=A#frag ",), ("no url",), (None,), ("",), ("//x#y",)], "u STRING")
    assert [x[0] for x in df.select(U.url_key(F.col("u"))).collect()] == ["http://ex.com:80/Path?q=A", "no url", None, "", "//x"]
    empty = df.where("false")
    cascade = U.Cascade.of(empty, empty)
    assert cascade.mark(empty, F.col("u")).count() == 0
    assert {x["listed"] for x in cascade.mark(df, F.col("u")).collect()} == {False}
    assert {x["listed"] for x in cascade.mark(df, F.col("u"), broadcast_mb=-1).collect()} == {False}
