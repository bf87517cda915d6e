import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import sharding as S


def plain(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=20), st.integers(1, 5000))
def test_same_as_the_scalar_algorithm(keys, shards):
    assert S.jump(np.array(keys, np.int64), shards).tolist() == [plain(k % 2**64, shards) for k in keys]


def test_only_the_share_of_new_shards_moves_and_only_there():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    a, b = S.jump(keys, 100), S.jump(keys, 110)
    moved = a != b
    assert (b[moved] >= 100).all() and abs(moved.mean() - 10 / 110) < 0.005
    assert np.bincount(a, minlength=100).min() > 1700


def test_edge_cases(spark, edge_docs, no_docs):
    out = S.assign(edge_docs, ["doc_id", "text"])
    assert set(out.columns) == set(edge_docs.columns) and out.count() == edge_docs.count()
    assert out.where("shard IS NULL OR shard < 0 OR shard >= 1024").count() == 0
    by_id = S.assign(edge_docs, ["doc_id"], 7).select("doc_id", "shard").distinct()
    assert by_id.count() == by_id.select("doc_id").distinct().count()
    assert S.assign(no_docs, ["doc_id"]).count() == 0
    assert {x["shard"] for x in S.assign(edge_docs, ["doc_id"], 1).collect()} == {0}


def test_written_shards_hold_their_keys(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    S.write_shards(df, str(tmp_path / "s"), ["doc_id"], 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and S.assign(back, ["doc_id"], 8, "again").where("again <> shard").count() == 0
