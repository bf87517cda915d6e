import numpy as np
import pytest

from rillstone.llm import packing as P
from tests.llm.conftest import prose


def check(rows, docs, capacity):
    want = sorted((d is None, d or 0, len(t.split())) for d, t in docs if t and t.split())
    packs, got = {}, {}
    for x in rows:
        packs.setdefault(x["pack_id"], []).append(x)
    for p in packs.values():
        assert sum(x["n_tokens"] for x in p) <= capacity
        assert sorted(x["slot"] for x in p) == list(range(len(p)))
    for x in rows:
        got.setdefault((x["doc_id"] is None, x["doc_id"] or 0), []).append((x["piece"], x["first_token"], x["n_tokens"]))
    total = sum(n for *_, n in want)
    assert sum(x["n_tokens"] for x in rows) == total
    for key, pieces in got.items():
        assert sum(n for _, _, n in pieces) == sum(n for a, b, n in want if (a, b) == key)
        assert all(first == piece * capacity for piece, first, _ in pieces)
    return len(packs), total


@pytest.mark.parametrize("capacity,cell", [(100, 10_000), (64, 25)])
def test_packs_hold_all_tokens_and_few_are_needed(spark, capacity, cell):
    r = np.random.default_rng(1)
    docs = [(i, prose(i, int(n))) for i, n in enumerate(np.exp(r.normal(3.4, 0.8, 200)).astype(int))]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    rows = P.pack(df, capacity, cell).collect()
    packs, total = check(rows, docs, capacity)
    assert packs <= np.ceil(total / capacity) * (1.02 if cell > 200 else 1.15) + 1
    again = P.pack(df.repartition(3), capacity, cell).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))  # the same whatever task runs it


def test_small_cases_are_optimal():
    def least(lengths, capacity):
        best = [len(lengths)]

        def place(i, room):
            if len(room) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(room)
                return
            for k in range(len(room)):
                if room[k] >= lengths[i]:
                    room[k] -= lengths[i]
                    place(i + 1, room)
                    room[k] += lengths[i]
            room.append(capacity - lengths[i])
            place(i + 1, room)
            room.pop()

        place(0, [])
        return best[0]

    r = np.random.default_rng(3)
    for _ in range(15):
        lengths = r.integers(1, 20, r.integers(1, 10))
        packs = P.evolve(lengths, [], 20, np.random.default_rng(0), 8, 6)[0]
        assert np.bincount(packs, weights=lengths).max() <= 20
        assert len(np.unique(packs)) == least(lengths.tolist(), 20)


def test_crossover_keeps_pieces_and_capacity():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 99, 300)
    a, b = P.fresh_packing(lengths, 100, r, 0.5), P.fresh_packing(lengths, 100, r, 0.5)
    for _ in range(20):
        a = P.crossover(lengths, a, b, 100, r)
        assert len(a) == 300 and a.min() == 0 and np.bincount(a, weights=lengths).max() <= 100


def test_repeated_rows_and_rows_without_an_id_over_capacity(spark):
    rows = [(None, prose(1, 25)), (None, prose(2, 25)), (None, prose(3, 31)), (7, prose(4, 25)), (7, prose(4, 25)), (7, prose(5, 45)), (8, prose(6, 10)), (8, prose(6, 10))]
    got = P.pack(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 10).collect()
    check(got, rows, 10)
    assert len({(x["pack_id"], x["slot"]) for x in got}) == len(got)


def test_equal_rows_spread_over_cells(spark):
    for key in ("CAST(NULL AS BIGINT)", "7L"):
        docs = spark.range(100_000).selectExpr(f"{key} AS doc_id", "'three words here' AS text")
        sizes = [x["count"] for x in P.in_cells(P.pieces(docs), 50).groupBy("cell").count().collect()]
        assert len(sizes) == 50 and sum(sizes) == 100_000 and max(sizes) < 2400


def test_migrants_evolve():
    from pyarrow import Table

    lengths = np.random.default_rng(2).integers(1, 99, 50).astype(np.int32)
    state = Table.from_pylist([{"cell": 0, "island": 0, "role": "items", "blob": lengths.tobytes()}], P._STATE_SCHEMA)
    first, last = P._epoch(state, 100, 0, 3, 2, 4, P.ELITE), P._epoch(state, 100, 1, 3, 2, 4, 0)
    assert sum(r.startswith("migrant") for r in first["role"].to_pylist()) == P.ELITE and set(first.filter([r.startswith("migrant") for r in first["role"].to_pylist()])["island"].to_pylist()) == {1}
    assert not any(r.startswith("migrant") for r in last["role"].to_pylist())


def test_edge_cases(spark, edge_docs, no_docs):
    rows = P.pack(edge_docs).collect()
    check(rows, [(x["doc_id"], x["text"]) for x in edge_docs.collect()], P.CAPACITY)
    assert sum(x["doc_id"] == 8 for x in rows) == -(-60_000 // P.CAPACITY)
    assert not {1, 2, 3} & {x["doc_id"] for x in rows}
    assert P.pack(no_docs).count() == 0 and P.pack(edge_docs.where("doc_id IN (1, 2, 3)")).count() == 0
