import random

import numpy as np
import pytest

from rillstone.llm import _tokens as T
from rillstone.llm import decontaminate as D
from tests.llm.conftest import WORDS, prose


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_score_is_smith_waterman():
    r = random.Random(1)
    for _ in range(80):
        a, b = [np.array([r.randrange(5) for _ in range(r.randrange(1, 15))], np.uint64) for _ in range(2)]
        best, start, end = D.align(a, b)
        assert best == smith_waterman(a.tolist(), b.tolist())
        if best:
            assert 0 <= start < end <= len(b) and smith_waterman(a.tolist(), b[start:end].tolist()) == best


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(12, 40)))) for i in range(30)]
    rows, planted = [], set()
    for i in range(200):
        text = prose(1000 + i, 100)
        if i % 4 == 0:
            k = i // 4 % 30
            words = items[k][1].split()
            for _ in range(len(words) // 10):
                j = r.randrange(len(words))
                words[j : j + 1] = r.choice(([], ["changed"], [words[j], "added"]))
            text = text[:200] + " " + " ".join(words).upper() + ". " + text[200:]
            planted.add((i, k))
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING"), planted, rows, items


def test_finds_what_brute_force_finds(spark, leaks):
    docs, bench, planted, rows, items = leaks
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in D.matches(docs, bench).collect()}
    want = set()
    for i, text in rows[:60]:
        words = T.word_hashes(text)
        for k, item in items:
            own = T.word_hashes(item)
            if D.align(own, words)[0] >= D.THRESHOLD * D.MATCH * len(own):
                want.add((i, k))
    assert {p for p in got if p[0] < 60} == want
    assert set(got) == planted
    kept = {x["doc_id"] for x in D.without_matches(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in planted}


def test_slices_of_the_benchmark_give_the_same(spark, leaks):
    docs, bench, planted, _, _ = leaks
    assert {(x["doc_id"], x["item_id"]) for x in D.matches(docs, bench, slice_words=60).collect()} == planted
    assert D.without_matches(docs, bench, slice_words=60).count() == docs.count() - len({i for i, _ in planted})


def test_item_in_every_document_keeps_its_seeds(spark):
    item = " ".join(WORDS[:20])
    docs = spark.createDataFrame([(i, prose(i, 30) + " " + item) for i in range(40)], "doc_id BIGINT, text STRING")
    assert D.matches(docs, spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")).count() == 40


def test_widely_copied_edited_and_cut_leaks_are_found(spark):
    items = [(k, " ".join(WORDS[30 * k : 30 * k + 30])) for k in range(4)]
    changed, cut, both = (items[k][1].split() for k in (0, 1, 2))
    changed[14] = "edited"
    both[5::6] = ["edited"] * 5
    rows = [" ".join(changed)] * 2000 + [" ".join(cut[:20])] * 2000 + [" ".join(both)] * 2000
    rows += [items[2][1]] * 3  # verbatim copies must not hide edited ones
    few = len(rows)
    rows += [" ".join(items[3][1].split()[:6])] * 50  # a fifth of an item is no leak
    docs = spark.createDataFrame([(i, prose(5000, 20) + " " + t) for i, t in enumerate(rows)], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(x["doc_id"], x["item_id"]) for x in D.matches(docs, bench).collect()}
    assert {(i, min(2, i // 2000)) for i in range(few)} <= got and not any(i >= few and k == 3 for i, k in got)
    assert {x["doc_id"] for x in D.without_matches(docs, bench).collect()} == set(range(few, len(rows)))


def test_edge_cases(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(None, "w1 w2 w3 w4 w5"), (1, None), (2, ""), (3, "one"), (4, prose(1, 80)), (4, prose(1, 80)), (5, prose(9, 60_000)[:300])], "item_id BIGINT, text STRING")
    got = sorted((x["doc_id"] or 0, x["item_id"]) for x in D.matches(edge_docs, bench).collect())
    assert got == [(0, 4), (4, 4), (5, 4), (5, 4), (8, 5), (9, 5)]
    kept = D.without_matches(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 6
    empty = bench.where("false")
    assert D.matches(no_docs, bench).count() == 0 and D.matches(edge_docs, empty).count() == 0
    assert D.without_matches(edge_docs, empty).count() == edge_docs.count() and D.without_matches(no_docs, empty).count() == 0
