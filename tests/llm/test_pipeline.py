import random

import pytest

import corpus_pipeline as C
from rillstone.llm import decontaminate as D
from rillstone.llm import line_dedup as L
from rillstone.llm import ngram_join as J
from rillstone.llm import packing as P
from rillstone.llm import queries
from rillstone.llm import toxicity as X
from rillstone.llm._tokens import word_hashes
from tests.llm.conftest import WORDS, prose
from tests.llm.test_line_dedup import whole
from tests.llm.test_ngram_join import brute_groups, edited
from tests.llm.test_packing import check

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(i, " ".join(r.choice(WORDS) for _ in range(25))) for i in range(6)]
    passage = prose(900, 60)
    rows, labels = [], []
    for i in range(160):
        text = prose(i, r.choice((20, 60, 150)))
        if i % 7 == 1:
            text = edited(prose(i - 1, 60), 0.03, r)
        if i % 9 == 2:
            text += "\n" + passage
        if i % 11 == 3:
            text += "\n" + items[i % 6][1]
        if i % 8 == 4:
            text = "you idiot " + text + " moron"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 8 == 4)))
    rows += [(500, rows[0][1], "en", "s", 5), (501, None, "en", None, None), (502, "", None, "s", 0), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_run_matches_brute_force(spark, corpus):
    folder, items = corpus
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    lexicon = X.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    left = [d for d in docs if lexicon.score(d[1])[0] < X.THRESHOLD]
    assert {i for i, _ in docs} - {i for i, _ in left} == {i for i in range(160) if i % 8 == 4}
    deduped = whole([d for d in left if d[0] is not None])
    left = [(i, t if i is None or t is None else deduped[i]) for i, t in left]
    before = dict(docs)
    left = [(i, t) for i, t in left if not (i is not None and t is not None and t != before[i] and not t.strip())]
    assert 500 not in dict(left)
    gone = {i for i, g in brute_groups(left, J.N, J.THRESHOLD) if i != g}
    left = [d for d in left if d[0] not in gone]
    assert gone
    leaked = {i for i, t in left if t for _, item in items if D.align(own := word_hashes(item), word_hashes(t))[0] >= D.THRESHOLD * D.MATCH * len(own)}
    left = [d for d in left if d[0] not in leaked]
    assert leaked
    rows = C.run(spark, folder).collect()
    check(rows, left, P.CAPACITY)
    assert {x["doc_id"] for x in rows} == {i for i, t in left if t and t.strip()}


def test_stages_return_the_columns_of_documents(spark, edge_docs, no_docs, corpus):
    folder, _ = corpus
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for docs in (edge_docs, no_docs):
        for _, stage in C.STAGES[:-1]:
            docs = C.cut(stage(spark, docs, folder), "test")
            assert docs.columns == edge_docs.columns
        C.pack(spark, docs, folder).count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and C.ORACLE_SQL is None
