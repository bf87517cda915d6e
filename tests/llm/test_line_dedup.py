import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import line_dedup as L
from tests.llm.conftest import prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_pairs_equal_lines_in_order(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a and b and not set(a) & set(b):
        assert not pairs


def test_patience_finds_blocks():
    a, b = [1, 2, 3, 4, 5], [9, 2, 3, 4, 8]
    assert L.patience(a, b) == [(1, 1), (2, 2), (3, 3)]
    assert L.common_blocks(a, b, [1] * 5, 3) == [1, 2, 3] and L.common_blocks(a, b, [1] * 5, 4) == []


def whole(rows, min_words=L.MIN_WORDS):
    """Every document against every earlier one: all lines in any common run of at least min_words words go."""
    texts = {i: t for i, t in rows if t is not None}
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in texts.items()}
    count = lambda x: 0 if x == "" else x.count(" ") + 1
    runs = {i: {tuple(x[s:e]) for s in range(len(x)) for e in range(s + 1, len(x) + 1)} for i, x in lines.items()}
    out = {}
    for i, x in lines.items():
        gone = set()
        for s in range(len(x)):
            for e in range(s + 1, len(x) + 1):
                if sum(map(count, x[s:e])) >= min_words and any(j < i and tuple(x[s:e]) in runs[j] for j in lines):
                    gone |= set(range(s, e))
        out[i] = "\n".join(y for k, y in enumerate(texts[i].split("\n")) if k not in gone)
    return out


def test_same_as_brute_force(spark):
    r = random.Random(3)
    blocks = [prose(100 + k, 48) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(i, r.choice((12, 36)))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(blocks) if r.random() < 0.8 else "short line here now")
        rows.append((i, "\n".join(parts)))
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == whole(rows) and any(got[i] != t for i, t in rows)
    for b in blocks:  # a passage stays in one document at most
        assert sum(b in t for t in got.values()) <= 1


def test_lines_that_many_hold(spark):
    """More than RARE documents hold the lines of the block, each first seen in another document."""
    lines = [prose(50 + k, 12, 12) for k in range(3)]
    rows = [(k, prose(k, 40) + "\n" + lines[k]) for k in range(3)] + [(i, "\n".join(lines) if i % 9 == 0 else r_line(i, lines)) for i in range(3, 120)]
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == whole(rows) and got[9] == "\n".join(lines) and got[18] == ""


def r_line(i, lines):
    return lines[i % 3] + "\n" + prose(1000 + i, 20, 20)


def test_scripts_without_blanks(spark):
    block = "\n".join("これは長い行です、たくさんの文字があります" for _ in range(1)) + "\n次の行もまた長いので数えます"
    rows = [(1, block), (2, "別の文章\n" + block)]
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == {1: block, 2: "別の文章"}


def test_block_of_lines_that_stand_singly_before(spark):
    a, b = prose(1, 25, 25), prose(2, 25, 25)
    rows = [(1, a), (2, b), *((i, a + "\n" + b) for i in range(3, 40))]
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == whole(rows, L.MIN_WORDS) and got[3] == rows[2][1] and got[39] == ""


def test_same_as_each_document_against_every_earlier_one(spark):
    r = random.Random(8)
    stock = [prose(300 + k, n, n) for k, n in enumerate([1, 2, 3, 5, 8, 12, 14, 17, 20, 25, 29, 31])] + [""]
    rows = [(i, "\n".join(r.choices(stock, k=r.randrange(1, 9)))) for i in range(150)]
    got = {x["doc_id"]: x["text"] for x in L.line_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == whole(rows, L.MIN_WORDS)


def test_edge_cases(spark, edge_docs, no_docs):
    out = L.line_dedup(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    by = {}
    for x in out.collect():
        by.setdefault(x["doc_id"], []).append(x)
    assert by[5][0]["text"] == "" == by[5][1]["text"] and by[5][0]["n_chars"] == 0
    assert by[4][0]["text"] == prose(1, 80) and by[1][0]["text"] is None and by[2][0]["text"] == "" and by[3][0]["text"] == "   \n\n "
    assert sorted(x["text"] is None for x in by[None]) == [False, True]
    assert "more words here" in by[9][0]["text"] and len(by[9][0]["text"]) < 200
    left = L.line_dedup(edge_docs, drop_emptied=True)
    assert sorted(x["doc_id"] for x in left.collect() if x["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 10, 11, 12]
    assert L.line_dedup(no_docs).count() == 0
