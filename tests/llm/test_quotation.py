import random

from pyspark.sql import functions as F

from rillstone.llm import _tokens as T
from rillstone.llm import quotation as Q

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def test_levels():
    lines = ["plain", "> one", ">> two", "> > two", " >\t>>three", ">", "a > b", ""]
    data, offsets = T.raw(T.column(["\n".join(lines), None, "> x"], lower=False))
    found = Q.Lines(data, offsets)
    assert found.level.tolist() == [0, 1, 2, 2, 3, 1, 0, 0, 0, 1] and found.row.tolist() == [0] * 8 + [1, 2]
    assert [data[a:b].tobytes().decode() for a, b in zip(found.content, found.end)] == ["plain", "one", "two", "two", "three", "", "a > b", "", "", "x"]
    assert found.own().to_pylist() == ["plain\na > b", "", ""]


def test_introductions_go_with_their_quotes_only():
    texts = ["On Monday he wrote:\n> a\nyes", "On Monday he wrote:\nno quote", "le lundi il a écrit :\n\n> a", "On Monday he wrote:"]
    assert Q.Lines(*T.raw(T.column(texts, lower=False))).own().to_pylist() == ["yes", "On Monday he wrote:\nno quote", "", "On Monday he wrote:"]


def parents(spark, *texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    return {x["turn"]: x["parent_turn"] for x in Q.link(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_passages_levels_and_frequent_lines(spark):
    found = parents(
        spark,
        "first question that is\nbroken over lines",
        "> FIRST question\n> that is broken  over lines\nThanks.",  # other breaks, case and blanks
        "> first question that is broken over lines\nother answer\n\nThanks.",
        "> > first question that is broken over lines\n> Thanks.\nfrom 2 or 1",  # both hold all: the latest
        "another topic\nThanks.",
        "> > first question that is broken over lines\n>\n> other answer\n>\n> Thanks.\nsecond",  # 4 is later, but holds one passage only
        *["Thanks."] * 20,
        "> Thanks.\nwelcome",  # many hold it: the latest
        "> > > first question that is broken over lines\nonly a deep quote",  # what 3 and 5 quote at level 2: the latest
    )
    assert found == {0: None, 1: 0, 2: 0, 3: 2, 4: None, 5: 2, **{k: None for k in range(6, 26)}, 26: 25, 27: 5}


def test_a_line_that_many_repeat_costs_its_number(spark):
    rows = [{"turn": i, "asks": [], "asks_lines": [7], "offers": [], "offers_lines": [7]} for i in range(20_000)]
    Q._linked(rows)
    assert [r["parent"] for r in rows] == [None, *range(19_999)]


def test_passages_that_many_hold_count_for_each_of_them(spark):
    found = parents(spark, "alpha\n\nThanks.", "alpha", *["Thanks."] * 12, "> alpha\n>\n> Thanks.\nfrom the first, which holds both")
    assert found == {**{k: None for k in range(14)}, 14: 0}


def test_links_are_those_of_all_votes():
    r = random.Random(3)
    for _ in range(30):
        some = lambda a, b: sorted({min(int(r.expovariate(0.3)), 30) + a for _ in range(r.randrange(b))})
        rows = [{"turn": 3 * i, "asks": some(0, 5), "asks_lines": some(100, 5), "offers": some(0, 5), "offers_lines": some(100, 5)} for i in range(60)]
        Q._linked(rows)
        for i, x in enumerate(rows):
            votes = [(len({*x["asks"]} & {*y["offers"]}), len({*x["asks_lines"]} & {*y["offers_lines"]}), y["turn"]) for y in rows[:i]]
            best = max(votes, default=(0, 0, 0))
            assert x["parent"] == (best[2] if best[:2] > (0, 0) else None)


def test_threads_are_rebuilt(spark):
    rows = [
        (1, 0, "user", "What is a shuffle?\nAnd why?"),
        (1, 1, "assistant", "> What is   a SHUFFLE?\n\nMoving rows."),
        (1, 2, "user", "On Monday he wrote:\n> > What is a shuffle?\n> Moving rows.\nThanks."),
        (1, 3, "assistant", "> And why?\nFor joins."),
        (1, 4, "user", "Something else"),
        (2, 0, "user", "What is a shuffle?"),
    ]
    got = [tuple(x) for x in Q.link(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, 0, None, 0, "user", "What is a shuffle?\nAnd why?"),
        (1, 1, 1, 0, 1, "assistant", "Moving rows."),
        (1, 2, 2, 1, 2, "user", "Thanks."),
        (1, 3, 3, 0, 1, "assistant", "For joins."),
        (1, 4, 4, None, 0, "user", "Something else"),
        (2, 0, 0, None, 0, "user", "What is a shuffle?"),
    ]


def test_round_trip(spark, data):
    conversations = spark.read.parquet(f"{data}/conversations.parquet")
    quoted = Q.with_quotes(conversations)
    assert quoted.where(F.col("text").rlike("(?m)^>>? ")).count() > 0
    got = {(x["conv_id"], x["turn"]): x for x in Q.link(quoted).collect()}
    for x in conversations.collect():
        out, turn = got[x["conv_id"], x["turn"]], x["turn"]
        assert out["text"] == x["text"].strip() and out["role"] == x["role"]
        assert out["parent_turn"] == (None if turn == 0 else turn - 2 if (x["conv_id"] + turn) % 3 == 0 and turn >= 2 else turn - 1)
    order = {}
    for (c, t), x in got.items():
        order.setdefault(c, {})[t] = x["position"]
    for (c, t), x in got.items():
        if x["parent_turn"] is not None:
            assert order[c][x["parent_turn"]] < x["position"]


def test_edge_cases(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    rows = [(None, 0, "user", "x"), (1, None, "user", "x"), (1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", "same"), (1, 3, "user", "same"), (1, 3, "user", "same"), (1, 4, "user", "> same\nfour"), (1, 5, "user", "> nothing known\nfive"), (2, 0, "user", long), (2, 1, "user", "> line 777 of many\r\n> line 778 of many\r\nyes")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"position": F.lit("x"), "own": F.lit(1), "line": F.lit(2), "parent": F.lit(None).cast("string")})
    got = {(x["conv_id"], x["turn"]): x for x in Q.link(df).collect()}
    assert len(got) == 8 and Q.link(df).count() == 8
    assert got[1, 0]["text"] == "" == got[1, 1]["text"] and got[1, 4]["parent_turn"] == 3 and got[1, 4]["text"] == "four"
    assert got[1, 5]["parent_turn"] is None and got[1, 5]["depth"] == 0 and got[2, 1]["parent_turn"] == 0 and got[2, 0]["text"] == long
    assert Q.link(df.where("false")).count() == 0
