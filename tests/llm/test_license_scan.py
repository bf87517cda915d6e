import random
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import license_scan as S
from tests.llm.conftest import prose


def runs_of(sequences):
    return {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), max_size=4), st.lists(st.integers(0, 4), max_size=14))
def test_matching_statistics_and_places_match_brute_force(sequences, text):
    automaton = S.SuffixAutomaton(sequences)
    known = runs_of(sequences)
    for end, (length, state) in enumerate(automaton.statistics(text), 1):
        want = max((n for n in range(end + 1) if n == 0 or tuple(text[end - n : end]) in known), default=0)
        assert length == want
        if length:
            run = text[end - length : end]
            assert automaton.ends[state] == {(k, j) for k, s in enumerate(sequences) for j in range(length, len(s) + 1) if s[j - length : j] == run}


def test_all_templates_are_found_whole_and_edited(spark):
    r = random.Random(1)
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(S.TEMPLATES.items())):
        rows.append((2 * k, prose(k, 40) + "\n" + text.upper() + "\n" + prose(k + 50, 40)))
        want.add((2 * k, name))
        words = text.split()
        if len(words) > 30:
            words[len(words) // 2] = "Edited"
            words.insert(len(words) // 4, "by somebody else")
            rows.append((2 * k + 1, prose(k, 20) + "\n// " + "\n// ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))))
            want.add((2 * k + 1, name))
    r.shuffle(rows)
    got = S.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert want <= {(x["doc_id"], x["template"]) for x in got}
    for x in got:  # what else is found is part of the text, like the notice in a header
        assert x["coverage"] >= S.COVERAGE and x["first_word"] < x["end_word"]
    exact = [x for x in got if (x["doc_id"], x["template"]) in want and x["doc_id"] % 2 == 0]
    assert all(x["coverage"] == 1.0 and x["first_word"] == 40 for x in exact)


def test_chains_match_brute_force():
    scanner = S.Scanner({"t": "a b c d e f g h i j k l m n o p"}, 2, 0.3, 4)
    r = random.Random(2)
    for _ in range(100):
        text = " ".join(r.choice("a b c d e f g h i j k l m n o p".split()) if r.random() < 0.3 else x for x in "a b c d e f g h i j k l m n o p".split())
        found = list(scanner.scan([text]))
        matches = scanner.matches(S.T.word_hashes(text).tolist(), 0)

        def best(k, matches=matches):
            t, x, y, n = matches[k]
            out = n
            for j, (_, a, b, m) in enumerate(matches):
                o = max(0, a + m - x, b + m - y)
                if a < x and b < y and o < n and x - a - m <= 4 and y - b - m <= 4:
                    out = max(out, best(j) + n - o)
            return out

        top = max((best(k) for k in range(len(matches))), default=0)
        assert (max(f[2] for f in found) if found else 0) == (top / 16 if top >= 0.3 * 16 else 0)


def test_short_template_within_a_longer_run_of_another():
    notice = S.TEMPLATES["Apache-2.0-notice"]
    for text in (f"{notice} the", f'{notice} (the "License"); you may not use this file.', f"{prose(1, 9)} {notice}\nthe License"):
        assert [(f[1], f[2]) for f in S.Scanner().scan([text])] == [("Apache-2.0-notice", 1.0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=14))
def test_runs_that_cannot_be_extended_match_brute_force(sequences, text):
    names = {f"t{k}": " ".join(f"x{w}" for w in s) for k, s in enumerate(sequences)}
    got = S.Scanner(names, 2).matches(S.T.word_hashes(" ".join(f"x{w}" for w in text)).tolist(), 5)
    want = set()
    for k, s in enumerate(sequences):
        for x in range(len(text)):
            for y in range(len(s)):
                n = 0
                while x + n < len(text) and y + n < len(s) and text[x + n] == s[y + n]:
                    n += 1
                if n >= 2 and not (x and y and text[x - 1] == s[y - 1]):
                    want.add((k, x + 5, y, n))
    assert len(got) == len(set(got)) and set(got) == want


def test_edge_cases(spark, edge_docs, no_docs):
    assert S.scan(edge_docs).count() == 0 and S.scan(no_docs).count() == 0
    notice = spark.createDataFrame([(None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "released  UNDER\nthe mit-license " * 2)], "doc_id BIGINT, text STRING")
    got = S.scan(edge_docs.unionByName(notice, allowMissingColumns=True)).collect()
    assert sorted((x["doc_id"] or 0, x["first_word"]) for x in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 5)]
    assert list(S.Scanner({}).scan(["mit license"])) == []


def test_long_texts_of_licence_words_take_linear_time():
    r = random.Random(4)
    words = [w for t in S.TEMPLATES.values() for w in t.split()]
    scanner = S.Scanner()

    def took(n):
        text = " ".join(" ".join(words[i : i + 6]) for i in (r.randrange(len(words) - 6) for _ in range(n // 6)))
        began = time.process_time()
        list(scanner.scan(pa.array([text])))
        return time.process_time() - began

    took(1000)
    assert took(48_000) < 16 * took(6000)


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "House-1.0.txt").write_text("You may use the frobnicator on every second Tuesday if it rains.")
    scanner = S.Scanner(S.read_templates(spark, str(tmp_path)))
    docs = spark.createDataFrame([(1, "x y you may use the frobnicator on every second tuesday, if it rains z")], "doc_id BIGINT, text STRING")
    assert [(x["doc_id"], x["template"], x["coverage"]) for x in S.scan(docs, scanner).collect()] == [(1, "House-1.0", 1.0)]
