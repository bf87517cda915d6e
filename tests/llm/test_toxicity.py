import random

import pytest

from rillstone.llm import toxicity as X
from tests.llm.conftest import prose


def plain_matches(clause, lexicon):
    """The grammar's meaning, written out for a clause as looks back from each word."""
    seen, out = [], []  # (symbol, word number) so far; quotation marks aren't words
    quoted = reported = False
    number = 0
    for token in X._SYMBOL.findall(clause):
        symbols, weight = ((X.QUOTE,), 0.0) if token in "\"“”«»„" else lexicon.symbols(token)
        for symbol in symbols:
            value = 0.0
            words = [s for s, _ in seen]
            if symbol == X.INSULT:
                back = words[::-1]
                person = bool(back) and (back[0] in (X.YOU, X.THIRD) or back[0] == X.NEGATION and next((s for s in back if s != X.NEGATION), None) in (X.YOU, X.THIRD))
                for k, s in enumerate(back[:4]):
                    if s in (X.INSULT, X.YOU, X.THIRD):
                        break
                    if s == X.COPULA:
                        rest = [x for x in back[k + 1 :]]
                        while rest and rest[0] == X.NEGATION:
                            rest.pop(0)
                        person = person or bool(rest) and rest[0] in (X.YOU, X.THIRD)
                        if person:
                            break
                value = weight * 0.6 * (1.5 if person else 1.0)
            elif symbol == X.THREAT:
                last = next((k for k, s in enumerate(words[::-1]) if s in (X.INTENT, X.THREAT)), None)
                value = weight * (0.4 if last is not None and last < 3 and words[::-1][last] == X.INTENT else 0.1)
            elif symbol in (X.YOU, X.THIRD):
                for k, s in enumerate(words[::-1][:3]):
                    if s == X.THREAT:
                        before = words[::-1][k + 1 :]
                        last = next((j for j, x in enumerate(before) if x in (X.INTENT, X.THREAT)), None)
                        value += 0.7 if last is not None and last < 3 and before[last] == X.INTENT else 0.2
                        break
                    if s in (X.YOU, X.THIRD, X.INTENT):
                        break
                if symbol == X.YOU and words and words[-1] == X.INSULT:
                    value += 0.55
            if X.NEGATION in words[::-1][:3]:
                value *= 0.1
            if reported or quoted:
                value *= 0.3
            if value > 0:
                out.append(value)
            if symbol == X.QUOTE:
                quoted, reported = not quoted, False
            else:
                seen.append((symbol, number))
                number += 1
                reported = reported or symbol == X.REPORT and not quoted
    return out


def test_machine_matches_plain_loops():
    r = random.Random(4)
    words = ["you", "he", "is", "will", "idiot", "kill", "not", "never", "said", '"', "moron", "them", "tree", "walks", ",", "blorpish", "you're", "trash"]
    lexicon = X.Lexicon({"blorp": 0.8})
    for _ in range(3000):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))
        assert [v for _, v in lexicon.clause(text)] == pytest.approx(plain_matches(text, lexicon)), text
        values = plain_matches(text, lexicon)
        rest = 1.0
        for v in sorted(values)[-X.TOGETHER :]:
            rest *= 1 - min(v, 1.0)
        assert lexicon.score(text)[0] == pytest.approx(1 - rest if any(w in text for w in ("idiot", "kill", "moron", "blorp", "trash")) else 0.0), text


def test_clauses_not_isolated_words():
    s = lambda t: X.Lexicon().score(t)[0]
    toxic = ("you idiot", "You are such a moron!", "these vermin", "an idiot and a moron", "Idiot, you!", "I will kill you", "we're gonna hurt them", "What an idiot. What a moron.", "IDIOT!! idiot$$$", "They're filth.")
    clean = ("The trash was collected on Monday.", "He made a stupid mistake in the budget.", "The trash was collected. He made a stupid mistake.", "an idiot", "kill the process", "They beat them in the final. They beat us.", "you are not an idiot", "he said 'you' and called her an idiot and a moron", 'She wrote "you are an idiot, you moron" in red', "not an idiot. " * 500, "I won't hurt you", "she was hurt", "a tree grows", "idiotic pathology")
    assert [t for t in toxic if s(t) < X.THRESHOLD] == [] and [t for t in clean if s(t) >= X.THRESHOLD] == []
    assert s("you idiot") > s("an idiot") > s("she said an idiot came") > s("not an idiot") > 0 and s("a tree grows") == 0
    assert s("idiot. " + "word " * 5000 + "moron.") == s("idiot") and s("idiot. " + "word " * 50 + "moron.") >= X.THRESHOLD


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        words = prose(i, 60).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(("grumpf", "zorrak")) + r.choice(("ta", "li", "no", "")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")


def test_held_out_accuracy_of_learned_stems(spark, labelled):
    docs, labels = labelled
    lexicon = X.learn(docs, labels.where("doc_id < 600"))
    assert any(s.startswith("grump") for s in lexicon.learned) and not any(s.startswith("w") for s in lexicon.learned)
    out = X.scores(docs.where("doc_id >= 600"), lexicon).withColumnRenamed("toxic", "found").join(labels, "doc_id").collect()
    assert len(out) == 300 and all(x["found"] == bool(x["toxic"]) for x in out)
    bounded = X.learn(docs, labels, rows=50)
    assert isinstance(bounded, X.Lexicon)


def test_better_than_a_bag_of_words(spark):
    """Labels that words alone can't explain: half of the clean documents deny, report or use the words of things."""
    r = random.Random(17)
    bad = ["you are an idiot", "these morons", "what scum, what vermin", "I will kill you", "you stupid loser"]
    fine = ["you are not an idiot", "she said they are morons", "kill the old process", "the trash was full", 'he wrote "you loser" there', "a stupid rule"]
    rows = []
    for i in range(400):
        words = prose(i, 80).replace("\n", " ").split(" ")
        for _ in range(r.randrange(1, 3)):
            words.insert(r.randrange(len(words)), ". " + r.choice(bad if i % 4 == 0 else fine) + " .")
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id BIGINT, text STRING"), spark.createDataFrame([(i, t) for i, _, t in rows if i < 200], "doc_id BIGINT, toxic INT")
    lexicon = X.learn(docs, labels)
    held = rows[200:]
    grammar = [(lexicon.score(t)[0] >= X.THRESHOLD, bool(toxic)) for _, t, toxic in held]
    bag = [(sum(max(lexicon.learned.get(w, 0), X.INSULTS.get(w, 0), X.THREATS.get(w, 0)) for w in t.lower().split()), bool(toxic)) for _, t, toxic in held]
    right = sum(a == b for a, b in grammar) / len(held)
    best = max(sum((v >= cut) == b for v, b in bag) / len(held) for cut in sorted({v for v, _ in bag}))
    assert right >= 0.97 and right > best + 0.05, (right, best)


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 0), (4, 1), (5, 2), (99, 1)], "doc_id BIGINT, toxic INT")
    lexicon = X.learn(edge_docs, labels)
    assert lexicon.learned == {} == X.learn(no_docs, labels).learned == X.learn(edge_docs, labels.where("false")).learned
    out = X.scores(edge_docs, lexicon)
    assert out.count() == edge_docs.count() and out.where("toxic OR score > 0").count() == 0
    bad = edge_docs.limit(0).unionByName(spark.createDataFrame([(7, "you idiot, you moron")], "doc_id BIGINT, text STRING"), allowMissingColumns=True)
    both = edge_docs.unionByName(bad).unionByName(bad)
    kept = X.without_toxic(both, lexicon)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert X.scores(both, lexicon).where("toxic").count() == 2
    assert X.scores(no_docs, lexicon).count() == 0 and X.without_toxic(no_docs, lexicon).count() == 0
    long = lexicon.score("x " * 300_000 + "idiot. " + "y " * 300_000)
    assert long == (pytest.approx(X.INSULT_ALONE), 1)
