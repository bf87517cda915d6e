"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the symbols of a clause (insult, threat, second and third
person, copula, intent, negation, reporting verb, quotation mark, other word):

* insult: an insult by itself scores INSULT_ALONE of its weight, too little to
  decide;
* threat: a violent verb scores little, more after a word of intent, and the
  rest comes with a person as its object ("will hurt you");
* target: an insult counts half as much again if it is addressed: next to a
  person ("you idiot", "these vermin", "idiot, you") or after a person and a
  copula ("he is such a moron"), but not with a person anywhere in the clause
  ("he made a stupid mistake");
* negation: weakens what stands in the three words after it;
* reported speech: after a reporting verb, or between quotation marks, weights
  are weakened too.

``compose`` makes them one machine: factors multiply, and a bonus that one of
them gives is scaled by the others. Its results are matches in clauses. A
document's score is the noisy or (1 - (1 - a)(1 - b)...) of the TOGETHER
strongest matches within WINDOW characters, so it lies between 0 and 1, and
neither a long text with an insult here and there nor any number of negated or
reported ones drifts over the threshold. A document is toxic from THRESHOLD on.

The lexicon has two sources: a small list of English words, and stems (words
and beginnings of words) learned from labelled documents. The weight of a stem
is the share of toxic ones among the labelled documents that have it; it goes
before the list's weight. The learning sample is bounded (LABEL_ROWS, chosen by
hash); scoring covers every text whole, at C speed for texts without an insult
or threat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm._common import cut

THRESHOLD = 0.8
#: So many of the strongest matches within so many characters make the score.
TOGETHER, WINDOW = 3, 1000
INSULT_ALONE = 0.6
#: At most so many labelled documents are learned from.
LABEL_ROWS = 20_000
#: A learned stem stands in at least this share of the toxic sample (and in three documents), mostly in new surroundings, and mostly in toxic ones.
SUPPORT, FRESH, PRECISION, CONFIDENCE = 0.005, 0.5, 0.4, 3.0
STEMS = (4, 5, 6, 8)

INSULT, THREAT, YOU, THIRD, COPULA, INTENT, NEGATION, REPORT, QUOTE, WORD = range(10)
SYMBOLS = 10

_STRONG = "idiot idiots moron morons imbecile scum loser losers dumbass scumbag lowlife bastard bastards asshole assholes bitch vermin filth subhuman"
_MILD = "pathetic worthless disgusting trash stupid clown clowns"
#: What may also be said of things weighs less, unless labels teach otherwise: two such words alone don't decide.
INSULTS = {w: 1.0 for w in _STRONG.split()} | {w: 0.75 for w in _MILD.split()}
THREATS = {w: 1.0 for w in "kill murder hurt destroy beat stab shoot strangle hang burn rape".split()}
_WORDS = {
    YOU: "you u yourself tu toi vous du dich dir ihr euch tú te ti usted ustedes",
    THIRD: "he him she her they them these those ihn sie él ella ellos",
    COPULA: "is are am was were be been being es est sont êtes bist ist sind seid eres son sois",
    INTENT: "will gonna going shall must should i'll we'll let's want wanna",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't won't can't without neither nor pas jamais nicht kein keine nie nunca jamás tampoco",
    REPORT: "said says say saying called calls calling wrote writes writing claimed claims quoted quotes alleged tweeted posted reported dit écrit sagte schrieb dijo escribió",
}
_SYMBOL_OF = {w: (s,) for s, ws in _WORDS.items() for w in ws.split()}
_SYMBOL_OF |= {f"{p}'{c}": (_SYMBOL_OF[p][0], COPULA) for p, c in (("you", "re"), ("they", "re"), ("he", "s"), ("she", "s"))} | {"youre": (YOU, COPULA), "ur": (YOU, COPULA)}

Arc = tuple[int, float, float, float]


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol] = (next state, factor of the symbol's weight, bonus, factor of the others' bonuses); a match scores factor * weight + bonus."""

    step: list[list[Arc]] = field(repr=False)


def _plain(states: int) -> list[list[Arc]]:
    """All symbols lead back to state 0 and change nothing."""
    return [[(0, 1.0, 0.0, 1.0)] * SYMBOLS for _ in range(states)]


def _insult(alone: float = INSULT_ALONE) -> Transducer:
    step = _plain(1)
    step[0][INSULT] = (0, alone, 0.0, 1.0)
    return Transducer(step)


def _threat(reach: int = 3) -> Transducer:
    # 0 nothing; 1 .. reach: so many words left after a word of intent; then, by words left, a threat without, and one with intent
    bare, meant = reach, 2 * reach
    step = _plain(3 * reach + 1)
    for state, arcs in enumerate(step):
        group, left = (state - 1) // reach, (state - 1) % reach if state else 0
        down = state - 1 if state and left else 0
        for s in range(SYMBOLS):
            arcs[s] = (state if s == QUOTE else down, 1.0, 0.0, 1.0)
        arcs[INTENT] = (reach, 1.0, 0.0, 1.0)
        intended = state and group == 0
        arcs[THREAT] = (meant + reach, 0.4, 0.0, 1.0) if intended else (bare + reach, 0.1, 0.0, 1.0)
        if state and group:
            for s in (YOU, THIRD):
                arcs[s] = (0, 1.0, 0.2 if group == 1 else 0.7, 1.0)
    return Transducer(step)


def _target(reach: int = 4, more: float = 1.5, after: float = 0.55) -> Transducer:
    # 0 nothing, 1 a person, 2 an insult; 3 .. 2 + reach: so many words left after a person and a copula
    step = _plain(3 + reach)
    for state, arcs in enumerate(step):
        down = state - 1 if state > 3 else 0
        for s in range(SYMBOLS):
            arcs[s] = (state if s == QUOTE else down, 1.0, 0.0, 1.0)
        arcs[INSULT] = (2, more, 0.0, 1.0) if state == 1 or state > 2 else (2, 1.0, 0.0, 1.0)
        arcs[YOU] = (1, 1.0, after if state == 2 else 0.0, 1.0)
        arcs[THIRD] = (1, 1.0, 0.0, 1.0)
        arcs[COPULA] = (2 + reach, 1.0, 0.0, 1.0) if state == 1 else arcs[WORD]
        if state == 1:
            arcs[NEGATION] = (1, 1.0, 0.0, 1.0)
    return Transducer(step)


def _negation(reach: int = 3, factor: float = 0.1) -> Transducer:
    step = []
    for left in range(reach + 1):
        f = factor if left else 1.0
        step.append([(reach if s == NEGATION else max(0, left - (s != QUOTE)), f, 0.0, f) for s in range(SYMBOLS)])
    return Transducer(step)


def _reported(factor: float = 0.3) -> Transducer:
    # 0 the author's own words, 1 after a reporting verb, 2 between quotation marks
    step = [[(s, factor if s else 1.0, 0.0, factor if s else 1.0)] * SYMBOLS for s in range(3)]
    step[0][REPORT], step[0][QUOTE] = (1, 1.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0)
    step[1][QUOTE] = (2, factor, 0.0, factor)
    step[2][QUOTE] = (0, factor, 0.0, factor)
    return Transducer(step)


def compose(*parts: Transducer) -> Transducer:
    """One machine that runs all at once: factors multiply; each one's bonus is scaled by the others."""
    machine = parts[0]
    for part in parts[1:]:
        width = len(part.step)
        machine = Transducer([[(p * width + q, f * g, a * z + b * y, y * z) for (p, f, a, y), (q, g, b, z) in zip(one, other)] for one in machine.step for other in part.step])
    return machine


MACHINE = compose(_insult(), _threat(), _target(), _negation(), _reported())
_CLAUSE = re.compile(r"[.!?;\n\r…。！？]")
_SYMBOL = re.compile(r"[\"“”«»„]|[\w'’]+")
_BREAKS = frozenset(".!?;\n\r…。！？")


def together(places: list[int], values: list[float]) -> float:
    """The greatest noisy or of the TOGETHER strongest of the matches within WINDOW characters; places are sorted."""
    best, low = 0.0, 0
    for high, at in enumerate(places):
        while at - places[low] > WINDOW:
            low += 1
        rest = 1.0
        for v in nlargest(TOGETHER, values[low : high + 1]):
            rest *= 1 - min(v, 1.0)
        best = max(best, 1 - rest)
    return best


class Lexicon:
    """Weights of insults and threats; a learned stem matches every word that begins with it, and the longest match counts."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.learned = dict(learned or {})
        self.stems = sorted({len(x) for x in self.learned}, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for w in {*INSULTS, *THREATS, *self.learned}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def symbols(self, word: str) -> tuple[tuple[int, ...], float]:
        """What a word stands for (a contraction for two symbols), and its weight."""
        word = word.replace("’", "'").strip("'_")
        for n in self.stems:
            if len(word) >= n and word[:n] in self.learned:
                return (INSULT,), self.learned[word[:n]]
        if word in INSULTS:
            return (INSULT,), INSULTS[word]
        if word in THREATS:
            return (THREAT,), THREATS[word]
        return _SYMBOL_OF.get(word, (WORD,)), 0.0

    def clause(self, clause: str) -> list[tuple[int, float]]:
        """(place, value) of the matches of a clause in lower case."""
        state, out = 0, []
        for m in _SYMBOL.finditer(clause):
            token = m.group()
            symbols, weight = ((QUOTE,), 0.0) if token in "\"“”«»„" else self.symbols(token)
            for symbol in symbols:
                state, factor, bonus, _ = MACHINE.step[state][symbol]
                if (value := factor * weight + bonus) > 0:
                    out.append((m.start(), value))
        return out

    def score(self, text: str | None) -> tuple[float, int]:
        """The score of a text, and how many of its clauses have matches."""
        if not text:
            return 0.0, 0
        text = text.lower()
        count, done = 0, -1
        places: list[int] = []
        values: list[float] = []
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if start < done or (start and (text[start - 1].isalnum())):
                continue
            low = start
            while low and text[low - 1] not in _BREAKS:
                low -= 1
            m = _CLAUSE.search(text, end + 1)
            done = m.start() if m else len(text)
            found = self.clause(text[low:done])
            count += bool(found)
            places += [low + at for at, _ in found]
            values += [v for _, v in found]
        return together(places, values), count


def _stems(text: str) -> Iterator[tuple[str, str]]:
    before = ""
    for word in re.findall(r"\w+", text.lower()):
        for n in STEMS:
            if len(word) > n:
                yield word[:n], before
        if len(word) >= STEMS[0]:
            yield word, before
        before = word


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs: Counter = Counter()
        around: set[tuple[str, str]] = set()
        for text in batch["text"].to_pylist():
            pairs = set(_stems(text or ""))
            docs.update({s for s, _ in pairs})
            around |= pairs
        if around:
            rest = dict(docs)
            yield pa.RecordBatch.from_pylist([{"stem": s, "before": b, "docs": rest.pop(s, 0)} for s, b in around], pa.schema([("stem", pa.string()), ("before", pa.string()), ("docs", pa.int64())]))


def _clean_counts(batches: Iterator[pa.RecordBatch], stems: set[str]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            total.update({s for s, _ in _stems(text or "")} & stems)
    yield pa.RecordBatch.from_pydict({"stem": pa.array(list(total), pa.string()), "docs": pa.array(list(total.values()), pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> Lexicon:
    """A lexicon from documents with labels (doc_id, toxic 0 or 1), of at most ``rows`` of these; an id with several labels counts as toxic if one says so."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("is_toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = cut(texts.join(F.broadcast(chosen), "id").select("text", "is_toxic"), "labelled")  # the broadcast has at most ``rows`` rows
    toxic, clean = sample.where("is_toxic = 1").select("text"), sample.where("is_toxic = 0").select("text")
    count = toxic.count()
    least = max(3, SUPPORT * count)
    found = toxic.mapInArrow(_toxic_counts, "stem string, before string, docs long").groupBy("stem", "before").agg(F.sum("docs").alias("docs"))
    found = found.groupBy("stem").agg(F.sum("docs").alias("docs"), F.count("*").alias("around")).where((F.col("docs") >= least) & (F.col("around") >= FRESH * F.col("docs")))
    n_toxic = {r["stem"]: r["docs"] for r in found.collect()}  # stems of a bounded sample
    if not n_toxic:
        return Lexicon()
    stems = set(n_toxic)
    n_clean = {r["stem"]: r["docs"] for r in clean.mapInArrow(lambda it: _clean_counts(it, stems), "stem string, docs long").groupBy("stem").agg(F.sum("docs").alias("docs")).collect()}
    return Lexicon(select(n_toxic, n_clean))


def select(n_toxic: dict[str, int], n_clean: dict[str, int]) -> dict[str, float]:
    """Stems and weights from the numbers of toxic and clean documents that have them.

    A stem is taken if the share of toxic ones is surely (at CONFIDENCE standard
    deviations) over PRECISION; one that a longer stem stands for nearly
    everywhere gives way to it, and one that adds nothing to a shorter is left out.
    """
    good = {}
    for s, n in n_toxic.items():
        size = n + n_clean.get(s, 0)
        p, z = n / size, CONFIDENCE
        if (p + z * z / (2 * size) - z * (p * (1 - p) / size + z * z / (4 * size * size)) ** 0.5) / (1 + z * z / size) >= PRECISION:
            good[s] = (n + 0.5) / (size + 1)
    longest: dict[str, int] = {}
    for s in good:
        for n in STEMS:
            if len(s) > n:
                longest[s[:n]] = max(longest.get(s[:n], 0), n_toxic[s])
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda x: (len(x), x)):
        if longest.get(s, 0) >= 0.9 * n_toxic[s]:
            continue
        shorter = next((kept[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in kept), 0.0)
        if not shorter or abs(good[s] - shorter) > 0.02:
            kept[s] = good[s]
    return kept


def _score(batches: Iterator[pa.RecordBatch], learned: dict[str, float], threshold: float) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(learned)
    for batch in batches:
        found = [lexicon.score(t) for t in batch["text"].to_pylist()]
        scores = np.array([s for s, _ in found], float)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.round(scores, 6)), pa.array([n for _, n in found], pa.int64()), pa.array(scores >= threshold - 1e-9)], ["doc_id", "score", "clauses", "toxic"])


def _keep(batches: Iterator[pa.RecordBatch], learned: dict[str, float], threshold: float) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(learned)
    for batch in batches:
        yield batch.filter(pa.array([lexicon.score(t)[0] < threshold - 1e-9 for t in batch["text"].cast(pa.string()).to_pylist()], pa.bool_()))


def scores(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, clauses, toxic) for every row of docs (doc_id, text; other columns are ignored).

    The score is from 0 to 1. A null or empty text scores 0 and isn't toxic; repeated rows and rows
    without an id are scored each; an empty table gives an empty one.
    """
    learned = lexicon.learned
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, learned, threshold), "doc_id long, score double, clauses long, toxic boolean")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic rows, with all their columns. See scores() for nulls, empty texts and repeats."""
    learned = lexicon.learned
    return docs.mapInArrow(lambda it: _keep(it, learned, threshold), docs.schema)
