"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two passes over the documents, both without a shuffle of texts: the first counts
in how many documents each n-gram of a test item stands; the second looks up
each item's n-grams, and aligns the words around every hit with the item's
words. The score is the best local alignment over that of an exact copy, so
copies with words changed, added or left out score nearly 1.

An n-gram is rare if at most RARE_SHARE of the documents have it, or at most
RARE_TIMES as many as have the rarest n-gram of its item. The words around a
rare one are aligned outright; those around frequent ones only if they hold so
many of the item's words that the threshold can be reached. So no n-gram is
lost as a seed, however many documents hold the item, whole, edited or cut; and
a passage that many documents hold is aligned once in a task.

The items go to all executors in slices of at most SLICE_WORDS words; a larger
benchmark takes more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import _tokens as T
from rillstone.llm._common import slices

N, THRESHOLD = 4, 0.5
RARE_SHARE, RARE_TIMES = 1e-4, 10
SLICE_WORDS = 1 << 22
#: Alignments that a task remembers.
KNOWN = 1 << 12
MATCH, MISMATCH, GAP = 2, -1, -1
_BITS = 20


class _Lookup:
    """Sorted hashes behind a bitmap of their first bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams of those that are listed, and their numbers."""
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        good = self.hashes[number] == grams[at]
        return at[good], number[good]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best score of a local alignment of two word sequences, and the words' range in it."""
    m = len(words)
    ramp = -GAP * np.arange(1, m + 1)
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    start = np.arange(m + 1)
    origin = 0
    for w in item:
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        cell = np.maximum(np.maximum(diagonal, up), 0)
        source = np.where(cell == 0, np.arange(1, m + 1), np.where(diagonal >= up, start[:-1], start[1:]))
        lifted = cell + ramp
        carried = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == carried, np.arange(m), 0))
        value = carried - ramp
        row = np.concatenate([[0], value])
        start = np.concatenate([[0], source[came]])
        k = int(np.argmax(row))
        if row[k] > best:
            best, end, origin = int(row[k]), k, int(start[k])
    return best, origin, end


def _seed_counts(batches: Iterator[pa.RecordBatch], lookup: _Lookup, n: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(lookup.hashes), np.int64)
    rows = 0
    for batch in (part for whole in batches for part in slices(whole)):
        hashes, _, _, offsets = T.words(T.column(batch["text"]))
        grams, offsets = T.ngrams(hashes, offsets, n)
        at, number = lookup.find(grams)
        doc = np.searchsorted(offsets, at, "right") - 1
        pairs = np.unique(doc * len(lookup.hashes) + number) if len(at) else np.zeros(0, np.int64)
        total += np.bincount(pairs % max(1, len(lookup.hashes)), minlength=len(total))[: len(total)]
        rows += batch.num_rows
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen])), pa.array(np.concatenate([[rows], total[seen]]))], ["seed", "df"])


class _Items:
    """The items' words, and which items have which n-gram that documents hold at which word, and whether it is rare."""

    def __init__(self, ids: list, words: list[np.ndarray], grams: list[np.ndarray], held: list[np.ndarray], rare: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        entries = [(g, i, k, bool(few)) for i, (gs, keep, rares) in enumerate(zip(grams, held, rare)) for k, (g, ok, few) in enumerate(zip(gs, keep, rares)) if ok]
        self.lookup = _Lookup(np.array([e[0] for e in entries], np.uint64))
        number = np.searchsorted(self.lookup.hashes, np.array([e[0] for e in entries], np.uint64))
        self.places: dict[int, list[tuple[int, int, bool]]] = {}
        for c, (_, i, k, few) in zip(number, entries):
            self.places.setdefault(int(c), []).append((i, k, few))

    def _aligned(self, i: int, words: np.ndarray) -> tuple[int, int, int]:
        key = (i, words.tobytes())
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[key] = align(self.words[i], words)
        return found

    def matches(self, words: np.ndarray, at: np.ndarray, number: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) of the best alignment with each item that reaches the threshold."""
        spans: dict[int, list[tuple[int, int]]] = {}
        outright = set()
        for p, c in zip(at.tolist(), number.tolist()):
            for i, k, few in self.places[c]:
                size = len(self.words[i])
                spans.setdefault(i, []).append((max(0, p - k - size // 2), min(len(words), p - k + size + size // 2)))
                if few:
                    outright.add(i)
        out = []
        for i, around in spans.items():
            around.sort()
            merged = [around[0]]
            for low, high in around[1:]:
                if low <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
                else:
                    merged.append((low, high))
            full = MATCH * len(self.words[i])
            if i not in outright:  # each of the item's words matches once at most
                merged = [(low, high) for low, high in merged if MATCH * np.isin(self.words[i], words[low:high]).sum() >= threshold * full]
            best = max(((score / full, low + a, low + b) for low, high in merged for score, a, b in [self._aligned(i, words[low:high])]), key=lambda x: (x[0], -x[1]), default=None)
            if best and best[0] >= threshold:
                out.append((i, *best))
        return out


def _hits(batch: pa.RecordBatch, items: _Items, n: int, threshold: float) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
    hashes, _, _, offsets = T.words(T.column(batch["text"]))
    grams, starts = T.ngrams(hashes, offsets, n)
    at, number = items.lookup.find(grams)
    if not len(at):
        return
    doc = np.searchsorted(starts, at, "right") - 1
    for d in np.unique(doc):
        own = doc == d
        for match in items.matches(hashes[offsets[d] : offsets[d + 1]], at[own] - starts[d], number[own], threshold):
            yield int(d), match


def _find(batches: Iterator[pa.RecordBatch], items: _Items, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        found = list(_hits(batch, items, n, threshold))
        if found:
            ids = batch["doc_id"].take(pa.array([d for d, _ in found]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[m[0]] for _, m in found], pa.int64()), *(pa.array([m[k] for _, m in found], t) for k, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64())))], ["doc_id", "item_id", "score", "first_word", "end_word"])


def _keep(batches: Iterator[pa.RecordBatch], items: _Items, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        keep = np.ones(batch.num_rows, bool)
        keep[[d for d, _ in _hits(batch, items, n, threshold)]] = False
        yield batch.filter(pa.array(keep))


def prepare(docs: DataFrame, benchmark: DataFrame, n: int = N, slice_words: int = SLICE_WORDS) -> Iterator[_Items]:
    """The benchmark in slices, with each item's n-grams that documents hold, and which are rare, by counts over all documents."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // (6 * slice_words)))
    for s in range(slices):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).orderBy("item_id", "text").collect()  # of bounded size
        words = [T.word_hashes(r["text"]) for r in rows]
        rows, words = [r for r, w in zip(rows, words) if len(w) >= n], [w for w in words if len(w) >= n]
        grams = [T.ngrams(w, np.array([0, len(w)]), n)[0] for w in words]
        lookup = _Lookup(np.concatenate(grams) if grams else np.zeros(0, np.uint64))
        counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _seed_counts(it, lookup, n), "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df")).collect() if rows else []
        df = {r["seed"]: r["df"] for r in counted}
        total, held, rare = df.pop(-1, 0), [], []
        for g in grams:
            own = np.array([df.get(int(i), 0) for i in np.searchsorted(lookup.hashes, g)])
            held.append(own > 0)
            rare.append(own <= max(RARE_SHARE * total, RARE_TIMES * max(1, own.min())))
        yield _Items([r["item_id"] for r in rows], words, grams, held, rare)


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): where documents hold test items.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    Null or empty texts match nothing, nor do items of fewer than n words or
    without an id. A document without an id is reported with a null doc_id;
    repeated rows are reported each. Of several places in a document that hold
    an item the best counts, the first of equals. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in prepare(docs, benchmark, n, slice_words):
        part = docs.mapInArrow(lambda it, items=items: _find(it, items, n, threshold), "doc_id long, item_id long, score double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the rows that hold a test item, with all their columns; null and empty texts stay. See matches()."""
    out = docs
    for items in prepare(docs, benchmark, n, slice_words):
        out = out.mapInArrow(lambda it, items=items: _keep(it, items, n, threshold), docs.schema)
    return out
