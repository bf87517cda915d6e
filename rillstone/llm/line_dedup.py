"""Line dedup by pairwise alignment.

Overlapping documents are found through the hashes of lines that they share:
of single lines that are rare (at most RARE documents hold them), and of runs
of adjacent lines, which are rare where their lines aren't: from each line on,
and up to each line, the least run that reaches MIN_WORDS words. A hash that
several documents hold links each of them to the first document that holds it,
so one in a million documents makes a million pairs, not its square. All
repeats are covered nevertheless: each line of a block that is common with any
earlier document lies in a least run within the block, and the first holder of
that run is aligned. The two documents of a pair are aligned by patience diff
on their lines' hashes; runs of lines that are common to both in order, of at
least MIN_WORDS words, are deleted from the later one; what is left is aligned
again, for blocks that moved; common runs that the order of the alignments
still missed are looked up at last.

Only hashes move until the end: one row per document with its lines' hashes and
lengths. The texts are joined with the deletions once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm import _tokens as T
from rillstone.llm._common import cut, fresh

#: Blocks under MIN_WORDS words stay: headings, signatures, stock phrases.
MIN_WORDS = 30
#: A single line of fewer words, or that more documents hold, links none by itself, though it is deleted within a block.
SEED_WORDS, RARE = 4, 64
#: In scripts without blanks between words each character counts as one.
_UNSPACED = "[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff]"


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that stand once in either part, as the longest run of pairs that rise in both."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {h: i for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1 and in_b.get(h) == 1}
    tails: list[int] = []
    at: list[tuple[int, int]] = []
    back: list[int] = []
    ends: list[int] = []
    for j in range(b0, b1):
        i = where.get(b[j])
        if i is None:
            continue
        k = bisect_left(tails, i)
        if k == len(tails):
            tails.append(i)
            ends.append(len(at))
        else:
            tails[k] = i
            ends[k] = len(at)
        back.append(ends[k - 1] if k else -1)
        at.append((i, j))
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(at[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a and b in order: common ends, then lines unique in both, then the parts between these."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _anchors(a, b, a0, a1, b0, b1)
        if not chain:  # nothing is unique on both sides: the first line of b that a has, as diff does
            first = {}
            for i in range(a1 - 1, a0 - 1, -1):
                first[a[i]] = i
            j = next((j for j in range(b0, b1) if b[j] in first), None)
            if j is None:
                continue
            chain = [(first[b[j]], j)]
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _blocks(a: list, b: list, words: list[int], min_words: int) -> list[int]:
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Numbers of the lines of b in blocks that are common with a, in one piece in both, and of at least min_words words.

    What is left of b is aligned again until nothing is found, so blocks that
    stand in another order, or twice in b, are found too. What overlaps blocks
    that were found, or that the alignments paired otherwise, is looked up.
    """
    left: list = list(b)
    out: set[int] = set()
    while found := _blocks(a, left, words, min_words):
        for j in found:
            left[j] = ("deleted", j)  # equals no line of a
        out.update(found)
    return sorted(out | _missed(a, b, words, min_words, out))


def _missed(a: list[int], b: list[int], words: list[int], min_words: int, known: set[int]) -> set[int]:
    """Lines of b that aren't known, in runs of at least min_words words that a has in one piece."""
    held = set(a)
    if all(j in known or h not in held for j, h in enumerate(b)):
        return set()
    starts, ends = least_runs(np.array(words, np.int64), np.array([0, len(b)]), min_words)
    places: dict[int, list[int]] = {}
    for i, h in enumerate(a):
        places.setdefault(h, []).append(i)
    out: set[int] = set()
    for s, e in zip(starts.tolist(), ends.tolist()):
        if any(j not in known and j not in out for j in range(s, e)) and any(a[i : i + e - s] == b[s:e] for i in places.get(b[s], ())):
            out.update(range(s, e))
    return out - known


def least_runs(words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end lines of the least runs within a row that reach min_words words: from each line on, and up to each line."""
    sums = np.concatenate([[0], np.cumsum(words)])
    first, last = np.repeat(offsets[:-1], np.diff(offsets)), np.repeat(offsets[1:], np.diff(offsets))
    line = np.arange(len(words))
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + min_words, "left"), line + 1)
    starts = np.minimum(np.searchsorted(sums, sums[1:] - min_words, "right") - 1, line)
    on, up = ends <= last, (starts >= first) & (sums[line + 1] - sums[np.maximum(starts, 0)] >= min_words)
    up &= ~(on[np.maximum(starts, 0)] & (ends[np.maximum(starts, 0)] == line + 1))  # is such a run from its first line on
    return np.concatenate([line[on], starts[up]]), np.concatenate([ends[on], line[up] + 1])


def _align(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {c: batch[c].to_pylist() for c in ("first_lines", "lines", "words")}
        gone = [common_blocks(a, b, w, min_words) for a, b, w in zip(cols["first_lines"], cols["lines"], cols["words"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "text_hash", "gone"])


def _links(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, line, run): the hashes of the documents' lines, and of their least runs."""
    for batch in batches:
        lines, offsets = batch["lines"].flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(batch["lines"].value_lengths().to_numpy(), dtype=np.int64)])
        words = batch["words"].flatten().to_numpy().astype(np.int64)
        starts, ends = least_runs(words, offsets, min_words)
        long = np.flatnonzero((words >= seed_words) & (words < min_words))
        several = ends - starts > 1  # of one line, its own hash links
        single = starts[~several]
        starts, ends = starts[several], ends[several]
        at = np.concatenate([long, single, starts])
        links = np.concatenate([lines[long], lines[single], T.span_hashes(lines, starts, ends)]).view(np.int64)
        row = np.searchsorted(offsets, at, "right") - 1
        order = np.lexsort((links, row))
        order = order[np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (links[order][1:] != links[order][:-1])])] if len(order) else order
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row[order])), pa.array(links[order], pa.int64()), pa.array(order >= len(long))], ["doc_id", "line", "run"])


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _words(lines: Column, text: Column) -> Column:
    """The numbers of words of the lines; the text is looked through once for scripts without blanks."""
    spaced = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    plain = F.transform(lines, lambda x: F.when(x == "", 0).otherwise(spaced(x)))
    return F.when(text.rlike(_UNSPACED), F.transform(lines, lambda x: F.when(x == "", 0).otherwise(spaced(x) + F.regexp_count(x, F.lit(_UNSPACED))))).otherwise(plain)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, rare: int = RARE) -> DataFrame:
    """(doc_id, text_hash, gone): the numbers, from 0, of the lines to delete from each document. See line_dedup()."""
    text = F.col("text").cast("string")
    trimmed = F.transform(_lines(text), lambda x: F.trim(x))
    per = docs.where(F.col("doc_id").isNotNull() & text.isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.transform(trimmed, lambda x: F.xxhash64(x)).alias("lines"),
        _words(trimmed, text).alias("words"),
    )
    per = cut(per.groupBy("doc_id").agg(F.max_by(F.struct("text_hash", "lines", "words"), "text_hash").alias("s")).select("doc_id", "s.*"), "lines")
    telling = per.select("doc_id", "lines", "words").mapInArrow(lambda it: _links(it, min_words, seed_words), "doc_id long, line long, run boolean")
    held = telling.groupBy("line").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"), F.max("run").alias("run"))
    first = held.where((F.col("docs") > 1) & (F.col("run") | (F.col("docs") <= rare))).select("line", "first")
    pairs = telling.join(first, "line").where("doc_id > first").select("doc_id", "first").distinct()
    earlier = per.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines"))
    both = pairs.join(per, "doc_id").join(earlier, "first").select("doc_id", "text_hash", "first_lines", "lines", "words")
    found = both.mapInArrow(lambda it: _align(it, min_words), "doc_id long, text_hash long, gone array<int>").where(F.size("gone") > 0)
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs with repeated blocks of lines deleted from all but the first document (by doc_id) that holds them.

    All columns stay; n_chars, where there is one, is counted anew for changed
    texts. A document that lost all its lines keeps an empty text, or goes with
    ``drop_emptied``. Rows without an id or a text are left as they are. Rows
    that share an id are one document: of different texts one alone is compared
    (that of the greatest hash) and changed, equal ones change alike. Lines are
    compared without the blanks around them; repeats within one document stay.
    An empty table gives an empty one.
    """
    own, text_hash, lines = fresh(docs, "__id", "__hash", "__gone")
    gone = deletions(docs, min_words, seed_words).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), F.col("gone").alias(lines))
    text = docs["text"].cast("string")
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone[own]) & (F.xxhash64(text) == gone[text_hash]), "left")
    left = F.array_join(F.filter(_lines(F.col("text").cast("string")), lambda x, i: ~F.array_contains(F.col(lines), i)), "\n")
    changed = {"text": F.when(F.col(lines).isNull(), F.col("text")).otherwise(left)}
    out = joined.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    if drop_emptied:
        out = out.where(F.col(lines).isNull() | (F.trim(F.regexp_replace(F.col("text"), "\n", " ")) != ""))
    return out.select(*docs.columns)
