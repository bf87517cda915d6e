"""Chat formatting by quotation linking.

Messages quote what they answer: lines that begin with ``>``, as many as the
quote is deep. Lines in a row of one level, up to a blank line, are a passage;
its words are hashed, so neither case nor blanks nor where lines break matters.
What a message quotes at level k + 1, the message that it answers has at level
k (its own text is level 0): the passages of all levels are joined to those of
earlier messages, and the one that holds most of them is the one answered; of
equals the one that holds most of the single lines quoted, for passages quoted
in part, then the latest. A passage or line counts for every earlier message
that has it, however many these are ("Thanks.").

Conversations are then rebuilt in reply order, answers after what they answer,
without the quotes. Parsing is a pass over batches of bytes; then one shuffle
by conversation, of the messages' own texts and of hashes, brings together what
is joined and ordered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm import _tokens as T
from rillstone.llm._common import runs, slices

#: Where more earlier messages have a passage, votes are counted in arrays; this affects cost only.
HOLDERS = 8
#: Texts are parsed and passed on in parts of about so many bytes; arrays of a part take some 30 times as many.
BATCH_BYTES = 1 << 20
#: A line that says who wrote what is quoted below; it goes with the quote.
_ATTRIBUTION = re.compile(r"(?i)^(on .{1,200} wrote:|le .{1,200} a écrit :|am .{1,200} schrieb .{0,100}:|el .{1,200} escribió:)$")
OUT = "conv_id long, position int, turn long, parent_turn long, depth int, role string, text string"
_PARSED = "conv_id long, turn long, role string, own string, digest long, asks array<long>, asks_lines array<long>, offers array<long>, offers_lines array<long>"
_SOLID = np.arange(256) > 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LEVEL, _LINE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


class Lines:
    """The lines of a batch of texts: first byte, where the content begins, end, row, level, and whether a line introduces a quote."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        breaks = np.flatnonzero(data == 10)
        rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        starts = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((starts, rows))
        self.row, self.start = rows[order], starts[order]
        following = np.concatenate([self.start[1:], [len(data)]])
        last = np.concatenate([self.row[1:] != self.row[:-1], [True]])
        self.size = np.where(last, offsets[self.row + 1], following) - self.start  # with the break
        self.end = self.start + self.size - np.where(last, 0, 1)
        filled = np.flatnonzero((data != 62) & (data != 32) & (data != 9))
        filled = np.concatenate([filled, [len(data)]])
        self.content = np.minimum(filled[np.searchsorted(filled, self.start)], self.end)
        marks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 62, out=marks[1:])
        self.level = marks[self.content] - marks[self.start]
        self.blank = self.content == self.end
        self.introduces = self._introduces(last)

    def _introduces(self, last: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), bool)
        n = len(out)
        quoted = (self.level > 0) & ~self.blank
        beyond = np.concatenate([np.where(last[:-1], False, quoted[1:]), [False]])  # the next line is a quote
        gap = np.concatenate([np.where(last[:-1], False, self.blank[1:] & (self.level[1:] == 0) & beyond[1:]), [False]])
        for k in np.flatnonzero((self.level == 0) & ~self.blank & (beyond | gap)).tolist() if n else ():
            line = self.data[self.content[k] : self.end[k]].tobytes().strip()
            out[k] = line.endswith(b":") and bool(_ATTRIBUTION.match(line.decode("utf-8", "replace")))
        return out

    def own(self) -> pa.Array:
        """The rows' texts without quotes and what introduces them."""
        keep = (self.level == 0) & ~self.introduces
        counts = np.bincount(self.row, weights=self.size * keep, minlength=len(self.offsets) - 1).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()), pa.py_buffer(self.data[np.repeat(keep, self.size)].tobytes()))
        return pc.ascii_trim_whitespace(texts)

    def hashes(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, level, hash) of the passages, and of the lines."""
        folded = _FOLD[self.data]
        sizes = np.stack([self.content - self.start, self.size - (self.content - self.start)], 1).ravel()
        folded[np.repeat(np.tile([True, False], len(self.start)), sizes)] = 32
        words, first, _, _ = T.tokens(folded, self.offsets, _SOLID)
        use = ~self.blank & ~self.introduces
        new = np.ones(len(use), bool)
        new[1:] = ~use[:-1] | (self.level[1:] != self.level[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(use)
        heads = np.flatnonzero(use & new)
        tails = at[np.concatenate([np.flatnonzero(new[at])[1:] - 1, [len(at) - 1]])] if len(at) else at
        out = []
        for a, b in ((heads, tails), (at, at)):
            out.append((self.row[a], self.level[a], T.span_hashes(words, np.searchsorted(first, self.start[a]), np.searchsorted(first, self.end[b]))))
        return out[0], out[1]


def _lists(rows: np.ndarray, keys: np.ndarray, count: int) -> pa.Array:
    """Distinct keys by row."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    keep = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, bool)
    rows, keys = rows[keep], keys[keep]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)), pa.array(keys.view(np.int64)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, most_bytes=BATCH_BYTES)):
        texts = T.column(batch["text"], lower=False)
        if pc.any(pc.match_substring(texts, "\r")).as_py():
            texts = pc.replace_substring_regex(texts, "\r\n?", "\n")
        data, offsets = T.raw(texts)
        lines = Lines(data, offsets)
        passages, single = lines.hashes()
        made = []
        for (row, level, key), solo in ((passages, False), (single, True)):
            if solo:
                ask = level == 1
                offer = level == 0
                key = T.mix(key * _LINE)
                made += [_lists(row[ask], key[ask], batch.num_rows), _lists(row[offer], key[offer], batch.num_rows)]
            else:
                ask = level > 0
                level = level.astype(np.uint64)
                made += [_lists(row[ask], T.mix(key[ask] + level[ask] * _LEVEL), batch.num_rows), _lists(row, T.mix(key + (level + np.uint64(1)) * _LEVEL), batch.num_rows)]
        digest = T.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
        asks, offers, asks_lines, offers_lines = made
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], lines.own().cast(pa.string()), pa.array(digest), asks, asks_lines, offers, offers_lines], ["conv_id", "turn", "role", "own", "digest", "asks", "asks_lines", "offers", "offers_lines"])


def parse(messages: DataFrame) -> DataFrame:
    """Messages with ``own`` (the text without quotes), a digest of the whole text, and hashes: what they quote (``asks``) and what others may quote of them (``offers``), of passages with their level, and of single lines."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_parse, _PARSED)


def _linked(rows: list[dict]) -> None:
    """Gives each message of a conversation, in order of turns, the turn that it answers as ``parent``."""
    holders: dict[int, array] = {}
    for at, r in enumerate(rows):
        held = [[holders[k] for k in keys if k in holders] for keys in (r["asks"], r["asks_lines"])]
        best = _most(*held) if held[0] or held[1] else None
        r["parent"] = None if best is None else rows[best]["turn"]
        for key in {*r["offers"], *r["offers_lines"]}:
            holders.setdefault(key, array("q")).append(at)


def _most(passages: list[array], lines: list[array]) -> int:
    """The row that most passages name; of equals the one that most lines name, then the last. Each names a row once, in order."""
    if len(passages) + len(lines) == 1:
        return (passages or lines)[0][-1]
    if all(len(x) <= HOLDERS for x in (*passages, *lines)):
        votes: dict[int, list[int]] = {}
        for kind, held in enumerate((passages, lines)):
            for x in held:
                for source in x:
                    votes.setdefault(source, [0, 0])[kind] += 1
        return max(votes, key=lambda s: (votes[s], s))
    size = max(x[-1] for x in (*passages, *lines)) + 1
    rows = np.arange(size)
    for held in (passages, lines):
        if held:
            count = np.bincount(np.concatenate([np.frombuffer(x, np.int64) for x in held]), minlength=size)[rows]
            rows = rows[count == count.max()]
    return int(rows[-1])


def _order(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        by: dict = {}
        for row in table.to_pylist():
            known = by.setdefault(row["conv_id"], {})
            rank = lambda r: (r["role"] is not None, r["role"] or "", r["own"], r["digest"])
            if row["turn"] not in known or rank(known[row["turn"]]) < rank(row):
                known[row["turn"]] = row
        out = []
        for conv, known in by.items():
            rows = sorted(known.values(), key=lambda r: r["turn"])
            _linked(rows)
            answers: dict = {}
            for r in rows:
                answers.setdefault(r["parent"], []).append(r)
            todo = [(r, 0) for r in reversed(answers.get(None, []))]
            position = 0
            while todo:
                r, depth = todo.pop()
                out.append({"conv_id": conv, "position": position, "turn": r["turn"], "parent_turn": r["parent"], "depth": depth, "role": r["role"], "text": r["own"]})
                position += 1
                todo += [(x, depth + 1) for x in reversed(answers.get(r["turn"], []))]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("position", pa.int32()), ("turn", pa.int64()), ("parent_turn", pa.int64()), ("depth", pa.int32()), ("role", pa.string()), ("text", pa.string())]))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, position, turn, parent_turn, depth, role, text): conversations in reply order, without quotes.

    messages: conv_id, turn, role, text; other columns are ignored. Rows
    without conv_id or turn are left out. Of rows that share both, the one with
    the greatest role and then own text counts. A null or empty text answers
    nothing and becomes an empty one. A message that quotes nothing known starts
    a thread of its own, at depth 0; threads follow one another by turn. An
    empty table gives an empty one. A conversation is ordered within one task.
    """
    parsed = parse(messages.where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(lambda it: _order(runs(it, ["conv_id"])), OUT)


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Conversations as mail threads: each message begins with what it answers, quoted, with the quotes in that.

    Which one it answers: the turn before, or the second before if conv_id + turn is a multiple of 3.
    For data without quotes, to try link() on. A null text counts as empty; of rows that share conv_id and turn
    the last one is quoted, each becomes a message; an empty table gives an empty one.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(by_turn))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(lambda it: _quote(runs(it, ["conv_id"])), "conv_id long, turn long, role string, text string")


def _quote(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    now, texts, out, size = None, {}, [], 0
    for table in tables:
        for conv, turn, role, text in zip(*(table[c].to_pylist() for c in schema.names)):
            if conv != now:
                now, texts = conv, {}
            text = text or ""
            parent = texts.get(turn - 2 if (conv + turn) % 3 == 0 and turn >= 2 else turn - 1)
            if parent is not None:
                quoted = "\n".join([(">" if x[:1] == ">" else "> ") + x for x in parent.split("\n")])
                text = f"On that day they wrote:\n{quoted}\n\n{text}"
            texts[turn] = text
            out.append((conv, turn, role, text))
            size += len(text)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
