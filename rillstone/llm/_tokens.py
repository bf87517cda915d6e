"""Words, shingles and lines of whole Arrow batches, by numpy on the UTF-8 bytes.

No Python string is made: a batch is lower-cased by Arrow, its bytes are split
where a byte isn't part of a word, and every word gets a 64-bit polynomial hash
from running sums, so a text of any length is processed whole. A word is a
maximal run of ASCII letters, digits, ``_`` and characters beyond ASCII; in scripts without blanks between words
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) each character is a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes are hashed in pieces of whole rows of about this many bytes.
CHUNK_BYTES = 1 << 16
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of x over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(values, lower: bool = True) -> pa.Array:
    """One large_string array; null stays null."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.large_string())
    if not isinstance(values, pa.Array):
        values = pa.array(values, pa.large_string())
    values = values.cast(pa.large_string())
    return pc.utf8_lower(values) if lower else values


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array; a null row is empty."""
    values = pc.fill_null(values, "")
    if values.offset:
        values = pa.concat_arrays([values, pa.array([], pa.large_string())])
        if values.offset:
            values = values.take(pa.array(np.arange(len(values))))
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(values) + 1) if buffers[1] is not None and len(values) else np.zeros(len(values) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(member[1:] != member[:-1]) + 1  # starts and ends in turn
    if len(member) and (member[0] or member[-1]):
        edge = np.concatenate([[0] if member[0] else [], edge, [len(member)] if member[-1] else []]).astype(np.int64)
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _characters(part: np.ndarray) -> np.ndarray:
    """First and end bytes of the characters of scripts without blanks between words."""
    at = np.flatnonzero((part >= 0xE0) & (part <= 0xE9))
    at = at[at + 2 < len(part)]
    if not len(at):
        return at
    lead, then = part[at], part[at + 1]
    at = at[(lead >= 0xE3) | (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB) | (lead == 0xE1) & ((then <= 0x82) | (then == 0x9E) | (then == 0x9F))]
    return np.unique(np.concatenate([at, at + 3]))


def words(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (among all rows' bytes) of each word, and the offsets of the rows in these."""
    return tokens(*raw(values), _WORD)


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of maximal runs of bytes that the table says belong to one."""
    hashes, firsts, lasts, counts = [], [], [], []
    row, n = 0, len(offsets) - 1
    while row < n:
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        until = min(until, n)
        low, high = offsets[row], offsets[until]
        part = data[low:high]
        member = table[part]
        starts, ends = _spans(member)
        bounds = offsets[row : until + 1] - low
        cuts = np.concatenate([bounds[1:-1], _characters(part)])
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(part))])
        cuts = cuts[member[cuts] & member[cuts - 1]]
        if len(cuts):  # a word must not run over from a row into the next
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        hashes.append(span_hashes(part, starts, ends))
        at = np.searchsorted(starts, bounds)
        counts.append(np.diff(at))
        firsts.append(starts + low)
        lasts.append(ends + low)
        row = until
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the rows' offsets in them; rows of fewer words have none."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
    joint = np.zeros(total, np.uint64)
    for k in range(n):
        joint = joint * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + total]
    keep = np.zeros(total + n, bool)
    keep[: len(hashes)] = True
    for k in range(1, n):
        at = offsets[1:] - k
        at = at[(at >= 0)]
        keep[at] = False
    joint = mix(joint[keep[:total]])
    return joint, np.concatenate([[0], np.cumsum(counts)])


def word_hashes(text: str) -> np.ndarray:
    return words(column([text]))[0]
