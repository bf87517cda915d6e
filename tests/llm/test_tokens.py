import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import _tokens as T

UNSPACED = "\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff"
WORD = re.compile(f"[{UNSPACED}]|(?:(?![{UNSPACED}])[0-9a-z_\u0080-\U0010ffff])+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8), st.integers(1, 4))
def test_words_and_ngrams_match_plain_python(texts, n):
    hashes, starts, ends, offsets = T.words(T.column(texts))
    data, _ = T.raw(T.column(texts))
    lower = T.column(texts).to_pylist()
    plain = [WORD.findall(t or "") for t in lower]
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(offsets, offsets[1:])]
    assert got == plain
    names: dict[str, int] = {}
    for ws, i, j in zip(plain, offsets, offsets[1:]):
        for w, h in zip(ws, hashes[i:j]):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    grams, bounds = T.ngrams(hashes, offsets, n)
    seen: dict[tuple, int] = {}
    for ws, i, j in zip(plain, bounds, bounds[1:]):
        want = [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
        assert len(want) == j - i
        for g, h in zip(want, grams[i:j]):
            assert seen.setdefault(g, h) == h


def test_sliced_batches_and_long_rows():
    texts = ["x y", "a" * 200_000 + " b", None, "c d"] * 3
    whole = T.words(T.column(texts))
    part = T.words(T.column(pa.array(texts).slice(4, 4)))
    assert np.array_equal(whole[0][whole[3][4] : whole[3][8]], part[0])


def test_slices_bound_bytes_and_rows():
    from rillstone.llm._common import slices

    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 95, "", "c" * 10] * 3), "n": pa.array(range(15))})
    for most_bytes, most_rows in ((100, 99), (5, 99), (1000, 2), (1000, 1000)):
        parts = list(slices(batch, "text", most_bytes, most_rows))
        assert [x for p in parts for x in p["n"].to_pylist()] == list(range(15)) and all(p.num_rows <= most_rows for p in parts)
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p["text"].to_pylist()) <= most_bytes + 95 for p in parts)
    assert list(slices(batch.slice(0, 0))) == []


def test_sweep_removes_what_cut_wrote(spark):
    import os

    from rillstone.llm import _common

    path = _common.cut(spark.range(3), "sweep").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    kept = list(_common._written)
    _common._written[:] = [p for p in kept if "/sweep-" in p]
    _common.sweep(spark)
    assert not os.path.exists(path)
    _common._written[:] = [p for p in kept if "/sweep-" not in p]


def test_scripts_without_blanks():
    hashes, starts, ends, offsets = T.words(T.column(["東京は today ไทย 한국어 é", "京"]))
    assert np.diff(offsets).tolist() == [3 + 1 + 3 + 1 + 1, 1] and hashes[1] == hashes[-1]
