import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import tiff, tiff_writer

METHODS = (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS)


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("predictor", (1, 2, 3))
@pytest.mark.parametrize("tile", (0, 16))
def test_round_trips(method, predictor, tile):
    r = np.random.default_rng(method + predictor + tile)
    for kind in ("f4", "f8") if predictor == 3 else ("u1", "u2", "u4", "i2") if predictor == 2 else ("u1", "u2", "u4", "i2", "f4"):
        for order in "<>":
            for planar in (1, 2):
                for big in (False, True):
                    for shape in ((7, 5), (33, 20, 3), (1, 1)):
                        image = (r.normal(size=shape) * 3).round().astype("i8").astype(kind)
                        blob = tiff_writer.write([image, image[::-1].copy()], method, predictor, tile, 4, order, planar, big)
                        pages = list(tiff.read_pages(blob))
                        assert [p.error for p in pages] == [None, None]
                        assert pages[0].pixels == image.astype("<" + kind).tobytes() and pages[1].pixels == image[::-1].astype("<" + kind).tobytes()
                        assert (pages[0].height, pages[0].width) == shape[:2] and pages[1].page == 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff_writer.pack_bits(data), len(data)) == data
    assert tiff.unpack_lzw(tiff_writer.pack_lzw(data), len(data)) == data


def test_lzw_over_all_code_widths():
    data = np.random.default_rng(1).integers(0, 5, 300_000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff_writer.pack_lzw(data), len(data)) == data


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_damaged_files_never_raise(data):
    blob = bytearray(tiff_writer.write([np.arange(60, dtype=np.uint8).reshape(6, 10)] * 2, data.draw(st.sampled_from(METHODS)), 1, data.draw(st.sampled_from((0, 16)))))
    for _ in range(data.draw(st.integers(1, 6))):
        blob[data.draw(st.integers(0, len(blob) - 1))] = data.draw(st.integers(0, 255))
    pages = list(tiff.read_pages(bytes(blob[: data.draw(st.integers(0, len(blob)))])))
    assert pages and all(p.pixels is not None or p.error for p in pages)


def test_bits_and_ring():
    image = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1]], np.uint8)
    blob = bytearray(tiff_writer.write([np.packbits(image, axis=1)], rows_per_strip=1))
    file = tiff._File(bytes(blob))
    at = file.first
    for k in range(int.from_bytes(blob[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        tag = int.from_bytes(blob[entry : entry + 2], "little")
        if tag in (256, 258):
            blob[entry + 8] = 9 if tag == 256 else 1
        end = entry + 12
    assert next(tiff.read_pages(bytes(blob))).pixels == image.tobytes()
    blob[end : end + 4] = at.to_bytes(4, "little")
    assert [p.error for p in tiff.read_pages(bytes(blob))] == [None, "the directories form a ring"]


def test_column(spark):
    one = tiff_writer.write([np.zeros((2, 2), np.uint8), np.ones((3, 1), np.uint16)], tiff.LZW)
    rows = [(1, bytearray(one), "a", 5), (1, bytearray(one), "a", 5), (2, None, None, 6), (3, bytearray(b""), "c", None), (None, bytearray(b"II*\0junk"), "d", 8)]
    df = spark.createDataFrame(rows, "id BIGINT, media BINARY, page STRING, source_page INT")
    out = tiff.pages(df).collect()
    assert [x for x in out[0].asDict()][:3] == ["id", "source_source_page", "source_page"]
    assert len(out) == 7
    assert [(x["page"], x["width"], x["height"], x["bits"]) for x in out[:2]] == [(0, 2, 2, 8), (1, 1, 3, 16)]
    assert bytes(out[1]["pixels"]) == b"\1\0" * 3 and [x["error"] is None for x in out] == [True] * 4 + [False] * 3
    assert tiff.pages(df.where("false")).count() == 0


def test_bits_in_turned_order():
    image = np.arange(60, dtype=np.uint8).reshape(6, 10)
    blob = bytearray(tiff_writer.write([image]))
    at = tiff._File(bytes(blob)).first
    for k in range(int.from_bytes(blob[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(blob[entry : entry + 2], "little") == 262:
            blob[entry : entry + 12] = struct.pack("<HHIHH", 266, 3, 1, 2, 0)
    start = bytes(blob).index(image.tobytes())
    blob[start : start + 60] = bytes(int(f"{x:08b}"[::-1], 2) for x in image.tobytes())
    assert next(tiff.read_pages(bytes(blob))).pixels == image.tobytes()


def test_pages_go_on_before_they_fill_memory(monkeypatch):
    monkeypatch.setattr(tiff, "FLUSH_BYTES", 1000)
    files = [tiff_writer.write([np.full((20, 20), k, np.uint8)] * k) for k in (1, 5, 3)] + [None] * 5
    schema = pa.schema([("id", pa.int64()), *((n, t) for n, t in zip(tiff.Page.__dataclass_fields__, [pa.int32()] * 9 + [pa.binary(), pa.string()]))])
    out = list(tiff._decode(iter([pa.RecordBatch.from_pydict({"id": list(range(8)), "m": pa.array(files, pa.binary())})]), "m", ["id"], schema))
    assert all(b.num_rows <= 2 or b["pixels"].null_count for b in out) and len(out) > 4
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["id"], r["page"]) for r in rows] == [(0, 0), *((1, k) for k in range(5)), *((2, k) for k in range(3)), *((k, None) for k in range(3, 8))]
    assert all(r["pixels"] is None or len(r["pixels"]) == 400 for r in rows)
