"""Media columns: TIFF and BigTIFF images, one row per page.

The chain of image directories is walked; strips or tiles are decoded (none,
PackBits, LZW, deflate), predictors (horizontal differences, floating point)
undone, planes and tiles put together. Malformed bytes never stop a job: what
is wrong is said in the row's ``error``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm._common import fresh

_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SIZES = {k: struct.calcsize("<" + form) for k, form in _TYPES.items()}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: A page that claims more bytes than this is refused, so that a forged header can't take an executor's memory.
MOST_BYTES = 1 << 30
#: Pages go on as soon as they have so many bytes of pixels.
FLUSH_BYTES = 1 << 26
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
PAGE = "page int, width int, height int, samples int, bits int, sample_format int, compression int, predictor int, photometric int, pixels binary, error string"


@dataclass
class Page:
    page: int | None = None
    width: int | None = None
    height: int | None = None
    samples: int | None = None
    bits: int | None = None
    sample_format: int | None = None
    compression: int | None = None
    predictor: int | None = None
    photometric: int | None = None
    pixels: bytes | None = None
    error: str | None = None


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_widths(count: int) -> np.ndarray:
    """Bits of each of the codes that follow a clear code: the table grows by one a code, and widths change one code early."""
    return np.minimum(9 + np.searchsorted([511, 1023, 2047], 258 + np.arange(count) - 1, "right"), 12)


_LZW_FIRST = [bytes([i]) for i in range(256)] + [b"", b""]
_LZW_MOST = 1 << 12
_LZW_WIDTHS = lzw_widths(_LZW_MOST)
_LZW_ENDS = np.cumsum(_LZW_WIDTHS)
#: Of so few bytes, codes are cut out of one integer.
_LZW_SMALL = 256
_LZW_SPANS = [(e, (1 << w) - 1) for e, w in zip(_LZW_ENDS.tolist(), _LZW_WIDTHS.tolist())]


def _lzw_codes(raw: np.ndarray, at: int, count: int) -> np.ndarray:
    """Up to so many codes from bit ``at`` on, as they follow a clear code; raw ends with two bytes of padding."""
    widths, ends = (_LZW_WIDTHS[:count], _LZW_ENDS[:count]) if count <= _LZW_MOST else ((w := lzw_widths(count)), np.cumsum(w))
    count = int(np.searchsorted(ends, (len(raw) - 2) * 8 - at, "right"))
    widths, ends = widths[:count], ends[:count]
    bit = at + ends - widths
    byte = bit >> 3
    three = raw[byte].astype(np.int32) << 16 | raw[byte + 1].astype(np.int32) << 8 | raw[byte + 2]
    return three >> (24 - (bit & 7) - widths) & ((1 << widths) - 1)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, that widen one code early. Between clear codes all widths are known, so codes are cut out in one go."""
    small = len(data) <= _LZW_SMALL
    raw = int.from_bytes(data, "big") if small else np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2, np.uint8)])
    out, length, at = [], 0, 0
    while length < size:
        if small:
            codes, end = [], 257
            left = 8 * len(data) - at
            for e, mask in _LZW_SPANS:
                if e > left:
                    break
                code = raw >> (left - e) & mask
                if code == 256 or code == 257:
                    at, end = at + e, code
                    break
                codes.append(code)
        else:
            found = _lzw_codes(raw, at, min(_LZW_MOST, size - length + 2))
            stop = np.flatnonzero(found >> 1 == 128)
            if not len(stop) and len(found) == _LZW_MOST:  # a writer that doesn't clear its table
                found = _lzw_codes(raw, at, size - length + 2)
                stop = np.flatnonzero(found >> 1 == 128)
            end = 257
            if len(stop):
                at, end, found = at + int(lzw_widths(int(stop[0]) + 1).sum()), int(found[stop[0]]), found[: stop[0]]
            codes = found.tolist()
        table, before = _LZW_FIRST[:], b""
        for code in codes:
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise ValueError(f"LZW code {code} isn't in the table")
            out.append(entry)
            length += len(entry)
            if before:
                table.append(before + entry[:1])
            before = entry
            if length >= size:
                break
        if end == 257:
            break
    return b"".join(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} isn't supported")


def _samples(data: bytes, rows: int, width: int, per: int, bits: int, form: int, predictor: int, order: str) -> np.ndarray:
    """Rows of samples of a strip or tile, predictor undone, in native byte order; (rows, width, per)."""
    row_bytes = (width * per * bits + 7) // 8
    if len(data) < rows * row_bytes:
        raise ValueError(f"a strip or tile has {len(data)} of {rows * row_bytes} bytes")
    raw = np.frombuffer(data[: rows * row_bytes], np.uint8).reshape(rows, row_bytes)
    if bits < 8:
        if bits not in (1, 2, 4):
            raise ValueError(f"samples of {bits} bits aren't supported")
        values = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        values = (values * (1 << np.arange(bits - 1, -1, -1))).sum(2)[:, : width * per].astype(np.uint8).reshape(rows, width, per)
        if predictor == 2:
            values = np.cumsum(values, axis=1, dtype=np.uint8) & np.uint8((1 << bits) - 1)
        return values
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits aren't supported")
    size = bits // 8
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(form, "u")
    if kind == "f" and bits == 8:
        raise ValueError("floating point samples of 8 bits aren't supported")
    if predictor == 3:
        if kind != "f":
            raise ValueError("predictor 3 is for floating point samples")
        plain = np.cumsum(raw.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, size, width * per)
        return np.ascontiguousarray(plain.transpose(0, 2, 1)).view(f">f{size}").astype(f"<f{size}").reshape(rows, width, per)
    values = raw.view(f"{order}u{size}").astype(f"<u{size}").reshape(rows, width, per)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return values.view(f"<{kind}{size}")


class _File:
    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if data[:2] == b"II" else ">"
        version = self.get("H", 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.first = self.get("Q", 8)[0] if self.big else self.get("I", 4)[0]

    def get(self, form: str, at: int) -> tuple:
        form = self.order + form
        if at < 0 or at + struct.calcsize(form) > len(self.data):
            raise ValueError(f"the file ends before byte {at + struct.calcsize(form)}")
        return struct.unpack_from(form, self.data, at)

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        """Tags of the directory, and where the next one is."""
        count_form, entry, word = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        count = self.get(count_form, at)[0]
        at += struct.calcsize("<" + count_form)
        self.get("B", at + count * entry - 1 if count else at)
        tags = {}
        inline = 8 if self.big else 4
        for tag, kind, n, place in struct.iter_unpack(f"{self.order}HH{word}{inline}s", self.data[at : at + count * entry]):
            form = _TYPES.get(kind)
            if form is None:
                continue
            size = _SIZES[kind] * n
            if size > len(self.data):
                raise ValueError(f"tag {tag} is longer than the file")
            form = f"{self.order}{n * len(form)}{form[0]}"
            if size <= inline:
                tags[tag] = struct.unpack_from(form, place)
            else:
                (start,) = struct.unpack(self.order + word, place)
                if start + size > len(self.data):
                    raise ValueError(f"the file ends before byte {start + size}")
                tags[tag] = struct.unpack_from(form, self.data, start)
        return tags, self.get(word, at + count * entry)[0]

    def page(self, tags: dict[int, tuple], page: Page) -> None:
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        width, height = one(256), one(257)
        page.width, page.height, page.photometric = width, height, one(262)
        page.samples, page.compression, page.predictor = one(277, 1), one(259, NONE), one(317, 1)
        depths = tags.get(258, (1,))
        page.bits, page.sample_format = depths[0], one(339, 1)
        if not width or not height:
            raise ValueError("no width or height")
        if len(set(depths)) > 1:
            raise ValueError("samples differ in bits")
        bits, per, planar = page.bits, page.samples, one(284, 1)
        size = max(1, bits // 8)
        if not per or width * height * per * size > MOST_BYTES:
            raise ValueError("the page is too large")
        tiled = 322 in tags
        block_width, block_height = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        starts, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
        if not starts or not counts or len(starts) != len(counts) or not block_width or not block_height:
            raise ValueError("no strips or tiles")
        if block_width * block_height * per * size > MOST_BYTES:
            raise ValueError("a tile is too large")
        turned = one(266, 1) == 2
        planes = per if planar == 2 else 1
        across, down = -(-width // block_width), -(-height // block_height)
        if len(starts) < planes * across * down:
            raise ValueError(f"{len(starts)} of {planes * across * down} strips or tiles")
        out = None
        in_block = 1 if planar == 2 else per
        for k in range(planes * across * down):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * block_height, rest % across * block_width
            rows = block_height if tiled else min(block_height, height - y)
            need = rows * ((block_width * in_block * bits + 7) // 8)
            if starts[k] + counts[k] > len(self.data):
                raise ValueError("a strip or tile is beyond the file's end")
            stored = self.data[starts[k] : starts[k] + counts[k]]
            data = _unpack(stored.translate(_TURNED) if turned else stored, page.compression, need)
            block = _samples(data, rows, block_width, in_block, bits, page.sample_format, page.predictor, self.order)
            if out is None:
                out = np.zeros((height, width, per), block.dtype)
            part = block[: height - y, : width - x]
            out[y : y + part.shape[0], x : x + part.shape[1], slice(plane, plane + 1) if planar == 2 else slice(None)] = part
        page.pixels = out.tobytes()


def read_pages(data: bytes | None) -> Iterator[Page]:
    """The pages of a file, one at a time; a null, empty or foreign one gives one row that says so."""
    if data is None:
        yield Page(error="null")
        return
    try:
        file = _File(data)
    except ValueError as e:
        yield Page(error=str(e))
        return
    at, seen = file.first, set()
    if not at:
        yield Page(error="no directory")
    while at:
        page = Page(len(seen))
        if at in seen:
            page.error = "the directories form a ring"
            yield page
            return
        seen.add(at)
        try:
            tags, at = file.directory(at)
        except (ValueError, struct.error) as e:
            page.error = str(e)
            yield page
            return
        try:
            file.page(tags, page)
        except (ValueError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            page.error = str(e)
        yield page


def _decode(batches: Iterator[pa.RecordBatch], column: str, kept: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fields = list(Page.__dataclass_fields__)
    for batch in batches:
        rows: list[int] = []
        held: list[Page] = []
        size = 0

        def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            made = [pa.array([getattr(p, f) for p in held], schema.field(len(kept) + k).type) for k, f in enumerate(fields)]
            out = pa.RecordBatch.from_arrays([batch[c].take(pa.array(rows, pa.int64())) for c in kept] + made, schema=schema)
            rows.clear()
            held.clear()
            return out

        for i in range(batch.num_rows):
            for page in read_pages(batch[column][i].as_py()):
                more = len(page.pixels or b"")
                if held and (size + more > FLUSH_BYTES or len(held) >= 4096):
                    yield flush()
                    size = 0
                rows.append(i)
                held.append(page)
                size += more
        if held:
            yield flush()


def pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each TIFF file in a binary column, with the row's other columns.

    pixels holds the samples row by row, low byte first, a byte each for samples
    of under 8 bits. Null or malformed files give one row with a null page and
    an error; a damaged page keeps what was read of its directory, as does one of
    over MOST_BYTES. Repeated rows are decoded each; an empty table gives an empty
    one. A column of df named like one of the page's gets ``source_`` before its
    name. A task holds one file, one page, and FLUSH_BYTES of pixels.
    """
    names = PAGE.split(", ")
    taken = {n.split()[0] for n in names}
    others = [c for c in df.columns if c != column]
    renamed = []
    for c in others:
        new = c
        while new.lower() in taken or (new != c and new in others):
            new = "source_" + new
        renamed.append(new)
    (media,) = fresh(df, "__media")
    selected = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, renamed)], F.col(f"`{column}`").cast("binary").alias(media))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([*selected.drop(media).schema.fields, *StructType.fromDDL(PAGE).fields])
    arrow = to_arrow_schema(out)
    return selected.mapInArrow(lambda it: _decode(it, media, renamed, arrow), out)
