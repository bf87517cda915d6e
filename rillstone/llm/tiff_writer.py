"""Writes TIFF files, for round trips and for tables that have no images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rillstone.llm.tiff import DEFLATE, LZW, NONE, OLD_DEFLATE, PACKBITS, lzw_widths


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


_FIRST = {bytes([i]): i for i in range(256)}


def pack_lzw(data: bytes) -> bytes:
    codes, table, widths = [256], dict(_FIRST), [np.full(1, 9)]
    since, now = 0, b""
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        codes.append(table[now])
        since += 1
        table[more] = 257 + since
        now = data[i : i + 1]
        if 258 + since >= 4093:
            codes.append(256)
            widths.append(lzw_widths(since + 1))
            table, since = dict(_FIRST), 0
    if now:
        codes.append(table[now])
        since += 1
    codes.append(257)
    if len(codes) < 250:  # all of 9 bits
        bits = 0
        for code in codes:
            bits = bits << 9 | code
        return (bits << -9 * len(codes) % 8).to_bytes(-(-9 * len(codes) // 8), "big")
    width = np.concatenate([*widths, lzw_widths(since + 1)])
    bits = (np.array(codes)[:, None] >> (width[:, None] - 1 - np.arange(12)).clip(0)) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(12) < width[:, None]]).tobytes()


_PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress}


def _block(part: np.ndarray, compression: int, predictor: int, order: str) -> bytes:
    rows, width, per = part.shape
    size = part.dtype.itemsize
    if predictor == 3:
        plain = np.ascontiguousarray(part.reshape(rows, -1).astype(f">f{size}")).view(np.uint8).reshape(rows, width * per, size).transpose(0, 2, 1).reshape(rows, -1, per)
        plain = plain.copy()
        plain[:, 1:] -= plain[:, :-1].copy()
        data = plain.tobytes()
    else:
        if predictor == 2:
            part = part.copy()
            ints = part.view(f"u{size}")
            ints[:, 1:] -= ints[:, :-1].copy()
        data = part.astype(part.dtype.newbyteorder(order)).tobytes()
    return _PACK[compression](data)


def write(images: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 3, order: str = "<", planar: int = 1, big: bool = False) -> bytes:
    """A file with a page for each image, an array (height, width[, samples])."""
    word, head = ("Q", 16) if big else ("I", 8)
    blob = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = head - struct.calcsize(word)
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, per = image.shape
        planes = [image[:, :, k : k + 1] for k in range(per)] if planar == 2 else [image]
        starts, counts = [], []
        for plane in planes:
            if tile:
                blocks = []
                for y in range(0, height, tile):
                    for x in range(0, width, tile):
                        full = np.zeros((tile, tile, plane.shape[2]), image.dtype)
                        part = plane[y : y + tile, x : x + tile]
                        full[: part.shape[0], : part.shape[1]] = part
                        blocks.append(full)
            else:
                blocks = [plane[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
            for block in blocks:
                data = _block(np.ascontiguousarray(block), compression, predictor, order)
                starts.append(len(blob))
                counts.append(len(data))
                blob += data
        form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        tags = {256: [width], 257: [height], 258: [image.dtype.itemsize * 8] * per, 259: [compression], 262: [1], 277: [per], 284: [planar], 317: [predictor], 339: [form] * per}
        tags |= {322: [tile], 323: [tile], 324: starts, 325: counts} if tile else {273: starts, 278: [rows_per_strip], 279: counts}
        entries = b""
        for tag, values in sorted(tags.items()):
            data = struct.pack(order + word * len(values), *values)
            if len(data) > struct.calcsize(word):
                place = struct.pack(order + word, len(blob))
                blob += data
            else:
                place = data.ljust(struct.calcsize(word), b"\0")
            entries += struct.pack(order + "HH" + word, tag, 16 if big else 4, len(values)) + place
        blob += b"\0" * (len(blob) % 2)
        struct.pack_into(order + word, blob, link, len(blob))
        blob += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(blob)
        blob += struct.pack(order + word, 0)
    return bytes(blob)
