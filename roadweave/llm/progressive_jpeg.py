"""Media columns as progressive JPEG: scans accumulate into coefficient arrays, which numpy turns into full-resolution RGB tensors.

decode() reads Huffman-coded progressive JPEGs of eight bits, of one or three components. store() keeps arbitrary bytes without loss as coefficients, 64 a block, each
as 256 plus the byte: a DC scan and two AC bands by spectral selection, each in two steps of successive approximation. All coefficients then
have the same size category and all codes one length, so that whole scans are packed and unpacked by array operations.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import named, stored

BLOCK = 64
#: MCUs of a row of the picture: its width of 16 samples an MCU fits in 16 bits.
MOST_MCUS = 4095
BANDS = ((1, 5), (6, 63))
# The zigzag order of a block's coefficients, and the luma weights and chroma factors of YCbCr.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
KR, KG, KB = 0.299, 0.587, 0.114
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: The inverse transform of a block: coefficients in zigzag order to samples in rows.
_INVERSE = np.kron(_COS, _COS)[ZIGZAG].astype(np.float32)
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Component:
    """blocks: rows x columns x 64 coefficients in zigzag order, filled up to whole MCUs."""

    ident: int
    h: int
    v: int
    table: int
    blocks: np.ndarray


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits filled up with ones to bytes, with a zero after each 0xFF."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")


def _scan_header(parts: list[tuple[int, int]], start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(x) for x in parts) + bytes([start, end, high << 4 | low]))


def _huffman(kind: int, symbol: int) -> bytes:
    """A table with one symbol, of code 0."""
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def store(payload: bytes, comment: bytes = b"") -> bytes:
    """A 4:2:0 progressive JPEG that holds the payload, a positive multiple of 64 bytes; block by block: four of luma, one of each chroma, MCU by MCU."""
    n = len(payload) // BLOCK
    mcus = -(-n // 6)
    rows = -(-mcus // MOST_MCUS)
    cols = -(-mcus // rows)
    raw = np.zeros((rows * cols * 6, BLOCK), np.uint8)
    raw[:n] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    mcu = raw.reshape(rows, cols, 6, BLOCK)
    # luma blocks of an MCU stand two by two
    luma = mcu[:, :, :4].reshape(rows, cols, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4)
    planes = [np.ascontiguousarray(x).reshape(-1, BLOCK) for x in (luma, mcu[:, :, 4], mcu[:, :, 5])]
    # a coefficient is 256 + its byte: all but its lowest bit go in the first step, eight bits of size category 8
    high, low = [x >> 1 | 128 for x in planes], [x & 1 for x in planes]
    frame = struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", n) + comment), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, frame)]
    # each DC coefficient between restarts, so that none is predicted from another
    out += [_segment(0xDD, b"\0\1"), _huffman(0x00, 8)]
    for k, x in enumerate(high):
        # 0, eight bits, seven ones; a second byte of 0xFF takes a zero after it
        dc = x[:, 0]
        cell = np.zeros((len(dc), 5), np.uint8)
        cell[:, 0], cell[:, 1] = dc >> 1, dc << 7 | 127
        cell[:, 3], cell[:, 4] = 255, 0xD0 + np.arange(len(dc)) % 8
        keep = np.ones(cell.shape, bool)
        keep[:, 2] = cell[:, 1] == 255
        keep[-1, 3:] = False
        out += [_scan_header([(k + 1, 0)], 0, 0, 0, 1), cell[keep].tobytes()]
    out.append(_segment(0xDD, b"\0\0"))
    for k, x in enumerate(low):
        out += [_scan_header([(k + 1, 0)], 0, 0, 1, 0), _stuffed(x[:, 0])]
    out.append(_huffman(0x10, 8))
    for k, x in enumerate(high):
        for a, b in BANDS:
            bits = np.zeros((len(x), b - a + 1, 9), np.uint8)
            bits[:, :, 1:] = np.unpackbits(x[:, a : b + 1, None], axis=2)
            out += [_scan_header([(k + 1, 0)], a, b, 0, 1), _stuffed(bits.ravel())]
    out.append(_huffman(0x10, 0))
    for k, x in enumerate(low):
        for a, b in BANDS:
            bits = np.zeros((len(x), b - a + 2), np.uint8)
            bits[:, 1:] = x[:, a : b + 1]
            out += [_scan_header([(k + 1, 0)], a, b, 1, 0), _stuffed(bits.ravel())]
    return b"".join([*out, b"\xff\xd9"])


def restore(picture: Picture) -> bytes:
    """The payload of store(), from a decoded picture's coefficients."""
    (n,) = struct.unpack(">Q", picture.comment[:8])
    luma, *chroma = (c.blocks for c in picture.components)
    rows, cols = chroma[0].shape[:2]
    luma = luma.reshape(rows, 2, cols, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, BLOCK)
    values = np.concatenate([luma, chroma[0][:, :, None], chroma[1][:, :, None]], axis=2).reshape(-1, BLOCK)
    return (values[:n] - 256).astype(np.uint8).tobytes()


class _Bits:
    """The bits of an entropy-coded segment; ones follow its end."""

    def __init__(self, data: bytes):
        self._bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        self._at = 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self._bits[self._at] if self._at < len(self._bits) else 1)
            self._at += 1
        return out

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")


def decode(media: bytes) -> Picture:
    """The coefficients of a progressive JPEG, accumulated over its scans."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, interval, picture, quant, huffman = 2, 0, None, {}, {}
    comment = b""
    while at + 4 <= len(media):
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        data = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = data
        elif marker == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                data = data[65 + 64 * wide :]
        elif marker == 0xC4:
            while data:
                table, code, k = {}, 0, 17
                for n, count in enumerate(data[1:17], 1):
                    for _ in range(count):
                        table[n, code] = data[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huffman[data[0]] = table
                data = data[k:]
        elif marker == 0xDD:
            interval = struct.unpack(">H", data)[0]
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", data[:6])
            if bits != 8:
                raise ValueError("only samples of eight bits are read")
            parts = [(data[6 + 3 * k], data[7 + 3 * k] >> 4, data[7 + 3 * k] & 15, data[8 + 3 * k]) for k in range(n)]
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            cols, rows = -(-width // (8 * hm)), -(-height // (8 * vm))
            picture = Picture(width, height, [Component(i, h, v, q, np.zeros((rows * v, cols * h, BLOCK), np.int16)) for i, h, v, q in parts], quant)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman-coded JPEGs are read")
        elif marker == 0xDA:
            found = _NEXT_MARKER(media, at)
            end = found.start() if found else len(media)
            _scan(picture, data, media[at:end], interval, huffman)
            at = end
            if media[at + 1 : at + 2] == b"\xd9":
                break
    if picture is None:
        raise ValueError("no frame")
    picture.comment = comment
    return picture


def _scan(picture: Picture, head: bytes, data: bytes, interval: int, huffman: dict) -> None:
    by_id = {c.ident: c for c in picture.components}
    parts = [(by_id[head[1 + 2 * k]], head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(head[0])]
    start, end, steps = head[-3:]
    high, low = steps >> 4, steps & 15
    hm, vm = max(c.h for c in picture.components), max(c.v for c in picture.components)
    if len(parts) == 1:
        # not interleaved: the component's own blocks, without those that fill up MCUs
        c = parts[0][0]
        cols, rows = -(-(-(-picture.width * c.h // hm)) // 8), -(-(-(-picture.height * c.v // vm)) // 8)
        if _uniform(c.blocks[:rows, :cols], parts[0], data, start, end, high, low, interval, huffman):
            return
        mcus = [[(0, y, x)] for y in range(rows) for x in range(cols)]
    else:
        rows, cols = parts[0][0].blocks.shape[0] // parts[0][0].v, parts[0][0].blocks.shape[1] // parts[0][0].h
        mcus = [[(k, y * c.v + j, x * c.h + i) for k, (c, _, _) in enumerate(parts) for j in range(c.v) for i in range(c.h)] for y in range(rows) for x in range(cols)]
    segments = iter(_RESTART.split(data) if interval else [data])
    bits, before, run = _Bits(b""), [0] * len(parts), 0
    for m, mcu in enumerate(mcus):
        if m == 0 or interval and m % interval == 0:
            bits, before, run = _Bits(next(segments, b"")), [0] * len(parts), 0
        for k, y, x in mcu:
            c, dc, ac = parts[k]
            z = c.blocks[y, x]
            if start == 0:
                if high:
                    z[0] |= bits.take(1) << low
                else:
                    before[k] += bits.signed(bits.symbol(huffman[dc]))
                    z[0] = before[k] << low
            elif high:
                run = _refine(z, bits, huffman[16 + ac], start, end, low, run)
            else:
                run = _first(z, bits, huffman[16 + ac], start, end, low, run)


def _first(z: np.ndarray, bits: _Bits, table: dict, k: int, end: int, low: int, run: int) -> int:
    """An AC band's first step in one block; returns the blocks that the end-of-band run still covers."""
    if run:
        return run - 1
    while k <= end:
        zeros, size = divmod(bits.symbol(table), 16)
        if size:
            k += zeros
            z[k] = bits.signed(size) << low
            k += 1
        elif zeros < 15:
            return (1 << zeros) - 1 + bits.take(zeros)
        else:
            k += 16
    return 0


def _refine(z: np.ndarray, bits: _Bits, table: dict, k: int, end: int, low: int, run: int) -> int:
    """An AC band's later step: a bit for each coefficient that isn't zero, and new ones of the lowest bit."""

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(z[k])) >> low & 1:
            z[k] += (1 << low) if z[k] > 0 else -(1 << low)

    while not run and k <= end:
        zeros, size = divmod(bits.symbol(table), 16)
        new = 0
        if size:
            new = (1 << low) if bits.take(1) else -(1 << low)
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= end:
            if z[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                z[k] = new
                k += 1
                break
            k += 1
    if run:
        for i in range(k, end + 1):
            if z[i]:
                correct(i)
        return run - 1
    return 0


def _uniform(blocks: np.ndarray, part: tuple, data: bytes, start: int, end: int, high: int, low: int, interval: int, huffman: dict) -> bool:
    """Reads a scan in which each block takes equally many bits, as follows from a table of one one-bit code: all blocks at once."""
    rows, cols = blocks.shape[:2]
    n = rows * cols
    if start == 0 and high:
        if interval:
            return False
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[:n]
        blocks[:, :, 0] |= (bits.astype(np.int16) << low).reshape(rows, cols)
        return True
    table = huffman[part[1] if start == 0 else 16 + part[2]]
    if list(table) != [(1, 0)]:
        return False
    (symbol,) = table.values()
    if start == 0:
        # each block in its own restart interval, of one code and `symbol` bits
        if interval != 1 or symbol != 8:
            return False
        whole = np.frombuffer(_RESTART.sub(b"", data).replace(b"\xff\0", b"\xff"), np.uint8)
        if len(whole) != 2 * n:
            return False
        v = (whole[0::2].astype(np.int16) << 1) | (whole[1::2] >> 7)
        blocks[:, :, 0] = (np.where(v & 128, v, v - 255) << low).reshape(rows, cols)
        return True
    if interval:
        return False
    band = end - start + 1
    if not high:
        if symbol != 8:
            return False
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: n * band * 9].reshape(n, band, 9)
        v = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
        blocks[:, :, start : end + 1] = (np.where(v & 128, v, v - 255) << low).reshape(rows, cols, band)
        return True
    now = blocks[:, :, start : end + 1]
    if symbol != 0 or (now <= 0).any():
        return False
    bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: n * (band + 1)].reshape(n, band + 1)
    now |= (bits[:, 1:].astype(np.int16) << low).reshape(rows, cols, band)
    return True


def _samples(c: Component, quant: np.ndarray, rows: slice) -> np.ndarray:
    """A component's samples of some rows of blocks, as floats around 128."""
    part = c.blocks[rows]
    y, x = part.shape[:2]
    out = (part.reshape(-1, BLOCK) * quant) @ _INVERSE
    return out.reshape(y, x, 8, 8).transpose(0, 2, 1, 3).reshape(y * 8, x * 8) + np.float32(128)


def rgb_rows(picture: Picture) -> Iterator[np.ndarray]:
    """The RGB tensor (rows, columns, 3; uint8) by rows of MCUs: inverse transforms, chroma repeated to full resolution, and conversion."""
    cs = picture.components
    hm, vm = max(c.h for c in cs), max(c.v for c in cs)
    for m in range(cs[0].blocks.shape[0] // cs[0].v):
        planes = []
        for c in cs:
            s = np.clip(np.rint(_samples(c, picture.tables[c.table], slice(m * c.v, (m + 1) * c.v))), 0, 255)
            planes.append(s.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1))
        height = min(8 * vm, picture.height - m * 8 * vm)
        planes = [p[:height, : picture.width] for p in planes]
        if len(planes) == 1:
            yield np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
            continue
        luma, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((*luma.shape, 3), np.float32)
        out[:, :, 0] = luma + np.float32(2 * (1 - KR)) * cr
        out[:, :, 1] = luma - np.float32(2 * KB * (1 - KB) / KG) * cb - np.float32(2 * KR * (1 - KR) / KG) * cr
        out[:, :, 2] = luma + np.float32(2 * (1 - KB)) * cb
        yield np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def rgb_tensor(media: bytes) -> np.ndarray:
    """The picture's full-resolution RGB tensor."""
    return np.concatenate(list(rgb_rows(decode(media))))


def feature(rgb: np.ndarray) -> str:
    """Size, the means of the channels, and the CRC of an RGB tensor."""
    r, g, b = rgb.reshape(-1, 3).mean(axis=0)
    return f"{rgb.shape[1]}x{rgb.shape[0]} {r:.2f} {g:.2f} {b:.2f} {zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with bytes 0 up to a positive multiple of 64, and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0"), len(data)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col` and media, the progressive JPEG that holds the text's padded bytes. Null text: empty. Repeated rows
    each get a row; long texts are stored whole. Empty table: no rows. Other columns are not read."""
    named(id_col, "media")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                media = [store(*_with_size(x.as_py())) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, media binary")


def _with_size(text: str | None) -> tuple[bytes, bytes]:
    payload, n = padded(text)
    return payload, struct.pack(">Q", n)


def tensors(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id_col`, media_bytes, media_sha256, n_bytes and payload (what store() put in; null in other pictures), height, width and rgb (binary, rows of columns
    of three channels) of each picture of a media column. A null picture has nulls. Repeated rows each get a row. Empty table: no rows."""
    named(id_col, "media", "media_bytes", "media_sha256", "n_bytes", "payload", "height", "width", "rgb")
    kind = media.schema[id_col].dataType.simpleString()
    types = {"media_bytes": pa.int64(), "media_sha256": pa.string(), "n_bytes": pa.int64(), "payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(types)
        picture = decode(data)
        own = len(picture.comment) == 16
        rgb = np.concatenate(list(rgb_rows(picture)))
        return len(data), sha256(data).hexdigest(), struct.unpack(">Q", picture.comment[8:])[0] if own else None, restore(picture) if own else None, *rgb.shape[:2], rgb.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                cols = zip(*(one(x.as_py()) for x in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(cols, types.values(), strict=True))], names=[id_col, *types])

    return media.select(id_col, "media").mapInArrow(run, f"{id_col} {kind}, media_bytes long, media_sha256 string, n_bytes long, payload binary, height int, width int, rgb binary")


def features(pictures: DataFrame) -> DataFrame:
    """The rows of tensors() with feature, computed from their rgb column, in place of it. A null picture has a null feature."""
    kept = [c for c in pictures.columns if c not in ("height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, rgb in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb"), strict=True):
                out.append(feature(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(h, w, 3)) if rgb.is_valid else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "feature"])

    return pictures.mapInArrow(run, T.StructType([*(pictures.schema[c] for c in kept), T.StructField("feature", T.StringType())]))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as a table of pictures and what is read back from it: `id_col`, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. Null text: empty. Repeated rows each get a row; long texts are stored whole. Empty table: no rows."""
    pictures = tensors(stored(media_column(df, id_col, text_col), "media"), id_col)
    payload = F.col("payload")
    shown = pictures.select(
        id_col, "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"), "media_bytes", "media_sha256", "height", "width", "rgb",
    )
    return features(shown)
