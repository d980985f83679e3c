"""TIFF pages as columns: directories are walked, strips and tiles decoded, predictors undone, a row for each page.

The reader takes classic TIFF of either byte order; samples of 1, 8 or 16 bits, interleaved or in planes; strips or tiles;
compression 1 (none), 5 (LZW), 8 and 32946 (deflate) and 32773 (PackBits); predictor 1 or 2. Any bytes give rows: a damaged
file or an unsupported page gives one with `error` set rather than a failed job, and nothing is allocated before the
sizes that a file claims are held against `MOST_BYTES`. The writer makes such files from payloads.

Edge cases: a null or empty payload has 64 zero bytes; a payload over `page_rows` rows of 64 samples spans several
pages, so very long texts are stored whole; equal payloads give equal files and repeated rows equal rows; a null file is a
damaged one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 2048, 256, 64
#: Bytes of a page's samples, one byte or two each, beyond which it is an error row rather than a worker out of memory.
MOST_BYTES = 1 << 29
DAMAGE = (struct.error, zlib.error, ValueError, KeyError, IndexError, OverflowError, ZeroDivisionError, MemoryError)
#: Field types of the format: bytes a value and struct code.
KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray | None
    error: str | None = None
    bits: int = 8


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            piece = data[k : min(b, k + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.extend((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literal(at, len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format asks."""
    singles = [bytes((k,)) for k in range(256)]
    out, acc, bits, width = bytearray(), 256, 9, 9
    table = {x: k for k, x in enumerate(singles)}
    free, prefix = 258, b""
    for byte in map(singles.__getitem__, data):
        longer = prefix + byte
        if longer in table:
            prefix = longer
            continue
        acc, bits = acc << width | table[prefix], bits + width
        table[longer], free, prefix = free, free + 1, byte
        if free == 4095:
            acc, bits = acc << 12 | 256, bits + 12
            table, free, width = {x: k for k, x in enumerate(singles)}, 258, 9
        elif free + 1 > 1 << width:
            width += 1
        if bits > 512:
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & (1 << rest) - 1, rest
    if prefix:
        acc, bits, free = acc << width | table[prefix], bits + width, free + 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes(bits + pad >> 3, "big"))


def lzw_decode(data: bytes, size: int) -> bytes:
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, last, out, held = list(fresh), 9, b"", [], 0
    acc = bits = at = 0
    end = len(data)
    while held < size:
        while bits < width:
            if at >= end:
                return b"".join(out)
            piece = data[at : at + 32]
            acc, bits, at = (acc & (1 << bits) - 1) << 8 * len(piece) | int.from_bytes(piece, "big"), bits + 8 * len(piece), at + 32
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        held += len(entry)
        last = entry
    return b"".join(out)


def _squeeze(data: bytes, how: int) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, 1)}[how]()


def _open(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        got = data
    elif how == PACKBITS:
        got = unpack_bits(data, size)
    elif how == LZW:
        got = lzw_decode(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {how} is not supported")
    if len(got) < size:
        raise ValueError("a strip or tile is short")
    return got[:size]


def write_tiff(pages: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """Pages as (8-bit grey rows, compression, predictor, tiled); a directory follows the data of its page."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for rows, how, predictor, tiled in pages:
        height, width = rows.shape
        if tiled:
            tall, wide = -(-height // TILE), -(-width // TILE)
            grid = np.zeros((tall * TILE, wide * TILE), np.uint8)
            grid[:height, :width] = rows
            blocks = [grid[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE] for y in range(tall) for x in range(wide)]
        else:
            blocks = [rows[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _squeeze(np.ascontiguousarray(block).tobytes(), how)
            places.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) & 1)
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [how]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [TILE]), (323, 4, [TILE]), (324, 4, places), (325, 4, sizes)] if tiled else [(273, 4, places), (278, 4, [STRIP_ROWS]), (279, 4, sizes)]
        entries, here = b"", {}
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"<{len(values)}{KINDS[kind][1]}", *values)
            if len(data) > 4:
                here[tag] = len(out)
                out += data
                data = struct.pack("<I", here[tag])
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Every page of a file, in directory order; a damaged directory ends the walk with an error page."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        at = struct.unpack_from(f"{order}I", data, 4)[0]
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            tags = {}
            for k in range(count := struct.unpack_from(f"{order}H", data, at)[0]):
                tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                if kind in KINDS and n:
                    size, code = KINDS[kind]
                    place = at + 10 + 12 * k if size * n <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
                    if place + size * n > len(data):
                        raise ValueError("a field reaches beyond the file")
                    tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
            at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0]
            yield _page(data, tags, order)
    except DAMAGE as problem:
        yield Page(0, 0, 0, 0, 0, None, _told(problem))


def _told(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _samples(raw: bytes, rows: int, wide: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Decoded bytes of a strip or tile as rows of samples."""
    if bits == 1:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : wide * samples].reshape(rows, wide, samples)
    return np.frombuffer(raw, np.uint8 if bits == 8 else f"{order}u2").reshape(rows, wide, samples)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default=0: tags.get(tag, (default,))[0]
    width, height, samples, how, predictor, bits = one(256), one(257), one(277, 1), one(259, 1), one(317, 1), one(258, 1)
    page = Page(width, height, samples, how, predictor, None, None, bits)
    try:
        if bits not in (1, 8, 16) or len(set(tags.get(258, (1,)))) != 1 or one(284, 1) not in (1, 2) or predictor not in (1, 2) or predictor == 2 and bits == 1:
            raise ValueError("only samples of 1, 8 or 16 bits with predictor 1 or 2 are supported")
        if not width or not height or not samples:
            raise ValueError("a page without samples")
        tiled, planes = 322 in tags, samples if one(284, 1) == 2 else 1
        wide, tall = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        if not wide or not tall:
            raise ValueError("a strip or tile without samples")
        kind, each = (np.uint16 if bits == 16 else np.uint8), samples // planes
        across, down = -(-width // wide), -(-height // tall)
        if max(width * height, wide * tall) * samples * np.dtype(kind).itemsize > MOST_BYTES:
            raise ValueError(f"a page of over {MOST_BYTES} bytes")
        places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        if len(places) != len(sizes) or len(places) != across * down * planes:
            raise ValueError("strips or tiles are missing")
        pixels = np.zeros((height, width, samples), kind)
        for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
            plane, k = divmod(k, across * down)
            y, x = k // across * tall, k % across * wide
            rows = tall if tiled else min(tall, height - y)
            block = _samples(_open(data[place : place + size], how, rows * -(-wide * each * bits // 8)), rows, wide, each, bits, order)
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=kind)
            pixels[y : y + rows, x : x + wide, plane : plane + each] = block[: height - y, : width - x]
        page.pixels = pixels
    except DAMAGE as problem:
        page.error = _told(problem)
    return page


def read_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each page of each file: key, page, width, height, samples, bits, compression, predictor, pixels, error.

    16-bit samples are little-endian in `pixels`, and samples of a bit take a byte each.
    """
    schema = "page int, width long, height long, samples int, bits int, compression int, predictor int, pixels binary, error string"
    kind = dict(df.dtypes)[key]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for number, page in enumerate(read_tiff(data.as_py() or b"")):
                    row = {"page": number, "width": page.width, "height": page.height, "samples": page.samples, "bits": page.bits, "compression": page.compression, "predictor": page.predictor, "pixels": None if page.pixels is None else page.pixels.astype(page.pixels.dtype.newbyteorder("<")).tobytes(), "error": page.error}
                    columns = [pa.array([name.as_py()], batch.schema.field(0).type), *(pa.array([v], pa.string() if k == "error" else pa.binary() if k == "pixels" else pa.int64() if k in ("width", "height") else pa.int32()) for k, v in row.items())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", *row])

    return df.select(key, media).mapInArrow(pages, f"file {kind}, {schema}").withColumnRenamed("file", key)


def payload_tiff(payload: bytes) -> bytes:
    """The file for a payload of a multiple of 64 bytes: rows of 64 samples, compression chosen by the payload's crc32."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    how, predictor, tiled = ((DEFLATE, 2, False), (DEFLATE, 1, True), (PACKBITS, 1, True), (LZW, 1, False))[zlib.crc32(payload) & 3]
    return write_tiff([(grid[y : y + PAGE_ROWS], how, predictor, tiled) for y in range(0, len(grid), PAGE_ROWS)])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the TIFF file of each text's padded payload."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [x.as_py() or b"" for x in part.column(1)]
                media = [payload_tiff(t + b"\0" * (-len(t) % WIDTH or (0 if t else WIDTH))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(files, "doc_id long, n_bytes long, media binary")


def feature(pages: list[Page]) -> str:
    """Integer statistics of all pages: their number, size, mean in thousandths, edges, and an 8-bin histogram."""
    flat = np.concatenate([p.pixels.reshape(-1) for p in pages])
    edges = sum(int(np.count_nonzero(p.pixels[:, 1:, 0] != p.pixels[:, :-1, 0])) for p in pages)
    bins = np.bincount(flat >> 5, minlength=8)
    return f"{len(pages)}p {pages[0].width}x{sum(p.height for p in pages)} mean {int(flat.sum(dtype=np.int64)) * 1000 // len(flat)} edges {edges} hist {'/'.join(map(str, bins))}"


def describe_media(media: DataFrame) -> DataFrame:
    """Decode every stored file and describe its payload and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[2:]]
            for data in batch.column(2):
                data = data.as_py() or b""
                pages = list(read_tiff(data))
                problem = next((p.error for p in pages if p.error), None)
                payload = b"".join(p.pixels.tobytes() for p in pages if p.pixels is not None)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), None if problem else feature(pages), problem)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op2(docs: DataFrame) -> DataFrame:
    return describe_media(encode_media(docs))
