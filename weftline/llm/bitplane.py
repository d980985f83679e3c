"""Token-id files: fixed-size id blocks are transposed into byte or bit planes, each plane compressed by zstandard.

A corpus file is a Parquet row per segment of whole documents: the documents' ids and lengths, and a payload in the
format below. Rows are written by Spark's own committer, so a lost executor leaves no half-written segment, and any
store that Spark writes to will do. Layout of a payload, all little-endian:

    "BPS1" | ids: u32 | block size: u32 | planes a block: u32 (4 byte planes or 32 bit planes) | crc32 of the ids: u32
    chunk index: a u32 end offset for each plane of each block, counted from the first plane
    the compressed planes

The chunk index gives random access: a range of ids is read by decoding the blocks it touches (`unpack_range`).

Edge cases: a null text counts as empty and holds the end id only; a very long document, longer than a segment, fills a
segment of its own; repeated rows and rows with equal or null doc_id keep their own entries, nulls first; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

MAGIC = b"BPS1"
HEAD = struct.Struct("<4sIIII")
SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def pack_ids(ids: np.ndarray, block: int = 16384, bits: bool = False, level: int = 1) -> bytes:
    """Encode unsigned 32-bit ids."""
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    planes = []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], dtype="<u4").view(np.uint8).reshape(-1, 4)
        if bits:
            part = np.packbits(np.unpackbits(part, axis=1, bitorder="little").T, axis=1, bitorder="little")
            planes += [squeeze(row.tobytes()) for row in part]
        else:
            planes += [squeeze(np.ascontiguousarray(part[:, k]).tobytes()) for k in range(4)]
    ends = np.cumsum([len(x) for x in planes], dtype="<u4") if planes else np.zeros(0, "<u4")
    head = HEAD.pack(MAGIC, len(ids), block, 32 if bits else 4, zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()))
    return head + ends.astype("<u4").tobytes() + b"".join(planes)


def unpack_range(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """`count` ids from place `first` on; only the planes of blocks that hold some of them are read and decompressed."""
    magic, n, block, planes, _ = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a bit-plane payload")
    count = n - first if count is None else count
    if first < 0 or count < 0 or first + count > n:
        raise ValueError(f"ids {first} to {first + count} of {n}")
    blocks = -(-n // block)
    ends = np.frombuffer(payload, "<u4", blocks * planes, HEAD.size).astype(np.int64)
    body = HEAD.size + 4 * blocks * planes
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    open_ = zstandard.ZstdDecompressor().decompress
    low, high = first // block, -(-(first + count) // block) if count else first // block
    out = np.empty(min(high * block, n) - low * block if count else 0, "<u4")
    for b in range(low, high):
        size, at = min(block, n - b * block), (b - low) * block
        raw = [open_(payload[body + starts[k] : body + ends[k]]) for k in range(b * planes, (b + 1) * planes)]
        if planes == 4:
            out[at : at + size].view(np.uint8).reshape(-1, 4)[:] = np.stack([np.frombuffer(x, np.uint8) for x in raw], axis=1)
        else:
            grid = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in raw]), axis=1, bitorder="little")[:, :size]
            out[at : at + size] = np.ascontiguousarray(np.packbits(grid.T, axis=1, bitorder="little")).view("<u4").ravel()
    return out[first - low * block :][:count] if count else out


def unpack_ids(payload: bytes) -> np.ndarray:
    """Decode a whole payload; raises ValueError if it is damaged."""
    out = unpack_range(payload)
    if zlib.crc32(out.tobytes()) != HEAD.unpack_from(payload)[4]:
        raise ValueError("checksum of a bit-plane payload differs")
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = 16384, segment_ids: int = 131072, bits: bool = False) -> None:
    """Tokenize documents (doc_id, text) and write them in ascending doc_id order; one shard for each range of ids."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back(tables=False)
        encode = common.encoder(tokenizer).encode
        end, schema = np.array([end_id], "<u4").tobytes(), pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"shard": shard, "segment": number, "shard_start": start, "n_ids": len(ids), "doc_ids": list(doc_ids), "lengths": list(lengths), "payload": pack_ids(ids, block, bits)}
            number, start, held = number + 1, start + len(ids), 0
            for x in (doc_ids, lengths, parts):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part, texts in common.text_slices(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    parts += (ids, end)
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(common.partitions_for(docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, SEGMENTS).write.options(**{"compression": "none", "parquet.block.size": str(16 << 20)}).parquet(path)


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a corpus file: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    The driver gets a row for each shard, the ids it holds; every segment is decoded on its own.
    """
    stored = spark.read.schema(SEGMENTS).parquet(path)
    starts, total = {}, 0
    for row in sorted(stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        starts[row["shard"]], total = total, total + row["n"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack_ids(row["payload"])
                data, cuts = memoryview(raw.tobytes()), np.cumsum([0, *row["lengths"]])
                first = starts[row["shard"]] + row["shard_start"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + cuts[:-1], pa.int64()), pa.array(row["lengths"], pa.int64())]
                columns.append(pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()))
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([raw[a:b].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.select("shard", "shard_start", "doc_ids", "lengths", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_some(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose ids are in `wanted` (doc_id): of their segments only their blocks are decoded."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    places = stored.select("shard", "segment", F.posexplode("doc_ids").alias("nth", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id")
    places = places.groupBy("shard", "segment").agg(F.collect_list("nth").alias("places"))  # a segment's documents at most

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts, names, ids = np.cumsum([0, *row["lengths"]]), [], []
                for nth in sorted(row["places"]):
                    names.append(row["doc_ids"][nth])
                    ids.append(unpack_range(row["payload"], int(cuts[nth]), row["lengths"][nth]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return stored.join(places, ["shard", "segment"]).select("doc_ids", "lengths", "payload", "places").mapInArrow(documents, "doc_id long, ids array<long>")


def op1(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents, read the file back, describe each document."""
    spark = docs.sparkSession
    path = common.shared_path(spark, "bitplane")
    write_ids(docs, path, tokenizer or common.tokenizer_file("word_bpe_49k.json"), end_id)
    return read_ids(spark, path)
