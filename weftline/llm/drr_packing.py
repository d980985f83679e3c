"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids. In every window a source's deficit grows by its quantum, its share of
`window` tokens; the queue serves the whole tokens its deficit allows and the rest of the deficit is carried into the
next window. A queue that runs dry leaves the round, and its quantum is dealt to the others by weight, so that windows
stay full. With v rounds of one token a unit of weight, source s has been dealt min(N_s, v * weight_s) tokens; a window
ends where these add up to a multiple of `window`. Between two queues that run dry that is a line, so

    served_s(i) = min(N_s, floor(weight_s * (i * window - D) / W))

with D tokens in queues dry by then and W the weight of the others: whole numbers throughout. Any task can resume the
round-robin at any window with the very deficits the windows before it left, and windows need not be dealt one after
the other. The served tokens of all windows, sources in code point order inside a window, form one gapless stream;
sequence k is its k-th run of `length` tokens, so only the last sequence needs padding. Target proportions default to
each source's share of all tokens, under which all queues last to the end; other weights, above 0, may be given.

Sources are few, as proportions are set for each: the driver and each task hold a number for each source.

Edge cases: a null text counts as empty and holds the end id only; a null source is a queue of its own, the last; very
long texts are cut at window and sequence ends only; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common


@dataclass
class Schedule:
    """Deficit round-robin in closed form. sizes: tokens of each queue; weights: whole numbers, its share of a window.

    With `refill` the quantum of a queue that has run dry is dealt to the others, else windows shrink.
    """

    sizes: list[int]
    weights: list[int]
    window: int
    refill: bool = False
    _rounds: dict[int, tuple[int, list[int], list[int]]] = field(default_factory=dict)
    _epochs: list[tuple[Fraction, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        """Epochs: the round v at which each begins, tokens in queues dry by then, weight of the others."""
        dry, left = 0, sum(self.weights)
        self._epochs.append((Fraction(0), dry, left))
        for v, k in sorted((Fraction(n, w), k) for k, (n, w) in enumerate(zip(self.sizes, self.weights, strict=True))) if self.refill else ():
            dry, left = dry + self.sizes[k], left - self.weights[k]
            self._epochs.append((v, dry, left))
        self._ends = [dry + v * left for v, dry, left in self._epochs]

    def served(self, source: int, windows: int) -> int:
        tokens = windows * self.window
        _, dry, left = self._epochs[bisect_right(self._ends, tokens) - 1]
        return min(self.sizes[source], self.weights[source] * (tokens - dry) // left) if left else self.sizes[source]

    def window_of(self, source: int, token: int) -> int:
        """The window that serves a token, counted from 0: the first with served(i + 1) > token."""
        weight = self.weights[source]
        _, dry, left = self._epochs[bisect_left(self._epochs, Fraction(token + 1, weight), key=lambda e: e[0]) - 1]
        return -(-(dry * weight + left * (token + 1)) // (self.window * weight)) - 1

    def round(self, window: int) -> tuple[int, list[int], list[int]]:
        """Place in the stream where a window begins; for each source, its place in the window and the tokens it had served."""
        if window not in self._rounds:
            if len(self._rounds) > 256:
                self._rounds.clear()
            before = [self.served(s, window) for s in range(len(self.sizes))]
            after = [self.served(s, window + 1) for s in range(len(self.sizes))]
            places, at = [], 0
            for a, b in zip(before, after, strict=True):
                places.append(at)
                at += b - a
            self._rounds[window] = (sum(before), places, before)
        return self._rounds[window]

    def runs(self, source: int, first: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(offset, place in the stream, tokens) for tokens first .. first + n of a queue, a run for each window."""
        at = first
        while at < first + n:
            window = self.window_of(source, at)
            base, places, before = self.round(window)
            end = min(first + n, self.served(source, window + 1))
            yield at - first, base + places[source] + at - before[source], end - at
            at = end


def id_code(tokenizer: str, end_id: int) -> str:
    """Array code of ids: 16 bits where the vocabulary allows, else 32."""
    from tokenizers import Tokenizer

    return "H" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "I"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, code: str) -> DataFrame:
    """Ids of all documents, stored once: part, source, doc_id, tokens before it in the part's own queue, n, ids.

    Texts are not shuffled. `code` says how ids are held (id_code).
    """
    width = np.dtype(code).itemsize
    schema = pa.schema([("part", pa.int32()), ("source", pa.string()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, queues = TaskContext.get().partitionId(), {}
        common.give_back(tables=False)
        encode, end = common.encoder(tokenizer, code).encode, np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for piece, texts in common.text_slices(batch, 2):
                sources, starts, ids = piece.column(1).to_pylist(), [], [x + end for x in encode(texts)]
                for source, x in zip(sources, ids, strict=True):
                    starts.append(queues.get(source, 0))
                    queues[source] = starts[-1] + len(x) // width
                columns = [pa.array([part] * len(piece), pa.int32()), piece.column(1), piece.column(0), pa.array(starts, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    encoded = docs.select("doc_id", "source", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "part int, source string, doc_id long, local_start long, n long, ids binary")
    return common.materialise(encoded, "packing-ids", compression="zstd")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, window: int = 65536, weights: Mapping[str | None, int] | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, source, text): where each run of ids lies in which sequence.

    The driver gets a row for each source. A part's place in its source's queue is a row for each part and source,
    joined by whatever join its size calls for.
    """
    code = id_code(tokenizer, end_id)
    ids = tokenize(docs, tokenizer, end_id, code)
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    parts = ids.groupBy("part", key.alias("queue")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = common.materialise(parts.select("part", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")), "packing-parts")
    totals = sorted((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    names = {name: k for k, (name, _) in enumerate(totals)}
    sizes = [n for _, n in totals]
    shares = sizes if weights is None else [weights[None if name[0] == "1" else name[1:]] for name, _ in totals]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        schedule = Schedule(sizes, shares, window, refill=True)
        for batch in batches:
            columns: list[list] = [[] for _ in out]
            for doc_id, queue, first, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                raw = memoryview(np.frombuffer(data.as_py(), f"<u{np.dtype(code).itemsize}").astype("<u4").tobytes())
                for offset, place, run in schedule.runs(names[queue], first, n):
                    while run:
                        take = min(run, length - place % length)
                        values = (doc_id, offset, take, zlib.crc32(raw[4 * offset : 4 * (offset + take)]), n, place // length, place % length, schedule.window_of(names[queue], first + offset))
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                        offset, place, run = offset + take, place + take, run - take
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    placed = ids.withColumn("queue", key).join(parts.select("part", "queue", "part_start"), ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("part_start") + F.col("local_start")).alias("first"), "n", "ids")
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long")


def op3(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(docs, tokenizer or common.tokenizer_file("byte_bpe_50k.json"))
