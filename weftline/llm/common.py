"""What the operators of this subpackage share: tables in the shared folder, bounded filters, cached tokenization."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BITMAP_BITS, FILTER_BUCKETS, HOT_KEYS, HOT_ROWS = 32768, 4096, 1000, 4096
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where that is unset, a temporary one of a local master only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_tables(since: int = 0, keep: int = 0) -> None:
    """Delete the tables written so far, but for the first `since` and the last `keep` ones.

    A query's result reads such tables, so the caller deletes them once the result is stored; the pipeline does so
    after each stage.
    """
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for spark, path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """How many partitions of about `each` bytes a table has by its files' sizes, at least the session's number for shuffles."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(-(-size // each), 1 << 20)) if size < 1 << 60 else usual


def tables_written() -> int:
    return len(_written)


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    mark = uuid.uuid4().hex[:8]
    return [f"{name}_{mark}" for name in names]


@dataclass
class BlockedFilter:
    """A Bloom filter as rows (bucket, bits) of 4 KiB each; `rows` is None where so many keys outgrow the largest filter."""

    rows: DataFrame | None
    buckets: int


def _slots(key: str, buckets: int) -> tuple[Column, list[Column]]:
    """A key's bucket and its three places in the bucket's bits."""
    places = F.xxhash64(F.lit("bits"), key)
    return F.pmod(F.xxhash64(F.lit("filter"), key), F.lit(buckets)), [F.shiftright(places, 15 * k).bitwiseAND(F.lit(BITMAP_BITS - 1)) for k in range(3)]


def bounded_filter(keys: DataFrame, key: str, most: int = FILTER_BUCKETS) -> BlockedFilter:
    """A filter over a column of a stored table, sized by the number of its rows: ten bits each, 16 MiB at most.

    About 2 % of other keys pass. Where there are more keys than 16 MiB serve with four bits each (33 million), a
    filter would let nearly everything pass; none is built then, and all rows count as `maybe_in`.
    """
    n = keys.count()
    buckets = max(1, min(most, -(-10 * n // BITMAP_BITS)))
    if 4 * n > most * BITMAP_BITS:
        return BlockedFilter(None, buckets)
    bucket, places = _slots(key, buckets)
    bits = keys.select(bucket.alias("bucket"), F.explode(F.array(*places)).alias("place"))
    return BlockedFilter(bits.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")), buckets)


def maybe_in(df: DataFrame, key: str, marks: BlockedFilter, negate: bool = False) -> DataFrame:
    """Rows whose key may be in the filter (no false negatives), or with `negate` the rows whose key is not in it.

    The broadcast side is the filter, at most 16 MiB at any size of the input. Columns of any names are left as they are.
    """
    if marks.rows is None:
        return df.where(F.lit(not negate))
    slot, bits = fresh("bucket", "bits")
    bucket, places = _slots(key, marks.buckets)
    joined = df.withColumn(slot, bucket).join(F.broadcast(marks.rows.toDF(slot, bits)), slot, "left")
    test = F.lit(True)
    for place in places:
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        test = test & (F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    test = F.coalesce(test, F.lit(False))
    return joined.where(~test if negate else test).select(*(F.col(f"`{c}`") for c in df.columns))


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join many rows to one row for each key, whose column `count` says how many rows of `left` have it (`total` in all).

    Fewer than `HOT_KEYS` keys can hold more than total / HOT_KEYS rows each. Their rows of `right` are broadcast, by that
    bound, and all other keys meet in a shuffle in which none is hot. `right` must be stored and have narrow rows.
    """
    least = max(total // HOT_KEYS, HOT_ROWS)
    if total <= least or right.where(F.col(count) > least).isEmpty():
        names = [*left.columns, *(c for c in right.columns if c not in (key, count))]
        return left.join(right.drop(count), key, how).select(*names)
    hot = F.broadcast(right.where(F.col(count) > least).drop(count))
    mark = fresh("hot")[0]
    probed = left.join(hot.withColumn(mark, F.lit(True)), key, "left")
    names = [*left.columns, *(c for c in right.columns if c not in (key, count))]
    found = probed.where(F.col(mark)).select(*names)
    rest = probed.where(F.col(mark).isNull()).select(*left.columns)
    return found.unionByName(rest.join(right.where(F.col(count) <= least).drop(count), key, how).select(*names))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _byte_table() -> dict[int, int]:
    """Bytes as letters, the way byte-level vocabularies write them: printable ones stand for themselves, others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (k for k in range(256) if k not in own)
    return {byte: 256 + nth for nth, byte in enumerate(others)}


_BYTE_TABLE = _byte_table()
_LETTERS, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS[[*b'.,;:!?*$#%&|)"]}']] = True


def _byte_letters(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    return text.encode().decode("latin-1").translate(_BYTE_TABLE)


def _odd_space() -> re.Pattern[bytes]:
    spaces = [chr(k) for k in range(0x3001) if chr(k).isspace() and chr(k) not in " \n"]
    return re.compile(b"|".join(re.escape(c.encode()) for c in spaces))


class CachedEncoder(dict):
    """Token ids of whole texts as little-endian bytes, by a file of the tokenizers library.

    A text is cut before each space or newline that follows a non-space character, and before a mark that follows a
    Latin letter. No pre-token of the supported files holds white space after another character, or a mark after a
    letter, so encoding the cuts one by one gives the ids of the whole text. Equal cuts of a slice of texts are found together by sorting their bytes, each distinct cut is
    looked up or encoded once, and ids are gathered for the whole slice. Texts with other white space, or
    with what special tokens begin with, are encoded whole. The table of cuts has two generations of at most `capacity` entries each.

    A cut of Latin letters with marks after them goes to the tokenizer's model without the steps before it, if
    one of two ways to write its pre-tokens (PROBES are encoded either way when the file is opened) gives the same ids.
    """

    LATIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$#%&|]*)")
    PROBES = (" the", "\nThe", "The", " Éauíß.", " end,", " WORDS!!", "\nnaïveÀ", " that&&&", " x***", "Øre;?", " thontionea", " unglichkeit$$$", " añosciónmente", "\nÉpa|")

    ODD_SPACE = _odd_space()
    LANES = 3  # cuts of up to 24 bytes are compared as 64-bit numbers

    def __init__(self, path: str, code: str = "I", capacity: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.code, self.capacity, self.old = Tokenizer.from_file(path), code, capacity, {}
        self.model, self.marks = self.tokenizer.model, {"": []}
        ways = (self._spaced, self._lower)
        self.pretokens = next((way for way in ways if all(self._latin(x, way) == self.whole(x.encode()) for x in self.PROBES)), None)

    @staticmethod
    def _spaced(space: str, word: str) -> list[str]:
        """Byte-level pre-tokens: a space belongs to the word after it, a newline is its own."""
        letters = _byte_letters(word)
        return ["Ċ", letters] if space == "\n" else ["Ġ" + letters if space else letters]

    @staticmethod
    def _lower(space: str, word: str) -> list[str]:
        """Pre-tokens in lower case without white space."""
        return [_byte_letters(word.lower())]

    def _latin(self, cut: str, way: Callable[[str, str], list[str]]) -> bytes | None:
        found = self.LATIN.fullmatch(cut)
        if found is None:
            return None
        if not found[3]:
            parts = way(found[1], found[2])
            ids = [token.id for token in self.model.tokenize(parts[-1])]
            return array(self.code, [token.id for token in self.model.tokenize(parts[0])] + ids if len(parts) > 1 else ids).tobytes()
        ids = [token.id for part in way(found[1], found[2]) for token in self.model.tokenize(part)]
        marks = found[3]
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": []}
            self.marks[marks] = [token.id for token in self.model.tokenize(marks)]
        return array(self.code, ids + self.marks[marks]).tobytes()

    def __missing__(self, cut: bytes) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = self.pretokens and self._latin(cut.decode(), self.pretokens)
            ids = self.whole(cut) if ids is None else ids
        if len(self) >= self.capacity:
            self.old = dict(self)
            self.clear()
        self[cut] = ids
        return ids

    def whole(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts of about two MB in all."""
        odd = {k for k, text in enumerate(texts) if b"<|" in text or self.ODD_SPACE.search(text)}
        even = [b"" if k in odd else text for k, text in enumerate(texts)]
        raw = b"".join(even)
        width = array(self.code).itemsize
        if raw:
            ids, ends = self._gather(raw, np.cumsum([0, *map(len, even)]))
            data, ends = memoryview(ids.tobytes()), (ends * width).tolist()
            out = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            out = [b""] * len(texts)
        for k in odd:
            out[k] = self.whole(texts[k])
        return out

    def _gather(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other, and where each text's ids begin and the last one's end."""
        n = len(raw)
        data = np.frombuffer(raw + bytes(8 * self.LANES + 8), np.uint8)
        space = (data[:n] == 32) | (data[:n] == 10)
        first = space.copy()
        first[1:] &= ~space[:-1]
        mark = np.flatnonzero(_MARKS[data[1:n]]) + 1
        before, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
        latin = (lead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)  # not the signs for times and divided by
        first[mark[_LETTERS[before] | latin]] = True
        first[bounds[:-1][bounds[:-1] < n]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        numbers = np.ndarray((n + 8 * self.LANES,), "<u8", buffer=data, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        lanes = [numbers[starts + 8 * k] & masks[np.clip(sizes - 8 * k, 0, 8)] for k in range(self.LANES)]
        key = sizes.astype(np.uint64)
        for lane in lanes:
            key = (key ^ lane) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        long = np.flatnonzero(sizes > 8 * self.LANES)
        key[long] = np.arange(len(long), dtype=np.uint64)
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = sizes[order[1:]] != sizes[order[:-1]]
        for lane in lanes:
            lane = lane[order]
            new[1:] |= lane[1:] != lane[:-1]
        new |= (sizes > 8 * self.LANES)[order]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        picked = order[new]
        a = starts[picked]
        pieces = [self[raw[x:y]] for x, y in zip(a.tolist(), (a + sizes[picked]).tolist(), strict=True)]
        pool = np.frombuffer(b"".join(pieces), np.dtype(f"<u{array(self.code).itemsize}"))
        lengths = np.array([len(x) for x in pieces], np.int64) // pool.itemsize
        offsets = np.cumsum(lengths) - lengths
        counts = lengths[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(offsets[which] - ends[:-1], counts)
        at += np.arange(len(at))
        return pool[at], ends[np.searchsorted(starts, bounds)]


def text_slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts (a binary column) have about `size` bytes, with the texts; null counts as empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")), at + 1)
        part = batch.slice(at, end - at)
        yield part, [x or b"" for x in part.column(column).to_pylist()]
        at = end


_encoders: dict[tuple[str, str], CachedEncoder] = {}


def give_back(tables: bool = True) -> None:
    """Return memory that a long-lived Python worker holds from earlier stages; with `tables`, token tables as well."""
    if tables:
        _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, code: str = "I") -> CachedEncoder:
    """One encoder for each Python worker."""
    if (path, code) not in _encoders:
        _encoders.clear()
        _encoders[path, code] = CachedEncoder(path, code)
    return _encoders[path, code]


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; every node has them under the same path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
