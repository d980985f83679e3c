"""Substring dedup by suffix automata over words.

A word goes if a window of 13 words of its document that covers it also starts in a document of smaller doc_id. Every
document is a reference for those after it. Automata of all text would be as large as the corpus, and streaming each
document through each of them is work in the square of it, so a search first finds which words of the references can be
shared at all; only these are kept in the reference shards, and a document is streamed through the shards that hold them:

1. Search. Every window has a key, the least hash of its 5-word runs, which only depends on its words; windows in a
   row mostly share it. Windows of a group of documents that one of them shares with a smaller one are told at once, and
   only the smallest one's stay (a partial aggregation, so a passage that all documents hold leaves one run a group).
   Runs of the others go to their key's bucket with 48 bits of each window's hash, where the same is done for all
   groups, a batch at a time. Each hit is a request: document, position, and place in a smaller document, the owner.
2. Shards. The requested words of the owners, in chunks of `CHUNK_WORDS` windows, are dealt to shards of about
   `SHARD_WORDS` words. The requested parts of documents are dealt to the same shards; a shard that many documents ask
   for is copied under a salt for each `SEGMENT_WORDS` words to stream, so it is broadcast to the tasks that need it.
3. Matching. Each task builds its shard's suffix automaton, owners in ascending order, and streams the documents' parts
   through it; the matching statistics give maximal spans of 13 or more words that a smaller document holds. Spans go
   back to their documents and their words are removed. Nothing is removed that an automaton hasn't matched word by
   word; a window is missed only if 64 bits of hashes collide in a group, or 112 bits in a bucket.

Bounds: a bucket holds a bounded number of distinct windows as the number of buckets follows the input's bytes; a shard
and a document's requests are bounded by words; the driver gets a few counts. Fewer than 1,000 hot shards are listed in
a broadcast.

Edge cases: null texts have no words; documents of under 13 words stay whole; very long texts are cut in chunks for the
shards only; rows with equal doc_id are one another's peers, not references, and each is judged alone; repeated rows give
equal rows; a null doc_id is neither reference nor cut; ties can't matter as doc_ids decide; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

WINDOW, GRAM = 13, 5
SLICE_BYTES, GROUP_BYTES = 1 << 20, 8 << 20
BUCKET_WORDS, BATCH_WINDOWS = 300_000, 1_000_000
CHUNK_WORDS, SHARD_WORDS, SEGMENT_WORDS = 8192, 1 << 15, 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C55)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(max(n, SLICE_BYTES + 1), base)
    return _POWERS[base]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that lie one after the other in `data`, and each word's text.

    A polynomial over a word's bytes from sums over all bytes, so no word is handled on its own.
    """
    n = len(data)
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[1:-1][bounds[1:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = edges[edges > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    inverse = pow(int(BASE), -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(int(BASE), n)[:n], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _table(inverse, n)[starts] + (stops - starts).astype(np.uint64)
    return _mixed(hashes), np.searchsorted(bounds, starts, side="right") - 1


def _rolled(x: np.ndarray, width: int, salt: int) -> np.ndarray:
    n = max(len(x) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += x[k : k + n] * np.uint64(pow(int(BASE), k + salt, 1 << 64))
    return _mixed(total)


def window_runs(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one key: key, text, pos (word), count; and `hashes`, 48 bits for each window."""
    words, text = word_hashes(data, bounds)
    n = max(len(words) - WINDOW + 1, 0)
    ok = text[:n] == text[WINDOW - 1 :] if n else np.zeros(0, bool)
    grams = _rolled(words, GRAM, 3)
    key = grams[:n].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(key, grams[k : k + n], out=key)
    places = np.flatnonzero(ok)
    key, owner = key[places], text[places]
    new = np.ones(len(places), bool)
    new[1:] = (key[1:] != key[:-1]) | (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    first_word = np.searchsorted(text, np.arange(len(bounds) - 1))
    hashes = _rolled(words, WINDOW, 40)[places] & np.uint64((1 << 48) - 1)
    # least hashes crowd at zero; mixing them again, which is one to one, spreads them evenly over the buckets
    return {"key": _mixed(key[at]), "text": owner[at], "pos": places[at] - first_word[owner[at]], "count": np.diff(np.append(at, len(places))), "hashes": hashes}


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, bytes, bounds) of a batch in slices of about SLICE_BYTES; nulls in doc_id are left out."""
    batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(b"")], names=["doc_id", "text"]).filter(batch.column(0).is_valid())
    sizes = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64) if len(batch) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")), at + 1)
        part = batch.slice(at, end - at)
        data = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8)
        yield part.column(0).to_numpy(), data, np.concatenate([[0], np.cumsum(sizes[at:end])])
        at = end


#: Columns of a packed batch of runs and their types.
PACKED = (("key", "<u8"), ("doc_id", "<i8"), ("pos", "<u4"), ("count", "<u4"))


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns one after the other, byte planes of each together, under zstandard."""
    n = len(columns["key"])
    parts = [np.array([n, len(columns["hashes"])], "<u4").tobytes()]
    for name, kind in PACKED:
        column = columns[name]
        if name == "key":
            column = np.diff(column, prepend=np.uint64(0))
        parts.append(np.ascontiguousarray(column.astype(kind)).view(np.uint8).reshape(n, -1).T.tobytes())
    parts.append(np.ascontiguousarray(columns["hashes"].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at, out = 8, {}
    for name, kind in PACKED:
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        at += n * size
    out["key"] = np.cumsum(out["key"], dtype=np.uint64)
    hashes = np.zeros((m, 8), np.uint8)
    hashes[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, at).reshape(m, 6)
    return out | {"hashes": hashes.view("<u8").ravel()}


def _picked(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    """Some rows, in the order given, with their windows."""
    count = columns["count"].astype(np.int64)
    first = np.cumsum(count) - count
    many = count[rows]
    windows = np.repeat(first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return {k: columns[k][windows if k == "hashes" else rows] for k in columns}


def _hits(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Windows that a smaller document among the runs holds, as requests; and the runs of all other windows."""
    columns = _picked(columns, np.argsort(columns["doc_id"], kind="stable"))
    count = columns["count"].astype(np.int64)
    run = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    hashes, key = columns["hashes"], columns["key"][run]
    mark = (hashes << np.uint64(16)) ^ key * BASE
    order = np.argsort(mark, kind="stable")
    same = (mark[order][1:] == mark[order][:-1]) & (hashes[order][1:] == hashes[order][:-1]) & (key[order][1:] == key[order][:-1])
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0)) if len(order) else order
    lead_of = np.empty(len(order), np.int64)
    lead_of[order] = order[lead]
    doc, pos = columns["doc_id"][run], columns["pos"][run].astype(np.int64) + nth
    hit = doc != doc[lead_of]
    at, owner = np.flatnonzero(hit), lead_of[hit]
    found = {"doc_id": doc[at], "pos": pos[at], "owner": doc[owner], "owner_pos": pos[owner]}
    joins = np.zeros(len(at), bool)
    joins[1:] = (run[at][1:] == run[at][:-1]) & (found["owner"][1:] == found["owner"][:-1]) & (np.diff(found["pos"]) == 1) & (np.diff(found["owner_pos"]) == 1)
    first = np.flatnonzero(~joins)
    requests = {k: v[first] for k, v in found.items()} | {"count": np.diff(np.append(first, len(at)))}
    left = np.flatnonzero(~hit)
    new = np.ones(len(left), bool)
    new[1:] = (run[left][1:] != run[left][:-1]) | (np.diff(left) != 1)
    first = np.flatnonzero(new)
    rest = {"key": key[left][first], "doc_id": doc[left][first], "pos": pos[left][first], "count": np.diff(np.append(first, len(left))), "hashes": hashes[left]}
    return requests, rest


REQUESTS = pa.schema([(k, pa.int64()) for k in ("doc_id", "pos", "owner", "owner_pos", "count")])


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def bucketed_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob, requests) rows: the runs of some MB of texts, dealt by key, and requests among those texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        held, size, flushes = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushes
            found, columns = _hits(_joined(held))
            held.clear()
            columns = _picked(columns, np.argsort(columns["key"], kind="stable"))
            place = (columns["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(columns["count"], dtype=np.int64)])
            names, blobs, flushes = [], [], flushes + 1
            for k in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[k], cuts[k + 1]
                names.append(int(k))
                blobs.append(_pack({n: v[ends[a] : ends[b]] if n == "hashes" else v[a:b] for n, v in columns.items()}))
            told = [None] * len(names)
            for at in range(0, len(found["doc_id"]), 1 << 15):  # requests ride along, spread over the buckets
                part = pa.RecordBatch.from_arrays([pa.array(found[k][at : at + (1 << 15)], pa.int64()) for k in REQUESTS.names], schema=REQUESTS)
                names.append(hash((int(found["doc_id"][at]), at, flushes)) % buckets)
                blobs.append(None)
                told.append(zstandard.ZstdCompressor(level=1).compress(_ipc(part)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array(told, pa.binary())], names=["bucket", "blob", "requests"])

        for batch in batches:
            for doc_ids, data, bounds in _texts(batch):
                runs = window_runs(data, bounds)
                if len(runs["key"]):
                    runs["doc_id"] = doc_ids[runs.pop("text")]
                    held.append(runs)
                size += len(data)
                if size >= GROUP_BYTES and held:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        common.give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "bucket int, blob binary, requests binary")


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of one bucket. Whenever a million windows are held, only those of the smallest documents stay."""
    held, windows = [], 0

    def told(found: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[k], pa.int64()) for k in REQUESTS.names], schema=REQUESTS)

    for batch in batches:
        for blob, requests in zip(batch.column(1), batch.column(2), strict=True):
            if requests.is_valid:
                yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(requests.as_py()))
                continue
            held.append(_unpack(blob.as_py()))
            windows += len(held[-1]["hashes"])
            if windows >= BATCH_WINDOWS + len(held[0]["hashes"]):
                found, rest = _hits(_joined(held))
                held, windows = [rest], len(rest["hashes"])
                yield told(found)
    if held:
        yield told(_hits(_joined(held))[0])


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Words that documents can share, stored: doc_id, owner, its chunk, first and end word in the owner, first word in the document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(batches)

    found = bucketed_runs(docs, buckets).groupBy("bucket").applyInArrow(search, ", ".join(f"`{k}` long" for k in REQUESTS.names))
    merged = found.groupBy("doc_id", "owner", F.floor(F.col("owner_pos") / CHUNK_WORDS).alias("chunk"), (F.col("pos") - F.col("owner_pos")).alias("shift"))
    merged = merged.agg(F.min("owner_pos").alias("first"), F.max(F.col("owner_pos") + F.col("count")).alias("end"))
    chunk = F.explode(F.sequence("chunk", F.floor((F.col("end") - 1) / CHUNK_WORDS)))
    cut = merged.select("doc_id", "owner", "shift", "first", "end", chunk.alias("chunk"))
    first = F.greatest("first", F.col("chunk") * CHUNK_WORDS)
    end = F.least("end", (F.col("chunk") + 1) * CHUNK_WORDS) + WINDOW - 1
    return common.materialise(cut.select("doc_id", "owner", "chunk", first.alias("first"), end.alias("end"), (first + F.col("shift")).alias("at")), "automaton-requests")


class SuffixAutomaton:
    """All word sequences of some passages, each with the smallest owner that holds it. Owners come in ascending order."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def add(self, words: list[bytes], owner: int = 0) -> None:
        """Another passage; passages don't run into each other."""
        nexts, link, length, last = self.next, self.link, self.length, 0
        for word in words:
            if word in nexts[last]:
                target = nexts[last][word]
                last = target if length[target] == length[last] + 1 else self._clone(last, word, target)
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            self.owner.append(owner)
            at = last
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = state
                at = link[at]
            if at >= 0:
                target = nexts[at][word]
                link[state] = target if length[target] == length[at] + 1 else self._clone(at, word, target)
            last = state

    def _clone(self, at: int, word: bytes, target: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        self.owner.append(self.owner[target])
        link[target] = copy
        while at >= 0 and nexts[at].get(word) == target:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def spans(self, words: list[bytes], least: int, doc_id: int | None = None) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of `least` or more words, from the longest match that ends at each word.

        With a doc_id, only matches count that an owner of smaller id holds; where the longest match has none, shorter
        ones of `least` or more words, which are the states it links to, may.
        """
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        state = size = 0
        out: list[list[int]] = []
        for end, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            if word in nexts[state]:
                state, size = nexts[state][word], size + 1
            if size < least:
                continue
            found, at = size, state
            while doc_id is not None and found >= least and owner[at] >= doc_id:
                at = link[at]
                found = length[at]
            if found >= least:
                if out and end - found <= out[-1][1]:
                    out[-1] = [min(out[-1][0], end - found), end]
                else:
                    out.append([end - found, end])
        return [(a, b) for a, b in out]


def _islands(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (first, end) as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(texts: DataFrame, wanted: DataFrame, keys: DataFrame, key: str, first: str) -> DataFrame:
    """The wanted words of each text: shard, key, tag (a hash of the text), at (first word), words joined by spaces.

    `keys` is a stored table whose column `key` has the ids of all these texts.
    """
    shard = "shard"
    parts = wanted.groupBy(key, shard).agg(F.collect_set(F.struct(F.col(first).alias("first"), (F.col(first) + F.col("end") - F.col("first")).alias("end"))).alias("parts"))
    parts = parts.groupBy(key).agg(F.collect_list(F.struct(shard, "parts")).alias("lists"))  # bounded by the document's words
    some = common.maybe_in(texts, "doc_id", common.bounded_filter(keys.select(F.col(key).alias("doc_id")), "doc_id"))
    joined = some.select(F.col("doc_id").alias(key), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tag")).join(parts, key)
    schema = pa.schema([("shard", pa.int64()), (key, pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words, out = (batch.column(1)[k].as_py() or b"").split(), []
                name, tag = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                for entry in batch.column(3)[k].as_py():
                    out += [(entry[shard], name, tag, a, b" ".join(words[a:b])) for a, b in _islands([(p["first"], p["end"]) for p in entry["parts"]])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.select(key, "text", "tag", "lists").mapInArrow(rows, f"shard long, `{key}` long, tag long, at long, words binary")


def shared_spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tag, first and end word of spans that smaller documents hold, stored; by streaming through automata."""
    held = wanted.groupBy("owner", "chunk", "first").agg(F.max("end").alias("end"))  # a part that many ask for is counted and cut once
    total = held.agg(F.sum(F.col("end") - F.col("first"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("owner", "chunk"), F.lit(shards)).alias("shard")
    asked = wanted.select("doc_id", shard, "at", "first", "end")
    loads = asked.groupBy("shard").agg(F.sum(F.col("end") - F.col("first")).alias("load"))
    load, most = loads.agg(F.sum("load"), F.max("load")).first()
    share = max(SEGMENT_WORDS, (load or 0) // common.HOT_KEYS)  # fewer than HOT_KEYS shards have more than one share
    hot = loads.where(F.col("load") > share).select("shard", F.ceil(F.col("load") / share).alias("salts"))
    one = F.lit(1).cast("bigint")

    def salted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("salts", one) if (most or 0) <= share else rows.join(F.broadcast(hot), "shard", "left").withColumn("salts", F.coalesce("salts", one))

    passages = salted(_cut(docs, held.select("owner", shard, "first", "end"), wanted, "owner", "first"))
    passages = passages.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("owner").alias("doc_id"), "tag", "at", "words")
    segments = salted(_cut(docs, asked, wanted, "doc_id", "at"))
    segments = segments.select("shard", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.lit(1).alias("kind"), "doc_id", "tag", "at", "words")
    dealt = passages.unionByName(segments).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id")
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "tag", "first", "end")])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, last = SuffixAutomaton(), None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, kind, doc_id, tag, at, words in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), *(batch.column(k).to_pylist() for k in range(2, 6)), batch.column(6), strict=True):
                if key != last:
                    automaton, last = SuffixAutomaton(), key
                words = words.as_py().split(b" ")
                if kind == 0:
                    automaton.add(words, doc_id)
                else:
                    out += [(doc_id, tag, at + a, at + b) for a, b in automaton.spans(words, WINDOW, doc_id)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        common.give_back()

    return common.materialise(dealt.mapInArrow(stream, "doc_id long, tag long, first long, end long"), "automaton-spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces) for every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = shared_spans(docs, requests(docs, max(64, size // 6 // BUCKET_WORDS)))
    hit = common.bounded_filter(spans, "doc_id")
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tag"))
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # bounded by the document's words
    shared = common.maybe_in(text, "doc_id", hit).join(lists, ["doc_id", "tag"], "left").drop("tag")
    alone = common.maybe_in(text, "doc_id", hit, negate=True).select("doc_id", "text", F.lit(None).cast("array<struct<first: long, end: long>>").alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                for a, b in reversed(_islands([(s["first"], s["end"]) for s in spans or ()])):
                    del words[a:b]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
        common.give_back()

    schema = "doc_id long, n_words long, n_removed long, kept binary"
    return alone.mapInArrow(remove, schema).unionByName(shared.mapInArrow(remove, schema))


def op8(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM starts),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS owner FROM wins) x WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hits) y),
cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(js, p[2])), lambda p: p[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id"""
