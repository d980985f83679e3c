"""Near copies: rows that share at least `LEAST` of the distinct five-word shingles of both, by SimHash and MinHash.

Candidates come from the trie self-join of 64-bit fingerprints (simhash_trie.links) and, as rows at 0.8 differ in about ten
bits, from `BANDS` bands of `DEPTH` minima each; a pair at 0.8 agrees in no band with a chance of 5 in 100,000, less above
that. Only an exact comparison of the shingles links rows:

1. Rows of equal shingle sets are a class; its row of smallest key stands for it from here on.
2. Each candidate is compared with the smallest row of each of its bands and of its fingerprint's links, so candidates
   grow with the input only. The smallest row goes under as many salts as its candidates need.
3. What is still in different components, though linked by candidates, is compared in blocks: rows outside a
   component's largest part, `BLOCK` at a time, against all its rows, of which each task streams a share. A task holds one
   block's shingles, and hands on links that join two parts only.

Edge cases: fewer words than a shingle form one shingle; null and empty texts have none and are alike; very long texts
are compared whole; rows are told apart by their key, so null, repeated and equal rows are rows of their own; a null
doc_id stays only where no other does; an empty table gives no rows; only the key, doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, simhash_trie

SHINGLE, LEAST = 5, (4, 5)
BANDS, DEPTH = 25, 5
CHUNK, BLOCK, SHARE = 4096, 256, 1024
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (3, BANDS * DEPTH), np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(simhash_trie.shingle_hashes(text, SHINGLE).astype(np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band, from the minima of `BANDS` * `DEPTH` orders of the hashes."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[at : at + CHUNK, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(DEPTH):
        out = (out ^ least[k::DEPTH]) * _MIX[2, k]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sketched(rows: DataFrame, key: str) -> DataFrame:
    """The key of every row, a digest of its shingle set, its fingerprint over shingles and its bands."""
    schema = pa.schema([(key, pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part, texts in common.text_slices(batch, 1):
                hashes = [simhash_trie.shingle_hashes(x, SHINGLE) for x in texts]
                sets = [np.unique(x.astype(np.uint64)) for x in hashes]
                prints = np.array([simhash_trie.fingerprint(x) for x in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(prints), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))], schema=schema)
        common.give_back()

    return rows.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(told, f"`{key}` long, digest binary, fp long, bands array<long>")


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets of hashes share enough."""
    part, whole = LEAST
    if min(len(one), len(other)) * whole < max(len(one), len(other)) * part:
        return False
    if not len(one):
        return True
    shared = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return shared * whole >= (len(one) + len(other) - shared) * part


def candidates(classes: DataFrame) -> DataFrame:
    """(head, key) pairs of classes (key, fp, bands) that may be alike, the head the smaller key; stored."""
    prints = common.materialise(classes.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "near-prints")
    total = classes.count()
    equal = common.join_hot(classes.select("fp", "key"), prints, "fp", "n", total).select("head", "key")
    near = common.materialise(simhash_trie.links(prints.select("fp")), "near-trie")
    for side in ("a", "b"):
        named = near.groupBy(side).agg(F.count("*").alias("n")).join(prints.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head")), side)
        near = common.join_hot(near, common.materialise(named, "near-named"), side, "n", total)
    near = near.select(F.least("a_head", "b_head").alias("head"), F.greatest("a_head", "b_head").alias("key"))
    dealt = classes.select("key", F.explode("bands").alias("band"))
    heads = common.materialise(dealt.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1"), "near-bands")
    banded = common.join_hot(dealt, heads, "band", "n", total * BANDS).select("head", "key")
    return common.materialise(equal.union(near).union(banded).where("head != key").distinct(), "near-candidates")


def _dealt(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of a cell in one task, by kind."""
    return cells.repartition(*groups).sortWithinPartitions(*groups, "kind")


def compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (head, key) that are alike, stored. `texts` has key and text."""
    counts = pairs.groupBy("head").agg(F.count("*").alias("n"))
    share = max(SHARE, pairs.count() // common.HOT_KEYS)
    hot = counts.where(F.col("n") > share).select("head", F.ceil(F.col("n") / share).alias("salts"))  # fewer than HOT_KEYS rows
    single, none = F.lit(1).cast("bigint"), hot.isEmpty()

    def salted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("salts", single) if none else rows.join(F.broadcast(hot), "head", "left").withColumn("salts", F.coalesce("salts", single))

    one = salted(counts.select("head")).join(texts.withColumnRenamed("key", "head"), "head")
    one = one.select("head", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("head").alias("key"), "text")
    others = salted(pairs).join(texts, "key").select("head", F.pmod(F.xxhash64("key"), "salts").alias("salt"), F.lit(1).alias("kind"), "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out = []
            for head, kind, key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                found = shingles(text.as_py() or b"")
                if kind == 0:
                    last, held = head, found
                elif head == last and alike(held, found):
                    out.append((head, key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        common.give_back()

    return common.materialise(_dealt(one.unionByName(others), ["head", "salt"]).mapInArrow(compare, "a long, b long"), "near-links")


def left_over(texts: DataFrame, classes: DataFrame, pairs: DataFrame, linked: DataFrame) -> DataFrame | None:
    """Links between parts of a candidate component that the comparison with smallest rows left apart; None if there are none."""
    parts = common.materialise(simhash_trie.components(linked).select(F.col("node").alias("key"), F.col("root").alias("part")), "near-parts")
    apart = common.materialise(pairs.join(linked.select(F.col("a").alias("head"), F.col("b").alias("key")), ["head", "key"], "left_anti"), "near-apart")
    heads = apart.groupBy("head").agg(F.count("*").alias("n")).join(parts.select(F.col("key").alias("head"), F.col("part").alias("head_part")), "head")
    crossing = common.join_hot(apart, common.materialise(heads, "near-heads"), "head", "n", apart.count(), "left").join(parts, "key", "left")
    crossing = crossing.select(F.coalesce("head_part", "head").alias("a"), F.coalesce("part", "key").alias("b")).where("a != b")
    groups = common.materialise(simhash_trie.components(crossing).select(F.col("node").alias("part"), F.col("root").alias("group")), "near-groups")
    members = parts.groupBy("part").agg(F.count("*").alias("n"))
    sized = groups.join(members, "part", "left").select("part", "group", F.coalesce("n", F.lit(1).cast("bigint")).alias("n"))
    sized = common.materialise(sized, "near-sized")
    sizes = sized.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    sizes = common.materialise(sizes.where("n > 2"), "near-sizes")  # two rows have been compared
    if sizes.isEmpty():
        return None
    blocks, salts = F.ceil((F.col("n") - F.col("most")) / BLOCK), F.ceil(F.col("n") / SHARE)
    few = common.join_hot(sized.select("part", "group", F.col("n").alias("rows")), sizes.select("group", "major", blocks.alias("blocks"), salts.alias("salts"), "parts"), "group", "parts", sized.count())
    few = common.materialise(few, "near-few")
    whole = common.join_hot(parts, few.select("part", "group", "major", "blocks", "salts", "rows"), "part", "rows", parts.count())
    single = few.join(parts.select("part").distinct(), "part", "left_anti").select(F.col("part").alias("key"), "part", "group", "major", "blocks", "salts")
    open_ = common.materialise(whole.select(*single.columns).union(single), "near-open")
    marks = common.bounded_filter(open_, "key")
    full = open_.join(common.maybe_in(texts, "key", marks), "key").join(common.maybe_in(classes.select("key", "bands"), "key", marks), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    minor = full.where("part != major").withColumn("salt", every("salts")).withColumn("block", place("blocks")).withColumn("kind", F.lit(0))
    stream = full.withColumn("block", every("blocks")).withColumn("salt", place("salts")).withColumn("kind", F.lit(1))
    dealt = _dealt(minor.unionByName(stream).select("group", "block", "salt", "kind", "key", "part", "text", "bands"), ["group", "block", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, trees = None, [], simhash_trie.Forest()
        for batch in batches:
            out = []
            for group, block, salt, kind, key, part, text, band in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), batch.column(7), strict=True):
                if (group, block, salt) != last:
                    last, held, trees = (group, block, salt), [], simhash_trie.Forest()
                found, band = shingles(text.as_py() or b""), np.array(band.as_py(), np.int64)
                if kind == 0:
                    held.append((key, part, found, band))
                    continue
                for other, its_part, its_set, its_band in held:
                    if trees.root(its_part) != trees.root(part) and (its_band == band).any() and alike(its_set, found):
                        trees.joins(its_part, part)
                        out.append((other, key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        common.give_back()

    return dealt.mapInArrow(compare, "a long, b long")


def surplus(rows: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that go: all but the smallest doc_id, then key, of each component. `rows` must be stored."""
    rows = rows.select(F.col(key).alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))
    told = common.materialise(sketched(rows, "key"), "near-sketches")
    classes = told.groupBy("digest").agg(F.min(F.struct("key", "fp", "bands")).alias("rep"), F.count("*").alias("n"))
    classes = common.materialise(classes.select("digest", F.col("rep.key").alias("head"), F.col("rep.fp").alias("fp"), F.col("rep.bands").alias("bands"), "n"), "near-classes")
    same = common.join_hot(told.select("digest", "key"), classes.select("digest", "head", "n"), "digest", "n", told.count())
    same = same.where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    heads = classes.select(F.col("head").alias("key"), "fp", "bands")
    pairs = candidates(heads)
    marks = common.bounded_filter(pairs.select(F.explode(F.array("head", "key")).alias("key")), "key")
    texts = common.maybe_in(rows.select("key", "text"), "key", marks)
    linked = compared(texts, pairs)
    rest = left_over(texts, heads, pairs, linked)
    found = linked.union(same) if rest is None else linked.union(same).union(rest)
    roots = simhash_trie.components(found).select(F.col("node").alias("key"), "root")
    placed = common.materialise(rows.select("key", "doc_id").join(roots, "key"), "near-placed")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"), F.count("*").alias("n"))
    best = common.materialise(best.select("root", F.col("best.key").alias("stays"), "n"), "near-best")
    gone = common.join_hot(placed, best, "root", "n", placed.count())
    return gone.where("key != stays").select(F.col("key").alias(key))
