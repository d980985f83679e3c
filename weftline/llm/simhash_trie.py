"""SimHash near-dedup by a binary trie self-join.

Fingerprints: 64 bits over the XXH64 of all word shingles, repeats included; documents of one fingerprint are a class.
Two fingerprints that differ in at most 3 bits agree in one of four 16-bit blocks, so classes are dealt by (block,
value), and in each such bucket a trie over the bits after the block is joined with itself: pairs of nodes are walked
together, level by level, differing bits are added up, and a pair is dropped once they exceed the budget. Buckets of
more than `SPLIT` classes are dealt once more by the 12-bit parts of the other 48 bits, of which one must agree as
well; this loses no pair. All links are followed, but a task hands on a spanning forest of them, at most a row for
each class it saw, so dense groups don't make quadratically many rows. Components come from rounds of large-star and
small-star contraction; each round is stored in the shared folder. Joins on a hub, a root or a fingerprint take the rows of
hot keys, fewer than 1,000, from a broadcast table (`common.join_hot`).

Edge cases: null and empty texts have fingerprint zero and link like others; fewer words than a shingle form one
shingle; very long texts are hashed whole; repeated rows and equal doc_ids are rows of their own; a null doc_id doesn't
count as smallest while another is reachable; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

BITS, BUDGET, SPLIT = 64, 3, 200_000
CHUNK = 1 << 17


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of unsigned 64-bit hashes, a bit set if over half of them have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles of lower-cased words; bytes.lower and bytes.split know ASCII letters and spaces only."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if len(words) < shingle:
        joined = [b" ".join(words)] if words else []
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.frombuffer(b"".join([xxh64_digest(x, seed) for x in joined]), ">u8")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(x.as_py() or b"", shingle)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        common.give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, top: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) in sorted distinct keys that agree in the `top` first bits and differ in at most `budget`.

    A trie node at depth d is a run of keys with equal first d bits. Node pairs are walked together, first the
    nodes at depth `top` with themselves; the frontier is cut into chunks, so memory stays bounded.
    """
    prefix = keys >> np.uint64(BITS - top) if top else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys))
    wide = ends - starts > 1
    roots = np.stack([starts[wide], ends[wide], starts[wide], ends[wide], np.zeros(wide.sum(), np.int64)])
    stack = [(top, roots[:, k : k + CHUNK]) for k in range(0, roots.shape[1], CHUNK)]
    while stack:
        depth, (al, ah, bl, bh, diff) = stack.pop()
        small = ((ah - al) * (bh - bl) <= 16) | (depth == BITS)
        if small.any():
            a, b, c, d = (x[small] for x in (al, ah, bl, bh))
            count = (b - a) * (d - c)
            pair = np.repeat(np.arange(len(a)), count)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i, j = a[pair] + nth // (d - c)[pair], c[pair] + nth % (d - c)[pair]
            good = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if good.any():
                yield i[good], j[good]
        if small.all():
            continue
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        halves = lambda lo: np.searchsorted(keys, (keys[lo] & ~(bit | (bit - np.uint64(1)))) | bit)
        am, bm, same = halves(al), halves(bl), al == bl
        nodes = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        nodes.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        front = np.concatenate([np.stack(x) for x in nodes], axis=1)
        keep = (front[1] > front[0]) & (front[3] > front[2]) & (front[4] <= budget) & ~((front[0] == front[2]) & (front[1] - front[0] == 1))
        front = front[:, keep]
        stack += [(depth + 1, front[:, k : k + CHUNK]) for k in range(0, front.shape[1], CHUNK)]


class Forest:
    """Union-find that hands on the links that join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp << np.uint64(by) | fp >> np.uint64(BITS - by) if by else fp


def links(classes: DataFrame, split: int = SPLIT) -> DataFrame:
    """A spanning forest (a, b) of all links between distinct fingerprints `fp`."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block")
    value = F.expr("(fp >> (48 - 16 * block)) & 65535")
    dealt = classes.select("fp", blocks).select("fp", "block", value.alias("value"))
    hot = dealt.groupBy("block", "value").count().where(F.col("count") > split).select("block", "value", F.lit(True).alias("hot"))
    dealt = dealt.join(hot, ["block", "value"], "left")
    whole = dealt.where("hot IS NULL").select("fp", "block", "value", F.lit(-1).cast("bigint").alias("sub"))
    cut = dealt.where("hot").select("fp", "block", "value", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    rest = F.expr("(((fp << (16 * block)) | shiftrightunsigned(fp, (64 - 16 * block) % 64)) >> (36 - 12 * part)) & 4095")
    cut = cut.select("fp", "block", "value", (F.col("part") * 4096 + rest).cast("bigint").alias("sub"))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come in order; whole ones are walked many at a time, parts of a split one each on its own."""
        held: list[tuple[int, int, np.ndarray]] = []

        def walk() -> Iterator[pa.RecordBatch]:
            trees = Forest()  # of the buckets held; links are told once for each such batch of buckets at most
            for block in {b for b, _, _ in held}:
                for sub in {s for b, s, _ in held if b == block}:
                    fps = np.concatenate([f for b, s, f in held if (b, s) == (block, sub)])
                    turned = np.sort(_rotate(fps, 16 * block))
                    for i, j in trie_pairs(turned, 16):
                        a, b = (_rotate(turned[x], (BITS - 16 * block) % BITS) for x in (i, j))
                        new = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if trees.joins(x, y)]
                        if new:
                            both = np.array(new, np.uint64).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            held.clear()

        last, size = None, 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            block, value, sub = (batch.column(k).to_numpy() for k in (1, 2, 3))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (sub[1:] != sub[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                key = (int(block[at]), int(value[at]), int(sub[at]))
                if key != last and (size > 50_000 or key[2] >= 0 or last and last[2] >= 0):
                    yield from walk()
                    size = 0
                held.append((key[0], key[2], fp[at:end]))
                last, size = key, size + end - at
        yield from walk()

    dealt = whole.unionByName(cut).repartition("block", "value", "sub").sortWithinPartitions("block", "value", "sub")
    return dealt.mapInArrow(forest, "a long, b long")


def _least(edges: DataFrame, total: int, most: int) -> DataFrame:
    """Edges (a, b) with m, the least b of each a. `most` is the largest number of edges of an a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if most <= common.HOT_ROWS:
        return edges.join(least.drop("n"), "a")
    return common.join_hot(edges, common.materialise(least, "star-least"), "a", "n", total)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a, b), stored: large-star and small-star by turns until only stars are left."""
    edges = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "star-0")
    for k in range(rounds):
        sides = edges.select("a", F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        nodes = sides.groupBy("a").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
        most, total, open_ = nodes.agg(F.max("n"), F.sum("up"), F.max((F.col("up") > 1) | (F.col("up") == 1) & (F.col("n") > 1))).first()
        if not open_:  # every node has one smaller neighbour and no other, or larger ones only
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        large = _least(edges.union(edges.select("b", "a")), 2 * total, most).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a != b").distinct()
        small = _least(large, total, most)
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = common.materialise(small.where("a != b").distinct(), f"star-{k + 1}")
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id for every row."""
    rows = common.materialise(fingerprints(docs, shingle), "simhash-rows")
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    placed = common.materialise(placed, "simhash-placed")
    smallest = common.materialise(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"), F.sum("n").alias("n")), "simhash-components")
    found, rows_in_all = smallest.agg(F.sum("classes"), F.sum("n")).first()
    named = common.join_hot(placed, smallest.drop("n"), "root", "classes", found or 0)
    return common.join_hot(rows, common.materialise(named.select("fp", "component_id", "n"), "simhash-named"), "fp", "n", rows_in_all or 0)


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
