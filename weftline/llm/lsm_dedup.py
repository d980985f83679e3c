"""Exact dedup by a log-structured merge index, in DataFrame functions only.

* Memtables: every scan partition holds the digests of its rows and flushes them as one run, sorted by digest, a
  Parquet file with minimum, maximum and a Bloom filter of the digest. Nothing is shuffled.
* Compaction: the runs of a batch merge into a table with a row for each digest, the smallest identifier, (most code
  points, smallest doc_id), and the number of rows; partial aggregation leaves a row for each digest and task, so a group
  with a third of all rows is no hot key. A table that has grown to a `FAN`th of the level below merges into that
  level, so a digest is rewritten a logarithmic number of times however many batches come.
* Hits: rows that pass a filter over the digests of several rows and are then found in a level's sorted run.
* Verification: each hit's normalised bytes are compared with those of the row that its digest keeps. Rows that differ
  under an equal digest form groups of their own by their bytes.

Hot digests: those with more than `SALT_ROWS` rows and a thousandth of all rows are fewer than 1,000, and are broadcast by
that bound with a number of salts; every join on a digest is on its salt as well, so no task gets the whole of a group.

Edge cases: null texts count as empty and are equal to texts of white space only; very long texts are digested whole;
among equal texts of equal length the smallest doc_id stays, null first; of repeated rows one stays; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

SPACE = r"[\x20\x09-\x0D]+"
SALT_ROWS, FAN = 1024, 4
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, code points, normalised text and its digest."""
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"))
    return texts.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _best(*more: str) -> Column:
    return F.min(F.struct((-F.col("points")).alias("fewer"), "doc_id", *more))


def flush(docs: DataFrame) -> DataFrame:
    """A batch's runs: (digest, doc_id, points), sorted by digest in each scan partition's file."""
    runs = _digested(docs).select("digest", "doc_id", "points").sortWithinPartitions("digest")
    return common.materialise(runs, "lsm-runs", **BLOOM)


def compact(runs: DataFrame) -> DataFrame:
    """A sorted table of the runs: digest, rows and the smallest identifier."""
    merged = runs.groupBy("digest").agg(F.count("*").alias("rows"), _best().alias("best"))
    return common.materialise(merged.sortWithinPartitions("digest"), "lsm-level", **BLOOM)


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two levels as one: counts add up, the smallest identifier stays."""
    merged = one.unionByName(other).groupBy("digest").agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))
    return common.materialise(merged.sortWithinPartitions("digest"), "lsm-level", **BLOOM)


class Index:
    """Levels of sorted tables, the newest and smallest last, and the number of digests in each."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def insert(self, docs: DataFrame) -> None:
        """Flush a batch's memtables and compact them; merge levels that have grown close to the ones below."""
        level = compact(flush(docs))
        size = level.count()
        while self.levels and self.levels[-1][0] <= FAN * size:
            level = merge(self.levels.pop()[1], level)
            size = level.count()
        self.levels.append((size, level))

    def table(self) -> DataFrame:
        """All levels as one table with a row for each digest."""
        while len(self.levels) > 1:
            (_, newer), (_, older) = self.levels.pop(), self.levels.pop()
            level = merge(older, newer)
            self.levels.append((level.count(), level))
        return self.levels[0][1]

    def lookup(self, text: str) -> DataFrame:
        """Rows of all levels for one text: the digest is pushed down to the files' ranges and Bloom filters."""
        digest = F.unhex(F.sha2(normalised(F.lit(text)), 256))
        found = [level.where(F.col("digest") == digest) for _, level in self.levels]
        out = found[0]
        for level in found[1:]:
            out = out.unionByName(level)
        return out


def _salted(rows: DataFrame, salts: Column) -> DataFrame:
    """A row for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))


def verify(docs: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """Hits of the digests in `shared` with `other`: null where a row's bytes equal its digest's kept row, else its bytes."""
    least = max(SALT_ROWS, total // common.HOT_KEYS)
    salts = F.when(F.col("rows") > least, F.ceil(F.col("rows") / SALT_ROWS)).otherwise(1)
    hot = shared.where(F.col("rows") > least).select("digest", salts.cast("bigint").alias("salts"))
    rows = common.maybe_in(_digested(docs), "digest", common.bounded_filter(shared, "digest")).withColumn("row", F.monotonically_increasing_id())
    if hot.isEmpty():
        rows = rows.withColumn("salts", F.lit(1).cast("bigint"))
    else:
        rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("bigint")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    hits = common.materialise(rows.join(_salted(shared.select("digest", "best", "rows"), salts).drop("rows"), ["digest", "salt"]), "lsm-hits")
    kept = hits.where((-F.col("points") == F.col("best.fewer")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    kept = _salted(kept.groupBy("digest", "salts").agg(F.min("norm").alias("kept_norm")), F.col("salts")).drop("salts")
    other = F.when(F.col("norm") != F.col("kept_norm"), F.col("norm"))
    return common.materialise(hits.join(kept, ["digest", "salt"]).select("digest", "salt", "salts", "doc_id", "points", "row", other.alias("other")), "lsm-verified")


def dedup(docs: DataFrame, batches: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; `batches`, if given, are the parts of `docs` as they came."""
    index = Index()
    for batch in batches or [docs]:
        index.insert(batch)
    level = index.table()
    total = level.agg(F.sum("rows")).first()[0] or 0
    hits = verify(docs, level.where("rows > 1"), total)
    groups = hits.groupBy("digest", "salts", "other").agg(F.count("*").alias("group_size"), _best("row").alias("keep"))
    groups = _salted(groups, F.col("salts")).select(F.col("digest").alias("group_digest"), F.col("salt").alias("group_salt"), F.col("other").alias("group_other"), "group_size", "keep")
    same = hits.join(groups, (F.col("digest") == F.col("group_digest")) & (F.col("salt") == F.col("group_salt")) & F.col("other").eqNullSafe(F.col("group_other")))
    several = same.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    single = level.where("rows = 1").select(F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return single.unionByName(several)


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs)


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""
