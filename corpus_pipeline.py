"""A training corpus from documents: quality, exact dedup, near-dedup, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and returns the columns of documents, the
last one the packed pieces. Between stages rows are stored as Parquet and read again; run() deletes what a stage stored
for itself once its rows are written.

Edge cases: decisions are made row by row, so null and repeated doc_ids, whose texts may differ, are rows of their own; a
null text counts as empty, which the quality stage rejects; very long texts are treated whole; of repeated rows one stays;
among equals the smallest doc_id stays, and a null one only where there is no other; an empty table gives no rows;
extra columns of any names pass through unchanged, as columns that stages add for themselves have generated names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, drr_packing, jaccard, knapsack_mix, lsm_dedup, weak_quality
from weftline.session import table


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key for each row, and its name; stored, as the key must not change."""
    key = common.fresh("row")[0]
    return common.materialise(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows", compression="zstd"), key


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Documents without the rows of some keys. Only rows that may be among them by a bounded filter are shuffled."""
    gone = common.materialise(gone, "pipeline-gone")
    marks = common.bounded_filter(gone, key)
    maybe = common.maybe_in(rows, key, marks).join(gone.hint("merge"), key, "left_anti")
    return common.maybe_in(rows, key, marks, negate=True).unionByName(maybe).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return weak_quality.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts."""
    rows, key = _rows(docs)
    found = lsm_dedup.dedup(rows.select(F.struct("doc_id", key).alias("doc_id"), "text"))
    return _without(rows, key, found.where("NOT kept").select(F.col(f"doc_id.{key}").alias(key)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each component of rows that share 0.8 or more of their five-word shingles.

    Candidates are SimHash links of the trie self-join, and MinHash bands for pairs beyond its budget of bits.
    """
    rows, key = _rows(docs)
    return _without(rows, key, jaccard.surplus(rows, key))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    rows, key = _rows(docs)
    copies = common.fresh("copies")[0]
    taken = knapsack_mix.mix(rows, keys=(key,)).where("taken > 0").select(key, F.expr("cast(taken / size as int)").alias(copies))
    taken = common.materialise(taken, "pipeline-mix").hint("merge")  # a row for each document taken: never broadcast
    joined = rows.join(taken, key)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return drr_packing.op3(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packing)]

#: No SQL has the trained scorer, XXH64 shingles or the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), common.tables_written()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.forget_tables(first, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
