"""Evaluation queries: expected passages against documents, turns against turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import folds, text
from weftline.operators import evaluation, matching
from weftline.plans.registry import query
from weftline.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn but the first with the text of the one before it as what is expected."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("actual"))
    return turns.withColumn("expected", F.lag("actual").over(Window.partitionBy("conv_id").orderBy("turn"))).where("expected IS NOT NULL")


_TURNS = "SELECT * FROM (SELECT conv_id, turn, text AS actual, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations) x WHERE expected IS NOT NULL"
_LINES = r"""
l AS (SELECT item_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark),
n AS (SELECT item_id, line_no, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS needle FROM l WHERE line <> '' AND NOT regexp_matches(line, '(?i)^#{1,6}\s+page\s+[0-9]+$')
  AND line NOT IN ('```', '---') AND NOT regexp_matches(line, '^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$')),
h AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS hay FROM documents)"""


@query(f"WITH {_LINES} SELECT item_id, line_no::BIGINT AS line_no, doc_id FROM n JOIN h ON contains(hay, needle)")
def expected_lines_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.contained_lines(evaluation.expected_lines(table(spark, sf_dir, "benchmark"), "item_id"), table(spark, sf_dir, "documents"))
    return found.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"""WITH {_LINES}, t AS (SELECT item_id, count(*) AS total FROM n GROUP BY item_id),
f AS (SELECT item_id, doc_id, count(*) AS matched FROM n JOIN h ON contains(hay, needle) GROUP BY item_id, doc_id)
SELECT f.item_id, doc_id, matched, total, 100 * matched >= 87 * total AS passed FROM f JOIN t ON f.item_id = t.item_id""")
def expected_match_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line recall of each passage in each document that holds a line of it, and the 87 per cent gate."""
    lines = evaluation.expected_lines(table(spark, sf_dir, "benchmark"), "item_id")
    found = evaluation.contained_lines(lines, table(spark, sf_dir, "documents")).groupBy("item_id", "doc_id").agg(F.count("*").alias("matched"))
    totals = lines.groupBy("item_id").agg(F.count("*").alias("total"))
    return found.join(totals, "item_id").withColumn("passed", 100 * F.col("matched") >= 87 * F.col("total"))


@query(rf"""WITH p AS ({_TURNS}),
e AS (SELECT conv_id, turn, tok, count(*) AS wanted FROM (SELECT conv_id, turn, unnest(regexp_extract_all(expected, '[0-9]+')) AS tok FROM p) x GROUP BY ALL),
a AS (SELECT conv_id, turn, tok, count(*) AS got FROM (SELECT conv_id, turn, unnest(regexp_extract_all(actual, '[0-9]+')) AS tok FROM p) x GROUP BY ALL)
SELECT e.conv_id, e.turn, sum(least(wanted, coalesce(got, 0)))::BIGINT AS matched, sum(wanted)::BIGINT AS expected
FROM e LEFT JOIN a ON e.conv_id = a.conv_id AND e.turn = a.turn AND e.tok = a.tok GROUP BY e.conv_id, e.turn""")
def digit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return evaluation.bag_recall(_turns(spark, sf_dir), ["conv_id", "turn"], digits("expected"), digits("actual"))


@query(rf"""WITH p AS ({_TURNS}),
s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(expected), '[0-9a-zа-яё]+')) AS e, regexp_extract_all(lower(actual), '[0-9a-zа-яё]+') AS a FROM p)
SELECT conv_id, turn, len(e)::BIGINT AS expected, len(list_filter(e, lambda t: NOT list_contains(a, t)))::BIGINT AS missing FROM s""")
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[0-9a-zа-яё]+"), F.lit(0)))
    pairs = _turns(spark, sf_dir).select("conv_id", "turn", tokens("expected").alias("e"), tokens("actual").alias("a"))
    return pairs.select("conv_id", "turn", F.size("e").cast("bigint").alias("expected"), F.size(F.array_except("e", "a")).cast("bigint").alias("missing"))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark),
p AS (SELECT item_id, t, lead(t) OVER (ORDER BY item_id) AS u FROM b)
SELECT item_id, levenshtein(t, u)::BIGINT AS edits, length(t) AS chars FROM p WHERE u IS NOT NULL""")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between each passage and the next, ASCII characters only. The passages are a fixed reference set."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    ranked = items.select("t", "item_id", F.rank().over(Window.orderBy("item_id")).alias("k"))
    nexts = ranked.select((F.col("k") - 1).alias("k"), F.col("t").alias("u"))
    return ranked.join(nexts, "k").select("item_id", F.levenshtein("t", "u").cast("bigint").alias("edits"), F.length("t").cast("bigint").alias("chars"))


@query(rf"""WITH RECURSIVE p AS ({_TURNS}), k AS (SELECT conv_id, turn, trim(regexp_replace(lower(actual), '\s+', ' ', 'g')) AS hay, list_filter(string_split(trim(regexp_replace(lower(expected), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM p),
r AS (SELECT conv_id, turn, hay, ws, 1::BIGINT AS i, 1::BIGINT AS place, 0::BIGINT AS found FROM k UNION ALL
  SELECT conv_id, turn, hay, ws, i + 1, CASE WHEN instr(substr(hay, place), ws[i]) > 0 THEN place + instr(substr(hay, place), ws[i]) - 1 + length(ws[i]) ELSE place END, found + (instr(substr(hay, place), ws[i]) > 0)::BIGINT FROM r WHERE i <= len(ws))
SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN 1.0 ELSE round(found::DOUBLE / len(ws), 6) END AS recall FROM r WHERE i = len(ws) + 1""")
def ordered_phrase_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a turn's first words that the next turn has in the same order."""
    phrases = F.filter(F.split(text.dedupe_key(F.col("expected")), " "), lambda w: w != "")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(folds.ordered_recall(phrases, text.dedupe_key(F.col("actual"))), 6).alias("recall"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS expected, substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) AS actual FROM documents),
e AS (SELECT doc_id, tok, count(*) AS wanted FROM (SELECT doc_id, unnest(regexp_extract_all(expected, '[0-9]+')) AS tok FROM d) x GROUP BY ALL),
a AS (SELECT doc_id, tok, count(*) AS got FROM (SELECT doc_id, unnest(regexp_extract_all(actual, '[0-9]+')) AS tok FROM d) x GROUP BY ALL)
SELECT e.doc_id, sum(least(wanted, coalesce(got, 0)))::BIGINT AS matched, sum(wanted)::BIGINT AS expected FROM e LEFT JOIN a ON e.doc_id = a.doc_id AND e.tok = a.tok GROUP BY e.doc_id""")
def document_digit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a document that its first half holds as often."""
    told = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", told.alias("expected"), F.substring(told, F.lit(1), F.floor(F.length(told) / 2).cast("int")).alias("actual"))
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return evaluation.bag_recall(docs, ["doc_id"], digits("expected"), digits("actual"))


@query()
def misread_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-like words of documents looked for in their lines as misread, every i as l: found by a near window."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    names = F.filter(F.array_distinct(F.split("line", " ")), lambda w: matching.identifier_like(w))
    flat = lines.select("doc_id", "line_no", F.explode(names).alias("name"), text.compact(F.replace("line", F.lit("i"), F.lit("l"))).alias("hay"))
    return flat.select("doc_id", "line_no", "name", matching.near("hay", text.compact(F.col("name"))).alias("found"))


@query()
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", evaluation.similarity(text.dedupe_key(text.folded(F.col("expected"))), text.dedupe_key(text.folded(F.col("actual")))).alias("percent"))


@query()
def fuzzy_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-like words of a turn (with a slash, underscore or dotted suffix) that the next turn nearly contains."""

    @F.pandas_udf("boolean")
    def near(hay: pd.Series, needle: pd.Series) -> pd.Series:
        return pd.Series([evaluation.fuzzy_contains(h, n) for h, n in zip(hay, needle, strict=True)])

    names = F.filter(F.array_distinct(F.split("expected", r"\s+")), lambda w: w.rlike(r"[/_]|\.[a-z]{2,}") & (F.length(w) <= 200))
    flat = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(names).alias("name"), text.compact(F.col("actual")).alias("hay"))
    return flat.select("conv_id", "turn", "name", near("hay", text.compact(F.col("name"))).alias("found"))


@query(r"""WITH p AS (SELECT c.conv_id, c.turn, c.text AS "primary", d.text AS fallback FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1),
t AS (SELECT *, len(regexp_extract_all("primary", '[\p{L}\p{N}_]+')) AS a, len(regexp_extract_all(fallback, '[\p{L}\p{N}_]+')) AS b FROM p)
SELECT conv_id, turn, CASE WHEN b < 8 OR b < greatest(8, (a * 1.2)::DECIMAL(18,1)::DOUBLE) THEN 'primary' WHEN trim("primary") = '' THEN 'fallback' ELSE 'both' END AS chosen FROM t""")
def sparse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two readings of a page is used: the second one needs 8 tokens and 1.2 times the first one's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("primary"))
    other = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("primary").alias("fallback"))
    count = lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))
    few = (count("fallback") < 8) | (10 * count("fallback") < 12 * count("primary"))
    return turns.join(other, ["conv_id", "turn"]).select("conv_id", "turn", F.when(few, "primary").when(F.trim("primary") == "", "fallback").otherwise("both").alias("chosen"))
