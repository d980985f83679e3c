"""Words with boxes: the token table that stands in for a recogniser's output, and what is built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def words(docs: DataFrame) -> DataFrame:
    """Tokens of each line with a box of 8 units a character and 14 of height, lines 20 apart, and a confidence.

    Texts are dealt by document before they are taken apart, so windows and groups by document, or by document and
    line, need no further exchange of the many words.
    """
    flat = lines(docs.select("doc_id", "text").repartition("doc_id")).select("doc_id", "line_no", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("pos", "text"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(8 * (F.length("text") + 1)).over(before), F.lit(0)).cast("int")
    conf = (F.col("doc_id") * 31 + F.col("line_no") * 7 + F.col("pos")) % 101
    placed = flat.withColumn("x1", left)
    return placed.select("doc_id", "line_no", "pos", "text", "x1", (20 * F.col("line_no")).alias("y1"), (F.col("x1") + 8 * F.length("text")).alias("x2"), (20 * F.col("line_no") + 14).alias("y2"), conf.cast("double").alias("conf"))


def confident(tokens: DataFrame, least: float = 40, exempt_numbers: bool = True, drop_noise: bool = True) -> DataFrame:
    """Tokens that pass the confidence filter: numbers need none, -1 and pure punctuation noise go."""
    number = F.col("text").rlike(r"^[0-9]+[.,]?[0-9]*$") if exempt_numbers else F.lit(False)
    good = (F.trim("text") != "") & (F.col("conf") != -1) & ((F.col("conf") >= least) | number)
    return tokens.where(good & ~F.col("text").rlike(r"^[.?\[\]]+$") if drop_noise else good)


def chained_lines(tokens: DataFrame, gap: float) -> DataFrame:
    """Lines of each document by chained centres: a new line where a centre is over `gap` from the one before it."""
    centre = (F.col("y1") + F.col("y2")) / 2
    order = Window.partitionBy("doc_id").orderBy("y1", "x1")
    fresh = F.when(F.abs(F.col("centre") - F.lag("centre").over(order)) <= gap, 0).otherwise(1)
    numbered = tokens.withColumn("centre", centre).withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "text"))), lambda w: w["text"]), " ")
    return numbered.groupBy("doc_id", "group").agg(text.alias("line"))


def interval_index(position: Column, edges: Column) -> Column:
    """Index of the first interval between sorted edges that holds a position, both ends inclusive; NULL outside."""
    spans = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.struct(k.alias("k"), F.element_at(edges, k).alias("lo"), F.element_at(edges, k + 1).alias("hi")))
    inside = F.filter(spans, lambda s: (s["lo"] <= position) & (position <= s["hi"]))
    return F.when(F.size(inside) > 0, F.element_at(inside, 1)["k"] - 1)


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Union of intervals: rows of each key whose intervals overlap or lie at most `gap` apart become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("reach", reach).withColumn("fresh", F.when(F.col(start) <= F.col("reach") + gap, 0).otherwise(1))
    return marked.withColumn("island", F.sum("fresh").over(order)).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns carry the suffixes a and b."""
    c = F.col
    wide = F.greatest(F.lit(0), F.least(c(f"x2{a}"), c(f"x2{b}")) - F.greatest(c(f"x1{a}"), c(f"x1{b}")))
    tall = F.greatest(F.lit(0), F.least(c(f"y2{a}"), c(f"y2{b}")) - F.greatest(c(f"y1{a}"), c(f"y1{b}")))
    area = lambda s: (c(f"x2{s}") - c(f"x1{s}")) * (c(f"y2{s}") - c(f"y1{s}"))
    return F.when(wide * tall > 0, wide * tall / (area(a) + area(b) - wide * tall)).otherwise(F.lit(0.0))


def suppress(boxes: Column, limit: float = 0.65) -> Column:
    """Greedy suppression as a fold: largest box first, then top-most; a box over `limit` with a kept one goes.

    `boxes` is array<struct<area, y1, x1, x2, y2>> with area negated, so that its natural order is the greedy one.
    """

    def overlap(p: Column, q: Column) -> Column:
        wide = F.greatest(F.lit(0), F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"]))
        tall = F.greatest(F.lit(0), F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"]))
        return wide * tall / F.greatest(F.lit(1), -p["area"] - q["area"] - wide * tall)

    ordered = F.array_sort(boxes)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, box: F.when(F.exists(kept, lambda k: overlap(k, box) > limit), kept).otherwise(F.array_append(kept, box)))
