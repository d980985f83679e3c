"""Layout queries: words to lines and cells, intervals, boxes, bands, tiles and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import folds, text
from weftline.operators import words
from weftline.plans.registry import query
from weftline.session import table

_WORDS = """
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM l),
e AS (SELECT doc_id, line_no, ws, unnest(range(len(ws))) AS pos FROM c),
w AS (SELECT doc_id, line_no, pos, ws[pos + 1] AS text, CASE WHEN pos > 0 THEN 8 * (length(array_to_string(ws[1:pos], ' ')) + 1) ELSE 0 END AS x1, 20 * line_no AS y1,
  CASE WHEN pos > 0 THEN 8 * (length(array_to_string(ws[1:pos], ' ')) + 1) ELSE 0 END + 8 * length(ws[pos + 1]) AS x2, 20 * line_no + 14 AS y2, (doc_id * 31 + line_no * 7 + pos) % 101 AS conf FROM e)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.words(table(spark, sf_dir, "documents"))


@query(f"WITH {_WORDS} SELECT doc_id, line_no, pos, text, x1, x2, y1, y2 FROM w WHERE (conf >= 40 OR regexp_matches(text, '^[0-9]+[.,]?[0-9]*$')) AND NOT regexp_matches(text, '^[.?\\[\\]]+$')")
def confident_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = words.confident(_words(spark, sf_dir))
    return kept.select("doc_id", "text", *(F.col(c).cast("bigint").alias(c) for c in ("line_no", "pos", "x1", "x2", "y1", "y2")))


@query(f"""WITH {_WORDS}, o AS (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER d) <= 20 THEN 0 ELSE 1 END AS fresh FROM w WHERE conf >= 40 WINDOW d AS (PARTITION BY doc_id ORDER BY y1, x1)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY y1, x1) AS grp FROM o)
SELECT doc_id, grp::BIGINT AS "group", string_agg(text, ' ' ORDER BY y1, x1) AS line FROM g GROUP BY doc_id, grp""")
def word_lines_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.chained_lines(_words(spark, sf_dir).where("conf >= 40"), 20)


@query(f"""WITH {_WORDS} SELECT doc_id, line_no::BIGINT AS line_no, string_agg(text, ' ' ORDER BY x1, text) AS line FROM w WHERE conf >= 40 GROUP BY doc_id, line_no""")
def word_lines_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored grouping of words that lie within 10 units of a line's first word; lines are 20 apart."""
    grouped = _words(spark, sf_dir).where("conf >= 40").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("y1").alias("top"), F.col("x1").alias("left"), "text")).alias("ws"))
    tops = F.array_sort(F.array_distinct(F.transform("ws", lambda w: w["top"])))
    told = grouped.select("doc_id", F.arrays_zip(tops.alias("top"), folds.anchored_groups(F.col("ws")).alias("line")).alias("z"))
    return told.select("doc_id", F.inline("z")).select("doc_id", (F.col("top") / 20).cast("bigint").alias("line_no"), "line")


@query()
def word_lines_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by a moving centre within the cells of a grid of 5 lines."""
    grouped = _words(spark, sf_dir).withColumn("cell", F.floor(F.col("line_no") / 5)).groupBy("doc_id", "cell")
    grouped = grouped.agg(F.collect_list(F.struct(((F.col("y1") + F.col("y2")) / 2).alias("centre"), F.col("x1").alias("left"), "text")).alias("ws"), F.median(F.col("y2") - F.col("y1")).alias("tall"))
    lined = grouped.select("doc_id", "cell", F.inline(folds.midpoint_groups(F.col("ws"), F.greatest(F.lit(4.0), F.floor(F.col("tall") * 0.65)))))
    return lined.groupBy("doc_id", "cell", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ").alias("text"))


_CELLS = f"""{_WORDS}, q AS (SELECT doc_id, text, line_no, x1, x2, (line_no // 2)::BIGINT AS row, greatest(ceil((x1 + x2) / 400) - 1, 0)::BIGINT AS col FROM w)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on a grid of rows of two lines and columns of 200, as many as a document's longest line needs.

    A word lies in the first column that holds its centre, both ends inclusive, so every word has a cell.
    """
    col = F.greatest(F.ceil((F.col("x1") + F.col("x2")) / 400) - 1, F.lit(0)).cast("bigint")
    return _words(spark, sf_dir).withColumn("col", col).withColumn("row", F.floor(F.col("line_no") / 2))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x1", "text"))), lambda w: w["text"]), " ")
    return _placed(spark, sf_dir).groupBy("doc_id", "row", "col").agg(text.cell_text(told).alias("cell"), F.max("x2").alias("reach"))


@query(rf"WITH {_CELLS} SELECT doc_id, row, col, trim(regexp_replace(replace(string_agg(text, ' ' ORDER BY line_no, x1), '|', '\|'), '\s+', ' ', 'g')) AS cell FROM q GROUP BY doc_id, row, col")
def words_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).drop("reach")


@query(rf"WITH {_CELLS} SELECT doc_id, count(DISTINCT CASE WHEN regexp_matches(text, '\S') THEN (row, col) END) AS filled, (ceil(max(x2) / 200) * (max(row) + 1))::BIGINT AS cells FROM q GROUP BY doc_id")
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold something and all cells of each document's grid."""
    cells = _placed(spark, sf_dir).groupBy("doc_id", "row", "col").agg(F.bool_or(F.col("text").rlike(r"\S")).alias("told"), F.max("x2").alias("reach"))
    return cells.groupBy("doc_id").agg(F.count_if("told").alias("filled"), (F.ceil(F.max("reach") / 200) * (F.max("row") + 1)).cast("bigint").alias("cells"))


@query()
def grid_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's cell, and blanks between them, as one Markdown table a document."""
    rows = _cells(spark, sf_dir).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("cells"), F.max("reach").alias("reach"))
    grids = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.ceil(F.max("reach") / 200).cast("bigint").alias("width"))
    blanks = lambda n: F.array_repeat(F.lit(""), n.cast("int"))

    def dense(cells: Column) -> Column:
        after = lambda i: F.coalesce(F.get(cells, i + 1)["col"], F.col("width"))
        told = F.transform(cells, lambda c, i: F.concat(F.array(c["cell"]), blanks(after(i) - c["col"] - 1)))
        return F.concat(blanks(F.get(cells, F.lit(0))["col"]), F.flatten(told))

    return grids.select("doc_id", text.table_markdown(F.transform("rows", lambda r: dense(r["cells"]))).alias("markdown"))


@query(f"""WITH {_WORDS}, r AS (SELECT doc_id, line_no // 2 AS band, x1, x2, max(x2) OVER (PARTITION BY doc_id, line_no // 2 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN x1 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, band ORDER BY x1, x2) AS island FROM r)
SELECT doc_id, band::BIGINT AS band, count(*) AS islands, sum(b - a)::BIGINT AS covered FROM (SELECT doc_id, band, island, min(x1) AS a, max(x2) AS b FROM i GROUP BY doc_id, band, island) x GROUP BY doc_id, band""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the spans of all words in each band of two lines."""
    placed = _words(spark, sf_dir).withColumn("band", F.floor(F.col("line_no") / 2).cast("bigint"))
    merged = words.islands(placed, ["doc_id", "band"], "x1", "x2")
    return merged.groupBy("doc_id", "band").agg(F.count("*").alias("islands"), F.sum(F.col("x2") - F.col("x1")).cast("bigint").alias("covered"))


_BOXES = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 40)::BIGINT AS x1, (l_suppkey % 30)::BIGINT AS y1, (l_partkey % 40 + 10 + l_quantity)::BIGINT AS x2, (l_suppkey % 30 + 20)::BIGINT AS y2 FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    return items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_quantity")).cast("bigint").alias("x2"), (y + 20).alias("y2"))


@query(f"""WITH {_BOXES}, p AS (SELECT a.k, a.n AS na, b.n AS nb, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.k = b.k AND a.n < b.n)
SELECT k, na, nb, i::BIGINT AS shared, (s - i)::BIGINT AS joined FROM p WHERE i > 0 AND i > 0.65 * (s - i)""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of an order that overlap by more than 0.65 of their union."""
    boxes = _boxes(spark, sf_dir)
    a, b = (boxes.select("k", *(F.col(c).alias(f"{c}{s}") for c in ("n", "x1", "y1", "x2", "y2"))) for s in "ab")
    wide = F.greatest(F.lit(0), F.least("x2a", "x2b") - F.greatest("x1a", "x1b"))
    tall = F.greatest(F.lit(0), F.least("y2a", "y2b") - F.greatest("y1a", "y1b"))
    area = lambda s: (F.col(f"x2{s}") - F.col(f"x1{s}")) * (F.col(f"y2{s}") - F.col(f"y1{s}"))
    pairs = a.join(b, "k").where("na < nb").where(words.iou("a", "b") > 0.65)
    return pairs.select("k", "na", "nb", (wide * tall).alias("shared"), (area("a") + area("b") - wide * tall).alias("joined"))


_KEPT = "greatest(0, least(p.x2, v[1].x2) - greatest(p.x1, v[1].x1)) * greatest(0, least(p.y2, v[1].y2) - greatest(p.y1, v[1].y1))"


@query(f"""WITH {_BOXES}, l AS (SELECT k, list_sort(list({{'area': -(x2 - x1) * (y2 - y1), 'y1': y1, 'x1': x1, 'x2': x2, 'y2': y2}})) AS bs FROM b GROUP BY k)
SELECT k, len(list_reduce(list_transform(bs, lambda q: [q]), lambda t, v: CASE WHEN len(list_filter(t, lambda p: ({_KEPT})::DOUBLE / greatest(1, -p.area - v[1].area - ({_KEPT})) > 0.65)) > 0 THEN t ELSE list_concat(t, v) END))::INT AS kept, len(bs) AS boxes FROM l""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("area", -(F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return boxes.groupBy("k").agg(F.size(words.suppress(F.collect_list(F.struct("area", "y1", "x1", "x2", "y2")))).alias("kept"), F.count("*").alias("boxes"))


@query("""SELECT doc_id, i::BIGINT AS start FROM (SELECT doc_id, unnest(CASE WHEN n_chars <= 800 THEN [0] ELSE list_distinct(list_append(range(0, n_chars - 799, 680), n_chars - 800)) END) AS i FROM documents) x""")
def overlapping_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 800 with 120 shared that cover a document to its end."""
    limit = F.col("n_chars") - 800
    starts = F.when(limit <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("bigint"), F.greatest(limit, F.lit(0)), F.lit(680).cast("bigint")), limit)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(starts).alias("start"))


@query("""SELECT doc_id, y AS top, least(y + 1600, n_chars) AS bottom FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars - 120, 1), 1480)) AS y FROM documents WHERE n_chars > 0) x""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1600 with 120 shared, until a chunk would begin in the last 120."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_chars") - 121, F.lit(0)), F.lit(1480).cast("bigint"))
    return docs.select("doc_id", "n_chars", F.explode(starts).alias("top")).select("doc_id", "top", F.least(F.col("top") + 1600, "n_chars").alias("bottom"))


@query("""WITH d AS (SELECT doc_id, 300 + doc_id % 700 AS w, n_chars * 4 AS h FROM documents), p AS (SELECT *, least(4200, 14000000 // w) AS tile FROM d WHERE h >= 4 * w)
SELECT doc_id, y AS source_y, least(tile, h - y)::BIGINT AS source_height FROM (SELECT *, unnest(range(0, greatest(h - 128, 1), tile - 128)) AS y FROM p) x
UNION ALL SELECT doc_id, 0, h FROM d WHERE h < 4 * w""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of tall images: 128 rows shared, at most 4200 rows and 14 million pixels each; others are one tile."""
    images = table(spark, sf_dir, "documents").select("doc_id", (300 + F.col("doc_id") % 700).alias("w"), (F.col("n_chars") * 4).alias("h"))
    tile = F.least(F.lit(4200), F.floor(14_000_000 / F.col("w")))
    starts = F.when(F.col("h") >= 4 * F.col("w"), F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("h") - 129, F.lit(0)), tile - 128)).otherwise(F.array(F.lit(0).cast("bigint")))
    tall = F.when(F.col("h") >= 4 * F.col("w"), F.least(tile, F.col("h") - F.col("source_y"))).otherwise(F.col("h"))
    return images.select("doc_id", "w", "h", F.explode(starts).alias("source_y")).select("doc_id", "source_y", tall.alias("source_height"))


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as grey rows: block, y in the block, x, value 0 to 255."""
    grey = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255))).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("block"), (F.col("vec_id") % 64).alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("block", "y", "x", grey(F.col("v")).alias("value"))


_RASTER = "r AS (SELECT vec_id // 64 AS block, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 255)))::INT AS value FROM embeddings)"


@query(f"WITH {_RASTER} SELECT block, y, count(*) FILTER (value < 128) AS dark, count(*) AS pixels FROM r GROUP BY block, y")
def row_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir).groupBy("block", "y").agg(F.count_if(F.col("value") < 128).alias("dark"), F.count("*").alias("pixels"))


@query(f"WITH {_RASTER} SELECT block, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS dark FROM r WHERE value < 60 GROUP BY block")
def content_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = _raster(spark, sf_dir).where("value < 60").groupBy("block")
    return dark.agg(F.min("x").cast("bigint").alias("x1"), F.min("y").alias("y1"), F.max("x").cast("bigint").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("dark"))


@query(f"""WITH {_RASTER}, h AS (SELECT block, value, count(*) AS n FROM r GROUP BY block, value),
c AS (SELECT block, value, sum(n) OVER w AS below, sum(n * value) OVER w AS mass, sum(n) OVER (PARTITION BY block) AS total, sum(n * value) OVER (PARTITION BY block) AS whole FROM h WINDOW w AS (PARTITION BY block ORDER BY value)),
s AS (SELECT block, value, power((whole / total) * (below / total) - mass / total, 2) / ((below / total) * (1 - below / total)) AS between_class FROM c WHERE below < total)
SELECT block, arg_max(value, (round(between_class, 6), -value))::BIGINT AS threshold FROM s GROUP BY block""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grey value with the largest between-class variance, the lower of equals; a raster of one value has none."""
    hist = _raster(spark, sf_dir).groupBy("block", "value").agg(F.count("*").alias("n"))
    order, whole = Window.partitionBy("block").orderBy("value"), Window.partitionBy("block")
    sums = hist.select("block", "value", F.sum("n").over(order).alias("below"), F.sum(F.col("n") * F.col("value")).over(order).alias("mass"), F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("value")).over(whole).alias("whole"))
    share = F.col("below") / F.col("total")
    between = F.pow(F.col("whole") / F.col("total") * share - F.col("mass") / F.col("total"), 2) / (share * (1 - share))
    best = sums.where("below < total").groupBy("block").agg(F.max_by("value", F.struct(F.round(between, 6), -F.col("value"))).alias("threshold"))
    return best.select("block", F.col("threshold").cast("bigint").alias("threshold"))


@query(f"""WITH {_RASTER}, p AS (SELECT block, y, count(*) FILTER (value < 100) AS ink FROM r GROUP BY block, y), q AS (SELECT block, y, y - row_number() OVER (PARTITION BY block ORDER BY y) AS run FROM p WHERE ink < 20)
SELECT block, min(y) AS start, max(y) + 1 AS "end" FROM q GROUP BY block, run HAVING count(*) >= 2""")
def blank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more rows with little ink."""
    rows = _raster(spark, sf_dir).groupBy("block", "y").agg(F.count_if(F.col("value") < 100).alias("ink")).where("ink < 20")
    runs = rows.withColumn("run", F.col("y") - F.row_number().over(Window.partitionBy("block").orderBy("y")))
    return runs.groupBy("block", "run").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("end"), F.count("*").alias("n")).where("n >= 2").select("block", "start", "end")


@query()
def band_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters split at their blank bands into chunks of 12 or more rows."""
    bands = blank_bands(spark, sf_dir).groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("bands"))
    return bands.select("block", F.inline(folds.split_by_bands(F.col("bands"), F.lit(64), 12)))


@query(f"""WITH RECURSIVE {_BOXES}, e AS (SELECT DISTINCT k, greatest(0, least(100, x2)) AS x FROM b UNION SELECT DISTINCT k, 100 FROM b), o AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM e WHERE x > 0),
r AS (SELECT k, i, 0::BIGINT AS segment, 0::BIGINT AS s, x AS t FROM o WHERE i = 1 UNION ALL SELECT r.k, o.i, CASE WHEN o.x - r.s <= 60 THEN r.segment ELSE r.segment + 1 END, CASE WHEN o.x - r.s <= 60 THEN r.s ELSE r.t END, o.x FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT k, segment, min(s) AS "start", max(t) AS "end" FROM r GROUP BY k, segment""")
def grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid lines of an order packed into segments of at most 60."""
    lines = _boxes(spark, sf_dir).groupBy("k").agg(F.collect_list(F.col("x2").cast("int")).alias("xs"))
    return lines.select("k", F.posexplode(folds.bounded_segments(F.col("xs"), F.lit(100), 60)).alias("segment", "span")).select("k", "segment", "span.start", "span.end")


@query()
def separator_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _boxes(spark, sf_dir).groupBy("k").agg(F.collect_list(F.col("x1").cast("int")).alias("xs"))
    return lines.select("k", F.posexplode(folds.mean_clusters(F.col("xs"), 4)).alias("cluster", "xs"))


@query(f"""WITH {_BOXES}, g AS (SELECT k, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY k ORDER BY x1, n) <= 5 THEN 0 ELSE 1 END AS fresh, n FROM b),
i AS (SELECT k, x1, sum(fresh) OVER (PARTITION BY k ORDER BY x1, n ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT k, grp::BIGINT AS "group", round_even(avg(x1), 0)::BIGINT AS position, count(*) AS members FROM i GROUP BY k, grp""")
def merged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions chained within 5 as one at their mean, halves to even.

    Boxes that agree in x1 and n have no order, and none is needed: the sum's frame is by range, so all of them lie in
    the group of the first. A frame by rows, as in the SQL, may put one that follows before the one that opens the group.
    """
    order = Window.partitionBy("k").orderBy("x1", "n")
    boxes = _boxes(spark, sf_dir).withColumn("fresh", F.when(F.col("x1") - F.lag("x1").over(order) <= 5, 0).otherwise(1))
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return boxes.withColumn("group", F.sum("fresh").over(so_far)).groupBy("k", "group").agg(F.bround(F.avg("x1"), 0).cast("bigint").alias("position"), F.count("*").alias("members"))


@query(f"""WITH {_BOXES} SELECT k, round(quantile_cont(x2, 0.9), 6) AS linear, list_sort(list(x2))[floor((count(*) - 1) * 0.9)::INT + 1] AS nearest, median(x2 - x1) AS middle FROM b GROUP BY k""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two quantile rules, linear and floor index, and a median of widths."""
    nearest = F.element_at(F.array_sort(F.collect_list("x2")), (F.floor((F.count("*") - 1) * 0.9) + 1).cast("int"))
    return _boxes(spark, sf_dir).groupBy("k").agg(F.round(F.percentile("x2", F.lit(0.9)), 6).alias("linear"), nearest.alias("nearest"), F.median(F.col("x2") - F.col("x1")).alias("middle"))


_INDEXES = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '' ELSE 'B1.' || lpad(l_linenumber::VARCHAR, 2, '0') END AS idx FROM lineitem)"""


@query(f"""WITH {_INDEXES}, s AS (SELECT k, n, idx, nullif(regexp_extract(idx, '\\.([0-9]+)$', 1), '')::INT AS num FROM x),
b AS (SELECT *, last_value(num IGNORE NULLS) OVER w AS pn, last_value(CASE WHEN num IS NOT NULL THEN n END IGNORE NULLS) OVER w AS pr, first_value(num IGNORE NULLS) OVER v AS nn, first_value(CASE WHEN num IS NOT NULL THEN n END IGNORE NULLS) OVER v AS nr FROM s
  WINDOW w AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY k ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT k, n, CASE WHEN idx = '' AND nn - pn = nr - pr THEN 'B1.' || lpad((pn + n - pr)::VARCHAR, 2, '0') ELSE idx END AS idx FROM b""")
def gap_filled_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank numbers between two that are as far apart as their rows are filled in."""
    items = table(spark, sf_dir, "lineitem")
    idx = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, "").otherwise(F.concat(F.lit("B1."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")))
    rows = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), idx.alias("idx"))
    rows = rows.withColumn("at", F.when(F.col("idx") != "", F.struct(F.regexp_extract("idx", r"\.([0-9]+)$", 1).cast("int").alias("num"), F.col("n").alias("row"))))
    order = Window.partitionBy("k").orderBy("n")
    before = F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("at", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after)
    fits = (F.col("idx") == "") & (F.col("after.num") - F.col("before.num") == F.col("after.row") - F.col("before.row"))
    filled = F.concat(F.lit("B1."), F.lpad((F.col("before.num") + F.col("n") - F.col("before.row")).cast("string"), 2, "0"))
    return rows.select("k", "n", F.when(fits, filled).otherwise(F.col("idx")).alias("idx"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS col FROM lineitem), g AS (SELECT *, sum((n % 3 <> 0)::INT) OVER (PARTITION BY l_orderkey ORDER BY col) AS head FROM c)
SELECT l_orderkey, min(n) FILTER (n % 3 <> 0)::VARCHAR AS text, min(col)::INT AS col, count(*)::INT AS colspan FROM g WHERE head > 0 GROUP BY l_orderkey, head""")
def merged_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column spans of rows in which every third cell continues the one to its left."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.when(n % 3 == 0, "::merge-left::").otherwise(n.cast("string"))).alias("row"))
    return rows.select("l_orderkey", F.inline(folds.merged_cells(F.col("row"))))


@query("""SELECT p_partkey, CASE WHEN m * 300 / 72 <= 6000 THEN 300 ELSE greatest(10, floor(300 * 6000 / (m * 300 / 72)))::BIGINT END AS dpi FROM (SELECT p_partkey, greatest(p_size * 40, p_retailprice::BIGINT)::DOUBLE AS m FROM part) x""")
def render_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of pages given as 'w x h pts' so that no side passes 6000 pixels."""
    size = F.concat((F.col("p_size") * 40).cast("string"), F.lit(" x "), F.bround("p_retailprice").cast("bigint").cast("string"), F.lit(" pts"))
    side = lambda k: F.regexp_extract("size", r"([0-9.]+)\s+x\s+([0-9.]+)\s+pts", k).cast("double")
    projected = F.greatest(side(1), side(2)) * 300 / 72
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", F.when(projected <= 6000, F.lit(300)).otherwise(F.greatest(F.lit(10), F.floor(300 * 6000 / projected))).cast("bigint").alias("dpi"))


@query("""SELECT p_partkey, CASE WHEN w BETWEEN 1300 AND 1900 AND h BETWEEN 1800 AND 2600 AND h * 10 >= 12 * w AND h * 10 <= 17 * w THEN 3 WHEN w >= 2200 AND h >= 1500 AND h * 10 <= 9 * w THEN CASE WHEN ink >= 5 THEN 11 ELSE 3 END WHEN w >= 1600 AND h >= 1000 THEN 3 ELSE 6 END::BIGINT AS psm
FROM (SELECT p_partkey, 1000 + p_partkey * 37 % 2000 AS w, 800 + p_partkey * 53 % 2200 AS h, p_size % 10 AS ink FROM part) x""")
def segmentation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing of page images by size, aspect and ink."""
    pages = table(spark, sf_dir, "part").select("p_partkey", (1000 + F.col("p_partkey") * 37 % 2000).alias("w"), (800 + F.col("p_partkey") * 53 % 2200).alias("h"), (F.col("p_size") % 10).alias("ink"))
    w, h = F.col("w"), F.col("h")
    portrait = w.between(1300, 1900) & h.between(1800, 2600) & (h * 10 >= w * 12) & (h * 10 <= w * 17)
    wide = (w >= 2200) & (h >= 1500) & (h * 10 <= w * 9)
    return pages.select("p_partkey", F.when(portrait, 3).when(wide, F.when(F.col("ink") >= 5, 11).otherwise(3)).when((w >= 1600) & (h >= 1000), 3).otherwise(6).cast("bigint").alias("psm"))
