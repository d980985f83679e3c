"""Table and page recovery: cells, logical columns, regions around tables, cuts, page shapes, word filters, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import words
from weftline.plans.layout import _WORDS, _words
from weftline.plans.registry import query
from weftline.session import table

_LINES = "i AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 300)::BIGINT AS x, (l_suppkey * 7 % 200)::BIGINT AS y, l_quantity AS q FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order stand for the ruled lines of a table: x and y positions, a coverage of 2 to 100 per cent."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 300).cast("bigint").alias("x"), (F.col("l_suppkey") * 7 % 200).cast("bigint").alias("y"), F.col("l_quantity").alias("q"))


def pairs(edges: Column) -> Column:
    """Neighbouring values of a sorted array as structs (nth, lo, hi)."""
    return F.transform(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda lo, nth: F.struct(nth.cast("bigint").alias("nth"), lo.alias("lo"), F.get(edges, nth + 1).alias("hi")))


def cells(x_lines: Column, y_lines: Column, least: int = 8) -> Column:
    """Cells between neighbouring lines, row by row; those under `least` wide or high are left out."""
    wide = F.filter(pairs(x_lines), lambda p: p["hi"] - p["lo"] >= least)
    tall = F.filter(pairs(y_lines), lambda p: p["hi"] - p["lo"] >= least)
    return F.flatten(F.transform(tall, lambda r: F.transform(wide, lambda c: F.struct(r["nth"].alias("row"), c["nth"].alias("col"), c["lo"].alias("x1"), r["lo"].alias("y1"), c["hi"].alias("x2"), r["hi"].alias("y2")))))


@query(f"""WITH {_LINES}, xs AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS x2, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS col FROM (SELECT DISTINCT k, x FROM i) a),
ys AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) AS y2, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS row FROM (SELECT DISTINCT k, y FROM i) a)
SELECT xs.k, row, col, x AS x1, y AS y1, x2, y2 FROM xs JOIN ys ON xs.k = ys.k WHERE x2 - x >= 8 AND y2 - y >= 8""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid that an order's lines make."""
    grids = _lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"))
    return grids.select("k", F.inline(cells(F.col("xs"), F.col("ys"))))


def spaced(positions: Column, first: Column, least: Column | int) -> Column:
    """`first` and every position that lies `least` or more after the one taken before it, as a fold."""
    return F.aggregate(positions, F.array(first), lambda taken, p: F.when(p - F.element_at(taken, -1) >= least, F.array_append(taken, p)).otherwise(taken))


@query(f"""WITH {_LINES}, m AS (SELECT k, x, max(q) AS q FROM i GROUP BY k, x), o AS (SELECT k, x, CASE WHEN x - lag(x) OVER (PARTITION BY k ORDER BY x) <= 8 THEN 0 ELSE 1 END AS fresh FROM m WHERE q >= 36),
g AS (SELECT k, x, sum(fresh) OVER (PARTITION BY k ORDER BY x) AS grp FROM o), p AS (SELECT k, round_even(avg(x), 0)::BIGINT AS x FROM g GROUP BY k, grp),
l AS (SELECT k, list(x ORDER BY x) AS xs FROM p GROUP BY k), a AS (SELECT k, count(*) AS lines FROM m GROUP BY k),
f AS (SELECT l.k, lines, list_reduce(list_concat([[0::BIGINT]], list_transform(xs, lambda v: [v])), lambda t, v: CASE WHEN v[1] - t[-1] >= 20 THEN list_concat(t, v) ELSE t END) AS taken FROM l JOIN a ON l.k = a.k),
e AS (SELECT k, lines, CASE WHEN 299 - taken[-1] >= 20 THEN list_append(taken, 299) ELSE taken END AS cols FROM f)
SELECT k, array_to_string(cols, ' ') AS columns FROM e WHERE len(cols) >= 3 AND len(cols) < lines + 2""")
def logical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns between separators that span 0.72 of a table's height, merged within 8, at least 20 apart, and its edges."""
    marks = _lines(spark, sf_dir).groupBy("k", "x").agg(F.max("q").alias("q"))
    order = Window.partitionBy("k").orderBy("x")
    major = marks.where("q >= 36").withColumn("fresh", F.when(F.col("x") - F.lag("x").over(order) <= 8, 0).otherwise(1)).withColumn("group", F.sum("fresh").over(order))
    merged = major.groupBy("k", "group").agg(F.bround(F.avg("x"), 0).cast("bigint").alias("x"))
    lists = merged.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(marks.groupBy("k").agg(F.count("*").alias("lines")), "k")
    taken = lists.withColumn("taken", spaced(F.col("xs"), F.lit(0).cast("bigint"), 20))
    columns = F.when(299 - F.element_at("taken", -1) >= 20, F.array_append("taken", F.lit(299).cast("bigint"))).otherwise(F.col("taken"))
    found = taken.withColumn("cols", columns).where((F.size("cols") >= 3) & (F.size("cols") < F.col("lines") + 2))
    return found.select("k", F.array_join(F.transform("cols", lambda c: c.cast("string")), " ").alias("columns"))


_TABLES = "t AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 300)::BIGINT AS x1, (l_suppkey * 13 % 900)::BIGINT AS y1, (l_partkey % 300 + 40 + l_quantity)::BIGINT AS x2, (l_suppkey * 13 % 900 + 30 + l_quantity * 2)::BIGINT AS y2 FROM lineitem)"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the tables on a page, which an order stands for, 400 wide and 1100 high."""
    x, y, q = F.col("l_partkey") % 300, F.col("l_suppkey") * 13 % 900, F.col("l_quantity").cast("bigint")
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x1"), y.alias("y1"), (x + 40 + q).alias("x2"), (y + 30 + 2 * q).alias("y2"))


@query(f"""WITH {_TABLES}, c AS (SELECT *, coalesce(max(y2) OVER (PARTITION BY k ORDER BY y1, x1, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM t), e AS (SELECT k, max(y2) AS cur FROM t GROUP BY k)
SELECT k, 'text' AS kind, cur AS top, y1 AS bottom FROM c WHERE y1 - cur > 40 UNION ALL SELECT k, 'table', y1, y2 FROM c UNION ALL SELECT k, 'text', cur, 1100 FROM e WHERE 1100 - cur > 40""")
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a page from the top, and the text above, between and below them where it is over 40 high."""
    boxes = _tables(spark, sf_dir)
    before = Window.partitionBy("k").orderBy("y1", "x1", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = boxes.withColumn("cur", F.coalesce(F.max("y2").over(before), F.lit(0).cast("bigint")))
    gap = lambda kind, top, bottom: F.struct(F.lit(kind).alias("kind"), top.cast("bigint").alias("top"), bottom.cast("bigint").alias("bottom"))
    inner = placed.select("k", F.inline(F.array_compact(F.array(F.when(F.col("y1") - F.col("cur") > 40, gap("text", F.col("cur"), F.col("y1"))), gap("table", F.col("y1"), F.col("y2"))))))
    tail = boxes.groupBy("k").agg(F.max("y2").alias("cur")).where("1100 - cur > 40").select("k", F.lit("text").alias("kind"), F.col("cur").alias("top"), F.lit(1100).cast("bigint").alias("bottom"))
    return inner.unionByName(tail)


@query(f"""WITH {_TABLES}, b AS (SELECT k, y AS top, lead(y) OVER (PARTITION BY k ORDER BY y) AS bottom FROM (SELECT k, y1 AS y FROM t UNION SELECT k, y2 FROM t UNION SELECT DISTINCT k, 0 FROM t UNION SELECT DISTINCT k, 1100 FROM t) u),
a AS (SELECT b.k, top, bottom, n, x1, x2 FROM b LEFT JOIN t ON t.k = b.k AND t.y1 <= top AND t.y2 >= bottom WHERE bottom IS NOT NULL),
c AS (SELECT *, coalesce(max(x2) OVER (PARTITION BY k, top ORDER BY x1, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a)
SELECT k, top, bottom, count(n) AS active, (coalesce(sum(greatest(0, x1 - cur)), 0) + greatest(0, 400 - coalesce(max(x2), 0)))::BIGINT AS free FROM c GROUP BY k, top, bottom""")
def bands_around_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between the edges of tables: how many tables cross each, and the width that none of them takes."""
    boxes = _tables(spark, sf_dir)
    page = boxes.groupBy("k").agg(F.array_sort(F.array_union(F.array_union(F.collect_set("y1"), F.collect_set("y2")), F.array(F.lit(0).cast("bigint"), F.lit(1100).cast("bigint")))).alias("ys"), F.collect_list(F.struct("x1", "n", "x2", "y1", "y2")).alias("tables"))
    bands = page.select("k", "tables", F.inline(pairs(F.col("ys")))).select("k", F.col("lo").alias("top"), F.col("hi").alias("bottom"), F.array_sort(F.filter("tables", lambda t: (t["y1"] <= F.col("lo")) & (t["y2"] >= F.col("hi")))).alias("active"))
    start = F.struct(F.lit(0).cast("bigint").alias("cur"), F.lit(0).cast("bigint").alias("free"))
    swept = F.aggregate("active", start, lambda s, t: F.struct(F.greatest(s["cur"], t["x2"]).alias("cur"), (s["free"] + F.greatest(F.lit(0), t["x1"] - s["cur"])).alias("free")))
    done = bands.withColumn("swept", swept)
    return done.select("k", "top", "bottom", F.size("active").cast("bigint").alias("active"), (F.col("swept.free") + F.greatest(F.lit(0), 400 - F.col("swept.cur"))).alias("free"))


@query(f"""WITH {_LINES}, s AS (SELECT k, n, x AS center, (y % 40)::DOUBLE AS gap, q / 50.0::DOUBLE AS coverage FROM i), c AS (SELECT k, n, x - 60 AS l, x + 60 + (y % 100) AS r FROM i WHERE n % 3 = 0),
g AS (SELECT *, max(gap * coverage) OVER (PARTITION BY k) AS best FROM s WHERE coverage >= 0.5 AND gap >= 8),
h AS (SELECT DISTINCT k, center FROM g WHERE gap * coverage >= 0.65::DOUBLE * best AND NOT EXISTS (SELECT 1 FROM c WHERE c.k = g.k AND c.l < g.center AND g.center < c.r AND c.r - c.l >= 105)),
l AS (SELECT k, list(center ORDER BY center) AS cs FROM h WHERE 300 - center >= 30 GROUP BY k)
SELECT k, array_to_string(list_reduce(list_concat([[0::BIGINT]], list_transform(cs, lambda v: [v])), lambda t, v: CASE WHEN v[1] - t[-1] >= 30 THEN list_concat(t, v) ELSE t END)[2:], ' ') AS cuts FROM l""")
def vertical_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of a page into columns: wide gaps that cover half the band, nearly as strong as the best, that cross no component
    over 0.35 of the page's width, and leave columns of 30 or more."""
    items = _lines(spark, sf_dir)
    gaps = items.select("k", F.col("x").alias("center"), (F.col("y") % 40).cast("double").alias("gap"), (F.col("q") / 50).alias("coverage")).where("coverage >= 0.5 AND gap >= 8")
    strong = gaps.withColumn("best", F.max(F.col("gap") * F.col("coverage")).over(Window.partitionBy("k"))).where(F.col("gap") * F.col("coverage") >= 0.65 * F.col("best"))
    wide = items.where("n % 3 = 0").select("k", (F.col("x") - 60).alias("l"), (F.col("x") + 60 + F.col("y") % 100).alias("r")).where("r - l >= 105")
    kept = strong.join(wide, (strong["k"] == wide["k"]) & (wide["l"] < strong["center"]) & (strong["center"] < wide["r"]), "left_anti")
    lists = kept.where("300 - center >= 30").groupBy("k").agg(F.array_sort(F.collect_set("center")).alias("cs"))
    cuts = F.slice(spaced(F.col("cs"), F.lit(0).cast("bigint"), 30), 2, F.size("cs") + 1)
    return lists.select("k", F.array_join(F.transform(cuts, lambda c: c.cast("string")), " ").alias("cuts"))


@query("""WITH s AS (SELECT p_partkey, 400 + p_partkey * 37 % 3200 AS w, 300 + p_partkey * 91 % 9000 AS h, p_partkey % 23 / 100.0::DOUBLE AS top, p_partkey % 19 / 100.0::DOUBLE AS bottom, p_partkey % 17 / 100.0::DOUBLE AS lft, p_partkey % 13 / 100.0::DOUBLE AS rgt,
  p_partkey % 95 / 100.0::DOUBLE AS ink, p_partkey % 37 AS hl, p_partkey % 11 AS vl, p_partkey % 20 / 100.0::DOUBLE AS fg FROM part)
SELECT p_partkey, w BETWEEN 1800 AND 2200 AND h BETWEEN 1000 AND 1400 AND h::DOUBLE / w BETWEEN 0.5 AND 0.75 AS projector, w >= 1200 AND h >= 600 AND h::DOUBLE / w BETWEEN 0.25 AND 1.0 AND top BETWEEN 0.02 AND 0.20 AND bottom BETWEEN 0.02 AND 0.20 AND lft >= 0.10 AND rgt >= 0.10 AND ink <= 0.80 AS edge_word,
  w >= 1800 AND h >= 1200 AND h::DOUBLE / w <= 1.6 AND hl >= 8 AND (vl >= 8 OR fg <= 0.08 OR hl >= 30) AS dense_grid, h >= 6000 AND h::DOUBLE / w >= 8 AS long_screenshot FROM s""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page looks like by its size, the ink on its edges and its ruled lines."""
    key = F.col("p_partkey")
    share = lambda n: key % n / 100
    size = table(spark, sf_dir, "part").select("p_partkey", (400 + key * 37 % 3200).alias("w"), (300 + key * 91 % 9000).alias("h"))
    aspect, w, h = F.col("h") / F.col("w"), F.col("w"), F.col("h")
    projector = w.between(1800, 2200) & h.between(1000, 1400) & aspect.between(0.5, 0.75)
    edge = (w >= 1200) & (h >= 600) & aspect.between(0.25, 1.0) & share(23).between(0.02, 0.20) & share(19).between(0.02, 0.20) & (share(17) >= 0.10) & (share(13) >= 0.10) & (share(95) <= 0.80)
    grid = (w >= 1800) & (h >= 1200) & (aspect <= 1.6) & (key % 37 >= 8) & ((key % 11 >= 8) | (share(20) <= 0.08) | (key % 37 >= 30))
    return size.select("p_partkey", projector.alias("projector"), edge.alias("edge_word"), grid.alias("dense_grid"), ((h >= 6000) & (aspect >= 8)).alias("long_screenshot"))


@query("""WITH s AS (SELECT p_partkey, 300 + p_partkey * 17 % 900 AS w, 1000 + p_partkey * 29 % 6000 AS h, 1 + p_partkey % 60 AS rows, 1 + p_partkey % 35 AS cols, CASE p_partkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'wide' ELSE 'plain' END AS profile FROM part),
p AS (SELECT * FROM (VALUES ('standard', 10, 8, 14), ('wide', 10, 8, 30)) v(profile, least_rows, least_cols, most_cols))
SELECT p_partkey, h >= 4000 AND h::DOUBLE / w >= 4 AND rows * cols > 500 AS segmented, coalesce(rows >= least_rows AND cols BETWEEN least_cols AND most_cols, FALSE) AS raw_text FROM s LEFT JOIN p ON s.profile = p.profile""")
def table_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table is read in segments, and whether raw text follows it, by the limits of its profile (three rows)."""
    key = F.col("p_partkey")
    profile = F.when(key % 3 == 0, "standard").when(key % 3 == 1, "wide").otherwise("plain")
    sized = table(spark, sf_dir, "part").select("p_partkey", (300 + key * 17 % 900).alias("w"), (1000 + key * 29 % 6000).alias("h"), (1 + key % 60).alias("rows"), (1 + key % 35).alias("cols"), profile.alias("profile"))
    limits = spark.createDataFrame([("standard", 10, 8, 14), ("wide", 10, 8, 30)], "profile string, least_rows int, least_cols int, most_cols int")
    joined = sized.join(F.broadcast(limits), "profile", "left")
    raw = F.coalesce((F.col("rows") >= F.col("least_rows")) & F.col("cols").between(F.col("least_cols"), F.col("most_cols")), F.lit(False))
    return joined.select("p_partkey", ((F.col("h") >= 4000) & (F.col("h") / F.col("w") >= 4) & (F.col("rows") * F.col("cols") > 500)).alias("segmented"), raw.alias("raw_text"))


@query(f"WITH {_WORDS} SELECT doc_id, line_no, pos, text, x1, x2, y1, y2 FROM w WHERE x2 > x1 AND y2 > y1 AND conf <> -1 AND (conf >= 20 OR regexp_matches(text, '^[0-9]+[.,]?[0-9]*$'))")
def table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for tables: a confidence of 20 or a number, with a box; punctuation stays."""
    kept = words.confident(_words(spark, sf_dir), 20, drop_noise=False).where("x2 > x1 AND y2 > y1")
    return kept.select("doc_id", "text", *(F.col(c).cast("bigint").alias(c) for c in ("line_no", "pos", "x1", "x2", "y1", "y2")))


@query(f"WITH {_LINES} SELECT k, n, least(x, x + 3) AS x1, y - 2 AS y1, x + 40 AS x2, y + 12 AS y2 FROM i WHERE q / 50.0 >= CASE k % 2 WHEN 0 THEN 0.4 ELSE 0.3 END")
def recognised_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised corners as upright boxes; a confidence of 0.4 counts, of 0.3 on receipts."""
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    quads = _lines(spark, sf_dir).withColumn("quad", F.array(point(0, 0), point(40, -2), point(37, 12), point(3, 10))).where(F.col("q") >= F.when(F.col("k") % 2 == 0, 20).otherwise(15))
    side = lambda name: F.transform("quad", lambda p: p[name])
    return quads.select("k", "n", F.array_min(side("x")).alias("x1"), F.array_min(side("y")).alias("y1"), F.array_max(side("x")).alias("x2"), F.array_max(side("y")).alias("y2"))


@query(f"""WITH {_LINES}, d AS (SELECT DISTINCT k, y FROM i), f AS (SELECT *, y - lag(y) OVER (PARTITION BY k ORDER BY y) AS step FROM d)
SELECT k, 1 + count(*) FILTER (step > 3) AS lines, 1 + count(*) FILTER (step > 2) AS groups FROM f GROUP BY k""")
def ruled_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a projection: indexes more than 3 apart are other lines, and groups of indexes at most 2 apart."""
    rows = _lines(spark, sf_dir).select("k", "y").distinct().withColumn("step", F.col("y") - F.lag("y").over(Window.partitionBy("k").orderBy("y")))
    return rows.groupBy("k").agg((1 + F.count_if(F.col("step") > 3)).alias("lines"), (1 + F.count_if(F.col("step") > 2)).alias("groups"))


@query(f"""WITH {_WORDS}, b AS (SELECT doc_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum((x2 - x1) * (y2 - y1)) AS ink FROM w WHERE conf >= 50 GROUP BY doc_id), p AS (SELECT doc_id, max(x2) + 50 AS wide, max(y2) + 60 AS tall FROM w GROUP BY doc_id)
SELECT p.doc_id, greatest(0, coalesce(x1 - 10, 0))::BIGINT AS x1, greatest(0, coalesce(y1 - 10, 0))::BIGINT AS y1, least(wide, coalesce(x2 + 10, wide))::BIGINT AS x2, least(tall, coalesce(y2 + 10, tall))::BIGINT AS y2, coalesce(10000 * ink > 5 * wide * tall, FALSE) AS visible
FROM p LEFT JOIN b ON p.doc_id = b.doc_id""")
def content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of a page with 10 around it, kept within the page, the whole page where there is none; and whether any ink shows."""
    page, dark = _words(spark, sf_dir), F.col("conf") >= 50
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("bigint")
    found = page.groupBy("doc_id").agg(*(f(F.when(dark, F.col(c))).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))), F.sum(F.when(dark, area)).alias("ink"), (F.max("x2") + 50).alias("wide"), (F.max("y2") + 60).alias("tall"))
    low = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c) - 10, F.lit(0))).cast("bigint").alias(c)
    high = lambda c, most: F.least(F.col(most), F.coalesce(F.col(c) + 10, F.col(most))).cast("bigint").alias(c)
    visible = F.coalesce(10000 * F.col("ink") > 5 * F.col("wide").cast("bigint") * F.col("tall"), F.lit(False))
    return found.select("doc_id", low("x1"), low("y1"), high("x2", "wide"), high("y2", "tall"), visible.alias("visible"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: array_to_string(list_transform(string_split(r, ' '), lambda w: CASE WHEN length(w) >= 12 THEN repeat('.', length(w)) ELSE w END), ' ')) AS rows FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(rows, chr(10))) AS raster_md5 FROM l""")
def erased_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a raster, a character a pixel, with runs of 12 or more dark pixels painted over."""
    opened = lambda row: F.array_join(F.transform(F.split(row, " "), lambda w: F.when(F.length(w) >= 12, F.regexp_replace(w, "(?s).", ".")).otherwise(w)), " ")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(F.array_join(F.transform(F.split("text", "\n"), opened), "\n").cast("binary")).alias("raster_md5"))


@query(f"""WITH {_WORDS}, r AS (SELECT doc_id, line_no // 8 AS band, x1, x2, max(x2) OVER (PARTITION BY doc_id, line_no // 8 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT doc_id, band::BIGINT AS band, reach::BIGINT AS "start", x1::BIGINT AS "end" FROM r WHERE x1 - reach >= 8""")
def whitespace_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank columns of 8 or more across eight lines: what lies between the union of the words' spans."""
    banded = _words(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 8).alias("band"), "x1", "x2")
    reach = F.max("x2").over(Window.partitionBy("doc_id", "band").orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1))
    return banded.withColumn("reach", reach).where("x1 - reach >= 8").select("doc_id", "band", F.col("reach").cast("bigint").alias("start"), F.col("x1").cast("bigint").alias("end"))


@query("""SELECT user_id, max(value) AS ratio, array_to_string(list(event_id ORDER BY event_id) FILTER (event_type = 'click'), ' ') AS separators, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id""")
def merged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of several extractors as one: the largest ratio, all separators in order, the last label."""
    listed = F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id"))))
    merged = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("ratio"), listed.alias("ids"), F.max_by("event_type", "event_id").alias("label"))
    return merged.select("user_id", "ratio", F.nullif(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), F.lit("")).alias("separators"), "label")


@query("""WITH s AS (SELECT p_partkey, p_partkey % 3 = 0 AS fixed, p_partkey % 4 AS fg, p_partkey % 5 <> 0 AS allowed FROM part)
SELECT p_partkey, CASE WHEN fixed THEN 'fixed' WHEN fg = 0 THEN 'empty' WHEN NOT allowed THEN 'unsegmented' ELSE 'spatial' END AS label, CASE WHEN fixed AND allowed THEN 'spatial_regions,text' WHEN fixed THEN 'text' WHEN fg > 0 AND allowed THEN 'spatial_regions' ELSE '' END AS stages FROM s""")
def selected_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by selector: the fixed one takes all that are allowed, the uniform one the spatial stage of a page with ink."""
    key = F.col("p_partkey")
    allowed = F.when(key % 5 != 0, F.array(F.lit("spatial_regions"), F.lit("text"))).otherwise(F.array(F.lit("text")))
    fixed, spatial = key % 3 == 0, F.array_contains(allowed, "spatial_regions")
    label = F.when(fixed, "fixed").when(key % 4 == 0, "empty").when(~spatial, "unsegmented").otherwise("spatial")
    stages = F.when(fixed, allowed).when(label == "spatial", F.array(F.lit("spatial_regions"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.array_join(stages, ",").alias("stages"))


@query(f"""WITH {_LINES}, c AS (SELECT k, list_distinct(list_concat([0, 300], list(x))) AS xs, list_distinct(list_concat([0, 200], list(y))) AS ys FROM i WHERE q >= 40 GROUP BY k),
b AS (SELECT k, unnest(list_sort(ys)) AS top, xs FROM c), d AS (SELECT k, xs, top, lead(top) OVER (PARTITION BY k ORDER BY top) AS bottom FROM b), e AS (SELECT k, top, bottom, unnest(list_sort(xs)) AS lft FROM d WHERE bottom IS NOT NULL),
f AS (SELECT *, lead(lft) OVER (PARTITION BY k, top ORDER BY lft) AS rgt FROM e)
SELECT k, top::BIGINT AS top, bottom::BIGINT AS bottom, lft::BIGINT AS "left", rgt::BIGINT AS "right" FROM f WHERE rgt - lft >= 20 AND bottom - top >= 20""")
def spatial_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a page between its bands and cuts, of 20 or more either way, in reading order."""
    big = lambda n: F.lit(n).cast("bigint")
    edges = _lines(spark, sf_dir).where("q >= 40").groupBy("k").agg(F.array_sort(F.array_union(F.collect_set("x"), F.array(big(0), big(300)))).alias("xs"), F.array_sort(F.array_union(F.collect_set("y"), F.array(big(0), big(200)))).alias("ys"))
    return edges.select("k", F.inline(cells(F.col("xs"), F.col("ys"), 20))).select("k", F.col("y1").alias("top"), F.col("y2").alias("bottom"), F.col("x1").alias("left"), F.col("x2").alias("right"))


STEPS = {"lower": F.lower, "trim": F.trim, "reverse": F.reverse}


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN trim(lower(t)) WHEN 1 THEN reverse(trim(t)) ELSE lower(t) END) AS done_md5 FROM d""")
def composed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by name, applied in the order in which a page lists them; unknown names leave it as it is."""
    kind = F.col("doc_id") % 3
    steps = F.when(kind == 0, F.array(F.lit("lower"), F.lit("trim"))).when(kind == 1, F.array(F.lit("trim"), F.lit("reverse"))).otherwise(F.array(F.lit("lower"), F.lit("unknown")))

    def apply(page: Column, step: Column) -> Column:
        out = page
        for name, f in STEPS.items():
            out = F.when(step == name, f(page)).otherwise(out)
        return out

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.aggregate(steps, F.coalesce("text", F.lit("")), apply).cast("binary")).alias("done_md5"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 0 THEN substr(text, 1, doc_id * 7919 % length(text)) || '~' || substr(text, doc_id * 7919 % length(text) + 2) ELSE '' END) AS fuzzed_md5 FROM documents")
def flipped_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text with one character, at a place that its id decides, replaced: input for readers that must not fail."""
    at = (F.col("doc_id") * 7919 % F.length("text")).cast("int")
    told = F.when(F.length("text") > 0, F.concat(F.substring("text", F.lit(1), at), F.lit("~"), F.substring("text", at + 2, F.length("text")))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(told, F.lit("")).cast("binary")).alias("fuzzed_md5"))


_RULED = """o AS (SELECT o_custkey AS k, (o_orderkey % 60)::BIGINT AS x, (o_orderkey * 7 % 40)::BIGINT AS y, (o_orderkey % 61)::BIGINT AS wide, (o_orderkey % 41)::BIGINT AS tall FROM orders),
p AS (SELECT DISTINCT k, unnest(range(0, wide)) AS x, y FROM o UNION SELECT DISTINCT k, x, unnest(range(0, tall)) AS y FROM o),
h AS (SELECT k, y, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS run FROM p), hr AS (SELECT k, y, run, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 20), hl AS (SELECT k, y AS spot FROM hr GROUP BY k, y HAVING sum(n) >= 30),
v AS (SELECT k, x, y - row_number() OVER (PARTITION BY k, x ORDER BY y) AS run FROM p), vr AS (SELECT k, x, run, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 12), vl AS (SELECT k, x AS spot FROM vr GROUP BY k, x HAVING sum(n) >= 20),
l AS (SELECT k, 'row' AS axis, spot FROM hl UNION ALL SELECT k, 'column', spot FROM vl), g AS (SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY k, axis ORDER BY spot) <= 2 THEN 0 ELSE 1 END AS fresh FROM l),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY k, axis ORDER BY spot) AS grp FROM g)"""


def opened(row: Column, least: int) -> Column:
    """How many pixels of a row of 0 and 1 lie in runs of `least` or more ones."""
    return F.aggregate(F.regexp_extract_all(row, F.lit(f"1{{{least},}}"), F.lit(0)), F.lit(0), lambda n, run: n + F.length(run))


@query(f"WITH {_RULED} SELECT k, axis, round_even((min(spot) + max(spot)) / 2.0, 0)::BIGINT AS position FROM j GROUP BY k, axis, grp")
def detected_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines found in rasters of 60 by 40: long runs across and down, rows and columns with enough of them, grouped
    where they lie at most 2 apart. A customer's orders draw a raster, each a line across and one down."""
    big = lambda c: c.cast("bigint")
    drawn = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(big(F.col("o_orderkey") % 60).alias("x"), big(F.col("o_orderkey") * 7 % 40).alias("y"), big(F.col("o_orderkey") % 61).alias("wide"), big(F.col("o_orderkey") % 41).alias("tall")).alias("l"))
    pages = drawn.groupBy("k").agg(F.collect_list("l").alias("ls"))  # a page's lines
    pixel = lambda x, y: F.when(F.exists("ls", lambda m: ((m["y"] == y) & (x < m["wide"])) | ((m["x"] == x) & (y < m["tall"]))), "1").otherwise("0")
    span = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = F.transform(span(40), lambda y: F.array_join(F.transform(span(60), lambda x: pixel(x, y)), ""))
    raster = pages.select("k", rows.alias("rows"))
    columns = F.transform(span(60), lambda x: F.array_join(F.transform("rows", lambda r: F.substring(r, x + 1, F.lit(1))), ""))
    found = raster.select("k", "rows", columns.alias("cols"))
    strong = lambda lines, run, least: F.filter(F.transform(lines, lambda r, n: F.when(opened(r, run) >= least, n)), lambda n: n.isNotNull())
    sides = F.array(F.struct(F.lit("row").alias("axis"), strong(F.col("rows"), 20, 30).alias("at")), F.struct(F.lit("column").alias("axis"), strong(F.col("cols"), 12, 20).alias("at")))
    lines = found.select("k", F.inline(sides)).select("k", "axis", F.explode("at").alias("at"))
    order = Window.partitionBy("k", "axis").orderBy("at")
    grouped = lines.withColumn("fresh", F.when(F.col("at") - F.lag("at").over(order) <= 2, 0).otherwise(1)).withColumn("group", F.sum("fresh").over(order))
    return grouped.groupBy("k", "axis", "group").agg(F.bround((F.min("at") + F.max("at")) / 2, 0).cast("bigint").alias("position")).drop("group")
