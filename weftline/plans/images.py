"""Queries on page images' sizes and boxes, placed items, expected pages, requests and line kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import images
from weftline.plans.registry import query
from weftline.session import table


@query("""WITH p AS (SELECT p_partkey, 100 + p_partkey * 37 % 1200 AS w, 150 + p_partkey * 53 % 1400 AS h, p_size * 5 AS light FROM part),
a AS (SELECT *, h::DOUBLE / w AS aspect FROM p)
SELECT p_partkey, CASE WHEN least(w, h) < 240 AND greatest(w, h) <= 900 AND w * h <= 300000 THEN 'small_text_upscale' WHEN w BETWEEN 650 AND 900 AND h BETWEEN 900 AND 1300 AND aspect BETWEEN 1.2::DOUBLE AND 1.7::DOUBLE THEN 'mobile_screen_upscale'
  WHEN w BETWEEN 850 AND 1200 AND h BETWEEN 1100 AND 1500 AND aspect BETWEEN 1.2::DOUBLE AND 1.6::DOUBLE AND light >= 120 THEN 'projector_slide_dewarp' END AS step,
  greatest(2, least(4, ceil(600.0::DOUBLE / least(w, h))))::BIGINT AS text_scale, w::DOUBLE / h <= 2 AND w::DOUBLE / (h // 3) >= 2.8::DOUBLE AS suspicious FROM a""")
def preprocess_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that pages need before they are read, by size and brightness."""
    key = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(key, (100 + key * 37 % 1200).alias("w"), (150 + key * 53 % 1400).alias("h"), (F.col("p_size") * 5).alias("light"))
    w, h = F.col("w"), F.col("h")
    return pages.select("p_partkey", images.preprocess_step(w, h, F.col("light")).alias("step"), images.small_text_scale(w, h).alias("text_scale"), images.suspicious_crop(w, h, w, F.floor(h / 3)).alias("suspicious"))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 50 AS x1, p_partkey % 30 AS y1, p_partkey % 50 + p_partkey * 7 % 400 AS x2, p_partkey % 30 + p_partkey * 3 % 90 AS y2 FROM part),
o AS (SELECT *, greatest(2, least(8, (x2 - x1) // 20, (y2 - y1) // 20)) AS off FROM b),
i AS (SELECT p_partkey, least(x2, x1 + off) AS x1, least(y2, y1 + off) AS y1, greatest(x1, x2 - off) AS x2, greatest(y1, y2 - off) AS y2, x2 - x1 AS w, y2 - y1 AS h FROM o),
s AS (SELECT *, least(4, greatest(1, 52.0::DOUBLE / greatest(1, h), CASE WHEN w < 120 THEN 120.0::DOUBLE / greatest(1, w) ELSE 1 END)) AS scale FROM i)
SELECT p_partkey, x1, y1, x2, y2, CASE WHEN w <= 0 OR h <= 0 THEN w WHEN scale > 1.05::DOUBLE THEN greatest(1, floor(w * scale))::BIGINT + 16 ELSE w + 16 END AS width, CASE WHEN w <= 0 OR h <= 0 THEN h WHEN scale > 1.05::DOUBLE THEN greatest(1, floor(h * scale))::BIGINT + 16 ELSE h + 16 END AS height,
  round_even(x1 / 3.0::DOUBLE, 0)::BIGINT + 700 AS page_x FROM s""")
def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of cells without their rules, their legible sizes, and a tile's coordinate on its page."""
    key = F.col("p_partkey")
    box = table(spark, sf_dir, "part").select(key, (key % 50).alias("x1"), (key % 30).alias("y1"), (key % 50 + key * 7 % 400).alias("x2"), (key % 30 + key * 3 % 90).alias("y2"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    inset = images.cell_inset(x1, y1, x2, y2)
    width, height = images.cell_size(x2 - x1, y2 - y1)
    return box.select("p_partkey", *(c.alias(n) for c, n in zip(inset, ("x1", "y1", "x2", "y2"), strict=True)), width.alias("width"), height.alias("height"), images.on_page(inset[0], F.lit(3.0), F.lit(700)).alias("page_x"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'png,jpg' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' END AS formats FROM customer""")
def raster_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of raster formats in their plain form; NULL where one isn't known."""
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, "PNG, jpeg,png").when(kind == 1, "jpeg,JPG").when(kind == 2, "png").otherwise("png,tiff")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(images.raster_formats(text), ",").alias("formats"))


@query(r"""SELECT conv_id, md5(regexp_replace(regexp_replace(regexp_replace(string_agg(text || CASE WHEN turn % 3 = 2 THEN chr(10) ELSE ' ' END, '' ORDER BY turn, text), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) x GROUP BY conv_id""")
def placed_item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages from placed items, each third of which ends its line. A page fits a task."""
    item = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 3 == 2).alias("ends_line"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return pages.select("conv_id", F.md5(images.item_text(F.col("items")).cast("binary")).alias("text_md5"))


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
h AS (SELECT doc_id, line, k, k % 5 = 2 AS heads FROM l),
p AS (SELECT *, sum(heads::INT) OVER (PARTITION BY doc_id ORDER BY k) AS page FROM h)
SELECT doc_id, page::BIGINT AS page, md5(regexp_replace(string_agg(CASE WHEN heads THEN '## Page ' || k ELSE line END, chr(10) ORDER BY k), '\s+$', '') || chr(10)) AS page_md5 FROM p WHERE page > 0 GROUP BY doc_id, page""")
def expected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected texts of pages: each begins at a heading that names it; what stands before the first belongs to none."""
    told = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 5 == 1, F.concat(F.lit("## Page "), (k + 1).cast("string"))).otherwise(x)).alias("lines"))
    heading = lambda x: F.trim(x).rlike(r"(?i)^#{1,6}\s+page\s+[0-9]+$")
    starts = F.filter(F.transform("lines", lambda x, k: F.when(heading(x), k)), lambda k: k.isNotNull())
    cut = told.withColumn("starts", starts)
    pages = cut.select("doc_id", "lines", "starts", F.posexplode("starts").alias("nth", "start"))
    end = F.coalesce(F.get("starts", F.col("nth") + 1), F.size("lines"))
    text = F.array_join(F.slice("lines", F.col("start") + 1, end - F.col("start")), "\n")
    return pages.select("doc_id", (F.col("nth") + 1).cast("bigint").alias("page"), F.md5(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).cast("binary")).alias("page_md5"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'json' WHEN event_id % 5 = 0 THEN 'text' WHEN event_id % 5 = 1 THEN 'markdown' WHEN event_id % 5 = 2 THEN 'events' WHEN event_id % 5 = 3 AND event_type <> 'click' THEN 'text' ELSE 'async' END AS mode FROM events""")
def response_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How requests want their answers."""
    nth = F.col("event_id") % 5
    explicit = F.when(F.col("event_type") == "error", "json").when(F.col("event_type") == "view", "unknown")
    accept = F.when(nth == 0, "Text/Plain").when(nth == 1, "text/markdown, */*").when(nth == 2, "text/event-stream").when(nth == 3, "*/*")
    return table(spark, sf_dir, "events").select("event_id", images.response_mode(explicit, accept, F.col("event_type") == "click").alias("mode"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), k AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN line || ' 5 ₽' WHEN 1 THEN 'Зав. кафедрой ' || line WHEN 2 THEN '| Практика ' || line WHEN 3 THEN 'Зачет с оценкой ' || line ELSE line END AS line FROM l),
c AS (SELECT doc_id, contains(line, '₽') AS price, length(line) <= 200 AND (contains(line, '/') OR contains(line, '_') OR regexp_matches(lower(line), '\.[a-zа-я]{2,}')) AS identifier, doc_id % 7 = 1 AS signature, doc_id % 7 = 3 AS control_summary, doc_id % 7 = 2 AS practice_row FROM k)
SELECT doc_id, count(*) FILTER (price) AS price, count(*) FILTER (identifier) AS identifier, count(*) FILTER (signature) AS signature, count(*) FILTER (control_summary) AS control_summary, count(*) FILTER (practice_row) AS practice_row FROM c GROUP BY doc_id""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each kind in a document."""
    kind = F.col("doc_id") % 7
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    told = F.when(kind == 0, F.concat("line", F.lit(" 5 ₽"))).when(kind == 1, F.concat(F.lit("Зав. кафедрой "), "line")).when(kind == 2, F.concat(F.lit("| Практика "), "line")).when(kind == 3, F.concat(F.lit("Зачет с оценкой "), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", told.alias("line")).groupBy("doc_id").agg(*(F.count_if(c).alias(n) for n, c in images.line_classes(F.col("line")).items()))


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, event_id, before IS NULL OR before = 'purchase' AS mounts FROM e WHERE event_type = 'view'""")
def mounted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to mount a target: one mounts if the target isn't there, at first or since it was removed."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    asked = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").select("user_id", "event_id", "event_type", before.alias("before"))
    return asked.where("event_type = 'view'").select("user_id", "event_id", (F.col("before").isNull() | (F.col("before") == "purchase")).alias("mounts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS accepted, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown status: ' || o_orderstatus END AS error FROM orders""")
def rejected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside a closed set aren't guessed at: such rows go on as errors."""
    status = F.col("o_orderstatus")
    known = status.isin("F", "O")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(known, status).alias("accepted"), F.when(~known, F.concat(F.lit("unknown status: "), status)).alias("error"))
