"""Queries around a document run: watchers, repairs, crop plans, stacked pages, trees, progress, settings and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import controls
from weftline.plans.registry import query
from weftline.session import table


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'close' WHEN 'purchase' THEN 'end' ELSE 'other' END AS kind FROM events),
s AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER w AS total, bool_or(kind = 'end') OVER w AS ended,
  min(CASE WHEN kind IN ('open', 'end') THEN t END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id)) AS lowest FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c WHERE kind = 'close' AND total = lowest AND NOT ended AND (nxt IS NULL OR nxt > t + 600000000))
SELECT user_id, event_id, t + 600000000 AS at_us FROM f WHERE k = 1""")
def grace_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are cancelled, as after a disconnect nobody watched them for ten minutes."""
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "close").when(F.col("event_type") == "purchase", "end").otherwise("other")
    return controls.grace_cancelled(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", kind.alias("kind")), "user_id", 600)


@query(r"""WITH x AS (SELECT o_custkey AS k, o_orderkey AS n, CASE WHEN o_orderkey % 4 = 0 THEN 'B1.' || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') WHEN o_orderkey % 17 = 0 THEN 'B1' ELSE '' END AS idx, o_orderkey % 5 <> 0 AS payload FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM x),
f AS (SELECT *, min(CASE WHEN idx LIKE 'B1.%' THEN place END) OVER (PARTITION BY k) AS one, arg_min(idx, place) FILTER (idx LIKE 'B1.%') OVER (PARTITION BY k) AS head FROM r),
g AS (SELECT *, coalesce(max(CASE WHEN idx = 'B1' AND place < one THEN place END) OVER (PARTITION BY k), 0) AS stop FROM f),
o AS (SELECT *, coalesce(idx = '' AND payload AND place < one AND place > stop, false) AS vacant FROM g),
b AS (SELECT *, substr(head, 4)::BIGINT - count(*) FILTER (vacant) OVER (PARTITION BY k ORDER BY place DESC) AS num FROM o)
SELECT k, n, CASE WHEN vacant AND num >= 1 THEN 'B1.' || lpad(num::VARCHAR, 2, '0') ELSE idx END AS idx FROM b""")
def backfilled_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank numbers above a group's first are counted down from it, to the last section row or 1."""
    key = F.col("o_orderkey")
    idx = F.when(key % 4 == 0, F.concat(F.lit("B1."), F.lpad((key % 12 + 1).cast("string"), 2, "0"))).when(key % 17 == 0, "B1").otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), key.alias("n"), idx.alias("idx"), (key % 5 != 0).alias("payload"), (idx == "B1").alias("section"))
    return controls.backfilled(rows, "k", ["n"]).select("k", "n", "idx")


def _passes() -> str:
    tiles = ", ".join(f"({k}, {c}, {r}, {s}, '{m}')" for k, (c, r, s, m) in enumerate(controls.TILE_PASSES))
    at = len(controls.TILE_PASSES)
    bands = ", ".join(f"({at + k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE, {s}, '{m}')" for k, (a, b, c, d, s, m) in enumerate(controls.BAND_PASSES))
    at += len(controls.BAND_PASSES)
    heads = ", ".join(f"({at + k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {s}, '{m}')" for k, (a, b, s, m) in enumerate(controls.HEADER_PASSES))
    return f"t(pass, columns, rows, scale, mode) AS (VALUES {tiles}), b(pass, a, z, tall, shared, scale, mode) AS (VALUES {bands}), d(pass, a, z, scale, mode) AS (VALUES {heads})"


def _starts(limit: str, size: str, overlap: str) -> str:
    return f"CASE WHEN {limit} <= {size} THEN [0] ELSE list_distinct(list_append(range(0, {limit} - {size} + 1, {size} - greatest(0, least({size} - 1, {overlap}))), {limit} - {size})) END"


@query(f"""WITH i AS (SELECT p_partkey AS image, 800 + p_partkey * 37 % 3000 AS w0, 900 + p_partkey * 91 % 4000 AS h0 FROM part),
r AS (SELECT image, greatest(w0, 3300) AS w, CASE WHEN w0 >= 3300 THEN h0 ELSE greatest(1, round_even(h0 * 3300::DOUBLE / w0, 0))::BIGINT END AS h FROM i), {_passes()},
ts AS (SELECT *, (w + columns - 1) // columns AS tw, (h + rows - 1) // rows AS th FROM r, t),
ty AS (SELECT *, unnest({_starts('h', 'th', 'greatest(24, th // 12)')}) AS y FROM ts), tx AS (SELECT *, unnest({_starts('w', 'tw', 'greatest(24, tw // 12)')}) AS x FROM ty),
bs AS (SELECT *, least(w - 1, round_even(w * a, 0)::BIGINT) AS l, greatest(24, least(h, round_even(w * tall, 0)::BIGINT)) AS bh, round_even(w * shared, 0)::BIGINT AS ov FROM r, b),
bb AS (SELECT *, greatest(1, least(h, bh)) AS bw FROM bs), byt AS (SELECT *, unnest({_starts('h', 'bw', 'least(bh - 1, ov)')}) AS y FROM bb)
SELECT image, pass, x AS "left", y AS top, least(w, x + tw) AS "right", least(h, y + th) AS bottom, scale, mode FROM tx
UNION ALL SELECT image, pass, l, y, greatest(l + 1, least(w, round_even(w * z, 0)::BIGINT)), least(h, y + bh), scale, mode FROM byt
UNION ALL SELECT image, pass, round_even(w * a, 0)::BIGINT, 0, greatest(round_even(w * a, 0)::BIGINT + 1, round_even(w * z, 0)::BIGINT), greatest(1, round_even(w * {controls.HEADER_HEIGHT!r}::DOUBLE, 0)::BIGINT), scale, mode FROM r, d""")
def dense_grid_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, bands and headers to read of pages with a dense grid."""
    key = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(key.alias("image"), (800 + key * 37 % 3000).alias("width"), (900 + key * 91 % 4000).alias("height"))
    return controls.crop_plan(images, "image")


@query("""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, 100 + o_orderkey * 7 % 400 AS width, 200 + o_orderkey * 11 % 500 AS height FROM orders)
SELECT doc, page, (max(width) OVER d - width) // 2 AS "left", coalesce(sum(height + 24) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top,
  max(width) OVER d AS stack_width, (sum(height) OVER d + 24 * (count(*) OVER d - 1))::BIGINT AS stack_height FROM p WINDOW d AS (PARTITION BY doc)""")
def stacked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's pages one below the other, centred."""
    key = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("page"), (100 + key * 7 % 400).alias("width"), (200 + key * 11 % 500).alias("height"))
    return controls.stacked_pages(pages, "doc", ["page"], 24)


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn % 5 = 3 AS hidden, role = 'assistant' AND length(text) > 0 AS told FROM conversations),
v AS (SELECT conv_id, node, told, [node] AS path FROM n WHERE parent IS NULL AND NOT hidden UNION ALL SELECT n.conv_id, n.node, n.told, list_append(v.path, n.node) FROM v JOIN n ON n.conv_id = v.conv_id AND n.parent = v.node WHERE NOT n.hidden)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place, node FROM v WHERE told""")
def visible_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a tree of turns, depth first, without what stands below a hidden turn."""
    turn = F.col("turn")
    parent = F.when(turn > 0, F.floor((turn - 1) / 2))
    nodes = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("node"), parent.alias("parent"), (turn % 5 == 3).alias("hidden"), ((F.col("role") == "assistant") & (F.length("text") > 0)).alias("told"))
    return controls.visible_messages(nodes, "conv_id")


_QUAD = "(10 + p_partkey % 7)::DOUBLE AS x0, (5 + p_partkey % 11)::DOUBLE AS y0, (200 + p_partkey % 13)::DOUBLE AS x1, (8 + p_partkey % 5)::DOUBLE AS y1, (180 + p_partkey % 17)::DOUBLE AS x2, (150 + p_partkey % 3)::DOUBLE AS y2, (30 + p_partkey % 19)::DOUBLE AS x3, (170 + p_partkey % 23)::DOUBLE AS y3"


@query(f"""WITH q AS (SELECT p_partkey, (p_size % 10) / 10.0::DOUBLE AS u, 0.25::DOUBLE AS v, {_QUAD} FROM part),
d AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS w, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q),
g AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / w AS g, ((x1 - x2) * sy - sx * (y1 - y2)) / w AS h FROM d)
SELECT p_partkey, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1), 4) AS x, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1), 4) AS y FROM g""")
def perspective_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where points of a flat page lie in a photograph of it, by its four corners."""
    corner = lambda base, by: (base + F.col("p_partkey") % by).cast("double")
    corners = [(corner(10, 7), corner(5, 11)), (corner(200, 13), corner(8, 5)), (corner(180, 17), corner(150, 3)), (corner(30, 19), corner(170, 23))]
    x, y = controls.square_to_quad((F.col("p_size") % 10) / 10, F.lit(0.25), corners)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("""WITH e AS (SELECT event_id, event_id % 6 AS total, event_id % 8 AS completed, CASE WHEN event_id % 3 > 0 THEN value END AS told FROM events),
s AS (SELECT *, greatest(0, least(1, CASE WHEN told > 1 THEN told / 100 ELSE told END)) AS part FROM e),
p AS (SELECT *, CASE WHEN told IS NULL THEN NULL ELSE part END AS page_share FROM s)
SELECT event_id, round(page_share, 6) AS page_share, CASE WHEN total > 0 THEN round(greatest(0, least(1, (least(completed, total) + coalesce(page_share, 0)) / total)), 6) END AS document_share FROM p""")
def progress_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of pages, told as a share or in per cent, and of their documents."""
    told = controls.share(F.when(F.col("event_id") % 3 > 0, F.col("value")))
    events = table(spark, sf_dir, "events").select("event_id", told.alias("page_share"))
    done = controls.document_share(F.col("event_id") % 6, F.col("event_id") % 8, F.col("page_share"))
    return events.select("event_id", F.round("page_share", 6).alias("page_share"), F.round(done, 6).alias("document_share"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '/../../../../up.html' WHEN 1 THEN '/../style.css' ELSE '' END AS path FROM pages),
s AS (SELECT page_id, path, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS k FROM p),
d AS (SELECT *, sum(CASE WHEN part = '..' THEN -1 WHEN part IN ('', '.') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM s)
SELECT page_id, min(depth) >= 0 AS safe, bool_or(regexp_matches(path, '[^/.][^/]*\.[^/]*$')) AS asset FROM d GROUP BY page_id""")
def static_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request paths: whether they stay below their root, and whether they name a file with an extension."""
    more = F.when(F.col("page_id") % 4 == 0, "/../../../../up.html").when(F.col("page_id") % 4 == 1, "/../style.css").otherwise("")
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1), more).alias("path"))
    return paths.select("page_id", controls.safe_path(F.col("path")).alias("safe"), F.col("path").rlike(r"[^/.][^/]*\.[^/]*$").alias("asset"))


@query(r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN '.turn[data-k="' || l_partkey || '"] > p' WHEN 1 THEN 'main >> .x' WHEN 2 THEN repeat('a', l_partkey::INT) ELSE 'a[href=JavaScript:' || l_partkey || ']' END AS selector FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, length(selector) BETWEEN 1 AND 500 AND regexp_matches(selector, '^[A-Za-z0-9_#.:\[\]="''\-\s>+~*()]+$') AND NOT contains(selector, '>>') AND NOT contains(lower(selector), 'javascript:') AS valid FROM s""")
def valid_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of settings that may be used: of safe characters, not too long, without chains or scripts.

    One that is too long is written out to the first character over the limit only: what follows can't make it valid,
    and all of it would take time and memory in proportion to the key.
    """
    part, kind, times = F.col("l_partkey").cast("string"), F.col("l_suppkey") % 4, F.col("l_partkey").cast("int")
    run = F.repeat(F.lit("a"), F.when(times > controls.LONGEST_SELECTOR, controls.LONGEST_SELECTOR + 1).otherwise(times))
    selector = F.when(kind == 0, F.concat(F.lit('.turn[data-k="'), part, F.lit('"] > p'))).when(kind == 1, "main >> .x").when(kind == 2, run).otherwise(F.concat(F.lit("a[href=JavaScript:"), part, F.lit("]")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", controls.valid_selector(selector).alias("valid"))


@query("""SELECT c_custkey, list_aggregate(list_sort(['ocr_languages:eng', 'layout_param:max_image_pixels=' || c_nationkey, 'layout_param:gap=' || c_custkey % 4, 'preprocess:' || lower(c_mktsegment)]), 'string_agg', '; ') AS flags FROM customer""")
def profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a profile, its parameters in snake case, sorted."""
    settings = F.create_map(F.lit("maxImagePixels"), F.col("c_nationkey").cast("string"), F.lit("gap"), (F.col("c_custkey") % 4).cast("string"))
    params = F.transform(F.map_entries(settings), lambda e: F.concat(F.lit("layout_param:"), controls.snake_case(e["key"]), F.lit("="), e["value"]))
    flags = F.concat(F.array(F.lit("ocr_languages:eng"), F.concat(F.lit("preprocess:"), F.lower("c_mktsegment"))), params)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(flags), "; ").alias("flags"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) x WHERE k <= 80""")
def ring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 80 lines of each log; the limit is the feature."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", back.alias("k")).where("k <= 80").select("user_id", "event_id")


@query("""WITH f AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_type = 'click' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN event_id % 9 = 0 THEN (props::JSON ->> '$.k') END AS fixed FROM events)
SELECT user_id, count(*) FILTER (severity IN ('HIGH', 'MEDIUM') AND fixed IS NOT NULL) AS blocking, count(*) FILTER (severity IN ('HIGH', 'MEDIUM') AND fixed IS NULL) AS accepted,
  CASE WHEN count(*) FILTER (severity IN ('HIGH', 'MEDIUM') AND fixed IS NOT NULL) > 0 THEN 'fail' ELSE 'pass' END AS gate FROM f GROUP BY user_id""")
def audit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of findings: one of gated severity that has a fix fails its report, others are counted as accepted."""
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "MEDIUM").otherwise("LOW")
    finding = F.to_json(F.struct(severity.alias("Severity"), F.when(F.col("event_id") % 9 == 0, F.get_json_object("props", "$.k")).alias("FixedVersion")))
    read = table(spark, sf_dir, "events").select("user_id", F.from_json(finding, "Severity string, FixedVersion string").alias("f"))
    gated = F.col("f.Severity").isin("HIGH", "MEDIUM")
    has_fix = F.coalesce(F.col("f.FixedVersion"), F.lit("")) != ""
    counts = read.groupBy("user_id").agg(F.count_if(gated & has_fix).alias("blocking"), F.count_if(gated & ~has_fix).alias("accepted"))
    return counts.withColumn("gate", F.when(F.col("blocking") > 0, "fail").otherwise("pass"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'small' WHEN o_orderstatus = 'O' THEN 'large' END AS model,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'gpu' WHEN o_orderkey % 3 = 1 THEN 'cpu' END WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 < 2 THEN 'gpu' END END AS backend FROM orders""")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and back end from a catalogue: the model's default where none is asked for, NULL where it isn't known."""
    catalogue = spark.createDataFrame([("F", "small", "cpu", ["cpu", "gpu"]), ("O", "large", "gpu", ["gpu"])], "o_orderstatus string, model string, usual string, backends array<string>")
    asked = F.when(F.col("o_orderkey") % 3 == 0, "gpu").when(F.col("o_orderkey") % 3 == 2, "tpu")
    wanted = F.coalesce(F.col("asked"), F.col("usual"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", asked.alias("asked")).join(F.broadcast(catalogue), "o_orderstatus", "left")
    return found.select("o_orderkey", "model", F.when(F.array_contains("backends", wanted), wanted).alias("backend"))


@query("""SELECT event_type, max(value) AS peak, count(*) AS samples FROM events GROUP BY event_type""")
def peak_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest of a run's memory samples."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("peak"), F.count("*").alias("samples"))
