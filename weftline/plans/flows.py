"""Orchestration as columns: totals, fallbacks, rules, routes, strategies, the task machine, sessions, page scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import tasks
from weftline.plans.registry import query
from weftline.session import table


@query("""WITH p AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS chunks, length(text) - length(replace(text, '.', '')) AS cells, length(text) < 150 AS blank FROM conversations)
SELECT conv_id, count(*) AS pages, sum(chunks)::BIGINT AS chunks, sum(cells)::BIGINT AS cells, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (blank), '') AS empty_pages FROM p GROUP BY conv_id""")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a document's pages added up, and its empty pages in order."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", "\n")).alias("chunks"), (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).alias("cells"), F.when(F.length("text") < 150, F.col("turn")).alias("blank"))
    totals = pages.groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum("chunks").alias("chunks"), F.sum("cells").alias("cells"), F.array_sort(F.collect_list("blank")).alias("blank"))
    return totals.select("conv_id", "pages", "chunks", "cells", F.array_join(F.transform("blank", lambda t: t.cast("string")), ",").alias("empty_pages"))


def first_reading(readings: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """Of recognisers (name, available, text) in order of trust, the first available one whose text isn't blank: name and text."""
    good = [(name, available & (F.trim(reading) != ""), reading) for name, available, reading in readings]
    return F.coalesce(*(F.when(ok, F.lit(name)) for name, ok, _ in good)), F.coalesce(*(F.when(ok, reading) for _, ok, reading in good), F.lit(""))


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'a ' || event_id END AS a, event_id % 4 <> 0 AS ua, CASE event_id % 5 WHEN 0 THEN ' ' ELSE 'b ' || event_id END AS b, event_id % 7 <> 0 AS ub, event_type AS c FROM events)
SELECT event_id, CASE WHEN ua AND trim(a) <> '' THEN 'first' WHEN ub AND trim(b) <> '' THEN 'second' WHEN c <> 'error' THEN 'stub' END AS engine, CASE WHEN ua AND trim(a) <> '' THEN a WHEN ub AND trim(b) <> '' THEN b WHEN c <> 'error' THEN c ELSE '' END AS reading FROM r""")
def fallback_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three recognisers a page's text comes from."""
    k = F.col("event_id")
    a = F.when(k % 3 == 0, "").when(k % 3 == 1, "  ").otherwise(F.concat(F.lit("a "), k.cast("string")))
    b = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("b "), k.cast("string")))
    engine, reading = first_reading([("first", k % 4 != 0, a), ("second", k % 7 != 0, b), ("stub", F.col("event_type") != "error", F.col("event_type"))])
    return table(spark, sf_dir, "events").select("event_id", engine.alias("engine"), reading.alias("reading"))


_RULES = [(1, "Customer#%0", "1-2"), (2, "Customer#%00_", "3"), (3, "Customer#%5%", "4,6"), (4, "%99", "1")]


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'Customer#%0', '1-2'), (2, 'Customer#%00_', '3'), (3, 'Customer#%5%', '4,6'), (4, '%99', '1')) v(no, pattern, pages)), m AS (SELECT c_custkey, arg_max(pages, no) AS pages, arg_min(no, no) AS first FROM customer JOIN r ON c_name LIKE pattern GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(m.pages, 'all') AS pages, coalesce('profile-' || first, 'default') AS profile FROM customer c LEFT JOIN m ON c.c_custkey = m.c_custkey""")
def rule_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by glob: the last that matches a name gives its pages, the first its profile; a rule list is small and broadcast."""
    rules = spark.createDataFrame(_RULES, "no int, pattern string, pages string")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    matched = names.join(F.broadcast(rules), F.expr("c_name LIKE pattern"), "left").groupBy("c_custkey").agg(F.max_by("pages", "no").alias("pages"), F.min("no").alias("first"))
    return matched.select("c_custkey", F.coalesce("pages", F.lit("all")).alias("pages"), F.coalesce(F.concat(F.lit("profile-"), F.col("first").cast("string")), F.lit("default")).alias("profile"))


@query(r"""WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1,3,5-7' WHEN 1 THEN '4-2' WHEN 2 THEN '0' WHEN 3 THEN '2,,3' WHEN 4 THEN 'x' ELSE '8' END AS sel FROM events),
p AS (SELECT event_id, sel, unnest(string_split(sel, ',')) AS part FROM s), q AS (SELECT event_id, regexp_matches(part, '^[1-9][0-9]*(-[1-9][0-9]*)?$') AS shaped, try_cast(split_part(part, '-', 1) AS BIGINT) AS a, coalesce(try_cast(nullif(split_part(part, '-', 2), '') AS BIGINT), try_cast(split_part(part, '-', 1) AS BIGINT)) AS b FROM p)
SELECT event_id, bool_and(shaped AND a <= b) AS valid, CASE WHEN bool_and(shaped AND a <= b) THEN sum(b - a + 1)::BIGINT ELSE 0 END AS pages FROM q GROUP BY event_id""")
def checked_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page selectors: single pages and rising ranges from 1, and how many pages a valid one names."""
    kind = F.col("event_id") % 6
    selector = F.when(kind == 0, "1,3,5-7").when(kind == 1, "4-2").when(kind == 2, "0").when(kind == 3, "2,,3").when(kind == 4, "x").otherwise("8")
    ends = F.transform(F.split(selector, ","), lambda part: F.when(part.rlike("^[1-9][0-9]*(-[1-9][0-9]*)?$"), F.struct(F.split_part(part, F.lit("-"), F.lit(1)).cast("bigint").alias("a"), F.split_part(part, F.lit("-"), F.lit(-1)).cast("bigint").alias("b"))))
    told = table(spark, sf_dir, "events").select("event_id", ends.alias("ends")).withColumn("valid", F.forall("ends", lambda e: F.coalesce(e["a"] <= e["b"], F.lit(False))))
    return told.select("event_id", "valid", F.when(F.col("valid"), F.aggregate("ends", F.lit(0).cast("bigint"), lambda n, e: n + e["b"] - e["a"] + 1)).otherwise(0).alias("pages"))


@query("""SELECT event_id, CASE WHEN NOT (mime LIKE 'image/%' OR mime = 'application/pdf') THEN 'unsupported' WHEN size = 0 THEN 'empty' WHEN size > 134217728 THEN 'too-large' WHEN external AND NOT consent THEN 'no-consent' WHEN NOT external AND NOT up THEN 'no-backend' ELSE 'accepted' END AS verdict
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'image/png' WHEN 'view' THEN 'application/pdf' WHEN 'error' THEN 'text/html' ELSE 'image/jpeg' END AS mime, event_id * 1000003 % 200000000 * (event_id % 11 <> 0)::INT AS size, event_id % 2 = 0 AS external, event_id % 3 = 0 AS consent, event_id % 5 <> 0 AS up FROM events) x""")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an upload is taken: a supported type, a size from 1 to 128 MiB, consent for external models, a live backend for local ones."""
    k, kind = F.col("event_id"), F.col("event_type")
    mime = F.when(kind == "click", "image/png").when(kind == "view", "application/pdf").when(kind == "error", "text/html").otherwise("image/jpeg")
    size = k * 1000003 % 200000000 * (k % 11 != 0).cast("int")
    verdict = F.when(~(mime.startswith("image/") | (mime == "application/pdf")), "unsupported").when(size == 0, "empty").when(size > 128 << 20, "too-large")
    verdict = verdict.when((k % 2 == 0) & (k % 3 != 0), "no-consent").when((k % 2 != 0) & (k % 5 == 0), "no-backend").otherwise("accepted")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), r AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '  ' || substr(text, 1, 40) || ' ' WHEN 1 THEN nxt ELSE ' ' END AS raw FROM p WHERE nxt IS NOT NULL),
s AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS b FROM r)
SELECT conv_id, turn, md5(CASE WHEN b <> '' AND NOT contains(a, b) THEN text || chr(10) || chr(10) || raw ELSE text END) AS page_md5, b <> '' AND NOT contains(a, b) AS appended FROM s""")
def raw_text_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's raw text goes after its parts unless they say it already, white space aside."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", following.alias("next")).where("next IS NOT NULL")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.substring("text", 1, 40), F.lit(" "))).when(F.col("turn") % 3 == 1, F.col("next")).otherwise(" ")
    pages = turns.withColumn("raw", raw)
    appended = (text.squeeze(F.col("raw")) != "") & ~F.contains(text.squeeze(F.col("text")), text.squeeze(F.col("raw")))
    return pages.select("conv_id", "turn", F.md5(F.when(appended, F.concat("text", F.lit("\n\n"), "raw")).otherwise(F.col("text")).cast("binary")).alias("page_md5"), appended.alias("appended"))


@query("""WITH s AS (SELECT p_partkey, 200 + p_partkey * 37 % 3000 AS w, 300 + p_partkey * 91 % 12000 AS h, p_partkey % 4 AS bands, p_partkey % 7 = 0 AS dense, p_partkey % 5 = 0 AS projector FROM part)
SELECT p_partkey, CASE WHEN h >= 6000 AND h::DOUBLE / w >= 8 THEN 'segments' WHEN dense THEN 'dense-grid' WHEN projector THEN 'projector' ELSE 'layout' END AS page_route,
  CASE WHEN h <= 1600 OR h::DOUBLE / w <= 1.8 THEN 'direct' WHEN bands > 1 THEN 'cards' ELSE 'chunks' END AS region_route,
  CASE WHEN h <= 1600 OR h::DOUBLE / w <= 1.8 THEN 1 WHEN bands > 1 THEN bands ELSE 1 + ceil(greatest(0, h - 1200) / 1100.0::DOUBLE)::BIGINT END::BIGINT AS calls FROM s""")
def recognition_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a page and an image region are read: by shape, and at once, by cards between blank bands, or in overlapping chunks."""
    key = F.col("p_partkey")
    sized = table(spark, sf_dir, "part").select("p_partkey", (200 + key * 37 % 3000).alias("w"), (300 + key * 91 % 12000).alias("h"), (key % 4).alias("bands"))
    aspect, direct = F.col("h") / F.col("w"), (F.col("h") <= 1600) | (F.col("h") / F.col("w") <= 1.8)
    page = F.when((F.col("h") >= 6000) & (aspect >= 8), "segments").when(key % 7 == 0, "dense-grid").when(key % 5 == 0, "projector").otherwise("layout")
    starts = F.when(F.col("h") > 1200, F.size(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 101, F.lit(1100).cast("bigint")))).otherwise(1)  # a chunk that ends at the region's end is the last
    calls = F.when(direct, 1).when(F.col("bands") > 1, F.col("bands")).otherwise(starts)
    return sized.select("p_partkey", page.alias("page_route"), F.when(direct, "direct").when(F.col("bands") > 1, "cards").otherwise("chunks").alias("region_route"), calls.cast("bigint").alias("calls"))


@query("""WITH t AS (SELECT p_partkey, 1 + p_partkey % 40 AS rows, 1 + p_partkey % 50 AS cols, p_partkey % 101 / 100.0::DOUBLE AS word_cover, p_partkey % 89 / 100.0::DOUBLE AS cell_cover, p_partkey % 3 = 0 AS raw FROM part)
SELECT p_partkey, CASE WHEN cols >= 45 AND word_cover >= 0.08 THEN 'curriculum' WHEN word_cover >= 0.35 THEN 'generic_markdown' WHEN rows * cols > 16 THEN CASE WHEN raw AND rows >= 10 AND cols BETWEEN 8 AND 30 THEN 'sparse-raw' ELSE 'raw-region' END
  WHEN cell_cover >= 0.2 THEN 'cells' WHEN raw AND rows >= 10 AND cols BETWEEN 8 AND 30 THEN 'sparse-raw' ELSE 'raw-region' END AS output FROM t""")
def table_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table region gives: the first formatter whose coverage suffices, up to 16 cells read one by one, or raw text."""
    key = F.col("p_partkey")
    shaped = table(spark, sf_dir, "part").select("p_partkey", (1 + key % 40).alias("rows"), (1 + key % 50).alias("cols"), (key % 101 / 100).alias("word_cover"), (key % 89 / 100).alias("cell_cover"))
    formatters = {"curriculum": (F.col("cols") >= 45) & (F.col("word_cover") >= 0.08), "generic_markdown": F.col("word_cover") >= 0.35}  # in order of trust
    written = F.coalesce(*(F.when(ok, F.lit(name)) for name, ok in formatters.items()))
    raw = F.when((key % 3 == 0) & (F.col("rows") >= 10) & F.col("cols").between(8, 30), "sparse-raw").otherwise("raw-region")
    cells = F.when((F.col("rows") * F.col("cols") <= 16) & (F.col("cell_cover") >= 0.2), "cells")
    return shaped.select("p_partkey", F.coalesce(written, cells, raw).alias("output"))


_LIFE = """g AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS task, event_id, CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'k' WHEN 'error' THEN 'c' WHEN 'purchase' THEN 'd' ELSE '' END AS kind FROM events),
s AS (SELECT task, string_agg(kind, '' ORDER BY event_id) AS log FROM g GROUP BY task), t AS (SELECT *, regexp_extract(log, '^[^vc]*v(.*)$', 1) AS run FROM s)"""


@query(f"""WITH {_LIFE} SELECT task, CASE WHEN NOT regexp_matches(log, '[vc]') THEN 'queued' WHEN regexp_matches(log, '^[^vc]*c') THEN 'cancelled' WHEN NOT regexp_matches(run, '[cd]') THEN 'running' WHEN regexp_matches(run, '^[^cd]*d') THEN 'completed'
  WHEN regexp_matches(run, '^[^cd]*c.*d') THEN 'cancelled' ELSE 'cancelling' END AS state, CASE WHEN regexp_matches(log, '^[^vc]*v') THEN length(regexp_replace(regexp_extract(run, '^([^cd]*)', 1), '[^k]', '', 'g')) ELSE 0 END::BIGINT AS pages FROM t""")
def task_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with cancellation: a queued one is cancelled at once, a running one when its worker ends; pages count while it runs."""
    return tasks.lifecycles(table(spark, sf_dir, "events"))


@query()
def worker_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as tasks: one worker, three places to wait, first come, first served; the rest is refused."""
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("job"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("bigint").alias("at"), (30 + F.col("o_orderkey") % 400).cast("bigint").alias("takes"))
    return tasks.slots(jobs, workers=1, places=3)


@query("""WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 ELSE 200 END AS first, CASE event_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 500 ELSE 200 END AS again, event_id % 3 = 0 AS html FROM events),
s AS (SELECT event_id, first = 401 AS refreshed, CASE first WHEN 401 THEN again ELSE first END AS status, html FROM r)
SELECT event_id, refreshed, CASE WHEN status = 401 THEN 'UNAUTHORIZED' WHEN status = 403 THEN 'FORBIDDEN' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status <> 200 THEN 'UPSTREAM' WHEN html THEN 'INVALID_RESPONSE' ELSE 'OK' END AS code, status = 429 OR status >= 500 OR status = 200 AND html AS retryable FROM s""")
def provider_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider's answer means; a 401 is tried once more with a new token."""
    k = F.col("event_id")
    first = F.when(k % 7 == 0, 401).when(k % 7 == 1, 403).when(k % 7 == 2, 429).when(k % 7 == 3, 503).when(k % 7 == 4, 404).otherwise(200)
    again, html = F.when(k % 5 == 0, 401).when(k % 5 == 1, 500).otherwise(200), k % 3 == 0
    told = table(spark, sf_dir, "events").select("event_id", (first == 401).alias("refreshed"), F.when(first == 401, again).otherwise(first).alias("status"), html.alias("html"))
    codes = {401: "UNAUTHORIZED", 403: "FORBIDDEN", 429: "RATE_LIMITED"}
    status = F.col("status")
    code = F.coalesce(*(F.when(status == s, c) for s, c in codes.items()), F.when(status != 200, "UPSTREAM"), F.when(F.col("html"), "INVALID_RESPONSE"), F.lit("OK"))
    return told.select("event_id", "refreshed", code.alias("code"), ((status == 429) | (status >= 500) | (status == 200) & F.col("html")).alias("retryable"))


@query("""WITH a AS (SELECT c_custkey, c_custkey % 6 AS k, (c_custkey * 100003 % 120000)::BIGINT AS expires, 60000 AS now FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'remote' WHEN 1 THEN 'remote' ELSE 'built-in' END AS selectors, coalesce(CASE WHEN k IN (0, 3) THEN 'variant-b' END, CASE WHEN k IN (1, 4) THEN 'variant-a' END, 'control') AS variant, expires - 30000 > now AS fresh FROM a""")
def configured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote selectors where all are valid, else the built-in ones; the first variant that is on; tokens good for 30 s more."""
    k = F.col("c_custkey") % 6
    remote = F.array(F.when(k == 0, "div.reply > p").when(k == 1, "#main [data-x]").when(k == 2, "a >> b").when(k == 3, "javascript:void").when(k == 4, "").otherwise(F.repeat(F.lit("x"), 501)), F.lit(".ok"))
    valid = F.forall(remote, lambda s: (F.length(s).between(1, 500)) & ~F.contains(s, F.lit(">>")) & ~F.contains(F.lower(s), F.lit("javascript:")))
    variant = F.coalesce(F.when(k.isin(0, 3), "variant-b"), F.when(k.isin(1, 4), "variant-a"), F.lit("control"))
    expires = F.col("c_custkey") * 100003 % 120000
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(valid, "remote").otherwise("built-in").alias("selectors"), variant.alias("variant"), (expires - 30000 > 60000).alias("fresh"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'auto' WHEN 1 THEN 'gateway' WHEN 2 THEN 'browser' WHEN 3 THEN 'local_tess' WHEN 4 THEN 'local_easy' WHEN 5 THEN 'llm' ELSE 'other' END AS source FROM customer)
SELECT c_custkey, CASE source WHEN 'auto' THEN 'backend_auto_standard' WHEN 'gateway' THEN 'backend_auto_standard' WHEN 'local_tess' THEN 'backend_tesseract_standard' WHEN 'local_easy' THEN 'backend_easyocr_standard' END AS backend, CASE source WHEN 'browser' THEN 'browser_tesseract_dewarp' ELSE 'browser_tesseract_standard' END AS browser FROM s""")
def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by source, from a table of six rows; a source without one has the standard profile in the browser."""
    #: The profiles that sources have.
    rows = [("auto", "backend_auto_standard", None), ("gateway", "backend_auto_standard", None), ("browser", None, "browser_tesseract_dewarp"), ("local_tess", "backend_tesseract_standard", None), ("local_easy", "backend_easyocr_standard", None), ("llm", None, None)]
    names = F.array(*(F.lit(r[0]) for r in rows), F.lit("other"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 7).cast("int")).alias("source"))
    joined = asked.join(F.broadcast(spark.createDataFrame(rows, "source string, backend string, browser string")), "source", "left")
    return joined.select("c_custkey", "backend", F.coalesce("browser", F.lit("browser_tesseract_standard")).alias("browser"))


@query("""WITH p AS (SELECT p_partkey, 100 + p_partkey * 37 % 9000 AS w, 100 + p_partkey * 91 % 12000 AS h, p_partkey % 2 = 0 AS border FROM part),
s AS (SELECT *, least(1.0::DOUBLE, 3200.0::DOUBLE / greatest(w, h), sqrt(8000000.0::DOUBLE / (w * h))) AS f, least(1.0::DOUBLE, 4096.0::DOUBLE / greatest(w, h), sqrt(12000000.0::DOUBLE / (w * h))) AS g FROM p)
SELECT p_partkey, greatest(1, round_even(w * f, 0))::BIGINT + CASE WHEN border THEN 20 ELSE 0 END AS fixture_width, greatest(1, round_even(h * f, 0))::BIGINT + CASE WHEN border THEN 20 ELSE 0 END AS fixture_height, greatest(1, floor(w * g))::BIGINT AS llm_width, greatest(1, floor(h * g))::BIGINT AS llm_height,
  f = 1 AND NOT border AS passthrough FROM s""")
def prepared_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images for offline fixtures (resized, bordered) and for vision models; untouched ones pass through."""
    key = F.col("p_partkey")
    w, h = (100 + key * 37 % 9000).cast("double"), (100 + key * 91 % 12000).cast("double")
    scale = lambda side, area: F.least(F.lit(1.0), side / F.greatest(w, h), F.sqrt(area / (w * h)))
    fixture, model, border = scale(F.lit(3200.0), F.lit(8e6)), scale(F.lit(4096.0), F.lit(12e6)), F.when(key % 2 == 0, 20).otherwise(0)
    even = lambda x: (F.greatest(F.lit(1.0), F.rint(x)).cast("bigint") + border)
    down = lambda x: F.greatest(F.lit(1), F.floor(x)).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", even(w * fixture).alias("fixture_width"), even(h * fixture).alias("fixture_height"), down(w * model).alias("llm_width"), down(h * model).alias("llm_height"), ((fixture == 1) & (border == 0)).alias("passthrough"))


@query("""WITH p AS (SELECT p_partkey, 20 + p_partkey * 37 % 1300 AS w, 20 + p_partkey * 91 % 1400 AS h FROM part)
SELECT p_partkey, CASE WHEN least(w, h) < 240 AND greatest(w, h) <= 900 AND w * h <= 300000 THEN greatest(2, least(4, ceil(600.0::DOUBLE / least(w, h)))) WHEN w BETWEEN 650 AND 900 AND h BETWEEN 900 AND 1300 AND h::DOUBLE / w BETWEEN 1.2 AND 1.7 THEN 2 ELSE 1 END::BIGINT AS scale FROM p""")
def upscale_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much small text and screens of phones are enlarged before they are read."""
    key = F.col("p_partkey")
    sized = table(spark, sf_dir, "part").select("p_partkey", (20 + key * 37 % 1300).alias("w"), (20 + key * 91 % 1400).alias("h"))
    short, long = F.least("w", "h"), F.greatest("w", "h")
    small = (short < 240) & (long <= 900) & (F.col("w") * F.col("h") <= 300_000)
    phone = F.col("w").between(650, 900) & F.col("h").between(900, 1300) & (F.col("h") / F.col("w")).between(1.2, 1.7)
    return sized.select("p_partkey", F.when(small, F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(600 / short)))).when(phone, 2).otherwise(1).cast("bigint").alias("scale"))


@query("""WITH e AS (SELECT event_id, user_id % 12 AS pages, event_id % 13 AS done, event_id % 97 / 97.0::DOUBLE AS within FROM events), p AS (SELECT *, CASE WHEN pages > 0 THEN least(1, (least(done, pages) + within) / pages) ELSE within END AS pct FROM e)
SELECT event_id, CASE WHEN pct >= 0.995 THEN 1.0 WHEN pages = 0 THEN pct ELSE least(0.992, greatest(pct, pct + least(1.0::DOUBLE / pages * 0.12, 0.026), least(pct + 0.045, (least(done, pages) + least(0.96, within + 0.28)) / pages))) END AS shown,
  CASE WHEN done = 0 THEN 'preparing' WHEN pages > 0 THEN 'page ' || least(done, pages) || ' of ' || pages ELSE 'page ' || done END AS label FROM p""")
def shown_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as it is shown: a little ahead of what is done, never at the end before it is, and the page's label."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 12).alias("pages"), (F.col("event_id") % 13).alias("done"), (F.col("event_id") % 97 / 97).alias("within"))
    pages, within, done = F.col("pages"), F.col("within"), F.least("done", "pages")
    told = events.withColumn("pct", F.when(pages > 0, F.least(F.lit(1.0), (done + within) / pages)).otherwise(within))
    pct = F.col("pct")
    ahead = F.least(F.lit(0.992), F.greatest(pct, pct + F.least(F.lit(1.0) / pages * 0.12, F.lit(0.026)), F.least(pct + 0.045, (done + F.least(F.lit(0.96), within + 0.28)) / pages)))
    label = F.when(F.col("done") == 0, "preparing").when(pages > 0, F.concat(F.lit("page "), done.cast("string"), F.lit(" of "), pages.cast("string"))).otherwise(F.concat(F.lit("page "), F.col("done").cast("string")))
    return told.select("event_id", F.when(pct >= 0.995, 1.0).when(pages == 0, pct).otherwise(ahead).alias("shown"), label.alias("label"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END AS t, doc_id % 2 = 0 AS pdf FROM documents), n AS (SELECT *, CASE WHEN NOT pdf THEN 1 WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS pages FROM d)
SELECT doc_id, pages::BIGINT AS pages, CASE WHEN pages = 0 THEN 'contains no pages' WHEN pages > 100 THEN pages || ' pages; limit is 100' END AS problem, CASE WHEN pages BETWEEN 1 AND 100 THEN pages ELSE 0 END::BIGINT AS rendered FROM n""")
def page_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents, a line standing for a page: an image is one page; no pages or over 100 are an error, not rows."""
    pdf = F.col("doc_id") % 2 == 0
    told = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    pages = F.when(~pdf, 1).when(told == "", 0).otherwise(F.size(F.split(told, "\n")))
    counted = table(spark, sf_dir, "documents").select("doc_id", pages.cast("bigint").alias("pages"))
    problem = F.when(F.col("pages") == 0, "contains no pages").when(F.col("pages") > 100, F.concat(F.col("pages").cast("string"), F.lit(" pages; limit is 100")))
    return counted.select("doc_id", "pages", problem.alias("problem"), F.when(F.col("pages").between(1, 100), F.col("pages")).otherwise(0).alias("rendered"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(10), chr(12)), chr(12))) AS page, unnest(range(len(string_split(replace(coalesce(text, ''), chr(10), chr(12)), chr(12))))) AS no FROM documents),
u AS (SELECT *, regexp_replace(page, '\s+$', '') AS kept, length(trim(regexp_replace(page, '\s+', ' ', 'g'))) >= 200 AND len(regexp_extract_all(page, '[A-Za-zА-Яа-яЁё]{3,}')) >= 20 AS usable FROM l)
SELECT doc_id, no::BIGINT AS no, md5(kept) AS page_md5 FROM (SELECT *, avg(usable::INT) OVER (PARTITION BY doc_id) AS part FROM u) x WHERE part >= 0.5""")
def text_layer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text layers cut at form feeds, right-trimmed; all pages of a document if half of them are usable, else none."""
    pages = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\f")), "\f")
    told = table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"))
    usable = F.filter("pages", lambda p: text.usable_page(p))
    kept = told.where(2 * F.size(usable) >= F.size("pages")).select("doc_id", F.posexplode("pages").alias("no", "page"))
    return kept.select("doc_id", F.col("no").cast("bigint").alias("no"), F.md5(F.regexp_replace("page", r"\s+$", "").cast("binary")).alias("page_md5"))


@query("SELECT doc_id, md5(base64(encode(coalesce(text, '')))) AS base64_md5 FROM documents")
def encoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as base64 without line ends."""
    packed = F.replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\r\n"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(packed.cast("binary")).alias("base64_md5"))


@query("""WITH e AS (SELECT user_id, event_id, event_type AS profile, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS held, lag(event_id % 4 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS busy FROM events)
SELECT user_id, event_id, CASE WHEN held IS NULL THEN 'create' WHEN busy THEN 'fresh' WHEN held = profile THEN 'reuse' ELSE 'replace' END AS session FROM e""")
def cached_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request finds a recogniser's session: the last one serves its own profile unless it is busy."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    held = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(order).alias("held"), F.lag(F.col("event_id") % 4 == 0).over(order).alias("busy"))
    return held.select("user_id", "event_id", F.when(F.col("held").isNull(), "create").when(F.col("busy"), "fresh").when(F.col("held") == F.col("event_type"), "reuse").otherwise("replace").alias("session"))


@query("SELECT conv_id, string_agg(role || ': ' || turn, chr(10) ORDER BY turn) AS text, count(*) AS items FROM conversations GROUP BY conv_id")
def recogniser_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a recogniser's answer joined by line, in order."""
    items = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.col("turn").cast("string")).alias("text"))))
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("items"))
    return told.select("conv_id", F.array_join(F.transform("items", lambda i: i["text"]), "\n").alias("text"), F.size("items").cast("bigint").alias("items"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'sample a' WHEN 1 THEN 'sample b' END AS sample FROM customer""")
def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by file name, from a table of two rows."""
    samples = spark.createDataFrame([("a.png", "sample a"), ("b.pdf", "sample b")], "file string, sample string")
    k = F.col("c_custkey") % 5
    files = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "a.png").when(k == 1, "b.pdf").otherwise("c.jpg").alias("file"))
    return files.join(F.broadcast(samples), "file", "left").select("c_custkey", "sample")


#: Plan sections, and the shape of their elective groups.
SECTIONS, ELECTIVES = ("Б1", "Б1.О", "Б1.В"), r"^Б1\.[ОВ]\.ДВ(\.[0-9]+)?$"
_CODES = ("Б1", "Б1.О.01", "Б1.В.ДВ.2", "Б1.О.", "x", "Б1.В.ДВ.2.1", " Б1.В ", "ФТД.007", "")


@query(r"""WITH c AS (SELECT p_partkey, trim(['Б1', 'Б1.О.01', 'Б1.В.ДВ.2', 'Б1.О.', 'x', 'Б1.В.ДВ.2.1', ' Б1.В ', 'ФТД.007', ''][1 + p_partkey % 9]) AS v FROM part), n AS (SELECT *, v IN ('Б1', 'Б1.О', 'Б1.В') OR regexp_matches(v, '^Б1\.[ОВ]\.ДВ(\.[0-9]+)?$') AS section, regexp_extract(v, '^(.*\.)[0-9]+$', 1) AS prefix, regexp_extract(v, '^.*\.([0-9]+)$', 1) AS digits FROM c)
SELECT p_partkey, section, nullif(prefix, '') AS prefix, try_cast(nullif(digits, '') AS BIGINT) AS number, nullif(length(digits), 0)::BIGINT AS width FROM n""")
def plan_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of plan rows: whether they name a section, and the prefix, number and width of a numbered one."""
    code = F.trim(F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES)).cast("int")))
    part = lambda k: F.nullif(F.regexp_extract("code", r"^(.*\.)([0-9]+)$", k), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return rows.select("p_partkey", (F.col("code").isin(*SECTIONS) | F.col("code").rlike(ELECTIVES)).alias("section"), part(1).alias("prefix"), part(2).cast("bigint").alias("number"), F.length(part(2)).cast("bigint").alias("width"))


@query(r"""WITH p AS (SELECT doc_id, doc_id % 5 AS k, trim(coalesce(text, '')) AS t FROM documents),
q AS (SELECT doc_id, trim(CASE k WHEN 0 THEN t WHEN 1 THEN '0000 1111 2222 ' || regexp_replace(substr(t, 1, 60), '[a-zA-Z]', '7', 'g') WHEN 2 THEN t || chr(1) || chr(2) WHEN 3 THEN '' ELSE upper(t) || ' 00000' END) AS native, CASE WHEN doc_id % 7 = 0 THEN '' ELSE t END AS ocr FROM p),
l AS (SELECT *, list_filter(string_split(native, chr(10)), lambda x: trim(x) <> '')[1:6] AS nl, list_filter(string_split(ocr, chr(10)), lambda x: trim(x) <> '')[1:6] AS ol, length(native)::DOUBLE AS n FROM q),
s AS (SELECT doc_id, native, ocr, n, length(native) - length(regexp_replace(native, '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) + length(native) - length(regexp_replace(native, '[ÃÂÐ]', '', 'g')) + len(regexp_extract_all(native, 'Ñ[\x{80}-\x{bf}]')) AS art,
  n - length(regexp_replace(native, '\p{L}', '', 'g')) AS let, n - length(regexp_replace(native, '\p{N}', '', 'g')) AS dig, n - length(replace(native, '0', '')) AS zer, n - length(regexp_replace(native, '[\s\x0b.,;:!?()\[\]{}"''«»“”‘’\-–—+*/=%№#@&<>|\\$_€£¥₽]', '', 'g')) AS mar,
  len(regexp_extract_all(native, '0{4,}|1{4,}|2{4,}|3{4,}|4{4,}|5{4,}|6{4,}|7{4,}|8{4,}|9{4,}')) AS runs,
  list_distinct(regexp_extract_all(lower(array_to_string(nl, chr(10))), '\p{L}[\p{L}\p{N}]+|\p{N}{2,}')) AS a, list_distinct(regexp_extract_all(lower(array_to_string(ol, chr(10))), '\p{L}[\p{L}\p{N}]+|\p{N}{2,}')) AS b FROM l)
SELECT doc_id, CASE WHEN native = '' THEN FALSE WHEN ocr = '' THEN TRUE WHEN art >= 2 OR art > 0.01 * n OR let + dig + mar < 0.72 * n OR let + dig < 0.18 * n THEN FALSE
  WHEN len(a) >= 4 AND len(b) >= 4 AND (let + dig + mar < 0.86 * n OR let + dig < 0.35 * n OR runs >= 2 OR zer > 0.12 * n OR dig + mar > 0.62 * n AND let < 0.28 * n) AND len(list_intersect(a, b)) < 0.08 * least(len(a), len(b)) THEN FALSE ELSE TRUE END AS trusted FROM s""")
def native_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's native text is to be trusted: no artifacts, readable, and, where it looks odd, tokens shared with what
    was recognised, by the first six lines of both."""
    t, k = F.trim(F.coalesce("text", F.lit(""))), F.col("doc_id") % 5
    odd = F.concat(F.lit("0000 1111 2222 "), F.regexp_replace(F.substring(t, 1, 60), "[a-zA-Z]", "7"))
    native = F.when(k == 0, t).when(k == 1, odd).when(k == 2, F.concat(t, F.lit("\x01\x02"))).when(k == 3, "").otherwise(F.concat(F.upper(t), F.lit(" 00000")))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.trim(native).alias("native"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(t).alias("ocr"))
    lines = lambda c: F.array_join(F.slice(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), 1, 6), "\n")
    told = pages.select("doc_id", "native", "ocr", F.struct(*(c.alias(n) for n, c in text.readable_counts(F.col("native")).items())).alias("s"), text.token_set(lines("native")).alias("a"), text.token_set(lines("ocr")).alias("b"))
    s = F.col("s")
    n, words, readable = s["chars"], s["letters"] + s["digits"], s["letters"] + s["digits"] + s["marks"]
    bad = (s["artifacts"] >= 2) | (s["artifacts"] > 0.01 * n) | (readable < 0.72 * n) | (words < 0.18 * n)
    strange = (readable < 0.86 * n) | (words < 0.35 * n) | (s["digit_runs"] >= 2) | (s["zeros"] > 0.12 * n) | ((s["digits"] + s["marks"] > 0.62 * n) & (s["letters"] < 0.28 * n))
    apart = (F.size("a") >= 4) & (F.size("b") >= 4) & (text.overlap_ratio(F.col("a"), F.col("b")) < 0.08)
    return told.select("doc_id", F.when(F.col("native") == "", False).when(F.col("ocr") == "", True).otherwise(~bad & ~(strange & apart)).alias("trusted"))


@query("""WITH g AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS task, event_id, event_type FROM events)
SELECT task, count(*) AS events, CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN 'complete' WHEN bool_or(event_type = 'purchase') THEN 'events-after-complete' ELSE 'ended-early' END AS verdict FROM g GROUP BY task""")
def log_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event log ends in its complete event, as a reader of logs demands."""
    log = tasks.task_log(table(spark, sf_dir, "events"))
    told = log.groupBy("task").agg(F.count("*").alias("events"), F.max_by("kind", "event_id").alias("last"), F.max(F.col("kind") == "complete").alias("completed"))
    verdict = F.when(F.col("last") == "complete", "complete").when(F.col("completed"), "events-after-complete").otherwise("ended-early")
    return told.select("task", "events", verdict.alias("verdict"))


@query("""SELECT s_nationkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(s_name, '|', '\\|') || ' | ' || s_suppkey || ' |', chr(10) ORDER BY s_suppkey) AS report, count(*) AS rows FROM supplier GROUP BY s_nationkey""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report as a Markdown table, one for each nation."""
    line = F.concat(F.lit("| "), F.replace(F.col("s_name"), F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("s_suppkey").cast("string"), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda r: r["line"])
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(lines.alias("lines"))
    return rows.select("s_nationkey", F.concat(F.lit("| name | key |\n| --- | --- |\n"), F.array_join("lines", "\n")).alias("report"), F.size("lines").cast("bigint").alias("rows"))


@query("""WITH f AS (SELECT c_custkey, lower(c_mktsegment) || '/' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.jpg' END AS file FROM customer)
SELECT file, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY file) AS place FROM f WHERE regexp_matches(lower(file), '\\.(png|jpg|jpeg|pdf)$') AND (file LIKE '%/1%' OR file LIKE '%5.%')""")
def fixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of supported kinds that one of several globs takes, in the order of their names within a folder."""
    k = F.col("c_custkey")
    name = F.concat(F.lower("c_mktsegment"), F.lit("/"), k.cast("string"), F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".txt").otherwise(".jpg"))
    files = table(spark, sf_dir, "customer").select(name.alias("file"))
    taken = F.col("file").like("%/1%") | F.col("file").like("%5.%")
    order = Window.partitionBy(F.split_part("file", F.lit("/"), F.lit(1))).orderBy("file")
    return files.where(F.lower("file").rlike(r"\.(png|jpg|jpeg|pdf)$") & taken).select("file", F.row_number().over(order).cast("bigint").alias("place"))
