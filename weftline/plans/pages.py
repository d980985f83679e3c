"""Page, table, profile and payload queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import rasters, words
from weftline.plans.layout import _raster
from weftline.plans.registry import query
from weftline.session import table


@query("""WITH p AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations),
e AS (SELECT conv_id, page, 0 AS k, 'progress' AS kind FROM p UNION ALL SELECT conv_id, page, 1, 'warning' FROM p WHERE page % 7 = 0 UNION ALL SELECT conv_id, page, 2, 'page' FROM p UNION ALL SELECT conv_id, n + 1, 3, 'complete' FROM p WHERE page = n)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page, k) - 1 AS seq, kind FROM e""")
def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a document's pages: progress, a warning where the page is empty (every seventh here), page; then complete."""
    each = Window.partitionBy("conv_id")
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(each.orderBy("turn")).alias("page"), F.count("*").over(each).alias("n"))
    kinds = F.array_compact(F.array(F.lit("progress"), F.when(F.col("page") % 7 == 0, "warning"), F.lit("page"), F.when(F.col("page") == F.col("n"), "complete")))
    events = pages.select("conv_id", "page", F.posexplode(kinds).alias("k", "kind"))
    return events.select("conv_id", (F.row_number().over(each.orderBy("page", "k")) - 1).cast("bigint").alias("seq"), "kind")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (contains(line, ' the ') AND contains(line, ' of ')) AS together, count(*) FILTER (contains(line, ' the ')) AS named FROM l GROUP BY doc_id""")
def pair_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a name, and those that hold its value as well."""
    lines = words.lines(table(spark, sf_dir, "documents")).groupBy("doc_id")
    name, value = F.contains("line", F.lit(" the ")), F.contains("line", F.lit(" of "))
    return lines.agg(F.count_if(name & value).alias("together"), F.count_if(name).alias("named"))


_RUNS = """r AS (SELECT vec_id // 64 AS block, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 255)))::INT AS value FROM embeddings),
i AS (SELECT block, y, x - row_number() OVER (PARTITION BY block, y ORDER BY x) AS run FROM r WHERE value < 128),
c AS (SELECT block, y, run, count(*) AS n FROM i GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT block, y, max(n) AS longest, count(*) AS runs FROM c GROUP BY block, y")
def dark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dark run of each raster row and how many there are."""
    dark = _raster(spark, sf_dir).where("value < 128")
    runs = dark.withColumn("run", F.col("x") - F.row_number().over(Window.partitionBy("block", "y").orderBy("x"))).groupBy("block", "y", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("block", "y").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


@query("""WITH r AS (SELECT vec_id // 64 AS block, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 0.5) * 255)))::INT AS value FROM embeddings)
SELECT block, count(*) FILTER (value < 220) AS ink, count(*) FILTER (value > 30) AS bright, count(*) AS pixels FROM r GROUP BY block""")
def ink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raster(spark, sf_dir).groupBy("block").agg(F.count_if(F.col("value") < 220).alias("ink"), F.count_if(F.col("value") > 30).alias("bright"), F.count("*").alias("pixels"))


@query()
def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.components(_raster(spark, sf_dir), "block", 60)


@query()
def horizontal_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four rows a character cut at line ends, into bands of 300 to 1200 rows."""

    @F.pandas_udf("array<struct<top:long,bottom:long>>")
    def cut(heights: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([[{"top": a, "bottom": b} for a, b in rasters.bands(int(h), [int(x) for x in c], [], 300, 1200)] for h, c in zip(heights, cuts, strict=True)])

    parts = F.split("text", "\n")
    ends = F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda out, line: F.array_append(out, F.element_at(out, -1) + 4 * (F.length(line) + 1)))
    pages = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", (F.col("n_chars") * 4).alias("h"), ends.alias("ends"))
    return pages.select("doc_id", F.inline(cut("h", "ends")))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, trim(unnest(string_split(text, chr(10)))) AS line FROM (SELECT doc_id, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | y |' || chr(10) || text || chr(10) || '| c |' AS text FROM documents) x),
p AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS tab FROM l WHERE line LIKE '|%|' AND length(line) > 1),
r AS (SELECT doc_id, tab, n, line FROM p WHERE NOT regexp_matches(line, '^\\|?\\s*:?-{3,}:?\\s*(\\|\\s*:?-{3,}:?\\s*)*\\|?$'))
SELECT doc_id, min(n)::BIGINT AS first_line, count(*) AS rows, max(len(string_split(line, '|')) - 2)::BIGINT AS columns FROM r GROUP BY doc_id, tab""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a text: runs of pipe lines without their separators, and their shapes."""
    framed = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.col("doc_id").cast("string"), F.lit(" | y |\n"), "text", F.lit("\n| c |"))
    lines = words.lines(table(spark, sf_dir, "documents").select("doc_id", framed.alias("text"))).withColumn("line", F.trim("line"))
    pipes = lines.where(F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 1))
    tables = pipes.withColumn("tab", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    rows = tables.where(~F.col("line").rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$"))
    shape = rows.groupBy("doc_id", "tab").agg(F.min("line_no").cast("bigint").alias("first_line"), F.count("*").alias("rows"), F.max(F.size(F.split("line", r"\|")) - 2).cast("bigint").alias("columns"))
    return shape.select("doc_id", "first_line", "rows", "columns")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_name <> '' THEN 'name: ' || c_name END, CASE WHEN c_custkey % 3 <> 0 THEN 'segment: ' || c_mktsegment END, 'nation: ' || c_nationkey], lambda x: x IS NOT NULL), '; ') AS card FROM customer""")
def key_value_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'label: value' parts joined, blanks left out."""
    fields = F.array(F.concat(F.lit("name: "), F.nullif("c_name", F.lit(""))), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("segment: "), "c_mktsegment")), F.concat(F.lit("nation: "), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_compact(fields), "; ").alias("card"))


@query(r"""SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') AS base, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def normalised_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without query, fragment and closing slashes, and their hosts."""
    base = F.regexp_replace(F.split_part(F.split_part(F.trim("url"), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'detail ' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'msg ' || event_id END, 'unknown') AS message FROM events""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first string of an error payload, by the order in which fields are trusted."""
    kind = F.col("event_id") % 3
    payload = F.when(kind == 0, F.concat(F.lit('{"detail": "detail '), "event_id", F.lit('", "reason": "r"}'))).when(kind == 1, F.concat(F.lit('{"error": {"msg": "msg '), "event_id", F.lit('"}}'))).otherwise("{}")
    found = [F.get_json_object("payload", path) for path in ("$.detail", "$.error.message", "$.error.msg", "$.message", "$.reason", "$.errors[0].msg")]
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload")).select("event_id", F.coalesce(*found, F.lit("unknown")).alias("message"))


@query("""SELECT c_custkey, coalesce(nullif(array_to_string(list_filter(['eng', 'rus', 'kaz', 'chi_sim'], lambda x: (x = 'eng' AND c_custkey % 2 = 0) OR (x = 'rus' AND c_custkey % 3 = 0) OR (x = 'chi_sim' AND c_custkey % 5 = 0)), '+'), ''), 'eng') AS languages FROM customer""")
def language_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed languages in order of priority, joined; English where none is installed."""
    key = F.col("c_custkey")
    installed = F.array_compact(F.array(F.when(key % 5 == 0, "chi_sim"), F.when(key % 2 == 0, "eng"), F.when(key % 3 == 0, "rus")))
    order = F.array(*map(F.lit, ("eng", "rus", "kaz", "chi_sim")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif(F.array_join(F.filter(order, lambda x: F.array_contains(installed, x)), "+"), F.lit("")), F.lit("eng")).alias("languages"))


@query("""SELECT p_partkey, floor(w * s)::BIGINT AS width, floor(h * s)::BIGINT AS height FROM (SELECT *, least(1, 4200.0::DOUBLE / greatest(w, h), sqrt(8000000.0::DOUBLE / (w * h))) AS s FROM (SELECT p_partkey, 1 + p_partkey * 37 % 9000 AS w, 1 + p_partkey * 91 % 12000 AS h FROM part) x) y""")
def bounded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes scaled down so that neither a side nor the area is over its limit."""
    w, h = 1 + F.col("p_partkey") * 37 % 9000, 1 + F.col("p_partkey") * 91 % 12000
    scale = F.least(F.lit(1.0), 4200 / F.greatest(w, h), F.sqrt(8_000_000 / (w * h)))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(w * scale).alias("width"), F.floor(h * scale).alias("height"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, k <= 8 AS admitted, CASE WHEN k <= 8 THEN k END AS place FROM o""")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission to queues of eight places that nothing leaves: first come, first served, the rest refused."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    queued = table(spark, sf_dir, "orders").select("o_orderkey", place.alias("k"))
    return queued.select("o_orderkey", (F.col("k") <= 8).alias("admitted"), F.when(F.col("k") <= 8, F.col("k")).alias("place"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE / count(*) OVER (PARTITION BY user_id) AS p FROM events),
s AS (SELECT *, min(CASE WHEN p >= 0.02 THEN t END) OVER (PARTITION BY user_id) AS began FROM e)
SELECT user_id, event_id, CASE WHEN p < 0.02 THEN NULL WHEN p >= 0.995 THEN 0 ELSE round((t - began) / 1000000.0::DOUBLE * (1 - p) / p, 3) END AS eta FROM s""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left by the share done so far: none below two per cent, nothing from 99.5."""
    each = Window.partitionBy("user_id")
    done = F.row_number().over(each.orderBy("event_id")) / F.count("*").over(each)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), done.alias("p"))
    began = F.min(F.when(F.col("p") >= 0.02, F.col("t"))).over(each)
    eta = F.round((F.col("t") - began) / 1_000_000 * (1 - F.col("p")) / F.col("p"), 3)
    return events.select("user_id", "event_id", F.when(F.col("p") >= 0.995, 0.0).when(F.col("p") >= 0.02, eta).alias("eta"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'fast' WHEN l_returnflag = 'A' THEN 'quality' END AS profile, l_returnflag = 'N' AS rejected FROM lineitem""")
def resolved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles looked up by name in a dimension table; rows with an unknown name are marked as rejected."""
    profiles = spark.createDataFrame([("R", "fast"), ("A", "quality")], "l_returnflag string, profile string")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(F.broadcast(profiles), "l_returnflag", "left")
    return found.select("l_orderkey", "l_linenumber", "profile", F.col("profile").isNull().alias("rejected"))


@query(r"""WITH b AS (SELECT doc_id, trim(text) AS n, 'OCR ' || trim(text) AS o, doc_id % 3 AS k FROM documents),
f AS (SELECT doc_id, CASE k WHEN 0 THEN n WHEN 1 THEN '' ELSE n || chr(1) || chr(2) END AS native, CASE k WHEN 0 THEN n ELSE o END AS ocr FROM b)
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN native ELSE ocr END) AS merged_md5 FROM f""")
def native_or_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native text where it can be trusted, and recognised text unless it says the same.

    A third of the documents have both readings equal, a third no native one, a third two control characters in it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("n"), (F.col("doc_id") % 3).alias("k"))
    native = F.when(F.col("k") == 0, F.col("n")).when(F.col("k") == 1, "").otherwise(F.concat("n", F.lit("\x01\x02")))
    both = docs.select("doc_id", native.alias("native"), F.when(F.col("k") == 0, F.col("n")).otherwise(F.concat(F.lit("OCR "), "n")).alias("ocr"))
    counts = text.readable_counts(F.col("native"))
    readable = counts["letters"] + counts["digits"] + counts["marks"]
    trusted = (F.col("native") != "") & (counts["artifacts"] < 2) & (counts["artifacts"] <= 0.01 * counts["chars"]) & (readable >= 0.72 * counts["chars"]) & (counts["letters"] + counts["digits"] >= 0.18 * counts["chars"])
    same = lambda c: F.trim(F.regexp_replace(text.squeeze(F.lower(c)), r"[^\p{L}\p{N} ]", ""))
    repeated = trusted & (same("native") != "") & (same("ocr") != "") & F.contains(same("native"), same("ocr"))
    parts = F.array(F.when(trusted, F.col("native")), F.when(~repeated & (F.col("ocr") != ""), F.col("ocr")))
    return both.select("doc_id", F.md5(F.array_join(F.array_compact(parts), "\n\n")).alias("merged_md5"))
