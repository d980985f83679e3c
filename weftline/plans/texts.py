"""Text queries: normalisation, dedup, quality, redaction, HTML, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import folds, text
from weftline.operators import words
from weftline.plans.registry import query
from weftline.session import table


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.xxhash64(text.dedupe_key(F.col("text"))).alias("hash"), F.sha2(text.dedupe_key(F.col("text")), 256).alias("key")
    return table(spark, sf_dir, "documents").groupBy(key[1]).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS lines FROM (
  SELECT doc_id, key, min(pos) AS pos, arg_min(line, pos) AS line FROM k WHERE key <> '' GROUP BY doc_id, key) x GROUP BY doc_id""")
def dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = words.lines(table(spark, sf_dir, "documents")).withColumn("key", text.dedupe_key(F.col("line"))).where("key != ''")
    first = keyed.groupBy("doc_id", "key").agg(F.min(F.struct("line_no", "line")).alias("first"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["line"]), "\n")
    return first.groupBy("doc_id").agg(joined.alias("text"), F.count("*").alias("lines"))


@query(r"""
SELECT doc_id, length(s) AS chars FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) x
WHERE length(s) >= 200 AND len(regexp_extract_all(s, '[A-Za-zА-Яа-яЁё]{3,}')) >= 20""")
def usable_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(text.usable_page(F.col("text")))
    return docs.select("doc_id", F.length(text.squeeze(F.col("text"))).cast("bigint").alias("chars"))


@query(r"""
WITH p AS (SELECT source, doc_id, text, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 200
  AND len(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[A-Za-zА-Яа-яЁё]{3,}')) >= 20 THEN 1 ELSE 0 END AS ok FROM documents),
g AS (SELECT source, count(*) AS pages, sum(ok) AS usable FROM p GROUP BY source)
SELECT p.doc_id, p.source, g.pages, g.usable::BIGINT AS usable FROM p JOIN g ON p.source = g.source WHERE g.usable * 2 >= g.pages""")
def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the sources of which half or more pages are usable."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", text.usable_page(F.col("text")).cast("int").alias("ok"))
    gate = pages.groupBy("source").agg(F.count("*").alias("pages"), F.sum("ok").alias("usable")).where("usable * 2 >= pages")
    return pages.join(gate, "source").select("doc_id", "source", "pages", "usable")


@query(r"""
SELECT doc_id, length(text) AS chars, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
  length(text) - length(regexp_replace(text, '\p{N}', '', 'g')) AS digits, length(text) - length(replace(text, '0', '')) AS zeros,
  length(text) - length(regexp_replace(text, '[\s.,;:!?()\[\]{}"''«»“”‘’\-–—+*/=%№#@&<>|\\$_€£¥₽]', '', 'g')) AS marks,
  length(text) - length(regexp_replace(text, '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) + length(text) - length(regexp_replace(text, '[ÃÂÐ]', '', 'g')) + len(regexp_extract_all(text, 'Ñ[\x{80}-\x{bf}]')) AS artifacts,
  len(regexp_extract_all(text, '0{4,}|1{4,}|2{4,}|3{4,}|4{4,}|5{4,}|6{4,}|7{4,}|8{4,}|9{4,}')) AS digit_runs
FROM documents""")
def readable_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.readable_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("bigint").alias(k) for k, c in counts.items()))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}]+|\p{N}{2,}')) AS toks FROM conversations),
p AS (SELECT conv_id, turn, toks, lag(toks) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
SELECT conv_id, turn, len(list_intersect(toks, prev))::BIGINT AS shared, least(len(toks), len(prev))::BIGINT AS smaller FROM p WHERE prev IS NOT NULL""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a turn shares with the one before it, against the smaller set."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("toks"))
    pairs = turns.withColumn("prev", F.lag("toks").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev IS NOT NULL")
    return pairs.select("conv_id", "turn", F.size(F.array_intersect("toks", "prev")).cast("bigint").alias("shared"), F.least(F.size("toks"), F.size("prev")).cast("bigint").alias("smaller"))


@query(r"""
SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'),
  '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
  '(?i)\b(api[_-]?key|token|authorization)\s*[:=]\s*[^\s,;]+', '\1=[REDACTED]', 'g'),
  '\b(?:[0-9][ -]?){13,19}\b', '[REDACTED-PAN]', 'g'), 2000) AS safe FROM documents""")
def redact_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("safe"))


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace({}, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '\s+', ' ', 'g'))"""


@query("SELECT page_id, " + _STRIP.format(r"regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1)") + " AS text FROM pages")
def strip_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


_NO_TITLE = r"regexp_replace(html, '(?i)<title[^>]*>[\s\S]*?</title>', '', 'g')"


@query("SELECT page_id, " + _STRIP.format(rf"CASE WHEN regexp_matches({_NO_TITLE}, '(?i)<body[^>]*>[\s\S]*?</body>') THEN regexp_extract({_NO_TITLE}, '(?i)<body[^>]*>([\s\S]*?)</body>', 1) ELSE {_NO_TITLE} END") + " AS text FROM pages")
def strip_html_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?i)<title[^>]*>[\s\S]*?</title>", "")
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(bare).alias("text"))


@query(r"""
SELECT doc_id, list_extract(regexp_extract_all(text, '([0-9]+[.,]?[0-9]*)\s*(₽|р|руб|\$|€)', 1), -1) || ' ' || list_extract(regexp_extract_all(text, '([0-9]+[.,]?[0-9]*)\s*(₽|р|руб|\$|€)', 2), -1) AS price,
  list_extract(regexp_extract_all(text, '([0-9]+)\s*(шт|г|кг|мл|л)', 1), 1) || ' ' || list_extract(regexp_extract_all(text, '([0-9]+)\s*(шт|г|кг|мл|л)', 2), 1) AS quantity FROM documents""")
def price_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.last_price(F.col("text")).alias("price"), text.first_quantity(F.col("text")).alias("quantity"))


_MARKED = "text || chr(10) || '  • item ' || doc_id || chr(10) || chr(10) || chr(10) || '– two' || chr(10) || '3.third' || chr(10) || '+ four  '"


@query(rf"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace({_MARKED}, '[•·●]', '-', 'g'), '[—–−]', '-', 'g') AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda s: trim(s)) AS ls FROM t),
m AS (SELECT doc_id, array_to_string(list_transform(ls, lambda s: CASE WHEN regexp_matches(s, '^[-+*] ') THEN '- ' || trim(s[2:]) WHEN regexp_matches(s, '^[0-9]\..') THEN '- ' || trim(s[3:]) ELSE s END), chr(10)) AS j FROM l)
SELECT doc_id, regexp_replace(regexp_replace(j, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS markdown FROM m""")
def format_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with list lines of all kinds after it, formatted."""
    marked = F.expr(_MARKED.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown(marked).alias("markdown"))


@query(r"""
SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS every_page,
  string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS filled_pages, count(*) AS pages FROM conversations GROUP BY conv_id""")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document in order, with and without the blank ones."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"])
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pages.alias("texts"), F.count("*").alias("pages"))
    rule = "\n\n---\n\n"
    return found.select("conv_id", F.array_join("texts", rule).alias("every_page"), F.array_join(F.filter("texts", lambda t: F.trim(t) != ""), rule).alias("filled_pages"), "pages")


@query(r"""
SELECT conv_id, string_agg('**' || role || ':**' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def messages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible messages of a content tree: a root for each conversation, its turns below; system turns are hidden."""
    shown = table(spark, sf_dir, "conversations").where("role != 'system'")
    told = F.concat(F.lit("**"), "role", F.lit(":**\n\n"), "text")
    return shown.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", told.alias("told")))), lambda m: m["told"]), "\n\n---\n\n").alias("markdown"))


@query(r"""
SELECT doc_id, (i - 1) // 500 AS chunk, substring(text, i, 500) AS part FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 500)) AS i FROM documents) x""")
def unicode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 500)).alias("chunk", "part")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "part")


_FOLD = "replace(replace(lower(text), 'ß', 'ss'), 'ё', 'е')"


@query(rf"""
SELECT doc_id, md5(regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS compact_md5,
  md5(translate(regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}]+', '', 'g'), '{text.CONFUSABLE_FROM}', '{text.CONFUSABLE_TO}')) AS folded_md5,
  len(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}_]+(?:[.+:/-][\p{{L}}\p{{N}}_]+)*'))::BIGINT AS tokens FROM documents""")
def compared_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms under which texts are compared: compact, with confusable letters folded, and as tokens."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(t)).alias("compact_md5"), F.md5(text.fold_confusables(text.compact(t))).alias("folded_md5"), F.size(text.tokens(t)).cast("bigint").alias("tokens"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ё', 'е'), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents)
SELECT doc_id, len(list_filter(range(1, length(t) + 1), lambda i: i = 1 OR t[i] <> t[i - 1]))::INT AS squashed_chars FROM c""")
def squashed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one character as that character."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.squash(text.compact(F.col("text")))).alias("squashed_chars"))


@query()
def overlap_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document cut into chunks of 8 that share 3 lines, and merged again."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ls") - 3, F.lit(1)), F.lit(5))
    chunked = lines.select("doc_id", "ls", F.transform(starts, lambda k: F.slice("ls", k, F.lit(8))).alias("cs"))
    return chunked.select("doc_id", folds.overlap_merge(F.col("cs")).alias("merged"), F.size("cs").alias("chunks"))


@query(r"""
SELECT doc_id, CASE WHEN h LIKE '255044462D%' THEN 'application/pdf' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' END AS kind, length(h)::BIGINT AS digits FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '255044462D' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FF' ELSE '' END || hex(encode(text)) AS h FROM documents) x""")
def sniffed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types of documents that got a signature in front of their bytes."""
    signature = F.when(F.col("doc_id") % 4 == 0, "255044462D").when(F.col("doc_id") % 4 == 1, "89504E470D0A1A0A").when(F.col("doc_id") % 4 == 2, "FFD8FF").otherwise("")
    content = F.concat(F.unhex(signature), F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", text.sniff(content).alias("kind"), (2 * F.length(content)).cast("bigint").alias("digits"))


@query(r"""
SELECT page_id, p::BIGINT AS page FROM (SELECT page_id, unnest(list_concat([1], list_concat([3 + page_id % 2], range(5, 8 + page_id % 3)))) AS p FROM pages) x""")
def page_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors such as '1,3,5-7' as a row for each page."""
    pages = table(spark, sf_dir, "pages")
    selector = F.concat(F.lit("1,"), (3 + F.col("page_id") % 2).cast("string"), F.lit(",5-"), (7 + F.col("page_id") % 3).cast("string"))
    parts = pages.select("page_id", F.explode(F.split(selector, ",")).alias("part"))
    ends = F.split("part", "-")
    return parts.select("page_id", F.explode(F.sequence(ends[0].cast("bigint"), F.element_at(ends, -1).cast("bigint"))).alias("page"))
