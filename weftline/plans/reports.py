"""Report queries: thresholds, gates, pivots, sweeps, severities, profiles, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import table

#: Acceptance thresholds in per cent.
IMAGE_THRESHOLD, PDF_THRESHOLD = 87, 90
METHODS = ("click", "view", "purchase")


def threshold(file: Column) -> Column:
    """Least match of a file: that of its PDF where it is a page raster of one."""
    base = F.coalesce(F.nullif(F.regexp_extract(file, r"(?i)^(.+\.pdf)(?:\.page-[0-9]{3})?\.raster\.(?:png|jpg)$", 1), F.lit("")), file)
    return F.when(F.lower(base).endswith(".pdf"), PDF_THRESHOLD).otherwise(IMAGE_THRESHOLD)


def gate(percent: Column, least: Column) -> Column:
    return F.when(percent.isNull(), "n/a").when(percent >= least, "pass").otherwise("fail")


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, method, matched, total: events of a user by type stand for a file's lines by method."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    file = F.concat(F.lit("f"), user.cast("string"), F.when(user % 3 == 0, ".png").when(user % 3 == 1, ".pdf").otherwise(".pdf.page-001.raster.png"))
    return events.groupBy(file.alias("file"), F.col("event_type").alias("method")).agg(F.count_if(F.col("event_id") % 11 != 0).alias("matched"), F.count("*").alias("total"))


_COMPARISON = """c AS (SELECT 'f' || user_id || CASE user_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' ELSE '.pdf.page-001.raster.png' END AS file, event_type AS method,
  count(*) FILTER (event_id % 11 <> 0) AS matched, count(*) AS total FROM events GROUP BY ALL),
p AS (SELECT file, method, (10000 * matched // total) AS basis, CASE WHEN regexp_matches(file, '(?i)\\.pdf') THEN 90 ELSE 87 END AS threshold FROM c)"""


@query(f"WITH {_COMPARISON} " + "SELECT file, max(threshold)::BIGINT AS threshold, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN basis END)::BIGINT AS {m}, coalesce(max(CASE WHEN method = '{m}' THEN CASE WHEN basis >= 100 * threshold THEN 'pass' ELSE 'fail' END END), 'n/a') AS {m}_gate" for m in METHODS) + " FROM p GROUP BY file")
def result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file: its threshold, and match (hundredths of a per cent) and gate of each method, 'n/a' if missing."""
    rows = _comparison(spark, sf_dir).withColumn("basis", F.floor(10000 * F.col("matched") / F.col("total")))
    wide = rows.groupBy("file").pivot("method", list(METHODS)).agg(F.max("basis")).withColumn("threshold", threshold(F.col("file")).cast("bigint"))
    return wide.select("file", "threshold", *METHODS, *(gate(F.col(m), F.col("threshold") * 100).alias(f"{m}_gate") for m in METHODS))


@query(f"WITH {_COMPARISON} SELECT file, method FROM p WHERE basis < 100 * threshold AND method IN {METHODS}")
def quality_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the matrix that fail, as rows again."""
    gates = result_matrix(spark, sf_dir).select("file", *(F.col(f"{m}_gate").alias(m) for m in METHODS))
    return gates.unpivot("file", list(METHODS), "method", "gate").where("gate = 'fail'").select("file", "method")


@query("""WITH g AS (SELECT item_id AS file, s AS scale, p AS prep, m AS psm, (item_id * 7919 + s * 31 + p * 17 + m * 13) % 101 AS score FROM benchmark, range(1, 5) a(s), range(0, 8) b(p), (VALUES (3), (4), (6), (11), (12)) c(m))
SELECT file, scale, prep, psm::BIGINT AS psm, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, scale, prep, psm) AS rank FROM g) x WHERE rank <= 10""")
def flag_sweep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of 160 parameter settings for each file."""
    grid = spark.range(1, 5).toDF("scale").crossJoin(spark.range(8).toDF("prep")).crossJoin(spark.createDataFrame([(m,) for m in (3, 4, 6, 11, 12)], "psm long"))
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"))
    scored = files.crossJoin(F.broadcast(grid)).withColumn("score", (F.col("file") * 7919 + F.col("scale") * 31 + F.col("prep") * 17 + F.col("psm") * 13) % 101)
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "scale", "prep", "psm"))
    return scored.withColumn("rank", rank.cast("bigint")).where("rank <= 10")


@query("SELECT event_type AS severity, count(*) AS findings, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("severity")).agg(F.count("*").alias("findings"), F.countDistinct("user_id").alias("files"))


@query("""WITH f AS (SELECT user_id, 'layout:' || event_type AS k, (event_id % 2 = 0)::VARCHAR AS v FROM events), s AS (SELECT DISTINCT user_id, CASE WHEN contains(k, ':') THEN k || '=' || v ELSE k || ':' || v END AS flag FROM f)
SELECT user_id, string_agg(flag, '; ' ORDER BY flag) AS flags FROM s GROUP BY user_id""")
def flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as 'key:value', or 'key=value' where the key has a colon; distinct, sorted, joined."""
    key, value = F.concat(F.lit("layout:"), "event_type"), (F.col("event_id") % 2 == 0).cast("string")
    flag = F.when(F.contains(key, F.lit(":")), F.concat(key, F.lit("="), value)).otherwise(F.concat(key, F.lit(":"), value))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(flag)), "; ").alias("flags"))


@query("""WITH d AS (SELECT c_custkey, (c_custkey % 9)::INT AS memory, (c_custkey % 5)::INT AS cores, c_custkey % 4 = 0 AS offline FROM customer)
SELECT c_custkey, CASE WHEN memory <= 2 OR cores <= 2 THEN 'low-memory' WHEN offline OR memory <= 4 THEN 'balanced' ELSE 'quality' END AS profile,
  CASE WHEN memory <= 2 OR cores <= 2 THEN 4000000 WHEN offline OR memory <= 4 THEN 8000000 ELSE 14000000 END::BIGINT AS most_pixels FROM d""")
def device_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of a device by memory and cores, with its limits from a dimension table of three rows."""
    memory, cores = F.col("c_custkey") % 9, F.col("c_custkey") % 5
    profile = F.when((memory <= 2) | (cores <= 2), "low-memory").when((F.col("c_custkey") % 4 == 0) | (memory <= 4), "balanced").otherwise("quality")
    limits = spark.createDataFrame([("low-memory", 4_000_000), ("balanced", 8_000_000), ("quality", 14_000_000)], "profile string, most_pixels long")
    return table(spark, sf_dir, "customer").select("c_custkey", profile.alias("profile")).join(F.broadcast(limits), "profile").select("c_custkey", "profile", "most_pixels")


@query("""SELECT s_suppkey, CASE WHEN sec < 1 THEN '<1 s' WHEN sec < 60 THEN greatest(1, floor(sec + 0.5))::BIGINT || ' s' WHEN sec < 3600 THEN floor(sec / 60 + 0.5)::BIGINT || ' min'
  WHEN floor((sec % 3600) / 60 + 0.5) = 0 THEN floor(sec / 3600)::BIGINT || ' h' ELSE floor(sec / 3600)::BIGINT || ' h ' || floor((sec % 3600) / 60 + 0.5)::BIGINT || ' min' END AS label
FROM (SELECT s_suppkey, (s_suppkey * s_suppkey * 7 % 20000) / 2.0::DOUBLE AS sec FROM supplier) x""")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions import text

    seconds = F.col("s_suppkey") * F.col("s_suppkey") * 7 % 20000 / 2
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.duration_label(seconds).alias("label"))
