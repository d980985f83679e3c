"""Task and stream queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import folds
from weftline.operators import tasks
from weftline.plans.registry import query
from weftline.session import table

_LOG = """g AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS task, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'page' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'other' END AS kind FROM events),
log AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id) - 1 AS seq FROM g)"""
_LIVE = "live AS (SELECT * FROM (SELECT *, min(CASE WHEN kind IN ('error', 'complete') THEN seq END) OVER (PARTITION BY task) AS ended FROM log) x WHERE ended IS NULL OR seq <= ended)"
_STATE = "st AS (SELECT task, CASE WHEN bool_or(kind = 'complete') THEN 'completed' WHEN bool_or(kind = 'error') THEN 'failed' ELSE 'running' END AS state, count(*) FILTER (kind = 'page') AS pages, count(*) AS events, min(event_id) AS first FROM live GROUP BY task)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_log(table(spark, sf_dir, "events"))


@query(f"WITH {_LOG}, {_LIVE}, {_STATE} SELECT task, state, pages, state = 'failed' AND pages > 0 AS partial, events FROM st")
def task_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.states(_log(spark, sf_dir))


@query(f"WITH {_LOG}, {_LIVE} SELECT task, string_agg('page ' || event_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq) FILTER (kind = 'page') AS markdown, count(*) FILTER (kind = 'page') AS pages FROM live GROUP BY task HAVING bool_or(kind = 'complete') AND count(*) FILTER (kind = 'page') > 0")
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of completed tasks: their pages joined in order."""
    live = tasks.live(_log(spark, sf_dir))
    pages = F.array_sort(F.collect_list(F.when(F.col("kind") == "page", F.struct("seq", F.concat(F.lit("page "), F.col("event_id").cast("string")).alias("md")))))
    done = live.groupBy("task").agg(pages.alias("ps"), F.max((F.col("kind") == "complete").cast("int")).alias("done")).where("done = 1 AND size(ps) > 0")
    return done.select("task", F.array_join(F.transform("ps", lambda p: p["md"]), "\n\n---\n\n").alias("markdown"), F.size("ps").cast("bigint").alias("pages"))


@query(f"WITH {_LOG}, {_LIVE}, {_STATE} SELECT task, first, events FROM st WHERE state = 'completed' ORDER BY first DESC, task LIMIT 50")
def task_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest completed tasks, by when they were created; the limit is the feature."""
    live = tasks.live(_log(spark, sf_dir))
    found = live.groupBy("task").agg(F.min("event_id").alias("first"), F.count("*").alias("events"), F.max((F.col("kind") == "complete").cast("int")).alias("done")).where("done = 1")
    return found.orderBy(F.desc("first"), "task").limit(50).select("task", "first", "events")


@query(f"WITH {_LOG}, {_LIVE} SELECT task, seq, kind FROM live WHERE seq >= 3")
def event_resume_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets that has seen events 0 to 2 of every task."""
    return tasks.live(_log(spark, sf_dir)).where("seq >= 3").select("task", "seq", "kind")


@query(f"WITH {_LOG}, m AS (SELECT task, seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY task ORDER BY seq) AS pause_us FROM log WHERE kind <> 'progress') SELECT task, seq, pause_us FROM m WHERE pause_us > 7200 * 1000000::BIGINT")
def stall_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.stalls(_log(spark, sf_dir), 7200).select("task", "seq", "pause_us")


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 14400 * 1000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, session::BIGINT AS session, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS events FROM s GROUP BY user_id, session""")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.sessions(table(spark, sf_dir, "events"), "user_id", 14400)


@query("SELECT user_id, date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"))


@query("""WITH RECURSIVE c AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT user_id, i, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NULL::BIGINT AS until, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS outcome FROM c WHERE i = 1
  UNION ALL SELECT c.user_id, c.i, CASE WHEN c.t < coalesce(r.until, 0) THEN r.failures WHEN ok THEN 0 ELSE r.failures + 1 END, CASE WHEN c.t < coalesce(r.until, 0) OR ok OR r.failures + 1 < 3 THEN r.until ELSE c.t + 3600 END,
  CASE WHEN c.t < coalesce(r.until, 0) THEN 'open' WHEN ok THEN 'ok' ELSE 'failed' END FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1)
SELECT user_id, (i - 1)::INT AS call, outcome FROM r""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user behind a breaker: errors are retryable failures, three of which shut it for an hour."""
    call = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"), F.lit(True).alias("retryable"))
    calls = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").groupBy("user_id").agg(F.collect_list(call).alias("calls"))
    return calls.select("user_id", F.posexplode(folds.circuit_states(F.col("calls"), 3, 3600)).alias("call", "outcome"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN event_id END AS page, CASE event_type WHEN 'click' THEN event_type || event_id END AS message FROM events)
SELECT user_id, event_id, last_value(page IGNORE NULLS) OVER w AS page, last_value(message IGNORE NULLS) OVER w AS message FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def progress_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known value of each field after each event; an absent field keeps what was known."""
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    page = F.when(F.col("event_type") == "view", F.col("event_id"))
    message = F.when(F.col("event_type") == "click", F.concat("event_type", F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(page, ignorenulls=True).over(order).alias("page"), F.last(message, ignorenulls=True).over(order).alias("message"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, event_id % 50 = 0 AS malformed FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 50 = 0""")
def ndjson_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON read permissively: every fiftieth line is cut short and comes out as malformed."""
    line = F.when(F.col("event_id") % 50 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    read = F.from_json(line, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE"})
    parsed = table(spark, sf_dir, "events").select("event_id", read.alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.select("event_id", F.when(~bad, F.col("r.k")).alias("k"), bad.alias("malformed"))
