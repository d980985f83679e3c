"""Task logs: ordered events of a task folded into states, results, progress and pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each kind of event means in a task's log.
MEANING = {"signup": "accepted", "view": "progress", "click": "page", "error": "error", "purchase": "complete"}
TERMINAL = ("error", "complete")


def task_log(events: DataFrame) -> DataFrame:
    """task (user and day), seq dense from 0, kind, event_id, ts."""
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in MEANING.items()), F.lit("other"))
    task = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    log = events.select(task.alias("task"), "event_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return log.withColumn("seq", F.row_number().over(Window.partitionBy("task").orderBy("event_id")).cast("bigint") - 1)


def live(log: DataFrame) -> DataFrame:
    """Events up to a task's first terminal one; later ones are ignored."""
    ended = F.min(F.when(F.col("kind").isin(*TERMINAL), F.col("seq"))).over(Window.partitionBy("task"))
    return log.withColumn("ended", ended).where("ended IS NULL OR seq <= ended")


def states(log: DataFrame) -> DataFrame:
    """task, state, pages, warnings, partial, events: an error is partial if a page came before it."""
    state = F.when(F.max((F.col("kind") == "complete").cast("int")) == 1, "completed").when(F.max((F.col("kind") == "error").cast("int")) == 1, "failed").otherwise("running")
    pages = F.count_if(F.col("kind") == "page")
    return live(log).groupBy("task").agg(state.alias("state"), pages.alias("pages"), ((state == "failed") & (pages > 0)).alias("partial"), F.count("*").alias("events"))


def stalls(log: DataFrame, seconds: int) -> DataFrame:
    """Meaningful events (heartbeats don't count) that come over `seconds` after the one before them."""
    meant = log.where(F.col("kind") != "progress")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("task").orderBy("seq"))
    return meant.withColumn("pause_us", pause).where(F.col("pause_us") > seconds * 1_000_000)


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands over time: key, first and last event_id, events of each session."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order) < gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order))
    return numbered.groupBy(key, "session").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("events"))


def lifecycles(events: DataFrame) -> DataFrame:
    """task, state, pages: the log of each task folded through the states of a task that can be cancelled.

    A task's log is one user's day of events; a longer one would be folded by a stateful stream instead.
    """
    log = task_log(events)
    steps = log.select("task", "seq", F.when(F.col("kind") == "progress", "start").when(F.col("kind") == "page", "page").when(F.col("kind") == "error", "cancel").when(F.col("kind") == "complete", "end").alias("step")).where("step IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda s: s["step"])
    every = log.select("task").distinct()
    logs = every.join(steps.groupBy("task").agg(ordered.alias("steps")), "task", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))

    def moved(at, step):
        state = at["state"]
        after = (
            F.when((state == "queued") & (step == "start"), "running")
            .when((state == "queued") & (step == "cancel"), "cancelled")
            .when((state == "running") & (step == "cancel"), "cancelling")
            .when((state == "running") & (step == "end"), "completed")
            .when((state == "cancelling") & (step == "end"), "cancelled")
            .otherwise(state)
        )
        return F.struct(after.alias("state"), (at["pages"] + F.when((state == "running") & (step == "page"), 1).otherwise(0)).alias("pages"))

    begun = F.struct(F.lit("queued").alias("state"), F.lit(0).cast("bigint").alias("pages"))
    return logs.select("task", F.aggregate("steps", begun, moved).alias("end")).select("task", "end.state", "end.pages")


def slots(jobs: DataFrame, workers: int, places: int) -> DataFrame:
    """queue, job, admitted, starts: jobs (queue, job, at, takes) of each queue in order of arrival.

    `workers` of them run at once and `places` wait; a job that finds every place taken is refused. Jobs that start earlier
    leave the queue first. A queue's jobs are folded in order, holding only those not ended yet.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "job", "takes")))

    def step(s, job):
        pending = F.filter(s["ends"], lambda e: e > job["at"])
        full = F.size(pending) >= workers + places
        # with all workers taken a job starts when the one `workers` places before it ends
        start = F.when(F.size(pending) < workers, job["at"]).otherwise(F.element_at(F.array_sort(pending), F.size(pending) - workers + 1))
        told = F.struct(job["job"].alias("job"), (~full).alias("admitted"), F.when(~full, start).alias("starts"))
        return F.struct(F.when(full, pending).otherwise(F.array_append(pending, start + job["takes"])).alias("ends"), F.array_append(s["told"], told).alias("told"))

    begun = F.struct(F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<struct<job:bigint,admitted:boolean,starts:bigint>>").alias("told"))
    folded = jobs.groupBy("queue").agg(ordered.alias("jobs")).select("queue", F.aggregate("jobs", begun, step).alias("s"))
    return folded.select("queue", F.inline("s.told"))
