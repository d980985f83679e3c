"""Streaming twins of the task operators: the same folds on an unbounded log, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.tasks import MEANING, TERMINAL


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder of Parquet files as they arrive; `ts` becomes a timestamp that watermarks accept."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def session_stream(events: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of each key that end after a gap; a session is given out once the watermark has passed it."""
    windows = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once each, however often they are delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def state_stream(events: DataFrame) -> DataFrame:
    """State of each task after each batch that changed it: the first terminal event wins, later ones are ignored.

    Events of a task must come in order of event_id across batches; within a batch they are sorted.
    """
    task = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in MEANING.items()), F.lit("other"))

    def fold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, pages, seen = state.get if state.exists else ("running", 0, 0)
        for row in pd.concat(batches).sort_values("event_id").itertuples():
            if told != "running":
                break
            seen, pages = seen + 1, pages + (row.kind == "page")
            if row.kind in TERMINAL:
                told = "completed" if row.kind == "complete" else "failed"
        state.update((told, pages, seen))
        yield pd.DataFrame({"task": [key[0]], "state": [told], "pages": [pages], "events": [seen]})

    keyed = events.select(task.alias("task"), "event_id", kind.alias("kind")).groupBy("task")
    return keyed.applyInPandasWithState(fold, "task string, state string, pages long, events long", "state string, pages long, events long", "update", GroupStateTimeout.NoTimeout)


def as_sse(events: DataFrame) -> DataFrame:
    """Events as server-sent event frames, in their log's order columns."""
    return events.select("task", "seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), "kind", F.lit("\ndata: "), F.to_json(F.struct("task", "seq", "kind")), F.lit("\n\n")).alias("frame"))
