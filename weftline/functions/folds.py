"""Ordered folds over arrays as native higher-order functions: state that a window's LAG can't carry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import bound


def _slices(items: Column, starts: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of each slice of an array and its number, given the places from 1 at which slices start."""

    def each(at: Column) -> Column:
        return F.transform(at, lambda a, k: body(F.slice(items, a, F.coalesce(F.get(at, k + 1), F.size(items) + 1) - a), k))

    return bound(starts, each)


def anchored_groups(words: Column, gap: int = 10) -> Column:
    """Lines of words (struct<top, left, text>): a new line where a top is over `gap` from its line's first top.

    Anchors are folded from the distinct tops, and lines are slices of the sorted words, so no word is copied twice.
    """

    def anchors(tops: Column) -> Column:
        far = lambda out, top: F.coalesce(top - F.try_element_at(out, F.lit(-1)) > gap, F.lit(True))
        return F.aggregate(tops, F.array().cast("array<double>"), lambda out, top: F.when(far(out, top), F.array_append(out, top)).otherwise(out))

    def lines(ws: Column) -> Column:
        tops = F.array_distinct(F.transform(ws, lambda w: w["top"].cast("double")))
        return bound(anchors(tops), lambda found: _slices(ws, starts(ws, found), lambda part, _: F.array_join(F.transform(part, lambda w: w["text"]), " ")))

    def starts(ws: Column, found: Column) -> Column:
        fresh = lambda w, i: (i == 0) | ((F.get(ws, i - 1)["top"] != w["top"]) & F.array_contains(found, w["top"].cast("double")))
        return F.filter(F.transform(ws, lambda w, i: F.when(fresh(w, i), i + 1)), lambda i: i.isNotNull())

    return bound(F.array_sort(words), lines)


def midpoint_groups(words: Column, tolerance: Column) -> Column:
    """Line numbers from 0 for words (struct<centre, left, text>): the line's centre moves half-way to each word."""
    start = F.struct(F.lit(None).cast("double").alias("centre"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, word: Column) -> Column:
        same = state["centre"].isNotNull() & (F.abs(word["centre"] - state["centre"]) <= tolerance)
        centre = F.when(same, (state["centre"] + word["centre"]) / 2).otherwise(word["centre"])
        starts = F.when(same, state["starts"]).otherwise(F.array_append(state["starts"], state["seen"] + 1))
        return F.struct(centre.alias("centre"), (state["seen"] + 1).alias("seen"), starts.alias("starts"))

    def lines(ws: Column) -> Column:
        told = lambda part, k: F.transform(part, lambda w: F.struct(k.alias("line"), w["left"].cast("int").alias("left"), w["text"].alias("text")))
        return F.flatten(_slices(ws, F.aggregate(ws, start, step, lambda s: s["starts"]), told))

    return bound(F.array_sort(words), lines)


def overlap_merge(chunks: Column, most: int = 20) -> Column:
    """Chunks of lines (array<array<string>>) joined without the lines that one's end and the next one's start share."""

    def norm(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))

    def shared(tail: Column, head: Column) -> Column:
        same = lambda n: (F.slice(tail, F.size(tail) - n + 1, n) == F.slice(head, F.lit(1), n)) & F.forall(F.slice(head, F.lit(1), n), lambda x: x != "")
        sizes = F.filter(F.sequence(F.lit(0), F.least(F.size(tail), F.size(head))), lambda n: (n > 0) & same(n))
        return F.coalesce(F.array_max(sizes), F.lit(0))

    def step(out: Column, chunk: Column) -> Column:
        tail = norm(F.slice(out, F.greatest(F.size(out) - most + 1, F.lit(1)), most))  # only these lines can be shared
        known = bound(tail, lambda t: bound(norm(F.slice(chunk, 1, most)), lambda h: shared(t, h)))
        return bound(known, lambda n: F.concat(out, F.slice(chunk, n + 1, F.greatest(F.size(chunk) - n, F.lit(0)))))

    return F.trim(F.array_join(F.aggregate(chunks, F.array().cast("array<string>"), step), "\n"))


def bounded_segments(lines: Column, limit: Column, span: int) -> Column:
    """Grid lines packed greedily into segments of at most `span`, or single intervals that are wider."""
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(lines, lambda x: F.greatest(F.lit(0), F.least(limit, x))), F.array(limit))))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out: Column, edge: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (edge - last["start"] <= span)
        start = F.when(F.size(out) > 0, last["end"]).otherwise(F.lit(0))
        return F.when(fits, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), edge.alias("end"))))).otherwise(F.concat(out, F.array(F.struct(start.alias("start"), edge.alias("end")))))

    return F.aggregate(F.filter(edges, lambda x: x > 0), empty, step)


def split_by_bands(bands: Column, height: Column, least: int) -> Column:
    """Chunks between blank bands (struct<start, end>): small content joins what follows, a short tail what precedes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, band: Column) -> Column:
        skipped = F.struct(F.greatest(state["at"], band["end"]).alias("at"), state["out"].alias("out"))
        cut = F.struct(band["end"].alias("at"), F.array_append(state["out"], F.struct(state["at"].alias("start"), band["start"].alias("end"))).alias("out"))
        return F.when(band["start"] <= state["at"], skipped).when(band["start"] - state["at"] < least, state).otherwise(cut)

    def finish(state: Column) -> Column:
        out, at, n = state["out"], state["at"], F.size(state["out"])
        widened = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), height.alias("end"))))
        return F.when(at >= height, out).when((n > 0) & (height - at < least), widened).otherwise(F.array_append(out, F.struct(at.alias("start"), height.alias("end"))))

    return F.when(F.size(bands) > 0, F.aggregate(bands, start, step, finish)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def mean_clusters(values: Column, tolerance: int) -> Column:
    """Sorted values in clusters: a value within `tolerance` of the last cluster's mean joins it."""

    def step(out: Column, value: Column) -> Column:
        last = F.element_at(out, -1)
        mean = F.aggregate(last, F.lit(0.0), lambda s, x: s + x) / F.size(last)
        near = (F.size(out) > 0) & (F.abs(value - mean) <= tolerance)
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.array_append(last, value)))).otherwise(F.array_append(out, F.array(value)))

    return F.aggregate(F.array_sort(values), F.array().cast("array<array<int>>"), step)


def ordered_recall(phrases: Column, text: Column) -> Column:
    """Share of phrases found in order; a missing phrase leaves the cursor where it is."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("found"))

    def step(state: Column, phrase: Column) -> Column:
        place = F.position(phrase, text, state["at"])
        return F.when(place > 0, F.struct((place + F.length(phrase)).alias("at"), (state["found"] + 1).alias("found"))).otherwise(state)

    return F.when(F.size(phrases) == 0, F.lit(1.0)).otherwise(F.aggregate(phrases, start, step, lambda s: s["found"] / F.size(phrases)))


def merged_cells(row: Column) -> Column:
    """Rendered cells of one table row: text, column and colspan, '::merge-left::' widening the cell before it."""
    empty = F.array().cast("array<struct<text:string,col:int,colspan:int>>")
    numbered = F.transform(row, lambda c, k: F.struct(c.alias("text"), k.alias("col")))

    def step(out: Column, cell: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["text"].alias("text"), last["col"].alias("col"), (last["colspan"] + 1).alias("colspan"))))
        grown = F.array_append(out, F.struct(cell["text"].alias("text"), cell["col"].alias("col"), F.lit(1).alias("colspan")))
        return F.when(cell["text"] == "::merge-left::", F.when(F.size(out) > 0, wider).otherwise(out)).when(cell["text"].isin("::merge-up::", "::merge-up-left::"), out).otherwise(grown)

    return F.aggregate(numbered, empty, step)


def circuit_states(calls: Column, threshold: int = 3, cooldown: int = 30) -> Column:
    """Outcome of each call (struct<at, ok, retryable>) behind a circuit breaker: 'ok', 'failed' or 'open'."""
    start = F.struct(F.lit(0).alias("failures"), F.lit(None).cast("bigint").alias("until"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, call: Column) -> Column:
        shut = state["until"].isNotNull() & (call["at"] < state["until"])
        failures = F.when(shut, state["failures"]).when(call["ok"], 0).when(call["retryable"], state["failures"] + 1).otherwise(state["failures"])
        trips = ~shut & ~call["ok"] & call["retryable"] & (failures >= threshold)
        until = F.when(trips, call["at"] + cooldown).otherwise(state["until"])
        told = F.when(shut, "open").when(call["ok"], "ok").otherwise("failed")
        return F.struct(failures.alias("failures"), until.alias("until"), F.array_append(state["out"], told).alias("out"))

    return F.aggregate(F.array_sort(calls), start, step, lambda s: s["out"])
