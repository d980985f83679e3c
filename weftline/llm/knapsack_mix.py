"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order, null last, weigh 1, 2, 3 and again; their targets share the words of all documents by
weight, none above three times its source's words. A target is its source's words some whole times and a rest. The
rest is filled with counts of documents by exact length that come as near to the budget, from below or above, as any choice
of documents can, in one way at all sizes: every length gives its proportional share of all but the last words, and a
bounded-knapsack dynamic program (a bit set of reachable sums) fills these from all documents that are left, lengths of any
size included. Where that is farther from the budget than the remainders of the lengths ask, more words are left to
the program, until it is as near or no choice of documents is left out. Documents of a length are taken in the order of a
seeded hash until the length's count is reached.

Skew: counting is pre-aggregated, the plan of a source sees a row for each distinct length, and ranks within a length
are taken in hash slots whose counts are summed first, so a length that a third of all documents share is dealt to
many tasks.

Sources are few, as weights are set for each: the driver gets a row for each source.

Edge cases: null and empty texts have size 0 and are never taken; a source without words has target 0; very long texts
are lengths like others; repeated rows are ranked one by one, rows that agree in doc_id in any order; reruns agree; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

WEIGHTS = (1, 2, 3)
CAP = 3
#: Bits of reachable sums held at once when a choice is read back; what isn't held is worked out again, with the same result.
WORK = 1 << 29
SLOTS = 4096


def targets(sizes: dict[str | None, int], cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Targets by source: shares by weight of all words, excess over the cap shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to the budget as any choice can.

    Over half of all words, what is left out is fitted instead. Of two sums as near either may be taken.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not total:
        return {}
    budget = min(budget, total)
    if 2 * budget <= total:
        return _nearest(counts, budget)
    out = _nearest(counts, total - budget)
    return {n: c - out.get(n, 0) for n, c in counts.items() if c > out.get(n, 0)}


def _nearest(counts: dict[int, int], budget: int) -> dict[int, int]:
    """The fit of a budget of at most half of all words: shares of all but the last words, the program for these.

    The last words are twice the longest length at first; each time after, they are four times as many, and lengths
    that have fewest words are wholly open besides. From shares within a longest length of the budget, a nearest choice
    is apart by at most two longest lengths over the greatest common divisor of all lengths, in documents: put in an
    order that keeps to that distance, sums between the two repeat beyond that, and what lies between equal sums can be
    left out. So `floor` can be fixed in any case.
    """
    longest, rare = max(counts), sorted(counts, key=lambda n: (n * counts[n], n))
    apart, least = 2 * longest // gcd(*counts), _least_gap(counts, budget)
    floor = {n: max(k - apart, 0) for n, k in _shares(counts, budget).items()}
    words = 2 * longest
    while True:
        whole = budget - words <= sum(n * k for n, k in floor.items())
        fixed = dict(floor) if whole else _shares(counts, budget - words)
        spare = words - 2 * longest
        for n in rare:
            spare -= n * counts[n]
            if spare < 0:
                break
            fixed[n] = 0
        left = budget - sum(n * k for n, k in fixed.items())
        found = _knapsack({n: c - fixed[n] for n, c in counts.items()}, left)
        if whole or abs(sum(n * k for n, k in found.items()) - left) <= least:
            take = {n: k + found.get(n, 0) for n, k in fixed.items()}
            return {n: k for n, k in take.items() if k}
        words *= 4


def _shares(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Proportional counts, rounded along the lengths, so that their words are within the longest length of the budget."""
    total, seen, given, out = sum(n * c for n, c in counts.items()), 0, 0, {}
    for n in sorted(counts):
        seen += counts[n]
        upto = seen * budget // total
        out[n], given = upto - given, upto
    return out


def _least_gap(counts: dict[int, int], budget: int) -> int:
    """How near to the budget a sum can be at best, by its remainders modulo the common divisors of the commonest lengths."""
    least, step = 0, 0
    for common_length in sorted(counts, key=lambda n: (-counts[n], n)):
        if gcd(step, common_length) == step:
            continue
        step = gcd(step, common_length)
        whole, reach = (1 << step) - 1, 1
        for n, k in _pieces({n: min(c, step) for n, c in counts.items() if n % step}):
            by = n * k % step
            reach |= (reach << by | reach >> step - by) & whole
            if reach == whole:
                break
        at = budget % step
        turned = (reach >> at | reach << step - at) & whole
        least = max(least, min((turned & -turned).bit_length() - 1, step - turned.bit_length() + 1))
    return least


def _pieces(room: dict[int, int]) -> list[tuple[int, int]]:
    """Counts of each length split in powers of two and a rest: any count up to the whole is a sum of some.

    Lengths come in the order of their golden hash, so that those that come first are spread over all lengths.
    """
    pieces = []
    for n in sorted(room, key=lambda n: (n * 0x9E3779B1 & 0xFFFFFFFF, n)):
        count, k = room[n], 1
        while count > 0:
            pieces.append((n, min(k, count)))
            count, k = count - k, 2 * k
    return pieces


def _knapsack(room: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack: reachable sums as bits; the nearest sum, the lower of two as near.

    A sum above the budget is of use if it is over by less than its smallest document, so sums end at the budget and the
    longest length together. The choice is read back from the sets before each piece, worked out again by halves where
    they are more than `WORK` bits.
    """
    most = budget + max(room, default=0)
    pieces = _pieces({n: min(c, most // n) for n, c in room.items()})
    mask = (1 << most + 1) - 1
    reach, last = 1, len(pieces)
    for step, (n, k) in enumerate(pieces):
        if reach >> budget & 1:
            last = step
            break
        reach |= reach << n * k & mask
    low = (reach & (1 << budget + 1) - 1).bit_length() - 1
    rest = reach >> budget
    high = budget + (rest & -rest).bit_length() - 1 if rest else None
    at = high if high is not None and high - budget < budget - low else low
    out: dict[int, int] = {}

    def back(start: int, stop: int, reach: int, at: int) -> int:
        """Notes what pieces start .. stop give to the sum `at`; returns the sum before them."""
        if stop - start > 1 and (stop - start) * most > WORK:
            middle, after = (start + stop) // 2, reach
            for n, k in pieces[start:middle]:
                after |= after << n * k & mask
            return back(start, middle, reach, back(middle, stop, after, at))
        sets = [reach]
        for n, k in pieces[start : stop - 1]:
            sets.append(sets[-1] | sets[-1] << n * k & mask)
        for j in range(stop - 1, start - 1, -1):
            if not sets[j - start] >> at & 1:
                n, k = pieces[j]
                out[n] = out.get(n, 0) + k
                at -= n * k
        return at

    back(0, last, 1, at)
    return out


def sized(docs: DataFrame, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, doc_id, source, queue (a source's key, never null), size in words, seeded hash; stored, as all steps read it."""
    size = F.size(F.regexp_extract_all(common.text_or_empty(), F.lit(common.WORD), F.lit(0))).cast("bigint")
    queue = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    return common.materialise(docs.select(*keys, "doc_id", "source", queue.alias("queue"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("luck")), "mix-sizes")


def mix(docs: DataFrame, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys, doc_id, source, size, source_size, target, taken for every row. The driver gets a row for each source."""
    spark = docs.sparkSession
    rows = sized(docs, seed, keys)
    sources = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    plan = [("1" if s is None else f"0{s}", sources[s], t, int(t // sources[s]) if sources[s] else 0) for s, t in targets(sources).items()]
    plan = [(q, n, t, whole, round(t) - whole * n if n else 0) for q, n, t, whole in plan]
    goals = spark.createDataFrame(plan, "queue string, source_size long, target double, whole long, budget long")

    def choose(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        found = fit(dict(zip(groups["size"].tolist(), groups["n"].tolist(), strict=True)), int(groups["budget"].iloc[0]))
        return pd.DataFrame({"queue": groups["queue"].iloc[0], "size": list(found), "quota": list(found.values())}).astype({"queue": object, "size": "int64", "quota": "int64"})

    counts = rows.where("size > 0").groupBy("queue", "size").agg(F.count("*").alias("n"))
    quotas = common.materialise(counts.join(goals.where("budget > 0"), "queue").select("queue", "size", "n", "budget").groupBy("queue").applyInPandas(choose, "queue string, size long, quota long"), "mix-quotas")

    ranked = rows.withColumn("slot", F.pmod("luck", F.lit(SLOTS)))
    slots = ranked.groupBy("queue", "size", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("queue", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("queue", "size", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(quotas, ["queue", "size"])
    room = slots.where("before < quota").select("queue", "size", "slot", (F.col("quota") - F.col("before")).alias("room"))
    rank = F.row_number().over(Window.partitionBy("queue", "size", "slot").orderBy("luck", "doc_id", *keys))
    ranked = ranked.withColumn("rank", rank).join(room, ["queue", "size", "slot"], "left")
    taken = F.col("size") * (F.col("whole") + (F.col("rank") <= F.coalesce("room", F.lit(0))).cast("bigint"))
    return ranked.join(goals, "queue").select(*keys, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
