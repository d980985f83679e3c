"""Operators around a document run: watchers, index repair, crop plans, stacked pages, visible trees, quadrilaterals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Passes over a dense grid. Bands and headers are ratios of the page's width.
TILE_PASSES = ((6, 5, 3, "wide"), (5, 4, 2, "text"))
BAND_PASSES = (
    (0.0, 0.38, 360 / 3300, 60 / 3300, 4, "text"),
    (0.0, 0.38, 360 / 3300, 60 / 3300, 4, "wide"),
    (85 / 3300, 390 / 3300, 360 / 3300, 60 / 3300, 5, "text"),
    (85 / 3300, 390 / 3300, 360 / 3300, 60 / 3300, 5, "wide"),
    (85 / 3300, 180 / 3300, 360 / 3300, 60 / 3300, 6, "text"),
    (130 / 3300, 390 / 3300, 100 / 3300, 20 / 3300, 6, "text"),
)
HEADER_HEIGHT = 220 / 3300
HEADER_PASSES = ((0.0, 1200 / 3300, 4, "text"), (0.0, 1200 / 3300, 4, "wide"), (0.0, 2200 / 3300, 3, "text"), (0.0, 2200 / 3300, 3, "wide"), (2600 / 3300, 1.0, 4, "text"), (2600 / 3300, 1.0, 4, "wide"))
MOST_NODES = 100_000


def grace_cancelled(events: DataFrame, key: str, grace_seconds: int) -> DataFrame:
    """key, event_id, at_us: the disconnect after which a task is cancelled, as nobody watched it for the grace time.

    Events (key, event_id, ts, kind) are 'open', 'close' (a disconnect) or 'end'. The number of watchers never falls
    below zero: it is the running sum less the lowest that sum has been, so no state is folded row by row.
    """
    order = Window.partitionBy(key).orderBy("event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    steps = events.select(key, "event_id", "kind", at.alias("at_us"), F.sum(step).over(so_far).alias("total"))
    counted = steps.withColumn("lowest", F.least(F.lit(0), F.min("total").over(so_far)))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    counted = counted.withColumn("next_us", F.min(F.when(F.col("kind").isin("open", "end"), F.col("at_us"))).over(later))
    counted = counted.withColumn("ended", F.max((F.col("kind") == "end").cast("int")).over(so_far))
    alone = counted.where("kind = 'close' AND total = lowest AND ended = 0").where(F.col("next_us").isNull() | (F.col("next_us") > F.col("at_us") + grace_seconds * 1_000_000))
    first = F.min(F.struct("event_id", "at_us"))
    return alone.groupBy(key).agg(first.alias("first")).select(key, "first.event_id", F.expr(f"first.at_us + {grace_seconds * 1_000_000}").alias("at_us"))


def backfilled(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Blank indexes above a group's first numbered one, counted down from it to 1.

    Rows (key, *order, idx, payload, section): rows without payload stay blank and take no number; nothing is filled
    in above the last section row before the first number.
    """
    place = Window.partitionBy(key).orderBy(*order)
    each = Window.partitionBy(key)
    numbered = rows.withColumn("place", F.row_number().over(place)).withColumn("at", F.when(F.col("idx").rlike(r"\.[0-9]+$"), F.col("place")))
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("at", F.regexp_extract("idx", r"^(.*\.)([0-9]+)$", 1).alias("prefix"), F.regexp_extract("idx", r"([0-9]+)$", 1).alias("digits")))).over(each)
    numbered = numbered.withColumn("first", first)
    stop = F.max(F.when(F.col("section") & (F.col("place") < F.col("first.at")), F.col("place"))).over(each)
    numbered = numbered.withColumn("stop", F.coalesce(stop, F.lit(0)))
    open_row = (F.col("idx") == "") & F.col("payload") & (F.col("place") < F.col("first.at")) & (F.col("place") > F.col("stop"))
    back = F.count_if(open_row).over(each.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    number = F.col("first.digits").cast("bigint") - back
    told = F.concat("first.prefix", F.lpad(number.cast("string"), F.greatest(F.length("first.digits"), F.length(number.cast("string"))), F.lit("0")))
    return numbered.withColumn("idx", F.when(open_row & (number >= 1), told).otherwise(F.col("idx"))).select(*rows.columns)


def covering_starts(limit: Column, size: Column, overlap: Column) -> Column:
    """Starts of windows of `size` that share `overlap` and cover 0 .. limit to its end."""
    size = F.greatest(F.lit(1), F.least(limit, size))
    step = size - F.greatest(F.lit(0), F.least(size - 1, overlap))
    zero = F.lit(0).cast("bigint")
    return F.when(limit <= size, F.array(zero)).otherwise(F.array_distinct(F.array_append(F.sequence(zero, F.greatest(limit - size, zero), step), limit - size)))


def crop_plan(images: DataFrame, key: str, target: int = 3300) -> DataFrame:
    """Crops of each image (key, width, height: long), widened to `target`: (key, pass, left, top, right, bottom, scale, mode).

    The passes are columns, not rows of a join: one scan of the images, one explode.
    """
    rounded = lambda x: F.bround(x, 0).cast("bigint")
    resized = images.select(key, F.greatest("width", F.lit(target)).alias("w"), F.when(F.col("width") >= target, F.col("height")).otherwise(F.greatest(F.lit(1), rounded(F.col("height") * target / F.col("width")))).alias("h"))
    w, h, zero, one = F.col("w"), F.col("h"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def crop(nth: int, left: Column, top: Column, right: Column, bottom: Column, scale: int, mode: str) -> Column:
        return F.struct(F.lit(nth).alias("pass"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), F.lit(scale).alias("scale"), F.lit(mode).alias("mode"))

    def tiles(nth: int, columns: int, rows: int, scale: int, mode: str) -> Column:
        tw, th = F.greatest(one, F.ceil(w / columns)), F.greatest(one, F.ceil(h / rows))
        xs, ys = (covering_starts(side, size, F.greatest(F.lit(24), F.floor(size / 12))) for side, size in ((w, tw), (h, th)))
        return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: crop(nth, x, y, F.least(w, x + tw), F.least(h, y + th), scale, mode))))

    def band(nth: int, from_: float, to: float, tall: float, shared: float, scale: int, mode: str) -> Column:
        left = F.greatest(zero, F.least(w - 1, rounded(w * from_)))
        right = F.greatest(left + 1, F.least(w, rounded(w * to)))
        size = F.greatest(F.lit(24), F.least(h, rounded(w * tall)))
        tops = covering_starts(h, size, F.greatest(zero, F.least(size - 1, rounded(w * shared))))
        return F.transform(tops, lambda y: crop(nth, left, y, right, F.least(h, y + size), scale, mode))

    def header(nth: int, from_: float, to: float, scale: int, mode: str) -> Column:
        left = rounded(w * from_)
        return crop(nth, left, zero, F.greatest(left + 1, rounded(w * to)), F.greatest(one, rounded(w * HEADER_HEIGHT)), scale, mode)

    makers = [(tiles, x) for x in TILE_PASSES] + [(band, x) for x in BAND_PASSES]
    plans = [make(nth, *x) for nth, (make, x) in enumerate(makers)]
    headers = [header(len(makers) + nth, *x) for nth, x in enumerate(HEADER_PASSES)]
    return resized.select(key, F.inline(F.concat(*plans, F.array(*headers))))


def stacked_pages(pages: DataFrame, key: str, order: list[str], gap: int) -> DataFrame:
    """Place of each page (key, *order, width, height) when a document's pages are stacked, centred, with a gap between."""
    each = Window.partitionBy(key)
    before = each.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0))
    widest = F.max("width").over(each)
    tall = F.sum("height").over(each) + gap * (F.count("*").over(each) - 1)
    return pages.select(key, *order, F.floor((widest - F.col("width")) / 2).alias("left"), top.cast("bigint").alias("top"), widest.alias("stack_width"), tall.alias("stack_height"))


def visible_messages(nodes: DataFrame, key: str, most: int = MOST_NODES) -> DataFrame:
    """(key, place, node): shown nodes of each tree in depth-first order, without what stands below a hidden one.

    Nodes (key, node, parent, hidden, told); siblings come in order of node; a row is given for nodes with `told`.
    A tree of more than `most` nodes is an error, which bounds what one task holds.
    """

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        if len(tree) > most:
            raise ValueError(f"a content tree exceeds {most} nodes")
        rows = {r.node: r for r in tree.itertuples()}
        below: dict[object, list] = {}
        for r in sorted(rows.values(), key=lambda r: r.node, reverse=True):
            below.setdefault(r.parent if r.parent in rows else None, []).append(r)
        found, stack = [], list(below.get(None, []))
        while stack:
            r = stack.pop()
            if not r.hidden:
                if r.told:
                    found.append(r.node)
                stack += below.get(r.node, [])
        return pd.DataFrame({key: [tree[key].iloc[0]] * len(found), "place": range(len(found)), "node": found})

    return nodes.groupBy(key).applyInPandas(walk, f"{key} {dict(nodes.dtypes)[key]}, place long, node long")


def square_to_quad(u: Column, v: Column, corners: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Where a point of the unit square falls in a quadrilateral (corners clockwise from the origin), in perspective.

    The eight unknowns of the homography have a closed form for a square, so no system is solved row by row.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    whole = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / whole, (dx1 * sy - sx * dy1) / whole
    depth = g * u + h * v + 1
    return ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / depth, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / depth


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(value: Column) -> Column:
    """A progress value as a share of 1: values over 1 are per cent; NULL where it isn't a finite number."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, clamped(F.when(value > 1, value / 100).otherwise(value)))


def document_share(total: Column, completed: Column, current: Column) -> Column:
    """Share of a document done: whole pages and a part of the current one; NULL without a page count."""
    done = F.least(F.greatest(F.lit(0), completed), total)
    return F.when(total > 0, clamped((done + F.coalesce(current, F.lit(0.0))) / total))


def safe_path(path: Column) -> Column:
    """True where no part of a relative path climbs above its root."""
    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(state["least"], depth).alias("least"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    return F.aggregate(F.split(path, "/"), start, step, lambda s: s["least"] >= 0)


#: What a selector may be made of, and its longest length.
SAFE_SELECTOR = r"""^[A-Za-z0-9_#.:\[\]="'\-\s>+~*()]+$"""
LONGEST_SELECTOR = 500


def valid_selector(text: Column) -> Column:
    shown = text.isNotNull() & F.length(text).between(1, LONGEST_SELECTOR) & text.rlike(SAFE_SELECTOR)
    return shown & ~F.contains(text, F.lit(">>")) & ~F.contains(F.lower(text), F.lit("javascript:"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))
