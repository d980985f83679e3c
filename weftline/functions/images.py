"""Sizes and boxes of page images, and what requests and lines are, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of lines that reports tell apart.
PRICE_MARK, SUMMARY_MARK, PRACTICE_MARK, LONGEST_IDENTIFIER = "₽", "зачет с оценкой", "практика", 200
SIGNATURE = r"(?U)\b(проректор|начальник|директор|зав\.?\s*кафедрой)\b"


def preprocess_step(w: Column, h: Column, brightness: Column) -> Column:
    """The step that a page image's size and mean brightness call for; NULL if none."""
    aspect = h / F.greatest(F.lit(1), w)
    small = (F.least(w, h) < 240) & (F.greatest(w, h) <= 900) & (w * h <= 300_000)
    mobile = w.between(650, 900) & h.between(900, 1300) & aspect.between(1.2, 1.7)
    slide = w.between(850, 1200) & h.between(1100, 1500) & aspect.between(1.2, 1.6) & (brightness >= 120)
    return F.when(small, "small_text_upscale").when(mobile, "mobile_screen_upscale").when(slide, "projector_slide_dewarp")


def small_text_scale(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(600 / F.greatest(F.lit(1), F.least(w, h))))).cast("bigint")


def suspicious_crop(w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """True where a page that is no banner would become one."""
    return (w / F.greatest(F.lit(1), h) <= 2.0) & (new_w / F.greatest(F.lit(1), new_h) >= 2.8)


def cell_inset(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """A cell's box without its rules: 2 to 8 pixels off each side, never past the other one."""
    off = F.greatest(F.lit(2), F.least(F.lit(8), F.floor((x2 - x1) / 20), F.floor((y2 - y1) / 20)))
    return [F.least(x2, x1 + off), F.least(y2, y1 + off), F.greatest(x1, x2 - off), F.greatest(y1, y2 - off)]


def cell_size(w: Column, h: Column) -> list[Column]:
    """Width and height of a cell made legible: up to four times as large, with 8 pixels around it."""
    wanted = F.greatest(F.lit(1.0), 52 / F.greatest(F.lit(1), h), F.when(w < 120, 120 / F.greatest(F.lit(1), w)))
    scale = F.least(F.lit(4.0), wanted)
    grown = lambda side: F.when((scale > 1.05) & (w > 0) & (h > 0), F.greatest(F.lit(1), F.floor(side * scale))).otherwise(side)
    margin = F.when((w > 0) & (h > 0), 16).otherwise(0)
    return [(grown(side) + margin).cast("bigint") for side in (w, h)]


def on_page(at: Column, scale: Column, offset: Column) -> Column:
    """A coordinate in an enlarged tile as one on its page."""
    return F.bround(at / scale, 0).cast("bigint") + offset


def raster_formats(text: Column) -> Column:
    """Formats of a comma-separated list, each once, 'jpeg' as 'jpg'; NULL if one isn't known or none is given."""
    names = F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x)))
    names = F.array_distinct(F.transform(names, lambda x: F.when(x == "jpeg", "jpg").otherwise(x)))
    return F.when(F.forall(names, lambda x: x.isin("png", "jpg")), names)


def item_text(items: Column) -> Column:
    """Text of placed items (struct<text, ends_line>): blanks squeezed, lines kept."""
    joined = F.array_join(F.transform(items, lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.when(x["ends_line"], "\n").otherwise(" "))), "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n[ \t]+", "\n"), r"^\s+|\s+$", "")


def response_mode(explicit: Column, accept: Column, json_upload: Column) -> Column:
    """How a request wants its answer: what it names, else what it accepts, else a task."""
    takes = lambda kind: F.contains(F.lower(F.coalesce(accept, F.lit(""))), F.lit(kind))
    told = F.when(explicit.isin("events", "text", "markdown", "json"), explicit)
    told = told.when(takes("text/plain"), "text").when(takes("text/markdown"), "markdown")
    return told.when(takes("application/x-ndjson") | takes("text/event-stream"), "events").when(takes("*/*") & ~json_upload, "text").otherwise("async")


def line_classes(line: Column) -> dict[str, Column]:
    """What kinds a report's line is of."""
    low = F.lower(line)
    return {
        "price": F.contains(line, F.lit(PRICE_MARK)),
        "identifier": (F.length(line) <= LONGEST_IDENTIFIER) & (F.contains(low, F.lit("/")) | F.contains(low, F.lit("_")) | low.rlike(r"\.[a-zа-я]{2,}")),
        "signature": low.rlike(SIGNATURE),
        "control_summary": F.contains(low, F.lit(SUMMARY_MARK)),
        "practice_row": low.startswith("|") & F.contains(low, F.lit(PRACTICE_MARK)),
    }
