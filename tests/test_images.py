"""Functions on image sizes, boxes, requests and lines on cases with known results."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import images


def one(spark, *columns):
    row = tuple(spark.range(1).select(*columns).first())
    return row if len(row) > 1 else row[0]


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(
    ("size", "light", "step"),
    [((239, 900), 0, "small_text_upscale"), ((239, 901), 0, None), ((240, 500), 0, None), ((700, 1000), 0, "mobile_screen_upscale"), ((1000, 1300), 120, "projector_slide_dewarp"), ((1000, 1300), 119, None), ((0, 0), 0, "small_text_upscale")],
)
def test_steps(spark, size, light, step):
    assert one(spark, images.preprocess_step(*lits(*size, light))) == step


def test_sizes_and_boxes(spark):
    assert [one(spark, images.small_text_scale(*lits(w, 900))) for w in (0, 100, 200, 250, 600)] == [4, 4, 3, 3, 2]
    assert one(spark, *images.cell_inset(*lits(0, 0, 400, 60))) == (3, 3, 397, 57)
    assert one(spark, *images.cell_inset(*lits(5, 5, 6, 6))) == (6, 6, 5, 5)
    assert one(spark, *images.cell_size(*lits(60, 20))) == (60 * 2.6 + 16, 20 * 2.6 + 16)
    assert one(spark, *images.cell_size(*lits(10, 5))) == (56, 36)
    assert one(spark, *images.cell_size(*lits(0, 5))) == (0, 5)
    assert [one(spark, images.on_page(*lits(x, 2.0, 10))) for x in (1, 3, 5)] == [10, 12, 12]
    assert one(spark, images.suspicious_crop(*lits(100, 100, 280, 100)))
    assert not one(spark, images.suspicious_crop(*lits(300, 100, 280, 100)))


def test_formats_items_and_modes(spark):
    assert [one(spark, images.raster_formats(F.lit(x))) for x in ("jpeg, PNG,jpg", "", "gif")] == [["jpg", "png"], None, None]
    items = F.expr("array(named_struct('text', ' a', 'ends_line', false), named_struct('text', 'b  c', 'ends_line', true), named_struct('text', cast(null as string), 'ends_line', false), named_struct('text', 'd', 'ends_line', true))")
    assert one(spark, images.item_text(items)) == "a b c\nd"
    cases = [("json", "text/plain", False), ("other", "TEXT/plain", False), (None, "*/*", False), (None, "*/*", True), (None, None, False)]
    modes = [one(spark, images.response_mode(F.lit(e).cast("string"), F.lit(a).cast("string"), F.lit(u))) for e, a, u in cases]
    assert modes == ["json", "text", "text", "async", "async"]


@pytest.mark.parametrize(("line", "kinds"), [("5 ₽", {"price"}), ("a_b", {"identifier"}), ("x" * 200 + "/", set()), ("Директор", {"signature"}), ("директорат", set()), ("| практика", {"practice_row"}), ("", set())])
def test_line_classes(spark, line, kinds):
    found = images.line_classes(F.lit(line))
    assert {k for k, v in spark.range(1).select(*(c.alias(n) for n, c in found.items())).first().asDict().items() if v} == kinds
