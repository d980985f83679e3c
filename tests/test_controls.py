"""Control operators and the workbook sink on small cases with known results."""

import datetime as dt
import random
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import controls
from weftline.sources import sheets


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_grace_cancel(spark):
    logs = {
        "back in time": [(0, "open"), (10, "close"), (12, "open")],
        "left": [(0, "open"), (10, "close"), (30, "open")],
        "one stays": [(0, "open"), (1, "open"), (10, "close")],
        "ended first": [(0, "open"), (5, "end"), (10, "close")],
        "stray close": [(0, "close"), (1, "open"), (9, "close")],
    }
    rows = [(name, n, at(t), kind) for name, log in logs.items() for n, (t, kind) in enumerate(log)]
    found = controls.grace_cancelled(spark.createDataFrame(rows, "task string, event_id long, ts timestamp, kind string"), "task", 5).collect()
    assert {r["task"]: r["event_id"] for r in found} == {"left": 1, "stray close": 2}
    empty = spark.createDataFrame([], "task string, event_id long, ts timestamp, kind string")
    assert controls.grace_cancelled(empty, "task", 5).count() == 0


def test_backfill(spark):
    rows = [("a", 1, "", True, False), ("a", 2, "S", True, True), ("a", 3, "", True, False), ("a", 4, "", False, False), ("a", 5, "", True, False), ("a", 6, "S.04", True, False), ("a", 7, "", True, False)]
    rows += [("b", 1, "", True, False), ("b", 2, "", True, False), ("b", 3, "X.2", True, False), ("c", 1, "", True, False)]
    got = controls.backfilled(spark.createDataFrame(rows, "k string, n int, idx string, payload boolean, section boolean"), "k", ["n"]).orderBy("k", "n").collect()
    assert [r["idx"] for r in got] == ["", "S", "S.02", "", "S.03", "S.04", "", "", "X.1", "X.2", ""]


@pytest.mark.parametrize(("limit", "size", "overlap", "starts"), [(10, 20, 3, [0]), (10, 4, 1, [0, 3, 6]), (10, 4, 0, [0, 4, 6]), (10, 4, 9, [0, 1, 2, 3, 4, 5, 6]), (0, 4, 1, [0])])
def test_covering_starts(spark, limit, size, overlap, starts):
    made = controls.covering_starts(*(F.lit(x).cast("bigint") for x in (limit, size, overlap)))
    assert spark.range(1).select(made.alias("s")).first()["s"] == starts


def test_crops_cover_the_page(spark):
    crops = controls.crop_plan(spark.createDataFrame([(1, 640, 480), (2, 4000, 90)], "image int, width long, height long"), "image").collect()
    for image, width, height in ((1, 3300, 2475), (2, 4000, 90)):
        for nth in range(len(controls.TILE_PASSES)):
            grid = np.zeros((height, width), bool)
            for c in crops:
                if (c["image"], c["pass"]) == (image, nth):
                    grid[c["top"] : c["bottom"], c["left"] : c["right"]] = True
            assert grid.all()
        assert all(0 <= c["left"] < c["right"] <= width for c in crops if c["image"] == image)


def test_visible_messages(spark):
    nodes = [(1, 0, None, False, True), (1, 1, 0, True, True), (1, 2, 1, False, True), (1, 3, 0, False, True), (1, 4, 3, False, False), (1, 5, 4, False, True), (1, 6, 99, False, True)]
    df = spark.createDataFrame(nodes, "page int, node long, parent long, hidden boolean, told boolean")
    assert [(r["place"], r["node"]) for r in controls.visible_messages(df, "page").orderBy("place").collect()] == [(0, 0), (1, 3), (2, 5), (3, 6)]
    with pytest.raises(Exception, match="exceeds 3 nodes"):
        controls.visible_messages(df, "page", most=3).collect()


def test_square_to_quad_matches_a_solved_homography(spark):
    rng = random.Random(5)
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for _ in range(3):
        quad = [(100 * x + rng.uniform(0, 20), 80 * y + rng.uniform(0, 20)) for x, y in square]
        left, right = [], []
        for (u, v), (x, y) in zip(square, quad, strict=True):
            left += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
            right += [x, y]
        m = np.append(np.linalg.solve(np.array(left, float), right), 1).reshape(3, 3)
        wanted = m @ (0.3, 0.7, 1)
        x, y = controls.square_to_quad(F.lit(0.3), F.lit(0.7), [(F.lit(a), F.lit(b)) for a, b in quad])
        assert tuple(spark.range(1).select(x, y).first()) == pytest.approx(tuple(wanted[:2] / wanted[2]))


def test_paths_selectors_and_shares(spark):
    paths = ["", "a/b", "a/../b", "a/../../b", "..", "/..", "./x"]
    assert [spark.range(1).select(controls.safe_path(F.lit(p))).first()[0] for p in paths] == [True, True, True, False, False, False, True]
    selectors = ["main > p", "a >> b", "", "x" * 501, "a[href=javascript:1]", "{x}"]
    assert [spark.range(1).select(controls.valid_selector(F.lit(s))).first()[0] for s in selectors] == [True, False, False, False, False, False]
    assert [spark.range(1).select(controls.share(F.lit(x).cast("double"))).first()[0] for x in (None, float("nan"), -1.0, 0.5, 1.0, 50.0, 900.0)] == [None, None, 0.0, 0.5, 1.0, 0.5, 1.0]
    assert spark.range(1).select(controls.document_share(F.lit(0), F.lit(1), F.lit(0.5))).first()[0] is None


def test_workbook(spark, tmp_path):
    report = spark.createDataFrame([("a.png", 91.5, "x < y & z"), ("a.png", 80.0, None), ("b.png", 70.0, "")], "file string, percent double, note string")
    path = str(tmp_path / "report.xlsx")
    sheets.write_xlsx(report.coalesce(1), f"file://{path}", "file")
    with zipfile.ZipFile(path) as archive:
        assert archive.testzip() is None
        for name in archive.namelist():
            ElementTree.fromstring(archive.read(name))
        sheet = ElementTree.fromstring(archive.read("xl/worksheets/sheet1.xml"))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rows = sheet.findall(".//m:row", ns)
    assert ["".join(c.itertext()) for c in rows[1].findall("m:c", ns)] == ["a.png", "91.5", "x < y & z"]
    assert [r.find("m:c", ns).get("s") for r in rows] == ["1", "2", "0", "2"]
    assert [sheets._name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
