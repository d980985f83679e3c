"""Literal vectors for functions, folds, operators, sources and streams."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import folds, text
from weftline.operators import evaluation, tasks, words
from weftline.plans import reports
from weftline.session import table
from weftline.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<array<string>>' if isinstance(v, list) and v and isinstance(v[0], list) else 'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, clean", [("  • item one\n\n\n– item two\nplain  ", "- item one\n\n- item two\nplain"), ("", ""), ("3.third\n* star\n-x", "- third\n- star\n-x")])
def test_markdown(spark, raw, clean):
    assert one(spark, text.markdown(F.col("t")), t=raw) == clean


def test_redaction(spark):
    safe = one(spark, text.redact(F.col("t")), t="Bearer abc.def token=secret 4567​8901​2345​6789")
    assert "secret" not in safe and "abc.def" not in safe and "8901" not in safe and "[REDACTED" in safe
    assert len(one(spark, text.redact(F.col("t"), 512), t="x" * 5000)) == 512


def test_chunks_count_code_points(spark):
    assert one(spark, text.chunks(F.col("t"), 2), t="A𝌆🙂B") == ["A𝌆", "🙂B"]
    assert one(spark, text.chunks(F.col("t"), 2), t="") == []


def test_html(spark):
    page = "<html><title> A &amp;lt; B </title><body><p>x</p><script>no</script></body></html>"
    assert one(spark, text.strip_html(F.col("t")), t=page) == "A < B"
    assert one(spark, text.strip_html(F.col("t")), t=page.replace(" A &amp;lt; B ", "")) == "x"


def test_price_and_quantity(spark):
    assert one(spark, text.last_price(F.col("t")), t="a 10 ₽ b 12,5 € c") == "12,5 €"
    assert one(spark, text.first_quantity(F.col("t")), t="2 шт 300 г") == "2 шт"
    assert one(spark, text.last_price(F.col("t")), t="none") is None


@pytest.mark.parametrize("raw, kind", [(b"%PDF-1.7", "application/pdf"), (b"\x89PNG\r\n\x1a\n..", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"RIFF\0\0\0\0WEBPVP8 ", "image/webp"), (b"RIFF", None), (b"", None)])
def test_sniff(spark, raw, kind):
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(text.sniff(F.col("c")).alias("k")).first().k == kind


def test_table_markdown(spark):
    assert one(spark, text.table_markdown(F.col("r")), r=[["Name", ""], ["", " "], ["Math", "42", "x"]]) == "| Name | Column 2 | Column 3 |\n| --- | --- | --- |\n| Math | 42 | x |"
    assert one(spark, text.table_markdown(F.col("r")), r=[["Name", "Hours"]]) == "| Name | Hours |\n| --- | --- |\n|   |   |"
    assert one(spark, text.table_markdown(F.col("r")), r=[[" "]]) == ""


@pytest.mark.parametrize("seconds, label", [(0.4, "<1 s"), (59.4, "59 s"), (90, "2 min"), (3600, "1 h"), (3690, "1 h 2 min")])
def test_duration_label(spark, seconds, label):
    assert spark.range(1).select(text.duration_label(F.lit(seconds)).alias("x")).first().x == label


@pytest.mark.parametrize("chunks, merged", [([["P0", "P1", "P2"], ["p1 ", "P2", "P3"], ["P3", "P4"]], "P0\nP1\nP2\nP3\nP4"), ([["Header", "  Product A  "], ["product a", "Footer"]], "Header\n  Product A  \nFooter"), ([["a", ""], ["", "b"]], "a\n\n\nb")])
def test_overlap_merge(spark, chunks, merged):
    assert one(spark, folds.overlap_merge(F.col("c")), c=chunks) == merged


def test_ordered_recall(spark):
    recall = folds.ordered_recall(F.col("p"), F.col("t"))
    assert one(spark, recall, p=["a", "b", "c"], t="a b c") == 1
    assert one(spark, recall, p=["a", "c", "b"], t="a b c") == pytest.approx(2 / 3)


def test_line_groupings_differ(spark):
    rows = [(0, 0, "a"), (9, 30, "b"), (18, 60, "c")]
    df = spark.createDataFrame([(rows,)], "ws array<struct<top:int,left:int,text:string>>")
    assert df.select(folds.anchored_groups(F.col("ws")).alias("x")).first().x == ["a b", "c"]
    flat = spark.createDataFrame([(1, top, left, left + 8, top + 2, t) for top, left, t in rows], "doc_id long, y1 int, x1 int, x2 int, y2 int, text string")
    assert [r.line for r in words.chained_lines(flat, 10).collect()] == ["a b c"]


def test_segments_bands_and_clusters(spark):
    row = spark.range(1).select(
        folds.bounded_segments(F.array(*map(F.lit, (10, 20, 45, 90))), F.lit(100), 40).alias("s"),
        folds.mean_clusters(F.array(*map(F.lit, (1, 3, 5, 20))), 3).alias("c"),
        folds.split_by_bands(F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(6).alias("start"), F.lit(8).alias("end")), F.struct(F.lit(20).alias("start"), F.lit(22).alias("end"))), F.lit(25), 5).alias("b"),
    ).first()
    assert [tuple(x) for x in row.s] == [(0, 20), (20, 45), (45, 90), (90, 100)]
    assert row.c == [[1, 3, 5], [20]]
    assert [tuple(x) for x in row.b] == [(4, 25)]


def test_interval_index_takes_the_first_of_two(spark):
    edges = F.array(*map(F.lit, (0, 10, 20)))
    got = spark.createDataFrame([(0,), (10,), (11,), (21,), (-1,)], "p int").select(words.interval_index(F.col("p"), edges).alias("i")).collect()
    assert [r.i for r in got] == [0, 0, 1, None, None]


def test_islands(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (1, 1, 2), (1, 9, 10), (2, 0, 1)], "k int, a int, b int")
    assert sorted((r.k, r.a, r.b, r.members) for r in words.islands(rows, ["k"], "a", "b").collect()) == [(1, 0, 6, 3), (1, 9, 10, 1), (2, 0, 1, 1)]


def test_suppression_is_greedy(spark):
    boxes = [(-100, 0, 0, 10, 10), (-90, 0, 0, 9, 10), (-25, 50, 50, 55, 55)]
    df = spark.createDataFrame([(boxes,)], "b array<struct<area:int,y1:int,x1:int,x2:int,y2:int>>")
    assert df.select(F.size(words.suppress(F.col("b"))).alias("n")).first().n == 2


def test_confidence_filter(spark):
    rows = [("ok", 40.0), ("low", 39.0), ("12,5", 3.0), ("x", -1.0), ("..?", 99.0), (" ", 99.0)]
    got = words.confident(spark.createDataFrame(rows, "text string, conf double")).collect()
    assert [r.text for r in got] == ["ok", "12,5"]


def test_circuit_breaker(spark):
    calls = [(0, 1, False, True), (1, 2, False, True), (2, 3, False, True), (5, 4, True, True), (40, 5, True, True), (41, 6, False, False)]
    df = spark.createDataFrame([(calls,)], "c array<struct<at:bigint,event_id:bigint,ok:boolean,retryable:boolean>>")
    assert df.select(folds.circuit_states(F.col("c"), 3, 30).alias("x")).first().x == ["failed", "failed", "failed", "open", "ok", "failed"]


def test_merged_cells(spark):
    got = one(spark, folds.merged_cells(F.col("r")), r=["a", "::merge-left::", "", "::merge-up::", "b"])
    assert [tuple(x) for x in got] == [("a", 0, 2), ("", 2, 1), ("b", 4, 1)]


@pytest.mark.parametrize("file, percent, gate", [("a.png", 87, "pass"), ("a.pdf", 89, "fail"), ("A.PDF.page-001.raster.png", 90, "pass"), ("a.pdf.raster.jpg", None, "n/a")])
def test_gate(spark, file, percent, gate):
    df = spark.createDataFrame([(file, percent)], "f string, p int")
    assert df.select(reports.gate(F.col("p"), reports.threshold(F.col("f"))).alias("g")).first().g == gate


def test_expected_lines(spark):
    raw = "## Page 1\nUseful text\n### Page 25\n| Header |\n| --- |\n```\n"
    got = evaluation.expected_lines(spark.createDataFrame([(1, raw)], "item_id int, text string"), "item_id").collect()
    assert [r.line for r in got] == ["Useful text", "| Header |"]


def test_contained_lines_start_and_end_within_words(spark):
    lines = spark.createDataFrame([(1, 0, "ne two thr"), (1, 1, "Two"), (1, 2, "two  three four")], "item_id int, line_no int, line string")
    docs = spark.createDataFrame([(7, "one TWO three"), (8, "nothing")], "doc_id int, text string")
    assert sorted((r.line_no, r.doc_id) for r in evaluation.contained_lines(lines, docs).collect()) == [(0, 7), (1, 7)]


def test_fuzzy_and_error_rate(spark):
    assert evaluation.fuzzy_contains("abcdefgh1jklmnop", "abcdefghijklmnop") and not evaluation.fuzzy_contains("a" * 8000, "b" * 24)
    rates = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abxd"), ("", ""), ("", "x")], "e string, a string").select(evaluation.error_rate(F.col("e"), F.col("a")).alias("r")).collect()
    assert [r.r for r in rates] == [0, 0.25, 0, 1]


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "87.5"), ("b.png", "n/a")], "file string, match string")
    files.write_delimited(rows, str(tmp_path / "r"), "\t")
    read = files.delimited(spark, str(tmp_path / "r"), ["file", "match"], "\t")
    assert sorted((r.file, r.n) for r in read.select("file", files.number(F.col("match")).alias("n")).collect()) == [("a.png", 87.5), ("b.png", None)]
    assert files.delimited(spark, str(tmp_path / "none"), ["file"]).collect() == []


def test_ndjson_uploads_and_settings(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.ndjson").write_text('{"type": "page", "page": 1}\n\n{"type": \n')
    got = files.ndjson(spark, str(tmp_path / "log"), "type string, page int").collect()
    assert sorted((r.type or "", r.malformed) for r in got) == [("", True), ("page", False)]
    (tmp_path / "up").mkdir()
    for name, size in (("a.pdf", 5), ("b.pdf", 0), ("c.pdf", 11)):
        (tmp_path / "up" / name).write_bytes(b"x" * size)
    good, bad = files.uploads(spark, str(tmp_path / "up"), 10, "*.pdf")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["empty", "too large"]
    assert one(spark, files.settings(F.col("t")), t="# c\nA=1\nB = 'x=y'\n\n") == {"A": "1", "B": "x=y"}
    assert one(spark, files.result_body(F.col("t")), t="# t\n---\nbody") == "body"


def test_streams_agree_with_batch(spark, tmp_path):
    from weftline.streaming import tasks as streams

    events = table(spark, SF, "events")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = streams.event_stream(spark, str(tmp_path / "in"), schema)
    streams.state_stream(source).writeStream.format("memory").queryName("task_states").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r.task: (r.state, r.pages, r.events) for r in spark.table("task_states").collect()}
    assert got == {r.task: (r.state, r.pages, r.events) for r in tasks.states(tasks.task_log(events)).collect()}
    streams.session_stream(source, "user_id", "4 hours", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    ended = spark.table("sessions").count()
    every = tasks.sessions(events, "user_id", 14400).count()
    assert 0 < ended <= every
