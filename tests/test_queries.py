"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted(str(tuple(plain(dict(zip(columns, row))[c]) for c in sorted(columns))) for row in cursor.fetchall())
    assert sorted(str(tuple(plain(row[c]) for c in sorted(columns))) for row in got) == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grid_markdown_holds_every_word(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(200))
    rows = [(1, f"{long}\nshort line"), (2, "one"), (3, "a" * 25 + " b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.markdown for r in QUERIES["grid_markdown"](spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        assert sorted(w for w in got[doc_id].split("\n")[0].split() if w not in ("|", "Column") and not w.isdigit()) == sorted(text.split())
    assert {d: got[d].split("\n")[0].count(" |") for d in got} == {1: -(-8 * len(long) // 200), 2: 1, 3: 2}


def test_cells_hold_every_word(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(200))
    texts = {1: f"{long}\nshort line", 2: "one", 3: "a" * 25 + " b", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cells, grids = {}, {}
    for doc_id, told in texts.items():
        for n, line in enumerate(told.split("\n")):
            left = 0
            for word in filter(None, line.split(" ")):
                col = max(-(-(2 * left + 8 * len(word)) // 400) - 1, 0)
                cells.setdefault((doc_id, n // 2, col), []).append(word)
                left += 8 * (len(word) + 1)
                grids[doc_id] = max(grids.get(doc_id, (0, 0)), (left - 8, 1))
    got = QUERIES["words_to_cells"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.row, r.col): r.cell for r in got} == {k: " ".join(ws) for k, ws in cells.items()}
    covered = {r.doc_id: (r.filled, r.cells) for r in QUERIES["cell_coverage"](spark, str(tmp_path)).collect()}
    assert covered == {d: (sum(k[0] == d for k in cells), -(-grids[d][0] // 200)) for d in grids}


def test_valid_selectors_of_any_key(spark, tmp_path):
    """Keys up to the largest int: a selector of that many characters is too long, and is told so without writing it out."""
    keys = [0, 1, 499, 500, 501, 502, 100_000, 2_147_483_647]
    rows = [(key, kind, key, kind) for key in keys for kind in range(4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.l_partkey, r.l_suppkey): r.valid for r in QUERIES["valid_selectors"](spark, str(tmp_path)).collect()}
    assert got == {(key, kind): kind == 0 or kind == 2 and 1 <= key <= 500 for key in keys for kind in range(4)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE l_partkey < 1000000")
    assert {(p, s): v for _, _, p, s, v in con.execute(ORACLES["valid_selectors"]).fetchall()} == {k: v for k, v in got.items() if k[0] < 1_000_000}


def test_shares_and_seconds_round_as_their_sql(spark, tmp_path):
    """Shares and seconds that end in a 5 after the places told: the double's exact value decides, ties go to even."""
    shares = [(21, 32), (23, 32), (1, 32), (1, 160), (3, 160), (2, 7), (5, 5)]
    rows, at = [], 0
    for user, (ok, total) in enumerate(shares):
        for k in range(total):
            event = 6 * at + (1 if k < ok else 3)
            rows.append((event, 4 * user, "click", [0.0005, 0.0625, 1.0005, 2.0015, 0.1875, 2.5, 0.3125][user]))
            at += 1
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    told = {r.file: r.percent for r in QUERIES["golden_matches"](spark, str(tmp_path)).collect()}
    assert told == {f"f{4 * u}.pdf": f"{100 * ok / total:.2f}" for u, (ok, total) in enumerate(shares)} and told["f0.pdf"] == "65.62"
    for name in ("golden_matches", "joined_summaries", "timed_matrix"):
        df = QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())


def test_merged_positions_of_boxes_without_an_order(spark, tmp_path):
    """Boxes alike in place and number lie in one group, in whatever order they are read."""
    boxes = [(k, n, x + 40 * k, 1, 1.0) for k in range(40) for n, x in [(1, 0), (1, 0), (1, 3), (2, 20), (2, 20), (2, 20), (1, 39), (1, 39)]]
    for nth, rows in enumerate((boxes, boxes[::-1])):
        folder = str(tmp_path / str(nth))
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
        got = sorted(map(tuple, QUERIES["merged_positions"](spark, folder).select("k", "group", "position", "members").collect()))
        assert got == [(k, *told) for k in range(40) for told in ((1, 1, 3), (2, 20, 3), (3, 39, 2))]
