"""Each operator's query against a brute-force version on a small table with every edge case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from weftline.llm import automaton_dedup, bitplane, common, drr_packing, html_mss, knapsack_mix, lsm_dedup, secrets_dp, simhash_trie, tiff, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, digest string, row string, fp string"


def _rows():
    rng = random.Random(5)
    words = [a + b for a in ("ta", "ré", "ki", "no", "ßu") for b in ("lo", "mi", "sé", "na")] + ["the", "of", "and"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    texts = [None, "", "  \n", "one", "Two words", prose(3000), "a b c " * 40]
    texts += [prose(rng.randint(5, 120)) for _ in range(40)]
    shared = prose(30)
    texts += [f"{prose(20)} {shared} {prose(9)}" for _ in range(6)]
    texts += [texts[9]] * 5 + [texts[9].replace(" ", "\n "), texts[10] + " more", texts[11].upper()]
    rows = [(k, t, "en", rng.choice(["s1", "s2", "s3", None]), None, "x", "x", "x", "x", "x") for k, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, "null id", None, None, None, None, None, None, None, None)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return common.materialise(spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id"), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("op", [bitplane.op1, tiff.op2, drr_packing.op3, lsm_dedup.op5, secrets_dp.op6, knapsack_mix.op7, automaton_dedup.op8, weak_quality.op9, simhash_trie.op10])
def test_empty_table(op, empty):
    assert op(empty).collect() == []


def _ids(name, text, end):
    return Tokenizer.from_file(common.tokenizer_file(name)).encode(text or "", add_special_tokens=False).ids + [end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(docs):
    wanted, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = _ids("word_bpe_49k.json", text, 2)
        wanted.append((doc_id, start, len(ids), _crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in bitplane.op1(docs).collect()]
    assert Counter(got) == Counter(wanted)


def test_op2(docs):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in tiff.op2(docs).collect()}
    wanted = set()
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        wanted.add((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == wanted
    assert tiff.op2(docs).where("error IS NOT NULL").count() == 0


def test_tiff_pages_as_rows(docs):
    pages = tiff.read_pages(tiff.encode_media(docs), "doc_id", "media")
    assert pages.where("error IS NULL AND length(pixels) = width * height * samples").count() == pages.count() >= len(ROWS)


def test_op3(docs):
    pieces = drr_packing.op3(docs).collect()
    ids = {doc_id: _ids("byte_bpe_50k.json", text, 0) for doc_id, text, *_ in ROWS}
    copies = Counter(r[0] for r in ROWS)
    covered = defaultdict(int)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == _crc(ids[p.doc_id][p.start : p.start + p.length]) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == {d: copies[d] * len(x) for d, x in ids.items()}
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or number == max(sequences)


def test_op4(spark):
    pages = [(1, "u", None, "x"), (2, "v", "", "x"), (3, "w", "<article><p>" + "long words here " * 5000 + "</p></article>", "x"), (3, "w", "<article><p>again</p></article>", "x")]
    got = html_mss.op4(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, 0), (2, 0), (3, 16 * 5000 - 1), (3, 5)])
    assert html_mss.op4(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_op5(docs):
    groups = defaultdict(list)
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for doc_id, text, *_ in ROWS:
        groups[(text or "").translate(strip)].append((-len(text or ""), doc_id))
    got = lsm_dedup.op5(docs).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for norm, members in groups.items():
        rows = by[hashlib.sha256(norm.encode()).hexdigest()]
        best = min(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0))[1]
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((m[1] is not None, m[1] or 0) for m in members)
        assert {r.keep_id for r in rows} == {best} and {r.group_size for r in rows} == {len(members)}
        assert sum(r.kept for r in rows) == 1


def test_equal_digests_of_other_bytes_are_told_apart(docs, monkeypatch):
    plain = lsm_dedup._digested
    monkeypatch.setattr(lsm_dedup, "_digested", lambda d: plain(d).withColumn("digest", lsm_dedup.F.unhex(lsm_dedup.F.lit("00"))))
    few = docs.where("doc_id < 20")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in lsm_dedup.dedup(few).collect()}
    assert got[0] == (2, 3) and got[3] == (3, 1) and got[12][1] == 3


def test_op6(docs):
    ranks = secrets_dp.word_ranks(common.tokenizer_file("byte_bpe_50k.json"))
    assert sum(r.n_assign for r in secrets_dp.op6(docs).collect()) == sum(k == "assign" for _, t, *_ in ROWS for k, _, _ in secrets_dp.spans(t or "", ranks))
    spark = docs.sparkSession
    text = "é password = hunter22 x"
    row = secrets_dp.op6(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_assign == 1 and row.base_sha256 == hashlib.sha256(b"assign:2:21").hexdigest() and row.spans == "assign:2:21"


def test_op7(docs):
    got = knapsack_mix.mix(docs).collect()
    assert len(got) == len(ROWS)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert target == pytest.approx(knapsack_mix.targets(dict(size)))
    for source in size:
        assert abs(taken[source] - target[source]) <= 25
    assert Counter(map(tuple, got)) == Counter(map(tuple, knapsack_mix.mix(docs).collect()))


def test_op8(docs):
    wanted = _op8_brute([(r[0], r[1]) for r in ROWS])
    assert any(w[2] for w in wanted)
    assert Counter(map(tuple, automaton_dedup.op8(docs).collect())) == wanted


def _op8_brute(rows):
    starts = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - 12):
            if doc_id is not None:
                starts[tuple(words[k : k + 13])] = min(doc_id, starts.get(tuple(words[k : k + 13]), doc_id))
    wanted = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = {j for k in range(len(words) - 12) if doc_id is not None and starts[tuple(words[k : k + 13])] < doc_id for j in range(k, k + 13)}
        wanted.append((doc_id, len(words), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()))
    return Counter(wanted)


@pytest.mark.parametrize("small", [False, True])
def test_op8_passage_in_every_document(spark, monkeypatch, small):
    """One passage in every document, long documents, chains of near copies; with small limits all cuts and salts are taken."""
    if small:
        for name, value in (("GROUP_BYTES", 2000), ("BATCH_WINDOWS", 200), ("CHUNK_WORDS", 16), ("SHARD_WORDS", 64), ("SEGMENT_WORDS", 100)):
            monkeypatch.setattr(automaton_dedup, name, value)
        monkeypatch.setattr(common, "HOT_KEYS", 4)
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage, long = prose(40), prose(3000)
    rows = [(k, f"{prose(rng.randint(0, 60))} {passage} {prose(rng.randint(0, 60))}") for k in rng.sample(range(1000), 150)]
    rows += [(1001, long), (1002, long + " end"), (5, long[500:9000]), (1003, "a b " * 300), (1004, "b a " * 50)]
    words = rows[0][1].split()
    for k in range(20):
        words[rng.randrange(len(words))] = f"x{k}"
        rows.append((rng.randrange(2000), " ".join(words)))
    rows += [rows[3], (rows[4][0], prose(30) + " " + passage), (None, passage), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, automaton_dedup.op8(table).collect())) == _op8_brute(rows)


def test_op9_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    from weftline.session import table

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    got = weak_quality.op9(table(spark, sf_dir, "documents")).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99


def test_op9_edges(docs):
    got = {r.doc_id: r for r in weak_quality.op9(docs).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and not got[0].kept and not got[1].kept and not got[2].kept
    assert weak_quality.accepted(docs).columns == docs.columns


def _components(texts):
    prints = {}
    for doc_id, text in texts:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and least[a] < least[b]:
                    least[b], changed = least[a], True
    return {d: (f"{prints[d]:016x}", least[d]) for d in prints}


@pytest.mark.parametrize("split", [200_000, 1])
def test_op10(docs, split, monkeypatch):
    plain = simhash_trie.links
    monkeypatch.setattr(simhash_trie, "links", lambda classes: plain(classes, split))
    wanted = _components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    got = simhash_trie.op10(docs.where("doc_id IS NOT NULL")).collect()
    assert len(got) == sum(r[0] is not None for r in ROWS)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == wanted
    assert simhash_trie.op10(docs.where("doc_id IS NULL")).first().component_id is None


@pytest.mark.parametrize("hot", [4096, 2])
def test_components_of_a_star_with_a_tail(spark, monkeypatch, hot):
    """A hub of many edges, whose rows are broadcast where it counts as hot, a chain from it and a tree apart."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    edges = [(500, k) for k in range(60)] + [(500 + k, 501 + k) for k in range(9)] + [(1000 + k, 1000 + k // 2) for k in range(1, 40)]
    got = {r.node: r.root for r in simhash_trie.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in [*range(60), *range(500, 510)]}, **{1000 + k: 1000 for k in range(40)}}
    assert simhash_trie.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.root for r in simhash_trie.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 100: 90}


@pytest.mark.parametrize("most", [4, 0])
def test_bounded_filter_has_no_false_negatives(docs, most):
    """Also where the filter is given up as too full (most = 0)."""
    keys = docs.where("doc_id % 3 = 0")
    marks = common.bounded_filter(keys, "doc_id", most)
    assert {r.doc_id for r in common.maybe_in(docs, "doc_id", marks).collect()} >= {r[0] for r in ROWS if r[0] is not None and r[0] % 3 == 0}
    both = common.maybe_in(docs, "doc_id", marks).count() + common.maybe_in(docs, "doc_id", marks, negate=True).count()
    assert both == len(ROWS)


def test_filter_lets_few_others_pass(spark):
    keys = common.materialise(spark.range(50_000), "test-keys")
    others = spark.range(1_000_000, 1_050_000)
    passed = common.maybe_in(others, "id", common.bounded_filter(keys, "id")).count()
    assert passed < 0.04 * 50_000


def test_join_hot(spark, monkeypatch):
    """A key with most rows meets a broadcast row, the others a shuffle; the result is the plain join's."""
    left = common.materialise(spark.range(20_000).selectExpr("if(id < 15000, 7, id) AS k", "id AS v"), "test-left")
    right = common.materialise(left.groupBy("k").count().withColumn("w", common.F.col("k") + 1).where("k != 16000"), "test-right")
    got = common.join_hot(left, right, "k", "count", 20_000, "left")
    plain = left.join(right.drop("count"), "k", "left").select("k", "v", "w")
    assert got.columns == ["k", "v", "w"] and got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, left = documents, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == documents.columns
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] >= left[1] >= left[2] >= left[3]
    kept = {r.doc_id: r.text for r in documents.collect()}
    prose = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert prose <= left[0]
    norm = [kept[d].translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for d in left[1]]
    assert len(set(norm)) == len(norm) and {kept[d].translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for d in left[0]} == set(norm)
    found = _components([(d, kept[d]) for d in left[1]])
    assert left[2] == {least for _, least in found.values()}
    pieces = pipeline.run(spark, sf_dir).collect()
    copies = Counter(r.doc_id for r in docs.collect())
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(copies)
    assert all(tokens[p.doc_id] == copies[p.doc_id] * p.doc_tokens for p in pieces)


def test_pipeline_near_dedup_links_at_four_fifths(spark):
    """Five-word shingles, all pairs compared; a copy just below 0.8 stays, one at 0.8 or more goes."""
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append((3 * k, " ".join(words), "en", "s", 0))
        for j, changed in enumerate((len(words) // 50, len(words) // 25)):
            for at in rng.sample(range(len(words)), changed):
                words[at] = "other"
            rows.append((3 * k + j + 1, " ".join(words), "en", "s", 0))
    rows += [(500, "", "en", "s", 0), (501, None, "en", "s", 0), (None, rows[0][1], "en", "s", 0), (502, "two words", "en", "s", 0), (502, "TWO  words", "en", "s", 0)]
    sets = []
    for _, text, *_ in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    wanted = Counter(min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None)) for r in set(root))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter(r.doc_id for r in common.materialise(pipeline.near_dedup(spark, docs, ""), "test-near").collect())
    assert 60 < len(set(root)) < len(rows) - 5
    assert got == wanted


def test_pipeline_decides_by_row(spark):
    """Null and repeated doc_ids: copies go row by row, and each row has its own number in the mix."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "B b"), (7, "A a"), (7, "B\nb"), (None, "C c"), (None, "C\nc"), (None, "D d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    got = [(r.doc_id, r.text.split()[0]) for r in common.materialise(pipeline.exact_dedup(spark, docs, ""), "test-rows").collect()]
    assert Counter(got) == Counter([(3, "B"), (7, "A"), (None, "C"), (None, "D")])
    same = spark.createDataFrame([(1, "a b c " * (k + 1), "en", s, 0) for k in range(9) for s in ("s1", "s2", None)], schema)
    words = sum(r.taken for r in knapsack_mix.mix(same).collect())
    assert sum(len(r.text.split()) for r in common.materialise(pipeline.mixture(spark, same, ""), "test-mixed").collect()) == words


def test_pipeline_edges(spark, docs, empty):
    import corpus_pipeline as pipeline

    for table in (docs, empty):
        left = table
        for name, stage in pipeline.STAGES[:-1]:
            left = common.materialise(stage(spark, left, ""), f"edge-{name}")
        assert pipeline.STAGES[-1][1](spark, left, "").count() >= 0
    once = common.materialise(pipeline.exact_dedup(spark, docs, ""), "edge")
    assert Counter(r.doc_id for r in once.collect())[12] == 1


def test_lsm_levels_of_several_batches(docs, monkeypatch):
    """Batches flushed and merged level by level give the rows of one batch; hot digests are salted."""
    wanted = Counter(map(tuple, lsm_dedup.op5(docs).collect()))
    monkeypatch.setattr(lsm_dedup, "SALT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 30)
    batches = [docs.where(f"coalesce(doc_id, 0) % 4 = {k}") for k in range(4)]
    assert Counter(map(tuple, lsm_dedup.dedup(docs, batches).collect())) == wanted
    index = lsm_dedup.Index()
    index.insert(docs)
    index.insert(docs.where("doc_id = 4"))
    assert [n for n, _ in index.levels] and len(index.levels) == 2
    assert sum(r.rows for r in index.lookup("Two\nwords").collect()) == 2


def test_pipeline_pieces_hold_every_document_the_mix_took(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"test-{name}")
    copies, tokens = Counter(r.doc_id for r in docs.collect()), Counter()
    pieces = pipeline.run(spark, sf_dir).collect()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(copies)
    assert all(tokens[p.doc_id] == copies[p.doc_id] * p.doc_tokens for p in pieces)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_in_chains(spark, monkeypatch, small):
    """Chains in which only neighbours are alike: the comparison with smallest rows leaves parts that blocks must join."""
    from weftline.llm import jaccard

    if small:
        monkeypatch.setattr(jaccard, "BLOCK", 2)
        monkeypatch.setattr(jaccard, "SHARE", 3)
        monkeypatch.setattr(common, "HOT_KEYS", 2)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(4)
    rows, key = [], 0
    for _ in range(3):
        words = [f"w{rng.randrange(9000)}" for _ in range(150)]
        for _ in range(25):
            for at in rng.sample(range(150), 2):
                words[at] = f"x{rng.randrange(9000)}"
            rows.append((key, rng.choice([None, rng.randrange(1000)]), " ".join(words)))
            key += 1
    rows += [(key + k, 5, t) for k, t in enumerate(["", None, " ", "a b", "A  b", rows[7][2].upper(), rows[7][2]])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in ((t or "").lower().split() for _, _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    stays = {min((rows[k][1] is None, rows[k][1] or 0, rows[k][0]) for k in range(len(rows)) if root[k] == r)[2] for r in set(root)}
    stored = common.materialise(spark.createDataFrame(rows, "rowkey long, doc_id long, text string").repartition(3), "test-chains")
    gone = [r.rowkey for r in jaccard.surplus(stored, "rowkey").collect()]
    assert 3 < len(stays) < len(rows) - 5
    assert sorted(gone) == sorted({r[0] for r in rows} - stays)


def _tiff_by_hand(data):
    """Grey 8-bit pages of a little-endian file, read plainly: (width, rows of bytes) for each directory."""
    number = lambda at, size: int.from_bytes(data[at : at + size], "little")
    at, pages = number(4, 4), []
    while at:
        tags = {}
        for k in range(number(at, 2)):
            entry = at + 2 + 12 * k
            size, count = {3: 2, 4: 4}[number(entry + 2, 2)], number(entry + 4, 4)
            place = entry + 8 if size * count <= 4 else number(entry + 8, 4)
            tags[number(entry, 2)] = [number(place + size * j, size) for j in range(count)]
        at = number(at + 2 + 12 * number(at, 2), 4)
        width, height, how = tags[256][0], tags[257][0], tags[259][0]
        tiled = 322 in tags
        wide, tall = (tags[322][0], tags[323][0]) if tiled else (width, tags[278][0])
        rows = [bytearray(width) for _ in range(height)]
        for k, (place, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
            y, x = k // -(-width // wide) * tall, k % -(-width // wide) * wide
            raw = data[place : place + size]
            if how == 8:
                raw = zlib.decompress(raw)
            elif how == 32773:
                out, j = b"", 0
                while j < len(raw):
                    n = raw[j] - 256 if raw[j] > 127 else raw[j]
                    out, j = (out + raw[j + 1 : j + 2 + n], j + 2 + n) if n >= 0 else (out + raw[j + 1 : j + 2] * (1 - n), j + 2)
                raw = out
            elif how == 5:
                bits, out, table, last, j, width_ = int.from_bytes(raw, "big"), b"", {}, None, 0, 9
                while True:
                    code = bits >> (8 * len(raw) - j - width_) & (1 << width_) - 1
                    j += width_
                    if code == 257:
                        break
                    if code == 256:
                        table, last, width_ = {k: bytes([k]) for k in range(256)} | {256: None, 257: None}, None, 9
                        continue
                    entry = table[code] if code in table else last + last[:1]
                    out += entry
                    if last is not None:
                        table[len(table)] = last + entry[:1]
                    width_ = max(9, (len(table) + 1).bit_length())
                    last = entry
                raw = out
            for j in range(min(tall, height - y)):
                line = bytearray(raw[j * wide : (j + 1) * wide])
                if tags[317][0] == 2:
                    for i in range(1, len(line)):
                        line[i] = (line[i] + line[i - 1]) % 256
                rows[y + j][x : x + wide] = line[: width - x]
        pages.append((width, [bytes(r) for r in rows]))
    return pages


def test_op2_media(docs):
    """The stored files hold the payloads, read by another reader; features are worked out again from its pages."""
    files = {r.media: r for r in tiff.encode_media(docs).collect()}
    by_sha = {hashlib.sha256(bytes(m)).hexdigest(): bytes(m) for m in files}
    seen = Counter()
    for r in tiff.op2(docs).collect():
        media = by_sha[r.media_sha256]
        pages = _tiff_by_hand(media)
        payload = b"".join(line for _, rows in pages for line in rows)
        assert r.media_bytes == len(media) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        edges = sum(a != b for _, rows in pages for line in rows for a, b in zip(line, line[1:]))
        bins = Counter(x >> 5 for x in payload)
        assert r.feature == f"{len(pages)}p 64x{len(payload) // 64} mean {sum(payload) * 1000 // len(payload)} edges {edges} hist {'/'.join(str(bins[k]) for k in range(8))}"
        seen[zlib.crc32(payload) & 3] += 1
    assert set(seen) == {0, 1, 2, 3}


def test_damaged_files_are_rows(spark):
    good = tiff.payload_tiff(b"x" * 64)
    files = [(1, bytearray(good)), (2, bytearray(good[:40])), (3, None), (4, bytearray(b"II*\0\xff\xff\xff\xff"))]
    table = spark.createDataFrame(files, "name long, media binary")
    got = {r.name: (r.error is None, r.pixels is not None) for r in tiff.read_pages(table, "name", "media").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}


def test_op6_base_spans(spark):
    """Counts and digests of base spans by the patterns alone, place by place."""
    import re

    texts = [t for _, t, *_ in ROWS] + [
        "password=abc token: 'xyz123+/=' é secret = short5 api-key=nope apikey=\"A.b-c_9\"",
        "AKIA" + "B7" * 8 + " AKIAshort xAKIA" + "C" * 20 + " 0123456789abcdef01234567 0123456789ABCDEF01234567 deadbeef",
        "Token:deadbeefdeadbeefdeadbeef TOKEN=" + "f" * 5000,
        "secret:password=hunter222",
    ]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    wanted = {}
    for k, text in enumerate(texts):
        text, found = text or "", []
        for kind, pattern, least in ((0, assign, 6), (1, re.compile("AKIA[A-Z0-9]+"), 20), (2, re.compile("[0-9a-f]+"), 24)):
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                if len(m[2] if kind == 0 else m[0]) >= least:
                    found.append((m.start(), kind, m.end()))
        told = ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(found))
        wanted[k] = (*(sum(f[1] == kind for f in found) for kind in range(3)), hashlib.sha256(told.encode()).hexdigest())
    got = secrets_dp.op6(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == wanted
    assert sum(w[0] + w[1] + w[2] for w in wanted.values()) > 6
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [kinds.count(k) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


def test_op7_targets_and_sums(spark):
    """Targets by bisection on the level that fills them, not by rounds; documents over 65,536 words."""
    lengths = {"a": [70_000] * 4, "b": [300_000, 310_000, 20], "c": [3] * 40, None: [100_000]}
    rows = [(100 * j + k, "w " * n, s) for j, (s, ns) in enumerate(lengths.items()) for k, n in enumerate(ns)]
    got = knapsack_mix.op7(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    sizes, weight = [sum(ns) for ns in lengths.values()], [1, 2, 3, 1]
    low, high = 0.0, float(10 * sum(sizes))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * n, w * mid) for n, w in zip(sizes, weight)) < sum(sizes) else (low, mid)
    for (source, ns), n, w in zip(lengths.items(), sizes, weight):
        mine = [r for r in got if {"a": 0, "b": 1, "c": 2, None: 3}[source] == r.doc_id // 100]
        target = min(3 * n, w * low)
        assert all(r.source_size == n and r.target == pytest.approx(target) for r in mine)
        rest = target - target // n * n
        sums = {0}
        for x in ns:
            sums |= {s + x for s in sums}
        assert abs(sum(r.taken for r in mine) - target) <= min(abs(s - rest) for s in sums) + 1


CLASHES = ["quality_score", "filter_slot", "filter_bits", "filter_bucket", "marked_id", "marked_kept", "mixed_id", "mix_copies", "key", "head", "band", "root", "copies", "kept", "digest", "fp"]


def test_pipeline_keeps_clashing_columns(spark):
    import corpus_pipeline as pipeline

    rows = [(k, " ".join(f"the of and to {k % 7} word{j}" for j in range(30 + k % 7)), "en", "s", 0, *(f"{c} {k}" for c in CLASHES)) for k in range(21)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    wanted = {r[0]: r for r in rows}
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, ""), f"clash-{name}")
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
        assert got and all(tuple(r) == wanted[r.doc_id] for r in got)
    assert pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_op1_reads_some_documents(docs):
    spark, path = docs.sparkSession, common.shared_path(docs.sparkSession, "test-ids")
    bitplane.write_ids(docs, path, common.tokenizer_file("word_bpe_49k.json"), 2, block=64, segment_ids=500)
    wanted = {5, 8, 12, 30}
    got = bitplane.read_some(spark, path, spark.createDataFrame([(k,) for k in wanted], "doc_id long")).collect()
    texts = {r[0]: r[1] for r in ROWS}
    assert {r.doc_id for r in got} == wanted and len(got) == 6
    assert all(r.ids == _ids("word_bpe_49k.json", texts[r.doc_id], 2) for r in got)
