"""Parts of the operators on their own, against plain versions and exact round trips."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import automaton_dedup, bitplane, common, drr_packing, html_mss, knapsack_mix, secrets_dp, simhash_trie, tiff, weak_quality


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans(), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_bitplane_round_trip(ids, bits, block):
    payload = bitplane.pack_ids(np.array(ids, "<u4"), block, bits)
    assert bitplane.unpack_ids(payload).tolist() == ids


def test_bitplane_damage_is_noticed():
    payload = bytearray(bitplane.pack_ids(np.arange(100, dtype="<u4")))
    payload[16] ^= 1
    with pytest.raises(ValueError):
        bitplane.unpack_ids(bytes(payload))


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_tiff_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_table_is_renewed():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_pages(how, predictor, tiled):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 256, (h, w), dtype=np.uint8) for h, w in ((1, 1), (300, 70), (65, 64))]
    got = list(tiff.read_tiff(tiff.write_tiff([(p, how, predictor, tiled) for p in pages])))
    assert [p.error for p in got] == [None] * 3
    assert all((a == b.pixels[:, :, 0]).all() for a, b in zip(pages, got, strict=True))


def test_damaged_tiff_gives_an_error_page():
    data = tiff.payload_tiff(b"abc".ljust(64, b"\0"))
    assert [p.error is None for p in tiff.read_tiff(data)] == [True]
    for bad in (b"", b"II*\0", b"xx", data[:20], data[:-30]):
        assert any(p.error for p in tiff.read_tiff(bad))


def _simulated(sizes, weights, window):
    """Deficit round-robin, window by window."""
    deficit, served, stream = [Fraction(0)] * len(sizes), [0] * len(sizes), []
    number = 0
    while any(a < b for a, b in zip(served, sizes)):
        for s, size in enumerate(sizes):
            deficit[s] += Fraction(window * weights[s], sum(weights))
            take = min(int(deficit[s]), size - served[s])
            stream += [(s, served[s] + k, number) for k in range(take)]
            deficit[s] -= take
            served[s] += take
        number += 1
    return stream


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=5), st.integers(3, 40), st.booleans())
@settings(max_examples=80, deadline=None)
def test_schedule_is_the_round_robin(queues, window, natural):
    sizes = [n for n, _ in queues]
    weights = sizes if natural else [w for _, w in queues]
    schedule = drr_packing.Schedule(sizes, weights, window)
    place = {}
    for s, n in enumerate(sizes):
        for offset, at, run in schedule.runs(s, 0, n):
            for k in range(run):
                place[at + k] = (s, offset + k, schedule.window_of(s, offset + k))
    assert [place[k] for k in range(sum(sizes))] == _simulated(sizes, weights, window)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.data())
@settings(max_examples=150, deadline=None)
def test_fit_comes_near(counts, data):
    total = sum(n * c for n, c in counts.items())
    budget = data.draw(st.integers(0, total))
    take = knapsack_mix.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert abs(sum(n * k for n, k in take.items()) - budget) <= max(counts)


def test_fit_is_exact_where_ones_are_left():
    assert sum(n * k for n, k in knapsack_mix.fit({1: 50, 1000: 300, 70_000: 3}, 123_030).items()) == 123_030


@pytest.mark.parametrize("counts, budget, wanted", [({300_000: 1, 310_000: 1}, 590_000, 610_000), ({1_000_000: 1}, 900_000, 1_000_000), ({1_000_000: 1}, 400_000, 0), ({1_000_000: 1}, 500_000, 0)])
def test_fit_goes_over_by_a_long_document_where_that_is_nearer(counts, budget, wanted):
    assert sum(n * k for n, k in knapsack_mix.fit(counts, budget).items()) == wanted


def test_targets():
    got = knapsack_mix.targets({"b": 100, "a": 10, None: 0, "c": 1000})
    assert got["a"] == 30 and got["b"] == 300 and got[None] == 0
    assert got["c"] == pytest.approx(1110 - 330)
    assert knapsack_mix.targets({}) == {}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=3), st.lists(st.sampled_from("abc"), max_size=30), st.integers(2, 5))
@settings(max_examples=150, deadline=None)
def test_automaton_covers_exactly_the_shared_windows(passages, words, least):
    automaton = automaton_dedup.SuffixAutomaton()
    for passage in passages:
        automaton.add(passage)
    known = {tuple(p[i : i + least]) for p in passages for i in range(len(p) - least + 1)}
    wanted = {k for i in range(len(words) - least + 1) if tuple(words[i : i + least]) in known for k in range(i, i + least)}
    got = {k for a, b in automaton.spans(words, least) for k in range(a, b)}
    assert got == wanted


def test_trie_join_finds_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    keys = {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(6)} | set(base)
    keys = np.array(sorted(keys), np.uint64)
    found = {(int(i), int(j)) for a, b in simhash_trie.trie_pairs(keys, 0) for i, j in zip(a, b)}
    wanted = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if bin(int(keys[i]) ^ int(keys[j])).count("1") <= 3}
    assert found == wanted and wanted


def test_fingerprint_by_hand():
    hashes = np.array([0b0110, 0b0101, 0b0100], np.uint64)
    assert simhash_trie.fingerprint(hashes) == 0b0100
    assert simhash_trie.fingerprint(hashes[:2]) == 0b0100
    assert simhash_trie.fingerprint(hashes[:0]) == 0


@given(st.lists(st.text(alphabet="aé <|>endoftx.,!'\n\t0ßÉ  …", max_size=40), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = common.encoder(common.tokenizer_file(name))
        raw = [t.encode() for t in texts]
        assert encoder.encode(raw) == [encoder.whole(x) for x in raw]


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<nav><a>Home</a></nav>", ""),
        ("<body><nav><a href=1>Home page of all</a></nav><div class=ad>buy more things now today</div><article><h1>T &amp; U</h1><p>One  <b>two</b>\n three.<p>Four five six.</article><footer>&copy; us and them</footer>", "T & U\nOne two three.\nFour five six."),
        ("<main><p>A fine long story about a small boat.</p><div class='share-bar share'>Share this story</div><p>It sailed.</p></main><section class=comments><p>I liked the boat very much, thank you for the story!</p></section>", "A fine long story about a small boat.\nIt sailed."),
        ("<article><p>Unclosed <b>bold text runs on<p>next block</article><script>var t='</p>';", "Unclosed bold text runs on\nnext block"),
    ],
)
def test_main_text(page, text):
    assert html_mss.extract(page) == text


def test_weights_have_signs():
    weights = dict(html_mss.default_weights())
    assert weights["word"] > 0 and weights["boilerplate word"] < 0
    assert all(v < 0 for k, v in weights.items() if "word" not in k)


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run_is_the_best(scores):
    first, end = html_mss.best_run([float(x) for x in scores])
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert sum(scores[first:end]) == max(best, 0)


def test_secret_spans():
    ranks = secrets_dp.word_ranks(common.tokenizer_file("byte_bpe_50k.json"))
    text = 'x Password="hunter" AKIA' + "A1" * 8 + " " + "0a" * 12 + " token: abc é api_key=Zk3vQ9xW1pLr8TmB"
    found = secrets_dp.spans(text, ranks)
    assert [k for k, _, _ in found if k != "guess"] == ["assign", "access", "hex", "assign"]
    assert [text[a:b] for k, a, b in found if k == "guess"] == ["Zk3vQ9xW1pLr8TmB"]
    assert secrets_dp.spans("secret:token: abcdefgh", ranks) == []


@pytest.mark.parametrize("easy, hard", [("password2019-01-02", "pkswqord2x19u0z-02"), ("qwertyuiop", "qpwoeiruty"), ("aaaaaaaaaaaa", "akdmwpqxbzrt"), ("abcabcabcabc", "abxcqbzabkca")])
def test_guess_cost_orders(easy, hard):
    ranks = secrets_dp.word_ranks(common.tokenizer_file("byte_bpe_50k.json"))
    assert secrets_dp.guess_bits(easy, ranks)[0] < secrets_dp.guess_bits(hard, ranks)[0]


@given(st.text(alphabet="pas1920-.qwert", max_size=9))
@settings(max_examples=60, deadline=None)
def test_guess_cost_is_least(value):
    ranks = {"pas": 3, "set": 9}
    spans = [*secrets_dp.parts(value, ranks)]

    def least(at):
        if at == len(value):
            return 0.0
        return min([secrets_dp._char_bits(value[at]) + least(at + 1)] + [bits + 1 + least(b) for a, b, bits, _ in spans if a == at])

    assert secrets_dp.guess_bits(value, ranks)[0] == pytest.approx(least(0))


def test_label_model_tells_labellers_apart():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.8
    right = (0.95, 0.9, 0.55)
    votes = [tuple(int(v) for v in np.where(rng.random(3) < right, 1, -1) * (1 if t else -1)) for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    model = weak_quality.LabelModel(list(counts), list(counts.values()))
    assert model.chance[1][0][2] > model.chance[1][2][2]
    assert ((model.posterior(np.array(votes)) > 0.5) == truth).mean() > 0.93


def test_votes_of_an_empty_text():
    assert weak_quality.votes(b" \n") == (-1,) * len(weak_quality.LABELLERS)
    assert weak_quality.Scorer(np.zeros(9)).score(b"") == 0.0


def test_word_hashes_equal_words_only():
    data = np.frombuffer("ab ab b\x0ba ábç".encode() + b"ab x", np.uint8)
    bounds = np.array([0, len(data) - 4, len(data)])
    hashes, text = automaton_dedup.word_hashes(data, bounds)
    assert text.tolist() == [0, 0, 0, 0, 0, 1, 1]
    assert hashes[0] == hashes[1] == hashes[5] and len(set(hashes.tolist())) == 5


def test_crc_of_ids_is_unsigned():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) >= 0


@given(st.sampled_from([0, 1, 2, 3, 7, 40]), st.lists(st.tuples(st.integers(0, 4000), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 4000))
@settings(max_examples=300, deadline=None)
def test_damaged_tiff_never_raises(seed, flips, cut):
    """Flipped bytes and cuts in files of all four codecs give rows, pages or errors, and no exception."""
    rng = np.random.default_rng(seed)
    data = bytearray(tiff.write_tiff([(rng.integers(0, 4, (70, 66), dtype=np.uint8), how, 1 + k % 2, k > 1) for k, how in enumerate((tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.NONE))]))
    for at, value in flips:
        data[-1 - at % len(data)] = value
    pages = list(tiff.read_tiff(bytes(data[: len(data) - cut % len(data)])))
    assert pages and all((p.error is None) == (p.pixels is not None) for p in pages)


def _directory(fields, body=b""):
    """A file of one directory with inline values, after `body` at offset 8."""
    at = 8 + len(body)
    entries = b"".join(tiff.struct.pack("<HHI", tag, 4, 1) + tiff.struct.pack("<I", v) for tag, v in sorted(fields.items()))
    return b"II*\0" + tiff.struct.pack("<I", at) + body + tiff.struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize(
    "change",
    [{322: 0, 323: 64, 324: 8, 325: 4}, {256: 1 << 31, 257: 1 << 31}, {256: 0}, {259: 5}, {277: 0}, {278: 0}, {258: 12}, {317: 9}, {273: 1 << 31}, {257: 1 << 20, 278: 1}],
)
def test_false_sizes_give_error_pages(change):
    plain = {256: 2, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 2, 279: 4}
    assert next(tiff.read_tiff(_directory(plain, b"abcd"))).pixels.tobytes() == b"abcd"
    page = next(tiff.read_tiff(_directory(plain | change, b"abcd")))
    assert page.pixels is None and page.error


def test_lzw_code_past_the_table_is_an_error():
    fields = {256: 4, 257: 1, 258: 8, 259: 5, 273: 8, 277: 1, 278: 1, 279: 4}
    assert next(tiff.read_tiff(_directory(fields, b"\xff\xff\xff\xff"))).error


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_other_samples(order):
    """16-bit samples with a predictor, bits, and planes, in files written by hand."""
    rows = np.array([[500, 70, 65535], [1, 2, 3]], np.uint16)
    diff = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1)
    swap = lambda data: (b"II*\0" if order == "<" else b"MM\0*") + data

    def file(fields, body):
        at = 8 + len(body)
        entries = b"".join(tiff.struct.pack(f"{order}HHI", tag, 4, 1) + tiff.struct.pack(f"{order}I", v) for tag, v in sorted(fields.items()))
        return swap(tiff.struct.pack(f"{order}I", at) + body + tiff.struct.pack(f"{order}H", len(fields)) + entries + b"\0\0\0\0")

    body = diff.astype(f"{order}u2").tobytes()
    page = next(tiff.read_tiff(file({256: 3, 257: 2, 258: 16, 259: 1, 273: 8, 277: 1, 278: 2, 279: len(body), 317: 2}, body)))
    assert (page.pixels[:, :, 0] == rows).all()
    page = next(tiff.read_tiff(file({256: 10, 257: 2, 258: 1, 259: 1, 273: 8, 277: 1, 278: 2, 279: 4}, b"\xaa\x80\x55\x40")))
    assert page.pixels[:, :, 0].tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1, 0], [0, 1, 0, 1, 0, 1, 0, 1, 0, 1]]


def _fluid(sizes, weights, tokens):
    """How much of each queue is dealt by the time `tokens` are, by filling up to the next dry queue again and again."""
    got = [Fraction(0)] * len(sizes)
    while tokens > 0 and any(g < n for g, n in zip(got, sizes)):
        open_ = [k for k in range(len(sizes)) if got[k] < sizes[k]]
        weight = sum(weights[k] for k in open_)
        step = min(Fraction(tokens, weight), min(Fraction(sizes[k] - got[k], weights[k]) for k in open_))
        for k in open_:
            got[k] += step * weights[k]
        tokens -= step * weight
    return got


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=5), st.integers(3, 40))
@settings(max_examples=80, deadline=None)
def test_schedule_refills_windows(queues, window):
    """Queues that run dry leave their share to the others: windows stay full but for fractions of a token a queue."""
    sizes, weights = [n for n, _ in queues], [w for _, w in queues]
    schedule = drr_packing.Schedule(sizes, weights, window, refill=True)
    for i in range(sum(sizes) // window + 2):
        assert [schedule.served(s, i) for s in range(len(sizes))] == [int(x) for x in _fluid(sizes, weights, i * window)]
    place, windows = {}, {}
    for s, n in enumerate(sizes):
        for offset, at, run in schedule.runs(s, 0, n):
            for k in range(run):
                place[at + k] = (s, offset + k)
                windows[schedule.window_of(s, offset + k)] = windows.get(schedule.window_of(s, offset + k), 0) + 1
    assert sorted(place) == list(range(sum(sizes))) and len(set(place.values())) == sum(sizes)
    last = max(windows)
    assert all(abs(n - window) < len(sizes) for k, n in windows.items() if k != last) and windows[last] < window + len(sizes)


@given(st.dictionaries(st.one_of(st.integers(1, 40), st.integers(60_000, 200_000)), st.integers(1, 3), min_size=1, max_size=5), st.floats(0, 1))
@settings(max_examples=120, deadline=None)
def test_fit_is_the_nearest_sum(counts, part):
    """Documents of any length, over 65,536 words as well, against all choices."""
    budget = int(sum(n * c for n, c in counts.items()) * part)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    take = knapsack_mix.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert abs(sum(n * k for n, k in take.items()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_beyond_the_full_program(monkeypatch):
    """With shares first and the program for the rest, long lengths still take part."""
    monkeypatch.setattr(knapsack_mix, "WORK", 0)
    assert sum(n * k for n, k in knapsack_mix.fit({70_000: 10}, 130_000).items()) == 140_000
    assert sum(n * k for n, k in knapsack_mix.fit({300_000: 1, 310_000: 1}, 590_000).items()) == 610_000
    counts = {n: 1 + n % 7 for n in range(5, 900)} | {250_000: 4}
    assert sum(n * k for n, k in knapsack_mix.fit(counts, 1_234_567).items()) == 1_234_567


@given(st.dictionaries(st.integers(1, 25), st.integers(1, 300), min_size=1, max_size=5), st.floats(0, 1), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_fit_is_the_nearest_sum_beyond_its_first_window(counts, part, times):
    """Many documents of few lengths, with common divisors and without, against the sets of all sums."""
    counts = {n * times: c for n, c in counts.items()}
    total = sum(n * c for n, c in counts.items())
    budget, sums = int(total * part), 1
    for n, c in counts.items():
        for _ in range(c):
            sums |= sums << n
    take = knapsack_mix.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert abs(sum(n * k for n, k in take.items()) - budget) == min(abs(s - budget) for s in range(total + 1) if sums >> s & 1)


@pytest.mark.parametrize("times", [1, 10, 100_000])
def test_fit_gives_every_length_its_share_at_every_size(times):
    """One way at all sizes: no size of the input from which on other lengths are preferred."""
    counts = {n: 40 * times for n in range(5, 205)}
    total = sum(n * c for n, c in counts.items())
    for part in (0.3, 0.7):
        take = knapsack_mix.fit(counts, int(total * part))
        assert sum(n * k for n, k in take.items()) == int(total * part)
        for low, high in ((5, 55), (55, 105), (105, 155), (155, 205)):
            assert sum(take.get(n, 0) for n in range(low, high)) == pytest.approx(part * 50 * 40 * times, rel=0.03)


@pytest.mark.parametrize("budget, gap", [(500_000_003, 0), (500_000_004, 1), (500_000_500, 497)])
def test_fit_is_the_nearest_where_few_documents_close_the_gap(budget, gap):
    take = knapsack_mix.fit({1000: 10**6, 1001: 3}, budget)
    assert take[1000] <= 10**6 and take[1001] <= 3
    assert abs(1000 * take[1000] + 1001 * take[1001] - budget) == gap


def test_fit_stops_where_remainders_allow_no_nearer_sum():
    counts = {7 * k: 10**5 for k in range(1, 3000)} | {8: 3}
    assert abs(sum(n * k for n, k in knapsack_mix.fit(counts, 7 * 10**9 + 5).items()) - 7 * 10**9 - 5) == 2


def test_fit_takes_the_same_whatever_is_held(monkeypatch):
    counts = {n: 1 + n % 7 for n in range(5, 900)} | {250_000: 4}
    wanted = knapsack_mix.fit(counts, 1_234_567)
    monkeypatch.setattr(knapsack_mix, "WORK", 0)
    assert knapsack_mix.fit(counts, 1_234_567) == wanted


def _brute_bits(part, ranks):
    """The cheapest way to guess one part, from the rules alone; None if only brute force takes it."""
    found, low = [], part.lower()
    for word, extra in ((low, 0), (low.translate(secrets_dp.LEET), 2)):
        if len(part) >= 3 and word in ranks:
            found.append(np.log2(ranks[word] + 1) + secrets_dp._case_bits(part) + extra)
            break
    if secrets_dp.DATE.fullmatch(part):
        found.append(np.log2(365 * 150) + (0 if part.isdigit() else 2))
    if secrets_dp.YEAR.fullmatch(part):
        found.append(np.log2(150))
    for size in range(1, len(part) // 2 + 1):
        times = len(part) // size
        if part == part[:size] * times and times >= (3 if size == 1 else 2):
            found.append(sum(map(secrets_dp._char_bits, part[:size])) + np.log2(times))
    if len(part) >= 4 and all(a + b in secrets_dp.neighbours() for a, b in zip(low, low[1:])):
        steps = [ord(b) - ord(a) for a, b in zip(low, low[1:])]
        found.append(np.log2(47) + 2 * (1 + sum(a * b < 0 for a, b in zip(steps, steps[1:]))) + np.log2(len(part)) + secrets_dp._case_bits(part))
    return min(found, default=None)


@given(st.one_of(st.text(alphabet="pas1920-.qwertT", max_size=14), st.text(alphabet="ab7", max_size=16), st.text(alphabet="qwerTYa", max_size=14)))
@settings(max_examples=200, deadline=None)
def test_guess_cost_against_all_cuts(value):
    ranks = {"pas": 3, "set": 9, "wert": 40, "pass": 2}
    cost = [0.0]
    for b in range(1, len(value) + 1):
        ways = [cost[b - 1] + secrets_dp._char_bits(value[b - 1])]
        ways += [cost[a] + bits + 1 for a in range(b) if (bits := _brute_bits(value[a:b], ranks)) is not None]
        cost.append(min(ways))
    assert secrets_dp.guess_bits(value, ranks)[0] == pytest.approx(cost[-1])


def test_long_words_and_units_count():
    """A word of 30 letters, a unit of 12 characters said twice, and a very long value."""
    word = "pneumonoultramicroscopicsilico"
    assert secrets_dp.guess_bits(word, {word: 5})[1] == [(0, 30, "word")]
    bits, cut = secrets_dp.guess_bits("904817263904817263", {})
    assert cut == [(0, 18, "repeat")] and bits < secrets_dp.STRONG_BITS
    assert secrets_dp.guess_bits("k3Qz9LmX0vBt" * 2, {})[1] == [(0, 24, "repeat")]
    assert secrets_dp.guess_bits("ab" * 2000, {})[1] == [(0, 4000, "repeat")]


@given(st.lists(st.sampled_from("ab"), max_size=14), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=10), min_size=1, max_size=4), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_automaton_counts_smaller_owners_only(words, passages, doc_id):
    automaton = automaton_dedup.SuffixAutomaton()
    for owner, passage in enumerate(passages):
        automaton.add(passage, owner)
    known = {tuple(p[i : i + 3]) for owner, p in enumerate(passages) if owner < doc_id for i in range(len(p) - 2)}
    wanted = {k for i in range(len(words) - 2) if tuple(words[i : i + 3]) in known for k in range(i, i + 3)}
    assert {k for a, b in automaton.spans(words, 3, doc_id) for k in range(a, b)} == wanted


ARTICLE = "<h1>A title</h1><p>One long story about a small boat, told at some length.</p><p>It sailed.</p>"
TEXT = "A title\nOne long story about a small boat, told at some length.\nIt sailed."


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'><nav><a href=/>Home page of all</a></nav>{ARTICLE}<footer>us and them</footer></body>",
        f"<body class='no-sidebar'><div>{ARTICLE}</div></body>",
        f"<body><div class='search-results'>{ARTICLE}</div><div class='sidebar'><p>Most read stories of the week</p></div></body>",
        f"<body class='nav-open'><article>{ARTICLE}</article></body>",
        "<article>" + ARTICLE.replace("<h1>", "<h1 class='post-header'>") + "</article>",
        "<article><header class='entry-header'><h1>A title</h1></header>" + ARTICLE.split("</h1>")[1] + "</article>",
        f"<form class='page-form'><div class=menu><a href=/1>Start</a></div>{ARTICLE}</form>",
        f"<main>{ARTICLE}</main><section class=comments><article class=comment><p>I liked the boat more than the story, thank you very much indeed for both!</p></article></section>",
        f"<article>{ARTICLE.replace('<p>It', '<div class=ad>buy boats today, they are cheap</div><p>It')}</article><div><p>Teasers of other tales of the sea that nobody asked for.</p></div>",
        f"<aside><h1>Elsewhere</h1><article>Another tale of some length stands here</article></aside><article>{ARTICLE}</article>",
    ],
)
def test_main_text_of_awkward_pages(page):
    assert html_mss.extract(page) == TEXT


def test_the_scan_decides(monkeypatch):
    """With the whole page in place of the best run the result is another one."""
    page = f"<body><nav><a href=/>Home page of all</a></nav><article>{ARTICLE}</article><footer>us and them</footer></body>"
    assert html_mss.extract(page) == TEXT
    monkeypatch.setattr(html_mss, "best_run", lambda scores: (0, len(scores)))
    assert html_mss.extract(page) == "Home page of all\n" + TEXT + "\nus and them"


@given(st.lists(st.tuples(st.sampled_from(["nav", "p", "div class=ad", "article", "h1", "footer", "li", "section class=comments"]), st.integers(0, 9), st.booleans()), max_size=14))
@settings(max_examples=150, deadline=None)
def test_main_text_against_all_runs(parts):
    """The chosen blocks are those of the best of all contiguous runs, the first and longest of equals."""
    page = "".join(f"<{tag}>{'word ' * n}" + f"</{tag.split()[0]}>" * closed for tag, n, closed in parts)
    weights = dict(html_mss.default_weights())
    items = html_mss.read(page).items
    scores = [html_mss._score(x, weights) for x in items]
    runs = [(i, j) for i in range(len(items)) for j in range(i + 1, len(items) + 1)]
    sums = {(i, j): sum(scores[i:j]) for i, j in runs}
    most = max(sums.values(), default=0)
    found = html_mss.best_run(scores)
    if most <= 0:
        assert found == (0, 0) and html_mss.extract(page) == ""
        return
    assert sums[found] == pytest.approx(most)
    lines = [html_mss.plain(x.text) for k, (kind, x) in enumerate(items) if kind == "block" and found[0] <= k < found[1] and scores[k] > 0]
    assert html_mss.extract(page) == "\n".join(lines)


def test_labelled_pages_come_out_right():
    import json
    from pathlib import Path

    pages = json.loads(Path(html_mss.__file__).with_name("labelled_pages.json").read_text())
    right = sum(html_mss.extract(p["html"]) == "\n".join(p["main"]) for p in pages)
    assert right >= len(pages) - 1 and len(pages) >= 9


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans(), st.integers(1, 64), st.data())
@settings(max_examples=60, deadline=None)
def test_bitplane_ranges(ids, bits, block, data):
    payload = bitplane.pack_ids(np.array(ids, "<u4"), block, bits)
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert bitplane.unpack_range(payload, first, count).tolist() == ids[first : first + count]
    with pytest.raises(ValueError):
        bitplane.unpack_range(payload, first, len(ids) - first + 1)
