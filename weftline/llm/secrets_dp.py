"""Secret scans: fixed patterns, and guess-cost dynamic programming on credential-context values.

Base spans come from three patterns, leftmost and non-overlapping for each kind. Values that stand in a credential
context (after a key such as password, pwd, client_secret or authorization) are cut by dynamic programming into words,
dates, repeats, keyboard walks and brute-force spans so that the bits to guess all parts are fewest; a value that
still costs `STRONG_BITS` or more gets a span of kind `guess`. Words and their ranks come from a public tokenizer's
vocabulary, a more frequent word being cheaper. Parts are of any length: words up to the vocabulary's longest, repeats of
any unit and walks with all their parts.

Edge cases: null texts count as empty and have no spans; very long texts and values are scanned whole; positions are code
points; of spans that start together the kinds come in the order assign, access, hex, guess; repeated rows give equal
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

KINDS = ("assign", "access", "hex", "guess")
STRONG_BITS = 40.0
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?:pwd|pass(?:word|wd|phrase|code)|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client)[_-]?(?:key|secret)|session[_-]?id|login)["']?\x20*(?:[:=]|\bis\b)\x20*(?:bearer\x20+|basic\x20+)?["']?([A-Za-z0-9+/_.=!@#$%^&*~-]{6,})""", re.IGNORECASE | re.ASCII)
#: Lower-case parts of which every match of ASSIGN or CONTEXT holds one.
HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "auth", "bearer", "session", "login")
DATE = re.compile(r"(?:19|20)\d\d[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
#: Rows of a keyboard, and letters that digits and signs stand for.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oieastasi")


@cache
def neighbours() -> frozenset[str]:
    """Pairs of keys next to each other, on a row or between rows."""
    out = set()
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            out |= {key + other for dy, dx in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]) for other in ROWS[y + dy][x + dx]}
    return frozenset(out)


@cache
def word_ranks(path: str) -> dict[str, int]:
    """Lower-case words of three or more letters by rank, from a tokenizer file's vocabulary."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    out: dict[str, int] = {}
    for word, rank in vocabulary.items():
        word = word.lstrip("Ġ").removesuffix("</w>").lower()
        if len(word) >= 3 and word.isascii() and word.isalpha():
            out[word] = min(rank + 1, out.get(word, rank + 1))
    return out


@cache
def longest_word(path: str) -> int:
    return max(map(len, word_ranks(path)), default=0)


def _case_bits(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    return 0.0 if not upper else 1.0 if upper == len(word) or upper == 1 and word[0].isupper() else math.log2(math.comb(len(word), min(upper, len(word) - upper)) + 1) + 1


def _char_bits(char: str) -> float:
    return math.log2(10 if char.isdigit() else 26 if char.islower() or char.isupper() else 33)


def _listed(value: str, ranks: dict[str, int], longest: int) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of words, plain or with signs for letters, and of dates."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    for a in range(n):
        for b in range(a + 3, min(n, a + longest) + 1):
            if rank := ranks.get(low[a:b]):
                yield a, b, math.log2(rank + 1) + _case_bits(value[a:b]), "word"
            elif plain[a:b] != low[a:b] and (rank := ranks.get(plain[a:b])):
                yield a, b, math.log2(rank + 1) + _case_bits(value[a:b]) + 2, "word"
        if found := DATE.match(value, a):
            yield a, found.end(), math.log2(365 * 150) + (2 if not found[0].isdigit() else 0), "date"
        if YEAR.match(value, a):
            yield a, a + 4, math.log2(150), "date"


def _periodic(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit): maximal runs that repeat a unit twice or more, a single character three times.

    Runs of a unit that is itself a repeat lie within the shorter unit's run, which is cheaper, and are left out.
    """
    codes, out = np.array([ord(c) for c in value], np.int32), []
    for size in range(1, len(value) // 2 + 1):
        same = np.concatenate([[False], codes[size:] == codes[:-size], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= max(size, 2) and not any(size % p == 0 and x <= a and b + size <= y for x, y, p in out):
                out.append((a, b + size, size))
    return out


def _walked(value: str) -> list[tuple[int, int]]:
    """Maximal runs of four or more keys, each next to the one before."""
    low, pairs, out, a = value.lower(), neighbours(), [], 0
    for b in range(1, len(value) + 1):
        if b == len(value) or low[b - 1 : b + 1] not in pairs:
            if b - a >= 4:
                out.append((a, b))
            a = b
    return out


def _turns(low: str) -> int:
    """How often a walk changes between higher and lower keys; a step to the same letter's other case is no step."""
    steps = [ord(y) - ord(x) for x, y in zip(low, low[1:], strict=False)]
    return sum(x * y < 0 for x, y in zip(steps, steps[1:], strict=False))


def parts(value: str, ranks: dict[str, int], longest: int | None = None) -> Iterator[tuple[int, int, float, str]]:
    """Every (start, end, bits, kind) that may be part of a cut, but for brute-force spans. Their number can be quadratic."""
    yield from _listed(value, ranks, max(map(len, ranks), default=0) if longest is None else longest)
    for a, b, size in _periodic(value):
        unit = sum(map(_char_bits, value[a : a + size]))
        for x in range(a, b):
            for y in range(x + (2 if size > 1 else 3) * size, b + 1, size):
                yield x, y, unit + math.log2((y - x) // size), "repeat"
    for a, b in _walked(value):
        for x in range(a, b):
            for y in range(x + 4, b + 1):
                yield x, y, math.log2(47) + 2 * (_turns(value[x:y].lower()) + 1) + math.log2(y - x) + _case_bits(value[x:y]), "walk"


def _walk_bits(value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns before each place, upper-case letters before it, logarithms of factorials."""
    codes = np.array([ord(c) for c in value.lower()], np.int64)
    steps = np.diff(codes)
    turn = np.zeros(len(value) + 1, np.int64)
    if len(steps) > 1:  # a turn at place k lies between the steps to k and from k
        turn[2 : len(steps) + 1] = np.cumsum(steps[1:] * steps[:-1] < 0)
    turn[len(steps) + 1 :] = turn[len(steps)]
    upper = np.concatenate([[0], np.cumsum([c.isupper() for c in value])])
    return turn, upper, np.concatenate([[0.0], np.cumsum(np.log2(np.arange(1, len(value) + 1)))])


def guess_bits(value: str, ranks: dict[str, int], longest: int | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """Bits of the cheapest cut, and its parts. A part costs a bit for standing where it stands, a brute-force character none.

    The same parts as of `parts`, but the starts of a repeat or walk that ends at a place are tried at once, so memory is
    in proportion to the value.
    """
    n = len(value)
    ending: dict[int, list[tuple[int, float, str]]] = {}
    for a, b, bits, kind in _listed(value, ranks, max(map(len, ranks), default=0) if longest is None else longest):
        ending.setdefault(b, []).append((a, bits, kind))
    chars = [_char_bits(c) for c in value]
    runs, walks = _periodic(value), _walked(value)
    units = [sum(chars[a : a + size]) for a, _, size in runs]
    turn, upper, factorial = _walk_bits(value) if walks else (None, None, None)
    cost, came = np.zeros(n + 1), [(0, "")]
    for b in range(1, n + 1):
        best, via = cost[b - 1] + chars[b - 1], (b - 1, "brute")
        for a, bits, kind in ending.get(b, ()):
            if cost[a] + bits + 1 < best:
                best, via = cost[a] + bits + 1, (a, kind)
        for (a, end, size), unit in zip(runs, units, strict=True):
            least = 2 if size > 1 else 3
            if a + least * size <= b <= end:
                times = np.arange(least, (b - a) // size + 1)
                tried = cost[b - size * times] + unit + np.log2(times) + 1
                if tried.min() < best:
                    best, via = tried.min(), (b - size * int(times[tried.argmin()]), "repeat")
        for a, end in walks:
            if a + 4 <= b <= end:
                x = np.arange(a, b - 3)
                size, capital = b - x, upper[b] - upper[x]
                mixed = np.logaddexp2(factorial[size] - factorial[capital] - factorial[size - capital], 0) + 1
                first = np.array([c.isupper() for c in value[a : b - 3]])
                case = np.where(capital == 0, 0.0, np.where((capital == size) | (capital == 1) & first, 1.0, mixed))
                tried = cost[x] + math.log2(47) + 2 * (turn[b - 1] - turn[x + 1] + 1) + np.log2(size) + case + 1
                if tried.min() < best:
                    best, via = tried.min(), (a + int(tried.argmin()), "walk")
        cost[b] = best
        came.append(via)
    cut, b = [], n
    while b:
        a, kind = came[b]
        if kind == "brute" and cut and cut[-1][2] == "brute":
            cut[-1] = (a, cut[-1][1], kind)
        else:
            cut.append((a, b, kind))
        b = a
    return float(cost[-1]), cut[::-1]


def spans(text: str, ranks: dict[str, int], strong: float = STRONG_BITS, longest: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start, then kind."""
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(hint in low for hint in HINTS):
        values = {}
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append(("assign", *m.span()))
                values[m.span(2)] = m[2]
        values |= {m.span(1): m[1] for m in CONTEXT.finditer(text)}
        found += [("guess", *place) for place, value in values.items() if guess_bits(value, ranks, longest)[0] >= strong]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, vocabulary: str, strong: float = STRONG_BITS) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, longest = word_ranks(vocabulary), longest_word(vocabulary)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x.as_py() or "", ranks, strong, longest)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op6(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    found = scan(docs, vocabulary or common.tokenizer_file("byte_bpe_50k.json"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
