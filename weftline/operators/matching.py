"""How an expected line is found in actual text: containment routes, a token vote, fuzzy windows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from weftline.functions import text

#: Lengths between which fuzzy windows are tried, and haystacks that are too long for them.
FUZZY_LEAST, FUZZY_MOST, FUZZY_RATIO, HAY_CHARS, HAY_RATIO = 8, 180, 0.91, 400, 3
#: Every window that is similar enough shares so many characters in a row with the needle.
GRAM = 4


def readings(actual: Column) -> Column:
    """An actual text in all the forms that lines are looked up in, worked out once for all its lines."""
    compact = text.compact(actual)
    tokens = F.array_distinct(text.tokens(actual))
    forms = F.transform(tokens, lambda t: text.compact(t))
    return F.struct(
        text.dedupe_key(text.folded(actual)).alias("plain"),
        compact.alias("compact"),
        text.fold_confusables(compact).alias("confusable"),
        text.squash(compact).alias("squashed"),
        tokens.alias("tokens"),
        forms.alias("compacts"),
        F.transform(forms, lambda t: text.fold_confusables(t)).alias("confusables"),
        F.transform(forms, lambda t: text.squash(t)).alias("squashes"),
    )


def footer_pattern(page: Column, total: Column) -> Column:
    """A page footer as recognisers write it: 3 may be a letter, and so may the z of the word between the numbers."""
    digits = lambda n: F.when(n == "3", "[3зaа]").otherwise(n)
    return F.concat(digits(page), F.lit("и[з3]"), digits(total))


def footer_found(line: Column, compact: Column) -> Column:
    """Whether a line names a page of a plan and the actual text has that footer."""
    pattern = r"страница\s+учебного\s+плана:\s*([0-9]+)\s+из\s+([0-9]+)"
    page, total = (F.regexp_extract(F.lower(line), pattern, k) for k in (1, 2))
    return (page != "") & F.regexp_like(compact, footer_pattern(page, total))


def routes(line: Column, actual: Column) -> dict[str, Column]:
    """The exact routes by name, true where the line is found by it. `actual` is a struct of `readings`."""
    compact = text.compact(line)
    confusable = text.fold_confusables(compact)
    return {
        "contained": F.contains(actual["plain"], text.dedupe_key(text.folded(line))),
        "compacted": (F.length(compact) >= 8) & F.contains(actual["compact"], compact),
        "footer": footer_found(line, actual["compact"]),
        "price": F.contains(line, F.lit("₽")) & (F.length(compact) >= 4) & F.contains(actual["compact"], compact),
        "confused": (F.length(confusable) >= 8) & F.contains(actual["confusable"], confusable),
    }


def line_tokens(line: Column) -> Column:
    return F.filter(text.tokens(line), lambda t: F.length(t) > 1)


def token_found(token: Column, actual: Column) -> Column:
    """Whether a token is among the actual ones, or inside the actual text, in one of the exact forms."""
    compact = text.compact(token)
    confusable, squashed = text.fold_confusables(compact), text.squash(compact)
    return (
        F.array_contains(actual["tokens"], token)
        | (F.length(compact) >= 2) & F.contains(actual["compact"], compact)
        | (F.length(confusable) >= 2) & F.contains(actual["confusable"], confusable)
        | F.array_contains(actual["confusables"], confusable)
        | (F.length(squashed) >= 3) & F.contains(actual["squashed"], squashed)
        | F.array_contains(actual["squashes"], squashed)
    )


def enough(votes: Column, total: Column, line: Column) -> Column:
    """Whether enough of a line's tokens are found: all of up to three, 0.8 of more, less for some kinds of lines."""
    plain = text.dedupe_key(text.folded(line))
    signature = plain.rlike(r"(?U)\b(проректор|начальник|директор|зав\.?\s*кафедрой)\b")
    practice = plain.startswith("|") & F.contains(plain, F.lit("практика"))
    ratio = F.when(total <= 3, 1.0).otherwise(0.8)
    ratio = F.when(signature | practice, F.least(ratio, F.lit(0.75))).otherwise(ratio)
    ratio = F.when(F.contains(plain, F.lit("зачет с оценкой")), F.least(ratio, F.lit(2 / 3))).otherwise(ratio)
    ratio = F.when(F.contains(plain, F.lit("merged subsection")), 0.6).otherwise(ratio)
    return (total > 0) & (votes / total >= ratio)


def cell_found(cell: Column, actual: Column) -> Column:
    """Whether a table cell's text is in the actual text: as it is, without signs, or by enough of its tokens."""
    compact, tokens = text.compact(cell), line_tokens(cell)
    votes = F.size(F.filter(tokens, lambda t: F.array_contains(actual["tokens"], t)))
    voted = (F.size(tokens) > 0) & (votes / F.size(tokens) >= F.when(F.size(tokens) <= 2, 1.0).otherwise(0.75))
    inside = F.contains(actual["plain"], text.dedupe_key(text.folded(cell))) | (F.length(compact) >= 4) & F.contains(actual["compact"], compact)
    return (F.trim(cell) != "") & (inside | voted)


def near_window(hay: str, needle: str, least: float = FUZZY_RATIO) -> bool:
    """Whether a window of `hay`, up to two characters shorter or longer than the needle, is similar enough to it.

    A similar window shares a run of `GRAM` characters with the needle, shifted by no more than the characters that may
    differ; only windows around such shared runs are compared. Long haystacks are left to exact search by the rule.
    """
    n = len(needle)
    if not FUZZY_LEAST <= n <= FUZZY_MOST:
        return False
    if needle in hay:
        return True
    if len(hay) > max(HAY_CHARS, HAY_RATIO * n):
        return False
    drift = int((1 - least) * (2 * n + 2)) + 1
    places: dict[str, list[int]] = {}
    for k in range(n - GRAM + 1):
        places.setdefault(needle[k : k + GRAM], []).append(k)
    starts = {j - k + d for j in range(len(hay) - GRAM + 1) for k in places.get(hay[j : j + GRAM], ()) for d in range(-drift, drift + 1)}
    for start in sorted(s for s in starts if s >= 0):
        for size in range(max(FUZZY_LEAST, n - 2), min(n + 2, len(hay) - start) + 1):
            matcher = difflib.SequenceMatcher(None, needle, hay[start : start + size])
            if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least:
                return True
    return False


@F.pandas_udf(BooleanType())
def near(hay: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([near_window(h or "", n or "") for h, n in zip(hay, needle, strict=True)])


@F.pandas_udf(LongType())
def near_votes(tokens: pd.Series, compacts: pd.Series, confusables: pd.Series) -> pd.Series:
    """How many tokens (compact, confusable form) are nearly one of the actual tokens, in either form."""

    def found(token: str, actual: list[str]) -> bool:
        return len(token) >= FUZZY_LEAST and any(near_window(a, token) for a in actual)

    return pd.Series([sum(found(t["compact"], a) or found(t["confusable"], b) for t in ts) for ts, a, b in zip(tokens, compacts, confusables, strict=True)], dtype="int64")


def identifier_like(line: Column) -> Column:
    return (F.length(line) <= 200) & (F.lower(line).rlike(r"[/_]|\.[a-zа-я]{2,}"))
