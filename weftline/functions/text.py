"""Text functions as Spark columns. They take and return Columns and stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters, in Java's syntax; its own \b follows Unicode.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: Letters that recognisers confuse, and what they fold to.
CONFUSABLE_FROM = "авеәəэғгйиілнңқктмoоөбрсуұүх"
CONFUSABLE_TO = "abeeeeggiiiahhkktn0006pcyyyx"
#: HTML references in the order they are decoded.
REFERENCES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))
#: Characters other than letters and digits that readable text has.
READABLE = r"""[\s.,;:!?()\[\]{}"'«»“”‘’\-–—+*/=%№#@&<>|\\$_€£¥₽]"""


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dedupe_key(text: Column) -> Column:
    return squeeze(F.lower(text))


def folded(text: Column) -> Column:
    """Case folded as far as the data needs: lower case, sharp s as ss, yo as ye."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ё"), F.lit("е"))


def compact(text: Column) -> Column:
    """Letters and digits only, folded."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "")


def squash(text: Column) -> Column:
    """Runs of one character as that character."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, CONFUSABLE_FROM, CONFUSABLE_TO)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}_]+(?:[.+:/-][\p{L}\p{N}_]+)*"), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens: two or more letters and digits that begin with a letter, or two or more digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}[\p{L}\p{N}]+|\p{N}{2,}"), F.lit(0)))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Common elements over the smaller set's size; 0 when a set is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def usable_page(text: Column, least_chars: int = 200, least_words: int = 20) -> Column:
    """Whether a page's text layer is worth keeping."""
    squeezed = squeeze(text)
    return (F.length(squeezed) >= least_chars) & (F.regexp_count(squeezed, F.lit(r"[A-Za-zА-Яа-яЁё]{3,}")) >= least_words)


#: What diagnostics mask, by the part that a text must hold for it. Patterns are tried on no other texts.
ZERO_WIDTH = "[​-‍⁠﻿]"
BEARER = rf"(?i){BOUNDARY}Bearer\s+[A-Za-z0-9._~+/=-]+"
KEYED = rf"(?i){BOUNDARY}(api[_-]?key|token|authorization)\s*[:=]\s*[^\s,;]+"
CARD = rf"{BOUNDARY}(?:[0-9][ -]?){{13,19}}{BOUNDARY}"


def redact(text: Column, most: int = 2000) -> Column:
    """Zero-width characters dropped, bearer tokens, keyed secrets and card numbers masked, cut to `most` characters."""
    masked = lambda t, hints, pattern, by: F.when(F.regexp_like(t, F.lit(hints)), F.regexp_replace(t, pattern, by)).otherwise(t)
    text = masked(text, ZERO_WIDTH, ZERO_WIDTH, "")
    text = masked(text, r"(?i)bearer\s", BEARER, "Bearer [REDACTED]")
    text = masked(text, r"(?i)(?:key|token|authorization)\s*[:=]", KEYED, "$1=[REDACTED]")
    text = masked(text, r"[0-9](?:[ -]?[0-9]){12}", CARD, "[REDACTED-PAN]")
    return F.left(text, F.lit(most))


def strip_html(page: Column) -> Column:
    """Visible text of a page: its title, or its body where the title is empty or missing."""
    title = F.regexp_extract(page, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    body = F.regexp_extract(page, r"(?i)<body[^>]*>([\s\S]*?)</body>", 1)
    has_body = F.regexp_like(page, F.lit(r"(?i)<body[^>]*>[\s\S]*?</body>"))
    text = F.when(title != "", title).when(has_body, body).otherwise(page)
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    for reference, char in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return squeeze(text)


def last_price(text: Column) -> Column:
    """The last amount before a currency sign, as 'amount sign'; NULL without one."""
    found = lambda group: F.try_element_at(F.regexp_extract_all(text, F.lit(r"([0-9]+[.,]?[0-9]*)\s*(₽|р|руб|\$|€)"), F.lit(group)), F.lit(-1))
    return F.concat(found(1), F.lit(" "), found(2))


def first_quantity(text: Column) -> Column:
    found = lambda group: F.try_element_at(F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*(шт|г|кг|мл|л)"), F.lit(group)), F.lit(1))
    return F.concat(found(1), F.lit(" "), found(2))


def markdown(text: Column) -> Column:
    """Bullets and dashes as hyphens, list markers as '- ', lines trimmed, blank runs as one line, edges trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, "[•·●]", "-"), "[—–−]", "-")
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    marker = lambda line: F.when(line.rlike(r"^[-+*] "), F.concat(F.lit("- "), F.trim(F.substring(line, 2, 1 << 30)))).when(line.rlike(r"^[0-9]\.."), F.concat(F.lit("- "), F.trim(F.substring(line, 3, 1 << 30)))).otherwise(line)
    joined = F.array_join(F.transform(lines, marker), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def readable_counts(text: Column) -> dict[str, Column]:
    """Counts of code points by class, and of encoding artifacts."""
    size = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    unsafe = size("[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]")
    mojibake = size("[ÃÂÐ]") + F.regexp_count(text, F.lit("Ñ[\\x80-\\xbf]"))
    return {
        "chars": F.length(text),
        "artifacts": unsafe + mojibake,
        "letters": size(r"\p{L}"),
        "digits": size(r"\p{N}"),
        "zeros": F.length(text) - F.length(F.replace(text, F.lit("0"), F.lit(""))),
        "marks": size(READABLE),
        "digit_runs": F.when(~F.regexp_like(text, F.lit("[0-9]{4}")), 0).otherwise(F.regexp_count(text, F.lit(r"([0-9])\1{3,}"))),
    }


def chunks(text: Column, size: int) -> Column:
    """Code points in chunks of `size`; an empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))


def sniff(content: Column) -> Column:
    """Content type by the first bytes of a binary column; NULL if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "image/webp")


def cell_text(text: Column) -> Column:
    return squeeze(F.replace(text, F.lit("|"), F.lit("\\|")))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value worked out once, however often and in whatever lambdas `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table_markdown(rows: Column) -> Column:
    """Rows (array<array<string>>) as a Markdown table: blank rows dropped, ragged ones padded, header names filled."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    def table(kept: Column, width: Column) -> Column:
        padded = lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
        header = F.transform(padded(F.element_at(kept, 1)), lambda c, k: F.when(c == "", F.concat(F.lit("Column "), (k + 1).cast("string"))).otherwise(c))
        body = F.when(F.size(kept) > 1, F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1))), padded)).otherwise(F.array(F.array_repeat(F.lit(" "), width)))
        return F.array_join(F.transform(F.concat(F.array(header), F.array(F.array_repeat(F.lit("---"), width)), body), line), "\n")

    def told(kept: Column) -> Column:
        whole = bound(F.array_max(F.transform(kept, F.size)), lambda width: table(kept, width))
        return F.when(F.size(kept) > 0, whole).otherwise(F.lit(""))

    return bound(F.filter(rows, lambda row: F.exists(row, lambda c: F.trim(c) != "")), told)


def duration_label(seconds: Column) -> Column:
    """'<1 s', 'n s', 'n min' or 'h h m min'; halves round up."""
    half_up = lambda x: F.floor(x + 0.5).cast("bigint").cast("string")
    hours, minutes = F.floor(seconds / 3600), half_up((seconds % 3600) / 60)
    long = F.when(minutes == "0", F.concat(hours.cast("string"), F.lit(" h"))).otherwise(F.concat(hours.cast("string"), F.lit(" h "), minutes, F.lit(" min")))
    return F.when(seconds < 1, "<1 s").when(seconds < 60, F.concat(F.greatest(F.lit(1), F.floor(seconds + 0.5)).cast("bigint").cast("string"), F.lit(" s"))).when(seconds < 3600, F.concat(half_up(seconds / 60), F.lit(" min"))).otherwise(long)
