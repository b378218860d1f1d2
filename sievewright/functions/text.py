"""String building blocks as Column expressions; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
NOT_WORD = "[^A-Za-z_0-9]"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use() mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(text: Column) -> Column:
    """The lines of a text at every Unicode line break; a final break opens no line, an empty text has none."""
    return let(F.split(text, LINE_BREAK), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def head(text: Column, n: int) -> Column:
    """The first n lines, joined by newlines; the rest of the text isn't split."""
    return F.array_join(F.slice(F.split(text, LINE_BREAK, n + 1), F.lit(1), F.lit(n)), "\n")


def occurrences(text: Column, needle: str) -> Column:
    """How often needle occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def strip(text: Column) -> Column:
    """text without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def raw_tokens(text: Column) -> Column:
    """Pieces between characters that aren't letters, digits or underscores; empty pieces stay."""
    return F.split(text, NOT_WORD)


def tokens(text: Column) -> Column:
    """raw_tokens() without the empty ones, repeats included."""
    return F.filter(raw_tokens(text), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def shingles(sequence: Column, n: int) -> Column:
    """The distinct runs of n neighbouring tokens, joined by blanks; none for a shorter sequence."""

    def of(s: Column) -> Column:
        # element by element: a slice would copy the sequence for each of its places
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - n, F.lit(0))), lambda i: F.concat_ws(" ", *(F.get(s, i + k) for k in range(n))))
        return F.array_distinct(F.when(F.size(s) >= n, runs).otherwise(F.array().cast("array<string>")))

    return let(sequence, of)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def sha1_hash32(text: Column) -> Column:
    """The first four bytes of SHA-1, least significant first, as a number."""
    h = F.sha1(text)
    return F.conv(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def line_statistics(text: Column) -> tuple[Column, Column, Column]:
    """(longest line, mean line length, share of letters and digits), for tables that lack these columns."""
    sizes = F.transform(lines(text), F.length)
    longest = F.coalesce(F.array_max(sizes), F.lit(0))
    mean = let(sizes, lambda s: F.try_divide(F.aggregate(s, F.lit(0), lambda a, x: a + x), F.size(s)))
    alnum = F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text))
    return longest, mean, alnum
