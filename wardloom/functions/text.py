"""Text measures and tests as Spark columns; null in, null out (counts and flags too) unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sets of signs that cannot be seen or change the direction of writing.
ZERO_WIDTH = "​‌‍⁠﻿"
BIDI = "‪‫‭‮‬"
CONTROL = r"[\p{Cc}&&[^\n\r\t]]"


def quoted(text: str) -> str:
    """``text`` as a literal part of a Java regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|#&~/" else c for c in text)


def ascii_lower(value: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out a single time, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contains_any(value: Column, needles: list[str]) -> Column:
    """Whether any needle is in the text.

    A chain of plain byte searches: over long texts it takes a tenth of the time of one alternation.
    """
    out = value.contains(needles[0])
    for n in needles[1:]:
        out = out | value.contains(n)
    return out


def first_of(value: Column, needles: list[str] | dict[str, str]) -> Column:
    """The first needle (or its label) in list order that the text contains; null if none."""
    labels = needles if isinstance(needles, dict) else {n: n for n in needles}
    return F.coalesce(*[F.when(value.contains(n), F.lit(label)) for n, label in labels.items()])


def first_match(value: Column, patterns: list[str]) -> Column:
    """Number of the first pattern in list order that matches; null if none."""
    return F.coalesce(*[F.when(value.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])


def words(value: Column) -> Column:
    """Tokens between white space, no empty ones."""
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def count_of(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def zero_width_count(value: Column) -> Column:
    return count_of(value, f"[{ZERO_WIDTH}]")


def bidi_count(value: Column) -> Column:
    return count_of(value, f"[{BIDI}]")


def control_count(value: Column) -> Column:
    return count_of(value, CONTROL)


def shape(value: Column) -> dict[str, Column]:
    """Character counts of a text: total, ASCII letters and digits, white space, other signs, and words.

    White space is the ASCII one; other blanks count as signs.
    """
    total = F.length(value)
    alpha, digit, space = count_of(value, "[A-Za-z]"), count_of(value, "[0-9]"), count_of(value, r"\s")
    return {"total": total, "alpha": alpha, "digit": digit, "space": space, "symbol": total - alpha - digit - space, "words": F.size(words(value))}


def symbol_ratio(value: Column) -> Column:
    s = shape(value)
    return ratio(s["symbol"], s["total"])


def looks_like_language(value: Column) -> Column:
    """At least 4 words, 35 % letters, 8 % white space and at most 45 % signs."""
    s = shape(value)
    return (s["words"] >= 4) & (ratio(s["alpha"], s["total"]) >= 0.35) & (ratio(s["space"], s["total"]) >= 0.08) & (ratio(s["symbol"], s["total"]) <= 0.45)


def string_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def domain_suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c gives [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without trailing dots; null for junk."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.+$", "")
