"""Tokens, n-grams and small scalar rules over review columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinaria.session import let

# The source whose ratings run from 0 to 10, and the keyword stems that mark
# Portuguese text.
TEN_POINT_SOURCES = ("ReclameAqui",)
PORTUGUESE_KEYWORDS = (
    "recomendo", "amei", "entrega", "otim[ao]", "excelente", "rapida", "celular", "gostei",
    "facil", "lindo", "bonito", "comprei", "legal", "perfume", "preco", "tela", "pra", "lento",
    "problema", "pelicula", "memoria", "cabelo", "ultima",
)


def words(text: Column) -> Column:
    """Whitespace-separated tokens; empty text gives an empty array."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def merge_title(title: Column, text: Column, null_title: str = "") -> Column:
    return F.concat(F.coalesce(title, F.lit(null_title)), F.lit(" "), F.coalesce(text, F.lit("")))


def remove_words(text: Column, stop: Iterable[str]) -> Column:
    """Drop the given words, rejoin the rest by single spaces. For bounded lists: the list
    becomes a hashed set inside the expression, so nothing is joined or shuffled."""
    stop = sorted(set(stop))
    if not stop:
        return F.array_join(words(text), " ")
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(stop)), " ")


def removed_words(text: Column, stop: Iterable[str]) -> Column:
    stop = sorted(set(stop))
    return F.filter(words(text), lambda w: w.isin(stop)) if stop else F.array().cast("array<string>")


def sentiment_label(rating: Column, source: Column,
                    ten_point_sources: Sequence[str] = TEN_POINT_SOURCES) -> Column:
    """``negative`` below 3 of 5, ``positive`` from 3 on, null for a null rating."""
    scaled = F.when(source.isin(*ten_point_sources), rating / 2).otherwise(rating)
    return F.when(scaled < 3, "negative").when(scaled >= 3, "positive")


def long_enough(text: Column) -> Column:
    """More than ten characters and at least four spaces."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (F.length(text) > 10) & (spaces >= 4)


def has_portuguese_keyword(text: Column) -> Column:
    return text.rlike(r"\b(" + "|".join(PORTUGUESE_KEYWORDS) + r")\b")


def language(text: Column, fallback: Column) -> Column:
    return F.when(has_portuguese_keyword(text), "pt").otherwise(fallback)


def fixed(value: Column, digits: int) -> Column:
    """Text of ``value`` with that many decimals, rounding the exact binary value half to even."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int) -> Column:
    return fixed(value, digits).cast("double")


def format_duration(seconds: Column, decimals: int = 1) -> Column:
    return (
        F.when(seconds.isNull() | F.isnan(seconds), "-")
        .when(seconds > 3600, F.concat(fixed(seconds / 3600, decimals), F.lit("h")))
        .when(seconds > 60, F.concat(fixed(seconds / 60, decimals), F.lit("m")))
        .when(seconds >= 1, F.concat(fixed(seconds, decimals), F.lit("s")))
        .otherwise(F.concat(fixed(seconds * 1000, 0), F.lit("ms"))))


def vector_tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters, as text vectorisers cut them. Text of plain letters and spaces, which normalised
    text is, needs no search for word boundaries."""
    return let(F.lower(text), lambda t: F.when(t.rlike("[^a-z ]"), F.regexp_extract_all(t, F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1)))
               .otherwise(F.filter(F.split(t, " "), lambda w: F.length(w) > 1)))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Contiguous n-grams for n = low..high in one array."""

    def contiguous(t: Column, n: int) -> Column:
        # sequence() counts down when its end is smaller, hence the size guard
        return F.when(F.size(t) >= n, F.transform(
            F.sequence(F.lit(1), F.size(t) - (n - 1)),
            lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(_no_strings())

    def build(t: Column) -> Column:
        parts = [t] if low == 1 else []
        parts += [contiguous(t, n) for n in range(max(low, 2), high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(tokens, build)


def _tails(t: Column, start: Column, stop: Column, length: int, head: Column) -> Column:
    """``head`` joined with every ordered pick of ``length`` tokens from positions start..stop."""
    picks = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    if length == 1:
        return F.transform(picks, lambda j: F.concat_ws(" ", head, F.get(t, j - 1)))
    return F.flatten(F.transform(
        picks, lambda j: _tails(t, j + 1, stop, length - 1, F.concat_ws(" ", head, F.get(t, j - 1)))))


def skip_ngrams(tokens: Column, high: int, skip: int, low: int = 1) -> Column:
    """Unigrams, then for each n up to ``high`` every head followed by n-1 ordered tokens
    picked from the next n-1+skip; only those of ``low`` words or more."""

    def skipping(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(t) - (n - 1)),
            lambda i: _tails(t, i + 1, F.least(i + (n - 1) + skip, F.size(t)), n - 1,
                             F.get(t, i - 1))))).otherwise(_no_strings())

    def build(t: Column) -> Column:
        parts = [t] if low == 1 else []
        parts += [skipping(t, n) for n in range(max(low, 2), high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(tokens, build)


def bucket(value: Column, buckets: int = 100) -> Column:
    """Engine-independent bucket of a value, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets
