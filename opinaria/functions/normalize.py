"""Text normalisation: the eleven ordered steps and their composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinaria.functions.entities import unescape_html
from opinaria.functions.translit import to_ascii

# The patterns that define the steps.
TAG = r"<[^.]*>"
TAG_BOUNDED = r"<[^>]*>"
URL = (r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
       r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)")
# A run of lower-case letters and digits holding a digit, with Unicode word boundaries.
WORD_WITH_DIGIT = r"(?U)\b[a-z]*[0-9][0-9a-z]*\b"
REPEATED_VOWEL = r"([aeiou])\1+"
SHORT_WORD = r"\b[a-z][a-z]?\b"


def fold_case(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def remove_tags(col: Column, bounded: bool = False) -> Column:
    """Blank out tags. The default is greedy up to the last ``>`` before a full stop, so text
    between two tags of one sentence goes too; ``bounded`` stops at the first ``>``."""
    return F.regexp_replace(col, TAG_BOUNDED if bounded else TAG, " ")


def remove_urls(col: Column) -> Column:
    return F.regexp_replace(col, URL, " ")


def remove_words_with_digits(col: Column) -> Column:
    return F.regexp_replace(col, WORD_WITH_DIGIT, " ")


def remove_control(col: Column) -> Column:
    """Drop Unicode category C. Line breaks leave no space behind, so words across one merge."""
    return F.regexp_replace(col, r"\p{C}", "")


def letters_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^a-z ]", " ")


def squeeze_spaces(col: Column) -> Column:
    return F.regexp_replace(col, r"\s\s+", " ")


def squeeze_vowels(col: Column) -> Column:
    return F.regexp_replace(col, REPEATED_VOWEL, "$1")


def remove_short_words(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SHORT_WORD, ""))


def normalize_text(col: Column, bounded_tags: bool = False) -> Column:
    """Lower-case ASCII words of three or more letters; null becomes the empty string."""
    out = unescape_html(fold_case(col))
    out = remove_urls(remove_tags(out, bounded_tags))
    out = to_ascii(remove_words_with_digits(out))
    # letters_only and squeeze_spaces in one pass
    out = F.regexp_replace(remove_control(out), "[^a-z]+", " ")
    return remove_short_words(squeeze_vowels(out))


def collapse_lines(col: Column) -> Column:
    """Line breaks to spaces, runs of spaces to one, trimmed; null becomes the empty string."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\n\r]", " ")
    return F.regexp_replace(F.regexp_replace(out, "  +", " "), r"^\s+|\s+$", "")
