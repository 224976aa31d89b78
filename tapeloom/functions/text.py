"""Text predicates on transcripts (Unicode aware, one regular expression each)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import DRINK_PATTERN, LAUGH_PATTERN, OUTRO_PATTERN, SYLLABLE_PATTERN

# Case-insensitive for all scripts, Unicode classes, "." stops at \n only.
FLAGS = "(?iuUd)"


def normalize_text(text: Column) -> Column:
    """Keep letters and numbers of every script."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(FLAGS + "(?:" + pattern + ")")


def matches_whole(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(FLAGS + r"\A(?:" + pattern + r")\z")


def is_generic_outro(text: Column, pattern: str = OUTRO_PATTERN) -> Column:
    return matches(text, pattern)


def is_nonlexical(clean: Column, pattern: str = SYLLABLE_PATTERN) -> Column:
    return matches_whole(clean, pattern)


def is_written_laugh(clean: Column) -> Column:
    return matches_whole(F.lower(clean), LAUGH_PATTERN)


def announces_drink(text: Column, pattern: str = DRINK_PATTERN) -> Column:
    return matches(text, pattern)
