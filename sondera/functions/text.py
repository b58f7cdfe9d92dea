"""Text column functions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode blank, and the four ASCII information separators.
BLANKS = r"[\p{IsWhite_Space}\x1c-\x1f]+"
WORDS = r"[\p{L}\p{N}]+"


def collapse_blanks(c: Column) -> Column:
    """Outer blanks removed, inner runs of blanks made one space; null stays null."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")


def words(c: Column) -> Column:
    """Maximal runs of letters and digits in reading order; null or wordless text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def lower_words(c: Column) -> Column:
    """The words of :func:`words` in lower case.

    Lower-casing the text first is quicker and the same, save for the one letter whose lower case ends in
    a combining mark, which would split its word: texts with it are lower-cased word by word.
    """
    return F.when(c.contains("İ"), F.transform(words(c), F.lower)).otherwise(words(F.lower(c)))
