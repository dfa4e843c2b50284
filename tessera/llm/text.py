"""Text expressions that several operators share. White space is \\x20 and \\x09-\\x0D throughout."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def filled(text: Column | str) -> Column:
    """The text, or the empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Array of the words, in order; null texts have none."""
    plain = F.translate(filled(text), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(plain, " ", -1), "")


def n_words(text: Column | str) -> Column:
    return F.regexp_count(filled(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
