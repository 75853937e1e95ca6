"""Column functions on names and spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E stand for U+0021..U+007E, one by one.
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(map(chr, range(0x21, 0x7F)))
#: What may stand between the parts of a name: white space of any kind, invisible characters and joining marks.
_BETWEEN = r"[\s\p{Z}\p{C}\p{Pd}_./+·]+"


def narrow(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def spelling(c: Column) -> Column:
    """A name without regard to case, width of letters, spacing and joining; null stays null, blank becomes ''."""
    return F.regexp_replace(F.lower(narrow(c)), _BETWEEN, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"[\s\p{Z}\p{C}]+", "") == "")


def file_base(path: Column) -> Column:
    """The last part of a path with / or \\, percent escapes decoded."""
    plain = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    return F.regexp_replace(plain, r"^.*[/\\]", "")
