"""Column functions on strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters of every Unicode kind, as a Java character class body (to be used with the flag (?U)).
BLANK = r"\s\x1c-\x1f"


def blank(c: Column) -> Column:
    """True for null, empty and all-white strings; never null."""
    return ~F.coalesce(c.rlike(rf"(?U)[^{BLANK}]"), F.lit(False))


def strip(c: Column) -> Column:
    """Without blanks of any Unicode kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def clean_name(c: Column) -> Column:
    """Lower case, other characters than a-z, 0-9 and + as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9+]+", "_"), r"^_+|_+$", "")


def usable(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
