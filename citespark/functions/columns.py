"""Column expressions; all of them stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "MISSING_TEXTS", "AUTHOR_ALIASES", "col_of", "squish", "strip_trailing_sep",
    "normalize_missing", "truncate_text", "clean_author", "split_field",
    "first_author_label", "short_reference", "tc_per_year", "period_of", "ratio",
]

# Texts that mean "missing" in exported records.
MISSING_TEXTS = (
    "", " ", "NA", "NULL", "list()", "character()", "numeric()",
    "[No abstract available]", "[No author name available]",
)
# Author names that need a spelled-out form.
AUTHOR_ALIASES = {"Dosi": "Dosi G"}
# Upper bounds (exclusive) of the publication periods.
PERIOD_BOUNDS = (1990, 2000, 2010, 2020)


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col_of(c), r"[\s\p{Z}]+", " "))


def strip_trailing_sep(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), "[,;]+$", "")


def normalize_missing(c: Column | str, texts: Sequence[str] = MISSING_TEXTS) -> Column:
    c = col_of(c)
    return F.when(~c.isin(list(texts)), c)


def truncate_text(c: Column | str, width: int) -> Column:
    """Text of at most ``width`` characters; a cut text ends in ``...``, counted in the width."""
    c = col_of(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def clean_author(c: Column | str, aliases: Mapping[str, str] = AUTHOR_ALIASES) -> Column:
    """Surname and first initial: everything from the first full stop on is cut."""
    name = F.regexp_replace(squish(c), r"\..*", "")
    out = name
    for short, full in aliases.items():
        out = F.when(name == short, F.lit(full)).otherwise(out)
    return out


def split_field(c: Column | str, sep: str = ";", lower: bool = False) -> Column:
    c = col_of(c)
    if lower:
        c = F.lower(c)
    return F.split(c, "\\Q" + sep + "\\E")


def first_author_label(authors: Column | str) -> Column:
    """``A``, ``A & B`` or ``A et al.``; null without authors."""
    a = col_of(authors)
    first = F.get(a, 0)
    return (
        F.when(F.size(a) == 1, first)
        .when(F.size(a) == 2, F.concat(first, F.lit(" & "), F.get(a, 1)))
        .when(F.size(a) > 2, F.concat(first, F.lit(" et al.")))
    )


def short_reference(au1: Column | str, py: Column | str, so: Column | str, width: int = 25, comma: bool = False) -> Column:
    return F.concat(
        col_of(au1), F.lit(", (" if comma else " ("), col_of(py).cast("string"), F.lit(") "),
        truncate_text(so, width),
    )


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; null instead of an error when the denominator is zero."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def tc_per_year(tc: Column | str, py: Column | str, as_of_year: int, digits: int | None = None, py_max: int | None = None) -> Column:
    year = col_of(py)
    if py_max is not None:
        year = F.least(year, F.lit(py_max))
    out = ratio(tc, F.lit(as_of_year) - year + F.lit(1))
    return out if digits is None else F.round(out, digits)


def period_of(py: Column | str, bounds: Sequence[int] = PERIOD_BOUNDS) -> Column:
    """Number of the first period whose upper bound lies after the year; null beyond the last."""
    py = col_of(py)
    out = F.when(py < bounds[0], F.lit(1))
    for i, bound in enumerate(bounds[1:], start=2):
        out = out.when(py < bound, F.lit(i))
    return out
