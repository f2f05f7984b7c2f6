"""Ratios, grades and presentation of numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import as_column

#: Least scores of the grades, from the best on.
GRADES = ((9.0, "A+"), (8.0, "A"), (7.0, "B+"), (6.0, "B"), (5.0, "C+"), (4.0, "C"), (3.0, "D"), (0.0, "F"))


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def grade(score) -> Column:
    c, out = as_column(score), None
    for least, name in GRADES:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise("F")


def money(amount) -> Column:
    """Dollars with B, M or K."""
    c = as_column(amount)
    size, out = F.abs(c), None
    for least, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        text = F.format_string(f"$%.1f{unit}", F.round(c / F.lit(least), 1))
        out = F.when(size >= least, text) if out is None else out.when(size >= least, text)
    return out.otherwise(F.format_string("$%.0f", c))


def percent(share) -> Column:
    return F.when(as_column(share).isNull(), "N/A").otherwise(F.format_string("%.1f%%", as_column(share) * F.lit(100.0)))


def bar(score, most: float = 10.0, width: int = 20) -> Column:
    """A bar of ``width`` characters, filled in proportion."""
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(as_column(score) / F.lit(most) * F.lit(width)).cast("int")))
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def padded_id(text, width: int = 10) -> Column:
    """Digits without leading zeros, filled up to ``width`` with zeros."""
    return F.lpad(F.regexp_replace(as_column(text).cast("string"), "^0+", ""), width, "0")


def key(*parts) -> Column:
    """Parts joined by colons."""
    return F.concat_ws(":", *[as_column(p).cast("string") for p in parts])


def community_id(zone, index, first_ids) -> Column:
    """A stable id of a community: the zone, its number and its first ids, hashed to 16 hex digits."""
    return short_hash(key(zone, index, F.array_join(as_column(first_ids), ",")), 16)


def short_hash(text, length: int = 12) -> Column:
    """The first hex digits of a SHA-256."""
    return F.substring(F.sha2(as_column(text).cast("binary"), 256), 1, length)
