"""Pin names and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SIDES = ("left", "right", "top", "bottom")
CONFUSABLE = ("O0", "I1l|", "S5", "B8", "Z2", "G6", "D0")


def strip(text: str | Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\r\x0b\x0c"))


def folded(text: str | Column) -> Column:
    """Lower case without any white space; null is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(F.coalesce(col, F.lit("")), " \t\n\r\x0b\x0c", ""))


def is_number(text: str | Column) -> Column:
    return F.trim(F.col(text) if isinstance(text, str) else text).rlike(r"^\d+$")


def natural_order(number: str = "pin_number") -> list[Column]:
    """Numbers by value, then everything else as text."""
    value = F.col(number).try_cast("bigint")
    return [value.isNull(), value, F.col(number)]


def confusable(left: Column, right: Column) -> Column:
    """Same length, different, and every differing position is a pair of look-alike glyphs."""
    pairs = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.concat(a, b))
    alike = [a + b for group in CONFUSABLE for a in group for b in group if a != b]
    ok = F.forall(pairs, lambda p: (F.substring(p, 1, 1) == F.substring(p, 2, 1)) | p.isin(*alike))
    return (F.length(left) == F.length(right)) & (left != right) & ok
