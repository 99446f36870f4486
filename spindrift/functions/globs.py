"""Globs with ``*`` alone, as LIKE patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_like(glob: str) -> str:
    for c in ("\\", "%", "_"):
        glob = glob.replace(c, "\\" + c)
    return glob.replace("*", "%")


def selects(col: Column, pattern: str) -> Column:
    """A selector's pattern: none or ``*`` takes all, a glob folds case, anything else is exact."""
    if pattern in ("", "*"):
        return F.lit(True)
    return col.ilike(to_like(pattern)) if "*" in pattern else col == pattern


def allows(col: Column, pattern: str) -> Column:
    """A role's or rule's pattern: case-sensitive and anchored."""
    return col.like(to_like(pattern)) if "*" in pattern else col == pattern


def allows_any(col: Column, patterns: list[str]) -> Column:
    """No patterns allow everything."""
    return reduce(lambda a, b: a | b, [allows(col, p) for p in patterns]) if patterns else F.lit(True)
