"""Rows of many owners in one table: per-tracker rules hold within an owner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = "owner_id"


def owner_of(*tables: DataFrame) -> list[str]:
    """["owner_id"] if the tables have that column, [] if none does: put it in front of join keys, groups and partitions.

    Tables that differ in it are refused, for one without owners would be matched with everybody's rows.
    """
    have = [OWNER in t.columns for t in tables]
    if any(have) and not all(have):
        raise ValueError(f"some tables have {OWNER} and others have not")
    return [OWNER] if all(have) else []


def owners_equal(keys: list[str], a: DataFrame, b: DataFrame, prefix: str = "") -> Column:
    """Condition that rows of a and b are of one owner; b's key column has that prefix."""
    return reduce(lambda x, y: x & y, [a[k] == b[prefix + k] for k in keys], F.lit(True))
