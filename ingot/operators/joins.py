"""Join helpers.

A side is hinted for broadcast only where its size is known: a list the caller holds on the
driver, and what matches it. Every other choice is the planner's, which decides by the
measured bytes of a side at run time. All functions are lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anti_join(big: DataFrame, exclude: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """``big`` rows with no match in ``exclude`` (NOT EXISTS)."""
    return big.join(exclude, on=on, how="left_anti")


def lookup_join(requested: DataFrame, table: DataFrame, key: str, listed: bool = False) -> DataFrame:
    """``requested LEFT JOIN table USING (key)``; ``listed``: ``requested`` is a list from the driver.

    A left outer join can only broadcast its right side, which here is the big
    table. So for a list the table is first cut down by a broadcast semi-join with the
    requested keys (Catalyst pushes it below a latest-wins aggregate on the same
    key), and the cut, at most one row per requested key when ``key`` is unique in ``table``, is
    broadcast back.
    """
    if not listed:
        return requested.join(table, on=key, how="left")
    matched = table.join(F.broadcast(requested.select(key)), on=key, how="left_semi")
    return requested.join(F.broadcast(matched), on=key, how="left")


def missing_keys(requested: DataFrame, table: DataFrame, key: str, listed: bool = False) -> DataFrame:
    """Requested keys that do not occur in ``table`` (requested LEFT ANTI table); as :func:`lookup_join`."""
    if not listed:
        return requested.join(table.select(key), on=key, how="left_anti")
    found = table.select(key).join(F.broadcast(requested.select(key)), on=key, how="left_semi").distinct()
    return requested.join(F.broadcast(found), on=key, how="left_anti")
