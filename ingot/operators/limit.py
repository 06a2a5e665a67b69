"""Ordered limits (L1-L4).

Spark has no row order; every "first N" here names its order explicitly so
the plan becomes TakeOrderedAndProject: each task keeps its own top N and
only N rows per task reach the final merge, whatever the table size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference's behaviour.
SAMPLE_ROWS = 100  # table sample size
RUN_HISTORY = 50  # run log length
WAIVER_LIMIT = 20  # default recommendation count


def first_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (ascending unless a Column says otherwise)."""
    if n < 0:
        raise ValueError(f"limit must be >= 0, got {n}")
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*cols).limit(n)


def newest_n(df: DataFrame, ts: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the greatest ``ts`` (ties broken by ``tiebreak`` descending)."""
    return first_n(df, [F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]], n)
