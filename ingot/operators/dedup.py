"""Latest-wins deduplication (A1-A3).

For every key keep the whole record with the greatest sequence value, and
remember the smallest sequence value of the key (its *first-seen* position),
because deduplicated tables are presented in first-seen order.

Two physical forms give the same rows:

* ``max_by`` (default): one aggregate, ``max_by(struct(values), seq)`` plus
  ``min(seq)``. Partial aggregation runs before the shuffle, so a hot key
  collapses to one row per map task and never crowds a single reducer.
* ``window``: ``row_number() over (partition by key order by seq desc) = 1``.
  Spark inserts a partial WindowGroupLimit before the shuffle; ``min(seq)``
  needs a second window function, which defeats that, so this form is used
  only when the first-seen position is not wanted.

The sequence must be unique inside a key; ties would make the winner arbitrary.
Whole records are replaced: the winner's NULL fields stay NULL (never a
per-column ``last(ignorenulls)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ = "_seq"
FIRST_SEQ = "_first_seq"


def latest_wins(
    df: DataFrame,
    keys: Sequence[str],
    seq: str = SEQ,
    *,
    first_seq: str | None = FIRST_SEQ,
    method: str = "max_by",
) -> DataFrame:
    """One row per key: the record with the greatest ``seq``.

    Output columns: ``keys``, the other columns in input order, ``seq`` (the
    winner's), and ``first_seq`` = min(seq) of the key unless ``first_seq`` is None.
    """
    keys = list(keys)
    values = [c for c in df.columns if c not in keys and c != seq]
    if method == "max_by":
        aggs = [F.max_by(F.struct(*[F.col(c) for c in values], F.col(seq)), F.col(seq)).alias("_w")]
        if first_seq:
            aggs.append(F.min(seq).alias(first_seq))
        out = df.groupBy(*keys).agg(*aggs)
        cols = [*keys, *[F.col(f"_w.{c}").alias(c) for c in values], F.col(f"_w.{seq}").alias(seq)]
        if first_seq:
            cols.append(F.col(first_seq))
        return out.select(*cols)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
        ranked = df.withColumn("_rn", F.row_number().over(w))
        if first_seq:
            ranked = ranked.withColumn(first_seq, F.min(seq).over(Window.partitionBy(*keys)))
        return ranked.where(F.col("_rn") == 1).drop("_rn")
    raise ValueError(f"unknown latest_wins method: {method!r}")
