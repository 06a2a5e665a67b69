"""Ranks of whole tables and of groups of any size, without a window over them.

The rows are dealt by ranges of (group, order) and sorted; ``monotonically_increasing_id`` then numbers them
within each part, and the parts' counts, summed up, say what comes before each part. So the rows of one
group spread over as many tasks as its size asks for, and the only window runs over one row for each group and part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingot.session import stored


def ranked(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order`` among all rows or among those with equal columns ``by``.

    The order should be total; equal rows get places next to each other. Runs jobs and stores its result.
    """
    keys = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(own.orderBy("_part")) - F.col("_n")
    runs = stored(runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift")), "runs")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def first_free(taken: DataFrame, groups: DataFrame, by: str, n: int, rank: str = "rank") -> DataFrame:
    """(by, place, rank): the first ``n`` numbers from 0 that ``taken`` (by, rank; each pair once) leaves free in each of ``groups``.

    With a group's taken numbers in order, the i-th one, e, has e - i free numbers below it. So free number j is j plus the
    count of the taken ones with e - i <= j: at most n counts for each group, however many are taken.
    """
    places = ranked(taken.select(by, rank), [rank], [by], "_i")
    below = places.select(by, (F.col(rank) - F.col("_i")).alias("free")).where(F.col("free") < n)
    counts = below.groupBy(by, "free").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(by).agg(F.collect_list(F.struct("free", "n")).alias("held"))  # n entries at most
    every = groups.select(by).join(held, by, "left")
    none = F.array().cast("array<struct<free:bigint,n:bigint>>")
    every = every.withColumn("held", F.coalesce("held", none))
    spread = every.select(by, "held", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place")) if n else every.select(by, "held", F.lit(0).alias("place")).limit(0)
    passed = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.when(x["free"] <= F.col("place"), x["n"]).otherwise(0))
    return spread.select(by, "place", (F.col("place") + passed).alias(rank))
