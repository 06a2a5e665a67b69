"""Operator 8: mixing sources to target weights by hash-threshold histograms.

A source's budget is met by whole passes over its documents plus one partial
pass: the documents whose hash lies below a threshold. The threshold comes from histograms of
words by (source, hash bucket): a running sum finds the bucket in which the
budget ends, and only that bucket is split by the next BITS bits, until the whole hash is
used. Nothing is sorted by document, a bigger budget takes all that a smaller one took, and
the hash depends on doc_id and text alone, so reruns agree.

The partial pass ends at the document that brings the source nearer to its target,
so a source misses its target by half its boundary document at most. Documents are taken whole.

Targets: TOTAL times all words, dealt by weight; what a source cannot take (CAP times its own size) is dealt to
the others by weight until none is above. This is one level L with target = min(CAP * size, L * weight), found from
one row per source in the order in which sources reach their caps.

Edge cases: a null text has size 0; null is a source of its own, the last; rows that share a doc_id (or have none) are dealt each by its
text, and only rows equal in doc_id and text are taken or left together; sources without words have target 0; an empty table gives an
empty result. Only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingot.llm.common import keyed, materialise, prepare, text_of, words

WEIGHTS = (5, 2, 1)  # fixed by the contract, repeating
TOTAL = 1.5  # fixed by the contract
CAP = 2  # fixed by the contract
HASH_BITS = 60
BITS = 12  # of each level: a source has 4096 buckets at most


def hash_of(doc_id):
    """The upper 60 bits of the MD5 of the id and the text's MD5, from 0."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text_of())))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """From one row per source (source, source_size): the same with target.

    Its windows are over one row per source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), rank % len(weights))
    rows = sizes.withColumn("w", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = total * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the first source that stays below its cap at the level its predecessors leave
    open_level = F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(every))
    most = (cap * F.col("source_size")).cast("double")
    target = F.least(most, F.coalesce(F.col("level") * F.col("w"), most))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source with a budget left (source, rest): the greatest hash its partial pass takes.

    sized: (source, size, hash).
    """
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for done in range(0, HASH_BITS, BITS):
        rows = sized
        if done:  # only the boundary bucket of each source goes on
            at = state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", HASH_BITS - done) == F.col("_p"))
            rows = sized.join(at, inside, "left_semi")
        bucket = F.shiftright("hash", HASH_BITS - done - BITS)
        hist = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", so_far).withColumnRenamed("source", "_s")
        here = hist.join(state.select("source", "rest"), F.col("source").eqNullSafe(F.col("_s"))).filter(
            (F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
        )
        state = here.select(
            "source", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("bucket").alias("prefix"), "n"
        )
        state = materialise(state)
    # the last bucket is one hash: take it if that comes nearer
    last = F.when(2 * F.col("rest") >= F.col("n"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", last.alias("threshold"))


def plan(docs: DataFrame) -> DataFrame:
    """Per source: source, source_size, target, passes, threshold (-1: no partial pass)."""
    prepare(docs.sparkSession)
    sized = docs.select("source", F.size(words(text_of())).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    sized = materialise(sized, "sizes")
    sizes = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sizes = sizes.withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    cut = thresholds(sized, sizes.select("source", rest.alias("rest")).filter("rest > 0"))
    cut = cut.withColumnRenamed("source", "_s")
    return sizes.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(-1)).alias("threshold")
    )


def _with_plan(rows: DataFrame, source: str, hashed: str, per_source: DataFrame) -> DataFrame:
    """``rows`` beside source_size, target and times: how often the mix takes the row."""
    per = per_source.withColumnRenamed("source", "_s")
    out = rows.join(per, F.col(source).eqNullSafe(F.col("_s")))
    return out.withColumn("times", F.col("passes") + (F.col(hashed) <= F.col("threshold")).cast("long"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    docs = docs.select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", F.size(words(text_of())).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    out = _with_plan(rows, "source", "hash", plan(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix: each document as many times as it is taken; the columns of ``docs``."""
    rows = keyed(docs, F.col("source"), hash_of(F.col("doc_id")))
    out = _with_plan(rows, "_k1", "_k2", plan(docs)).filter("times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), "times"))).select("_row.*")


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as w from s),
l as (select *, (1.5 * sum(source_size) over () - 2 * coalesce(sum(source_size) over b, 0))
    / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
lv as (select level from l where level * w <= 2 * source_size order by source_size / w, source nulls last limit 1),
t as (select source, source_size, least(2.0 * source_size, coalesce((select level from lv) * w, 2.0 * source_size))::double as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from t),
g as (select source, h, sum(size) as n from d group by source, h),
c as (select *, sum(n) over (partition by source order by h) as upto from g),
b as (select c.source, case when 2 * (target - passes * source_size - (upto - n)) >= n then h else h - 1 end as threshold
  from c join p on c.source is not distinct from p.source
  where target - passes * source_size > 0
    and upto - n <= target - passes * source_size and target - passes * source_size < upto)
select d.doc_id, d.size::bigint as size, p.source_size, p.target,
  (d.size * (p.passes + case when d.h <= coalesce(b.threshold, -1) then 1 else 0 end))::bigint as taken
from d join p on d.source is not distinct from p.source left join b on d.source is not distinct from b.source
"""
