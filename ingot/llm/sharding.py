"""Operator 2: shards by extendible hashing.

The directory maps hash prefixes to shards. A bucket that is over the byte limit is split on its next
hash bit, and only such buckets are; a shard is the shortest prefix whose
rows fit. Depths are walked in steps of BITS bits: one histogram by prefix gives the sizes of the
next BITS depths for the buckets that are still too large, so the
documents' sizes are read a few times and their texts once.

The hash is of doc_id and text; rows that are equal in both are dealt out by a
second hash of their place, so that a row repeated for a third of the table is split too. A single row
over the limit is a shard of its own, whole, and marked ``oversized``.

Edge cases: a null text has 0 bytes, a null id hashes like any value; rows of 0 bytes stay where their prefix leads;
an empty table gives an empty result and directory. Only doc_id and text are read for the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import keyed, materialise, prepare, text_of

LIMIT = 8 << 20
BITS = 12
HASH_BITS = 120  # 60 of id and text, 60 of the row's place


def _bits(value: Column) -> Column:
    """60 bits as text, from MD5."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, 15), 16, 2), 60, "0")


def hashed(docs: DataFrame) -> DataFrame:
    """The rows as ``_row`` beside bytes and bits (text of 0 and 1)."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_of()))
    place = F.monotonically_increasing_id().cast("string")
    out = keyed(docs, F.octet_length(text_of()).cast("long"), F.concat(_bits(key), _bits(place)))
    return out.withColumnsRenamed({"_k1": "bytes", "_k2": "bits"})


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per shard: shard (hash prefix), shard_bytes, shard_docs, oversized. sized: (bytes, bits)."""
    fits = (F.col("bytes") <= limit) | (F.col("docs") <= 1)
    whole = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("docs"))
    whole = materialise(whole.select(F.lit("").alias("shard"), F.lit(0).alias("depth"), "bytes", "docs"))
    shards = whole.filter(fits & (F.col("docs") > 0))
    large, is_open = sized.select("bytes", "bits"), whole.filter(~fits)
    for top in range(0, HASH_BITS, BITS):
        if not is_open.limit(1).count():
            break
        # all rows here are in buckets over the limit: their sizes at the next BITS depths, from one histogram
        depths = F.sequence(F.lit(top + 1), F.lit(top + BITS))
        fine = large.groupBy(F.substring("bits", 1, top + BITS).alias("fine"))
        fine = fine.agg(F.sum("bytes").alias("n"), F.count(F.lit(1)).alias("k")).withColumn("depth", F.explode(depths))
        bucket = F.substr("fine", F.lit(1), F.col("depth"))
        sizes = fine.groupBy(bucket.alias("shard"), "depth").agg(F.sum("n").alias("bytes"), F.sum("k").alias("docs"))
        sizes = materialise(sizes)
        over = sizes.filter(~fits)
        # a bucket came from a split if the one before it was over the limit
        split = over.select(F.col("shard").alias("_p")).union(is_open.select("shard"))
        parent = F.substr("shard", F.lit(1), F.col("depth") - 1)
        shards = shards.union(sizes.filter(fits).join(split, parent == F.col("_p"), "left_semi"))
        is_open = over.filter(F.col("depth") == top + BITS)
        if top + BITS < HASH_BITS:
            inside = is_open.select(F.col("shard").alias("_p"))
            large = large.join(inside, F.substring("bits", 1, top + BITS) == F.col("_p"), "left_semi")
        else:
            shards = shards.union(is_open)
    return materialise(shards).select(
        "shard", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("bytes") > limit).alias("oversized")
    )


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` (with bits) beside their shard: each is looked up at every depth the directory has."""
    depths = sorted(r[0] for r in shards.select(F.length("shard")).distinct().collect())  # HASH_BITS + 1 at most
    at = F.explode(F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.substr("bits", F.lit(1), d)))
    return rows.withColumn("_at", at if depths else F.lit("")).join(shards, F.col("_at") == F.col("shard")).drop("_at")


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard, shard_bytes, shard_docs, oversized: one row per document."""
    prepare(docs.sparkSession)
    sized = hashed(docs.select("doc_id", "text")).select(F.col("_row.doc_id").alias("doc_id"), "bytes", "bits")
    sized = materialise(sized, "sizes")
    return assign(sized, directory(sized, limit)).drop("bits")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write the documents as Parquet with one folder per shard; returns the directory."""
    prepare(docs.sparkSession)
    rows = materialise(hashed(docs), "hashed")  # the places of equal rows are dealt once, and both uses read the same
    shards = directory(rows.select("bytes", "bits"), limit)
    out = assign(rows, shards).select("_row.*", F.concat(F.lit("s"), F.col("shard")).alias("_shard"))
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
    return shards


ORACLE = f"""
with d as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint as bytes,
    lpad(bin(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint), 60, '0') as bits
  from documents),
p as (select bits, bytes, substr(bits, 1, k) as prefix, k from d, (select unnest(range(0, 61)) as k)),
s as (select prefix, k, sum(bytes)::bigint as n, count(*) as c from p group by prefix, k),
f as (select d.*, s.prefix, s.n, s.c, row_number() over (partition by d.doc_id, d.bits order by s.k) as r
  from d join p on p.bits = d.bits join s on s.prefix = p.prefix and s.k = p.k where s.n <= {LIMIT} or s.c = 1)
select doc_id, bytes, prefix as shard, n as shard_bytes, c as shard_docs, n > {LIMIT} as oversized from f where r = 1
"""
