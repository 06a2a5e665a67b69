"""One JSON document of any size, parsed by many tasks.

A document that is one map (or list) is read in byte ranges and cut where its entries end:

1. Spark's text reader takes the comma for the line separator, so its splits are the byte ranges and its rows the texts
   between commas. A comma never follows the beginning of an escape, so a text's quotes can be counted without knowing what came before.
2. Whether a text begins within a string is the parity of all quotes before it; how deep it begins, the sum of the brackets
   before it that are outside strings. Both are prefix sums: within a range by a window over the range, for either state that the
   range may begin in, and over the ranges by a window with one row for each.
3. A text that begins outside strings at depth 1 begins an entry. The texts of an entry are joined again and parsed.

So one task holds a range, or an entry, and never the document. An entry's position is that of its beginning, which keeps the
document's order. A damaged document gives its readable entries, and the others as texts that did not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ingot.session import stored

_ESCAPE = r"\\."  # of JSON strings: a backslash and the character it stands before


def _depth(text: Column) -> Column:
    """Opening less closing brackets."""
    kept = lambda signs: F.length(F.regexp_replace(text, f"[^{signs}]", ""))
    return (kept(r"\[{") - kept(r"\]}")).cast("long")


def _texts(spark: SparkSession, pattern: str) -> DataFrame:
    """The texts between commas: with quotes, and the depth they add if they begin outside (``d0``) or within (``d1``) a string."""
    raw = spark.read.option("lineSep", ",").text(pattern)
    raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", f"(?s){_ESCAPE}", ""), '"', -1)
    every = lambda k: _depth(F.array_join(F.filter("parts", lambda x, i: i % 2 == k), ""))
    raw = raw.withColumn("parts", parts)
    return raw.select("_file", "_block", "_at", "value", (F.size("parts") - 1).cast("long").alias("quotes"), every(0).alias("d0"), every(1).alias("d1"))


def entries(spark: SparkSession, pattern: str) -> DataFrame:
    """(_file, _block, _p, text, first) of each entry of the documents that match; ``first``: the text begins with the document's bracket."""
    here = Window.partitionBy("_file", "_block").orderBy("_at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    inside = F.coalesce(F.sum("quotes").over(before), none) % 2
    rows = _texts(spark, pattern).withColumn("inside", inside)
    # as it is if the range begins outside strings, and the other way round if within one
    rows = rows.withColumns({"a": F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")), "b": F.when(F.col("inside") == 0, F.col("d1")).otherwise(F.col("d0"))})
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), none) for c in ("a", "b")})
    rows = stored(rows.drop("d0", "d1"), "ranges")

    ranges = rows.groupBy("_file", "_block").agg(*[F.sum(c).alias(c) for c in ("quotes", "a", "b")])
    over = Window.partitionBy("_file").orderBy("_block")
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("flipped", F.coalesce(F.sum("quotes").over(ahead), none) % 2 == 1)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("flipped"), F.col("b")).otherwise(F.col("a"))).over(ahead), none))
    ranges = ranges.select(F.col("_file").alias("f"), F.col("_block").alias("k"), "flipped", F.col("depth").alias("base"))

    rows = rows.join(ranges, (F.col("_file") == F.col("f")) & (F.col("_block") == F.col("k")))
    depth = F.col("base") + F.when(F.col("flipped"), F.col("b_before")).otherwise(F.col("a_before"))
    outside = (F.col("inside") == 0) != F.col("flipped")
    at = F.struct("_block", "_at")
    rows = rows.select("_file", "_block", "_at", "value", (outside & (depth <= 1)).alias("starts"), (depth <= 0).alias("first"))
    # an entry's name is the place where it starts: the last start in the range, or else that of the ranges before
    rows = rows.withColumn("start", F.last(F.when(F.col("starts"), at), ignorenulls=True).over(here))
    rows = stored(rows, "entries")
    last = rows.groupBy("_file", "_block").agg(F.max("start").alias("last"))
    last = last.select(F.col("_file").alias("f"), F.col("_block").alias("k"), F.last("last", ignorenulls=True).over(ahead).alias("held"))
    rows = rows.join(last, (F.col("_file") == F.col("f")) & (F.col("_block") == F.col("k"))).withColumn("start", F.coalesce("start", "held"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x["value"]), ",")
    found = rows.groupBy("_file", "start").agg(text.alias("text"), F.bool_or(F.col("first") & F.col("starts")).alias("first"))
    return found.select("_file", F.col("start._block").alias("_block"), F.col("start._at").alias("_p"), "text", "first")


def parsed_entries(found: DataFrame) -> DataFrame:
    """The entries with ``doc``, a map or list of one item; null if the text is no entry.

    The text of the first entry begins with the document's bracket, that of the last one ends with the closing one, after which the parser stops.
    """
    own = F.coalesce(*[F.try_parse_json(F.concat("text", F.lit(c))) for c in "}]"])
    wrapped = F.coalesce(*[F.try_parse_json(F.concat(F.lit(o), F.col("text"), F.lit(c))) for o, c in ("{}", "[]")])
    return found.withColumn("doc", F.when(F.col("first"), own).otherwise(wrapped))
