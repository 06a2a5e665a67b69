"""Operator 10: quality rules from cross-document line frequency (DataFrame functions only).

Lines are normalised (white space to one space, trimmed, lower case, digits to
0) and hashed. For every host the number of distinct documents holding a line
is counted over all documents; a line above the host's limit is boilerplate
and is removed, and a document of which too little is left is rejected.

* A host is the document's ``source``; a null source is a host of its own.
* Copies of a document count once: a document is identified by a digest of the set of all its
  normalised lines, which copies share. So a line is not boilerplate because one text
  was copied a thousand times. Documents of that line alone count as one. Near copies that
  differ in a normalised line are distinct documents: nothing tells them from documents around a shared block.
* The limit of a host is ``max(min_docs, host_share * documents of the host)``.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; repeated rows count once and each gets the same verdict; a line of white
space only is never counted; an empty table gives an empty result. Extra columns do not
matter: only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import NON_SPACE, SPACE, keyed, let, materialise, prepare, text_of, words

MIN_WORDS = 50  # fixed by the contract
MAX_REPEAT_PERCENT = 50  # fixed by the contract
SYMBOLS = r"[#*$%&|<>]"  # fixed by the contract
WINDOW = 3  # fixed by the contract

MIN_DOCS = 20
HOST_SHARE = 0.002
MIN_LEFT_PERCENT = 30


FEW_REPEATS = 64  # up to so many repeated windows, a scan of them is cheaper than a sort by position


def normalised(line: Column) -> Column:
    # the replacement makes a new string for every word, so it is left out where it changes nothing
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    flat = F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.regexp_replace(F.lower(flat), "[0-9]", "0")


def lines_of(text: Column) -> Column:
    """Normalised lines that hold a word: hash, code points."""
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    return F.transform(F.transform(full, normalised), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def windows(w: Column) -> Column:
    """The hash of every 3-word window, in text order."""
    last = F.size(w) - WINDOW
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))


def repeat_words(h: Column, ordered: Column) -> Column:
    """Words inside a window that occurs twice or more, first occurrence included.

    h: the windows' hashes in text order; ordered: the same, sorted.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), x + WINDOW) - x)
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def scanned(twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return F.array_compact(at)

    def by_sort() -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = let(
            pairs,
            lambda s: F.filter(
                s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
            ),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    twice = F.array_distinct(F.filter(ordered, lambda x, i: F.get(ordered, i + 1) == x))
    starts = lambda t: F.when(F.size(t) <= FEW_REPEATS, scanned(t)).otherwise(by_sort())
    return let(twice, lambda t: F.when(F.size(t) == 0, 0).otherwise(let(starts(t), covered))).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """The row-local figures, beside the keys of ``keyed_docs``."""
    text = F.col("_text")
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    # three steps, so that the sort is compiled code over plain longs
    out = docs.withColumn("_w", words(text))
    out = out.withColumn("_h", windows(F.col("_w")))
    out = out.withColumn("_s", F.sort_array("_h"))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.concat_ws("", F.col("_w"))).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_h"), F.col("_s")),
    }).drop("_w", "_h", "_s")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def keyed_docs(docs: DataFrame) -> DataFrame:
    """Row, key (id and text digest, so that repeated ids do not mix), host and text."""
    host = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = keyed(docs, F.col("doc_id"), F.xxhash64(text_of()), host, text_of())
    return rows.withColumnsRenamed({"_k1": "_id", "_k2": "_tx", "_k3": "_host", "_k4": "_text"})


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line: _id, _tx, _host, whole (code points of the document's lines), p, h, n."""
    lines = docs.select("_id", "_tx", "_host", lines_of(F.col("_text")).alias("_l"))
    whole = F.aggregate("_l", F.lit(0), lambda a, x: a + x["n"])
    return lines.select("_id", "_tx", "_host", whole.alias("whole"), F.posexplode("_l").alias("p", "_x")).select(
        "_id", "_tx", "_host", "whole", "p", "_x.h", "_x.n"
    )


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(_host, h) of the lines that stand in more distinct documents of a host than its limit."""
    lines = docs.select("_host", lines_of(F.col("_text")).alias("_l"))
    lines = lines.select("_host", F.array_sort(F.array_distinct(F.transform("_l", lambda x: x["h"]))).alias("_s"))
    lines = lines.select("_host", F.xxhash64("_s").alias("doc"), F.explode("_s").alias("h"))
    counted = lines.groupBy("_host", "h").agg(F.count_distinct("doc").alias("docs"))
    hosts = docs.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"))
    return (
        counted.filter(F.col("docs") > min_docs)
        .join(hosts, "_host")
        .filter(F.col("docs") > host_share * F.col("host_docs"))
        .select("_host", "h")
    )


def line_verdicts(docs: DataFrame, min_left: int = MIN_LEFT_PERCENT, **limits) -> DataFrame:
    """Per document that loses a line: _id, _tx, _host, removed (line hashes), depleted."""
    hit = line_rows(docs).join(frequent_lines(docs, **limits), ["_host", "h"])
    # positions make the set the same for a repeated row
    per = hit.groupBy("_id", "_tx", "_host").agg(
        F.collect_set(F.struct("p", "h", "n")).alias("hit"), F.max("whole").alias("whole")
    )
    gone = F.aggregate("hit", F.lit(0), lambda a, x: a + x["n"])
    return per.select(
        "_id", "_tx", "_host",
        F.array_distinct(F.transform("hit", lambda x: x["h"])).alias("removed"),
        (100 * (F.col("whole") - gone) < min_left * F.col("whole")).alias("depleted"),
    )


def _judged(rows: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    """``rows`` (with the keys) beside removed and kept."""
    verdicts = line_verdicts(docs, **limits).withColumnsRenamed({"_id": "_i", "_tx": "_t", "_host": "_o"})
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tx") == F.col("_t")) & (F.col("_host") == F.col("_o"))
    out = rows.join(verdicts, same, "left").drop("_i", "_t", "_o")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_removed (distinct lines removed)."""
    docs = keyed_docs(docs.select("doc_id", "text", "source"))
    rows = base_rules(docs).drop("_row", "_text")
    out = _judged(rows, docs, **limits)
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def filter_quality(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; the columns of ``docs``.

    n_chars, where the table has it, follows the text. A text that loses no line stays as it is.
    """
    prepare(docs.sparkSession)
    columns = docs.columns
    key = keyed_docs(docs)
    # written first: a filter on the figures would be pushed below them and repeat their work for every row
    judged = materialise(_judged(base_rules(key).drop("_row", "_text"), key, **limits), "quality")
    judged = judged.filter("kept").dropDuplicates(["_id", "_tx", "_host"])
    judged = judged.select(F.col("_id").alias("_i"), F.col("_tx").alias("_t"), F.col("_host").alias("_o"), "removed")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tx") == F.col("_t")) & (F.col("_host") == F.col("_o"))
    # a row's text is shuffled once
    out = key.drop("_text").join(judged, same).withColumn("_text", text_of("_row.text"))
    line_hash = lambda x: F.xxhash64(normalised(x))
    left = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("removed", line_hash(x)))
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    out = out.withColumn("_new", text)
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as gram
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
r as (select doc_id, gram from g group by doc_id, gram having count(*) > 1),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g join r using (doc_id, gram)) group by doc_id),
l as (select doc_id, source, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) as flat
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n as (select doc_id, source, line, regexp_replace(flat, '[0-9]', '0', 'g') as norm from l),
u as (select doc_id, count(*) - count(distinct line) as dup, sum(length(norm)) as whole, list_sort(list_distinct(list(md5(norm)))) as m from n group by doc_id),
e as (select doc_id, source, norm, md5(array_to_string(m, ',')) as sig from n join u using (doc_id)),
f as (select source, norm from e join (select source as s, count(*) as docs from d group by source) h on h.s is not distinct from source
  group by source, norm, docs having count(distinct sig) > {MIN_DOCS} and count(distinct sig) > {HOST_SHARE} * docs),
v as (select n.doc_id, count(distinct n.norm) as removed, sum(length(n.norm)) as gone
  from n join f on n.norm = f.norm and n.source is not distinct from f.source group by n.doc_id),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(u.dup, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, whole
  from d left join u using (doc_id) left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    and not coalesce(100 * (whole - gone) < {MIN_LEFT_PERCENT} * whole, false) as kept,
  coalesce(removed, 0)::bigint as n_removed
from b left join v using (doc_id)
"""
