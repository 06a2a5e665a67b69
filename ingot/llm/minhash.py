"""Operator 7: near duplicates by Fast Similarity Sketching, banding and exact verification.

1. Every text becomes its set of word shingles; equal sets (128-bit digest of
   the whole set) are one node, so thousands of copies cost one row from here.
2. Nodes that agree in all coordinates of a band share its bucket. Candidates come from buckets
   of two or more, but pairs of a bucket are never made as rows. Each node is held against that hub of its
   buckets that its sketch is nearest to (a bucket's hub shares most buckets with others: in a family of copies,
   its middle). What verifies is linked. The nodes outside a bucket's largest component then form a group
   with that component. Outside nodes and the others are cut into parts of bounded size, and every pair of an outside
   node and another node of its group is compared in a cell of two parts: on sketches first, which leaves few nodes, then
   on the full sets. What comes out are nodes, and links. So components are those of all candidate pairs.
3. A candidate's sketches must agree as often as those of a pair at the threshold, less MARGIN standard deviations;
   a link is confirmed on the two full sets.

A pair of similarity 0.8 is missed with probability 5e-8 by the bands, and
3e-5 by the sketch; a link never comes without the confirmation on full sets.

Edge cases: a text without words (or null) has an empty set, is linked with nothing and stays its own
component; fewer words than a shingle make one shingle of all of them; repeated rows are copies,
each with the same result; a null doc_id takes part, and has a null component only if no document
of its component has an id; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.llm import sketch
from ingot.llm.common import keyed, materialise, prepare
from ingot.llm.components import components

PERCENT = 80  # fixed by the contract
MARGIN = 4.0
PER_BLOCK = 4096  # nodes of a part at most, about
PER_BYTES = 1 << 26  # the same for the bytes of its full sets
BITS = 1 << 23  # places of the bitmap that goes to every task: 1 MB


def _least_agreement(percent: int) -> int:
    p = percent / 100
    return int(sketch.T * p - MARGIN * sqrt(sketch.T * p * (1 - p)))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, id, score) of the buckets with two nodes or more; score: the sizes of all buckets of a node."""
    rows = nodes.select(F.explode("bands").alias("key"), F.col("set_id").alias("id"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = materialise(rows.join(shared, "key"))
    score = rows.groupBy("id").agg(F.sum("size").alias("score"))
    return materialise(rows.drop("size").join(score, "id").select("key", "id", "score"))


def _cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outside nodes and all nodes of each group, each with the ``cell`` of every comparison that it takes part in.

    The outside nodes of a group are cut into parts, and so are the others. A cell is a part of outside nodes and one
    that it is held against: a part of the others, the part itself or a later outside part. Small groups share a cell.
    """
    weight = F.lit(PER_BYTES // PER_BLOCK)
    if "shingles" in rows.columns:
        weight = weight + F.octet_length("shingles")
    sums = [F.sum(F.when(F.col("own") == own, weight).otherwise(0)).alias(c) for own, c in ((False, "out"), (True, "in"))]
    size = materialise(rows.groupBy("y").agg(*sums))
    total = size.agg(F.sum(F.col("out") + F.col("in"))).first()[0] or 0
    outs, ins = F.greatest(F.ceil(F.col("out") / PER_BYTES), F.lit(1)), F.ceil(F.col("in") / PER_BYTES)
    size = size.select(
        F.col("y").alias("_y"), outs.alias("_outs"), ins.alias("_ins"),
        F.when(F.col("out") + F.col("in") <= PER_BYTES // 8, F.pmod(F.xxhash64("y"), F.lit(total // PER_BYTES + 1))).alias("_small"),
    )
    h = F.xxhash64("a")
    part = F.when(F.col("own"), F.col("_outs") + F.pmod(h, F.greatest("_ins", F.lit(1)))).otherwise(F.pmod(h, "_outs"))
    placed = rows.join(size, F.col("y") == F.col("_y")).withColumn("_part", part)
    against = F.transform(F.sequence(F.col("_part"), F.col("_outs") + F.col("_ins") - 1), lambda t: F.xxhash64("y", "_part", t))
    held = F.transform(F.sequence(F.lit(0).cast("long"), F.least("_part", F.col("_outs") - 1)), lambda q: F.xxhash64("y", q, "_part"))

    def side(df: DataFrame, cells: Column) -> DataFrame:
        cells = F.when(F.col("_small").isNotNull(), F.array("_small")).otherwise(cells)
        out = df.select(*rows.columns, F.explode(cells).alias("cell"))
        return out.toDF(*out.columns)  # columns of its own, as both sides come from one table

    return side(placed.filter("not own"), against), side(placed, held)


def _links(pairs: DataFrame, facts: DataFrame, percent: int, schema: str, work) -> DataFrame:
    """Run ``work`` on each cell of groups: a table of outside nodes and one of the nodes they are held against.

    pairs: (a, y, own), own: a is one of those that others are held against.
    """
    outside, inside = _cells(materialise(pairs.join(facts.withColumnRenamed("set_id", "a"), "a")))
    return outside.groupBy("cell").cogroup(inside.groupBy("cell")).applyInArrow(work, schema)


def near_roots(nodes: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the nodes with a link: the components of all candidate pairs (see the module's text)."""
    least = _least_agreement(percent)
    brief = nodes.select("set_id", "n", "brief")
    # 1. each node and the hub of its buckets that its sketch is nearest to
    hub = rows.groupBy("key").agg(F.max(F.struct("score", "id"))["id"].alias("b"))
    pairs = rows.join(hub, "key").filter(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct()
    side = lambda x: brief.toDF(x, f"n_{x}", f"s_{x}")
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    near = near.mapInArrow(sketch.near_batches(least, percent), "a binary, b binary, agree int")
    near = materialise(near.groupBy("a").agg(F.max(F.struct("agree", "b"))["b"].alias("b")))
    full = lambda x: sets.toDF(x, f"f_{x}")
    both = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "f_a", "f_b")
    roots = components(both.mapInArrow(sketch.link_batches(percent), "a binary, b binary"))

    # 2. nodes outside the largest component of a bucket form a group with that component
    now = rows.select("key", "id").join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    now = materialise(now)
    per = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = per.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("y"), F.count(F.lit(1)).alias("n"))
    now = now.join(mixed.filter("n > 1").drop("n"), "key").select(F.col("id").alias("a"), "y", (F.col("root") == F.col("y")).alias("own"))
    groups = materialise(now.distinct())
    if not groups.limit(1).count():
        return roots
    # 3. those that agree with some other node of their group well enough for a link
    close = _links(groups, brief, percent, "a binary, y binary, own boolean", sketch.close_nodes(least, percent))
    close = materialise(close.distinct())
    # 4. links between them, each confirmed on the full sets
    links = _links(close, brief.select("set_id", "brief").join(sets, "set_id"), percent, "a binary, b binary", sketch.group_links(least, percent))
    more = materialise(links)
    if not more.limit(1).count():
        return roots
    at = lambda c: roots.toDF(c, f"r_{c}")
    ends = more.join(at("a"), "a", "left").join(at("b"), "b", "left")
    later = components(ends.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")))
    old = roots.join(later.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    alone = later.join(roots, "node", "left_anti")  # nodes that had no link before
    return materialise(old.union(alone.select("node", "root")))


def _bits(marks: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of BITS places, those of the values of ``tx``; its size does not depend on theirs."""
    place = F.pmod("tx", F.lit(BITS)) + 1
    rows = marks.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _flagged(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """The documents with ``marked``: whether their place is in the bitmap, found without a shuffle."""
    place = F.pmod("tx", F.lit(BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "bucket", "left")
    marked = byte.bitwiseAND(F.pow(F.lit(2), at.bitwiseAND(F.lit(7))).cast("int")) != 0
    return found.withColumn("marked", F.coalesce(marked, F.lit(False))).drop("bucket", "bits")


def _marked(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """The documents whose place is in the bitmap."""
    return _flagged(docs, bits).filter("marked").drop("marked")


def _verdicts(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, tx (the text's digest), n, root, component_id, kept: one row per document."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tx"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = docs.mapInArrow(
        sketch.sketch_batches(shingle),
        f"doc_id {kind}, tx long, set_id binary, n long, bands array<long>, brief binary",
    )
    marks = materialise(marks, "sketches")
    first = [F.first(c).alias(c) for c in ("n", "bands", "brief")]
    nodes = marks.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "tx")).alias("at"), *first)
    nodes = materialise(nodes, "nodes")
    rows = _buckets(nodes)
    # the texts of nodes that share a bucket are read once more: their sets are made from them, whole
    wanted = nodes.select("set_id", "at.*").join(rows.select(F.col("id").alias("set_id")).distinct(), "set_id")
    wanted = materialise(wanted)
    ids = wanted.toDF("set_id", "_i", "_t")
    texts = _marked(docs, _bits(wanted)).join(ids, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("tx") == F.col("_t")))
    texts = texts.select("set_id", "text")
    sets = materialise(texts.mapInArrow(sketch.set_batches(shingle), "set_id binary, shingles binary"), "sets")
    if sets.count() > wanted.count():  # rows that are there more than once
        sets = materialise(sets.dropDuplicates(["set_id"]), "sets")
    roots = near_roots(nodes, sets, rows, percent)
    rooted = marks.select("doc_id", "tx", "set_id", "n").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "set_id"))
    least = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "tx", "n", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    return _verdicts(docs, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; the columns of ``docs``.

    Rows are told apart by doc_id and text: of several texts with that id in one component the one with the smallest digest stays, of rows that
    repeat it one, and texts that merely share an id with others are judged by themselves. Documents without words or without an id all stay.
    """
    found = _verdicts(docs, shingle, percent).filter("n > 0 and doc_id is not null").select("doc_id", "tx", "root", "kept")
    found = materialise(found, "verdicts")
    best = found.filter("kept").groupBy("root").agg(F.min("tx").alias("best"))
    judged = found.join(best, "root", "left").withColumn("stays", F.coalesce(F.col("kept") & (F.col("tx") == F.col("best")), F.lit(False)))
    gone = judged.filter(~F.col("stays")).select("doc_id", "tx").distinct()
    gone = materialise(gone, "gone")
    again = judged.filter("stays").groupBy("doc_id", "tx").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    again = materialise(again.select("doc_id", "tx"))
    # only rows whose text may be one of those are shuffled
    rows = keyed(docs, F.col("doc_id"), F.xxhash64("text")).withColumn("tx", F.col("_k2"))
    rows = _flagged(rows, materialise(_bits(gone.union(again)), "bits")).withColumnRenamed("tx", "_x")
    same = (F.col("_k1") == F.col("doc_id")) & (F.col("_k2") == F.col("tx"))
    plain = rows.filter("not marked")
    left = rows.filter("marked").join(gone, same, "left_anti")
    if not again.limit(1).count():
        return plain.union(left).select("_row.*")
    # rows that repeat the one that stays
    many = left.join(again, same, "left_semi").dropDuplicates(["_k1", "_k2"])
    once = left.join(again, same, "left_anti")
    return plain.union(once).union(many).select("_row.*")
