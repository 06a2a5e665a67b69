"""Operator 13: Merkle manifest of a dataset, with every level of a block as one string of concatenated digests.

1. A row's leaf is the SHA-256 of its fields. Rows are numbered within their group: a range partitioning by group and
   key sorts them, ``monotonically_increasing_id`` numbers them within the parts, and the parts' counts, summed up,
   give what comes before each part. So a group of any size is spread over many tasks.
2. BLOCK consecutive rows are a block. Its leaves, concatenated, are one hex string; fixed-width substrings of FAN
   digests are hashed to the string of the next level, LEVELS times. The blocks' top digests are the rows
   of the next round, until each group has one digest left; then the groups' roots are folded to the root in the same way.
3. A row's siblings on a level are the two substrings that flank its digest within its run. The
   path of a block's top digest comes down from the round above by a join on (group, block), which has one row for each block.

Edge cases: a null field is ``-``, so a null text isn't an empty one; rows with equal keys are ordered by their leaves, so
repeated rows are leaves of their own, whose results are the same whichever comes first; a null key comes first and is
never tampered with; a group of one row has its leaf as root; an empty table gives an empty result. Columns
other than FIELDS are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingot.llm.common import let, materialise, prepare

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed by the contract, in this order
FAN = 16  # fixed by the contract
EVERY = 5  # fixed by the contract: rows whose key's crc32 it divides are tampered with
HEX = 64  # hex digits of a digest
LEVELS = 2  # levels of a block
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, g (the group's sort key), leaf, other: ``other`` is the leaf with ``changed`` as text, or null."""
    row = {c: field(F.col(c)) for c in FIELDS}
    leaf = hashed(F.concat(*row.values()))
    other = F.when(changed.isNotNull(), hashed(F.concat(*(row | {"text": field(changed)}).values())))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, and no null key
    return docs.select("doc_id", group.alias("g"), leaf.alias("leaf"), other.alias("other"))


def tampered(every: int = EVERY) -> Column:
    """The text with A-Z lower-cased where the crc32 of the id is divisible; or else null."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.when(crc % every == 0, F.translate("text", UPPER, LOWER))


# --------------------------------------------------------------------------- ranks


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows (with g) and ``rank``, from 0 by ``order`` within g, and ``total``, the rows of g. ``order`` must be unique."""
    keys = ["g", *order]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = materialise(cut.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    runs = cut.groupBy("g", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("g")
    before = F.sum("n").over(own.orderBy("part")) - F.col("n")
    runs = materialise(runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total")), "runs")
    found = cut.withColumn("part", part).join(runs, ["g", "part"])
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "part")


# --------------------------------------------------------------------------- levels


def cut(level: Column, start: Column, n: Column) -> Column:
    """``n`` digests of a level from digest ``start`` on."""
    return F.substr(level.cast("binary"), (start * HEX + 1).cast("int"), (n * HEX).cast("int")).cast("string")


def above(level: Column) -> Column:
    """The level above: the digest of each run of FAN, concatenated."""
    runs = F.ceil(F.length(level) / (HEX * FAN)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: hashed(cut(level, i * FAN, F.lit(FAN))))
    return F.array_join(hashes, "")


def flanks(level: Column, at: Column) -> Column:
    """The digests left and right of digest ``at`` in its run."""
    start = at - at % FAN
    end = F.least(start + FAN, (F.length(level) / HEX).cast("int"))
    return F.struct(cut(level, start, at - start).alias("l"), cut(level, at + 1, end - at - 1).alias("r"))


def goes_up(k: int) -> Column:
    """Whether level k of a block is hashed on: while several nodes of the group remain, and always in groups of many blocks."""
    return (F.col("total") > BLOCK) | (F.col("total") > FAN**k)


def rounds(nodes: DataFrame, kept: list[str]) -> list[DataFrame]:
    """Per round the blocks: g, block, total, members (node and the columns kept, by rank), l0, l1, ..., top.

    nodes: g, rank, total, node and the columns to keep. The first round keeps them; its later ones have blocks as members.
    """
    out = []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most:
        member = F.struct("rank", "node", *(kept if not out else []))
        block = nodes.groupBy("g", F.floor(F.col("rank") / BLOCK).alias("block"), "total").agg(F.sort_array(F.collect_list(member)).alias("members"))
        block = block.withColumn("l0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
        for k in range(LEVELS):
            block = block.withColumn(f"l{k + 1}", F.when(goes_up(k), above(F.col(f"l{k}"))))
        top = F.coalesce(*[f"l{k}" for k in reversed(range(LEVELS + 1))])
        members = F.transform("members", lambda m: m.dropFields("rank"))
        out.append(materialise(block.withColumns({"top": top, "members": members}).drop(f"l{LEVELS}"), "blocks"))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = out[-1].filter(F.col("total") > BLOCK).select(
            "g", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node")
        )
    return out


PATH = "array<struct<l:string,r:string>>"


def members(blocks: DataFrame, over: DataFrame) -> DataFrame:
    """The blocks' members with path: each one's flanks by level, then those of its block's top digest.

    over: g, block, path and further columns, which are kept.
    """
    rows = blocks.join(over, ["g", "block"]).select("*", F.posexplode("members").alias("pos", "m")).drop("members")
    none = F.array().cast(PATH)
    steps = [F.when(goes_up(k), F.array(flanks(F.col(f"l{k}"), F.floor(F.col("pos") / FAN**k).cast("int")))).otherwise(none) for k in range(LEVELS)]
    rank = F.col("block") * BLOCK + F.col("pos")
    return rows.select("g", rank.alias("rank"), "m.*", F.concat(*steps, "path").alias("path"), *[c for c in over.columns if c not in ("g", "block", "path")])


@dataclass
class Manifest:
    first: list[DataFrame]  # rounds within the groups
    groups: DataFrame  # g, ended (the round that gave its root), node (the root), and its path to the root of all

    def proofs(self) -> DataFrame:
        """Per row: doc_id, g, leaf, other, path (l and r of each level, from the leaf up), subroot, root."""
        over = None
        for k in reversed(range(len(self.first))):
            ended = self.groups.filter(F.col("ended") == k).select("g", F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root")
            over = ended if over is None else ended.unionByName(over)
            over = members(self.first[k], over)
            if k:
                over = over.select("g", F.col("rank").alias("block"), "path", "subroot", "root")
        return over.select("doc_id", "g", F.col("node").alias("leaf"), "other", "path", "subroot", "root")


def manifest(rows: DataFrame) -> Manifest | None:
    """The manifest of rows (doc_id, g, leaf, other); None if there are none."""
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    first = rounds(ranked(rows, ["doc_id", "leaf", "row"]).withColumnRenamed("leaf", "node"), ["doc_id", "other"])
    if not first:
        return None
    roots = None
    for k, blocks in enumerate(first):
        ended = blocks.filter(F.col("total") <= BLOCK).select(F.col("g").alias("name"), F.lit(k).alias("ended"), F.col("top").alias("node"))
        roots = ended if roots is None else roots.unionByName(ended)
    # all groups are one group
    nodes = ranked(roots.withColumn("g", F.lit("")), ["name"])
    over = None
    for blocks in reversed(rounds(nodes, ["name", "ended"])):
        if over is None:
            over = blocks.select("g", "block", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
        over = members(blocks, over)
        groups, over = over, over.select("g", F.col("rank").alias("block"), "path", "root")
    return Manifest(first, materialise(groups.select(F.col("name").alias("g"), "ended", "node", "path", "root"), "groups"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: hashed(F.concat(s["l"], h, s["r"])))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per document."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = manifest(leaves(docs, tampered()))
    if found is None:
        schema = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], f"doc_id {kind}, {schema}")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = found.proofs().select(
        "doc_id", "leaf", "subroot", "root", hashed(siblings).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {0})"
_CRC = """xor(list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(range(1, length({0}) + 1),
    lambda i: list_concat([ascii({0}[i])::ubigint + 9000000000::ubigint], list_transform(range(8), lambda j: 8000000000::ubigint))))),
    lambda c, x: case when x >= 9000000000::ubigint then xor(c, x - 9000000000::ubigint)
      when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end), 4294967295::ubigint)"""

ORACLE = f"""with recursive d as (
  select doc_id, source, {_LEAF.format(_FIELD.format("text"))} as leaf,
    case when text is not null and {_CRC.format("(doc_id::varchar)")} % {EVERY} = 0
      then {_LEAF.format(_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} end as other from documents),
r as (select *, coalesce('=' || source, '') as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
    count(*) over (partition by source) as n from d),
t(g, lvl, idx, node, n) as (
  select g, 0, idx, leaf, n from r
  union all
  select g, lvl + 1, idx // {FAN}, sha256(string_agg(node, '' order by idx)), (n + {FAN - 1}) // {FAN} from t where n > 1 group by g, lvl, idx // {FAN}, n),
s as (select g, node, row_number() over (order by g) - 1 as idx, count(*) over () as n from t where n = 1),
u(lvl, idx, node, n) as (
  select 0, idx, node, n from s
  union all
  select lvl + 1, idx // {FAN}, sha256(string_agg(node, '' order by idx)), (n + {FAN - 1}) // {FAN} from u where n > 1 group by lvl, idx // {FAN}, n),
steps as (
  select r.g, r.idx, x.lvl, coalesce(string_agg(t.node, '' order by t.idx) filter (t.idx < x.at), '') as l,
    coalesce(string_agg(t.node, '' order by t.idx) filter (t.idx > x.at), '') as r
  from (select g, idx, unnest(range(0, 12)) as lvl from r) r, lateral (select r.lvl as lvl, r.idx // ({FAN} ** r.lvl)::bigint as at) x
  join t on t.g = r.g and t.lvl = x.lvl and t.idx // {FAN} = x.at // {FAN} and t.n > 1 group by all),
tops as (
  select s.g, x.lvl, coalesce(string_agg(u.node, '' order by u.idx) filter (u.idx < x.at), '') as l,
    coalesce(string_agg(u.node, '' order by u.idx) filter (u.idx > x.at), '') as r
  from (select g, idx, unnest(range(0, 12)) as lvl from s) s, lateral (select s.lvl as lvl, s.idx // ({FAN} ** s.lvl)::bigint as at) x
  join u on u.lvl = x.lvl and u.idx // {FAN} = x.at // {FAN} and u.n > 1 group by all),
path as (select g, idx, list({{'l': l, 'r': r}} order by part, lvl) as path from (
    select g, idx, 0 as part, lvl, l, r from steps
    union all select r.g, r.idx, 1, tops.lvl, tops.l, tops.r from r join tops using (g)) group by all),
out as (select doc_id, leaf, s.node as subroot, (select node from u where n = 1) as root, coalesce(path, []) as path, coalesce(other, leaf) as now
  from r join s using (g) left join path on path.g = r.g and path.idx = r.idx)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) as proof_sha256,
  list_reduce(list_concat([{{'l': now, 'r': ''}}], path), lambda h, p: {{'l': sha256(p.l || h.l || p.r), 'r': ''}}).l as folded_root,
  list_reduce(list_concat([{{'l': now, 'r': ''}}], path), lambda h, p: {{'l': sha256(p.l || h.l || p.r), 'r': ''}}).l = root as verified
from out"""
