"""Operator 12: hard negatives by threshold joins on an inverted index, after L2AP.

A search takes anchors with windows of scores and returns the best rows within each window. Rows lie in blocks of BLOCK by
a hash, so rows that are alike (one vector, one label) spread over all of them; anchors come in chunks of CHUNK, and every
chunk meets every block of its vector length, so a task holds one of either.

1. A block's dimensions are ordered by their energy and cut into slabs. Its inverted index holds, per slab, the rows
   whose product with a chunk's anchors can still reach the lowest threshold there; the slabs at the end that are
   covered by the bound |rest of the row| * |rest of the anchor| < threshold are omitted.
2. Partial scores are accumulated from the postings. A pair is dropped when its partial score and the product of the
   remaining norms stay below its anchor's threshold. The scores of what is left are completed from the omitted slabs; they are whole numbers.
3. Windows begin with a high threshold, at which some WANT rows are expected. Those that don't fill get a lower one, until they
   fill or their bottom is reached: all rows above a threshold are found, so a filled window is exact. A block
   returns k rows for each window at most.

The first thresholds come from the mean and spread of an anchor's scores against SAMPLE rows. That sample only sets the
pace: a poor guess costs a round, never a row.

Edge cases: a row with a null id, label or vector, or with a component that is null or not finite (or not finite times SCALE) takes
no part; rows equal in id, label and vector count once, others that share an id are rows of their own, but none is a candidate
of an anchor with its id; vectors of other lengths than the anchor's are no candidates; of equal scores the smaller id
comes first; a window that is not filled returns what there is, an anchor without positives or negatives nothing; a positive with a negative
score has an empty window; scores beyond 64 bits are held at their ends; an empty table gives an empty result.
Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingot.llm.common import ARROW_ROWS, materialise, prepare, ships

ships(__name__)

POSITIVES, NEGATIVES = 5, 10  # fixed by the contract
ANCHORS, RELABELLED, LABELS = 100, 7, 10  # fixed by the contract: divisors of ids, and the number of labels
LEAST, MOST = 3, 9  # fixed by the contract: tenths of the positive's score that a negative's lies between
SCALE = 256  # fixed by the contract

BLOCK = 4096  # rows of a block, about
CHUNK = 256  # anchors of a chunk, about
CELLS = 8  # rows (a block and a chunk each) of an Arrow batch: some 5 MB
SLAB = 8  # dimensions
SPARSE = 32  # pairs are verified one by one when fewer than one in SPARSE is left
PAIRS = 1 << 16  # of them at once
SAMPLE = 4096  # rows that the first thresholds are set by
WANT = 4  # times k: the rows expected above a window's first threshold
STEP = 16  # times as many are expected above the next one
BOTTOM, TOP = -(2**63), 2**63 - 1


def vector_batches(batches):
    """For mapInArrow over (vec_id, label, embedding): vec_id, label, dim, x (components times SCALE, rounded down; 64-bit floats)."""
    for b in batches:
        keep, dims, out = [], [], []
        for i, x in enumerate(b.column(2).to_pylist()):
            if x is None or None in x:
                continue
            with np.errstate(over="ignore"):
                v = np.floor(np.array(x, np.float64) * SCALE)
            if np.isfinite(v).all():
                keep.append(i)
                dims.append(len(v))
                out.append((v + 0.0).tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
            names=["vec_id", "label", "dim", "x"],
        )


def vectors(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, label, dim, x: the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.mapInArrow(vector_batches, "vec_id long, label long, dim int, x binary")
    once = rows.dropDuplicates(["vec_id", "label", "x"])
    return materialise(once.withColumn("row", F.monotonically_increasing_id()), "vectors")


# --------------------------------------------------------------------------- blocks and chunks


def pack_block(key, rows):
    """For applyInArrow of a block's rows: one row with their ids, labels and components, as narrow as they fit."""
    dim, n = key[0].as_py(), rows.num_rows
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float64).reshape(n, dim)
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    ids, labels = (np.asarray(rows.column(c)).astype("<i8").tobytes() for c in ("vec_id", "label"))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "kind": [kind],
        "ids": pa.array([ids], pa.binary()), "labels": pa.array([labels], pa.binary()), "xs": pa.array([x.astype(kind).tobytes()], pa.binary()),
    })


def blocks(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dim, block, kind, ids, labels, xs: one row for each block; and (dim, n, blocks) of each vector length."""
    sizes = data.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "lengths")
    dealt = data.join(sizes.select(F.col("dim").alias("_d"), "blocks"), F.col("dim") == F.col("_d"))
    dealt = dealt.select("vec_id", "label", "dim", "x", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
    schema = "dim int, block long, kind string, ids binary, labels binary, xs binary"
    return materialise(dealt.groupBy("dim", "block").applyInArrow(pack_block, schema), "blocks"), sizes


class Index:
    """A block's rows by slabs of its dimensions, the most energetic first, with the norms of what remains after each slab."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.cuts = list(range(0, x.shape[1], SLAB)) + [x.shape[1]]
        self.rest = self.norms(self.x)
        self.most = np.abs(x).max(initial=0)

    def norms(self, y: np.ndarray) -> np.ndarray:
        """Per row and cut the norm of the components from there on."""
        square = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([square, np.zeros((len(y), 1))], axis=1)[:, self.cuts])

    def find(self, q: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs whose score is ``low`` of the anchor or more, and perhaps of some just below."""
        q = np.ascontiguousarray(q[:, self.order])
        rest = self.norms(q)
        floor = low - 1e-9 * (1 + rest[:, 0] * self.rest[:, 0].max(initial=0))  # rounding drops no pair
        # the slab from which on a row's components are covered for all anchors: those are not in its postings
        ends = (self.rest * rest.max(axis=0, initial=0) >= floor.min(initial=np.inf)).sum(axis=1)
        ends = np.minimum(ends, len(self.cuts) - 1)
        rows = np.flatnonzero(ends)
        ends = ends[rows]
        part = np.zeros((len(q), len(rows)))
        for k, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            posted = np.flatnonzero(ends > k)
            if not len(posted):
                break
            if len(posted) == len(rows):
                part += q[:, a:z] @ self.x[rows, a:z].T
            else:
                part[:, posted] += q[:, a:z] @ self.x[rows[posted], a:z].T
        left = np.empty(part.shape, bool)
        for e in np.unique(ends):
            mine = ends == e
            left[:, mine] = part[:, mine] + rest[:, e][:, None] * self.rest[rows[mine], e] >= floor[:, None]
        if left.sum() * SPARSE >= left.size:  # many are left: verify them together
            for e in np.unique(ends):
                mine = np.flatnonzero((ends == e) & left.any(axis=0))
                part[:, mine] += q[:, self.cuts[e] :] @ self.x[rows[mine], self.cuts[e] :].T
            i, j = np.nonzero(left & (part >= floor[:, None]))
            score = part[i, j]
        else:
            i, j = np.nonzero(left)
            score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + PAIRS]], self.x[rows[j[s : s + PAIRS]]]) for s in range(0, len(i), PAIRS)] or [np.empty(0)])
        if self.most * np.abs(q).max(initial=0) * max(1, q.shape[1]) < 2**53:
            return i, rows[j], score.astype(np.int64)  # sums of whole numbers below 2**53 are exact
        big, small = ({n: [int(c) for c in m[n]] for n in set(at.tolist())} for m, at in ((self.x, rows[j]), (q, i)))
        pairs = zip(i.tolist(), rows[j].tolist(), strict=True)
        exact = [min(TOP, max(BOTTOM, sum(c * d for c, d in zip(small[m], big[n], strict=True)))) for m, n in pairs]
        return i, rows[j], np.array(exact, np.int64)


def search_batches(same: bool, k: int):
    """For mapInArrow over a block's columns and ``chunk``: row, no, vec_id, score of the best k in each window."""

    def run(batches):
        held, index, ids, labels = None, None, None, None
        for b in batches:
            for c in b.to_pylist():
                if held != (c["dim"], c["block"]):
                    held = c["dim"], c["block"]
                    ids, labels = np.frombuffer(c["ids"], "<i8"), np.frombuffer(c["labels"], "<i8")
                    index = Index(np.frombuffer(c["xs"], c["kind"]).astype(float).reshape(len(ids), -1))
                anchors = c["chunk"]
                q = np.frombuffer(b"".join(a["x"] for a in anchors), np.float64).reshape(len(anchors), -1)
                low = np.array([min(w["low"] for w in a["windows"]) for a in anchors], float)
                i, j, score = index.find(q, low)
                own_id, own_label = (np.array([a[f] for a in anchors], np.int64) for f in ("vec_id", "label"))
                fit = ((labels[j] == own_label[i]) == same) & (ids[j] != own_id[i])
                i, j, score = i[fit], j[fit], score[fit]
                order = np.lexsort((ids[j], -score, i))
                i, score, found = i[order], score[order], ids[j][order]
                ends = np.searchsorted(i, np.arange(len(anchors) + 1))
                out = []
                for a, s, e in zip(anchors, ends[:-1], ends[1:], strict=True):
                    falls = -score[s:e]  # ascending
                    for w in a["windows"]:
                        start = s + np.searchsorted(falls, -w["high"], side="left") if w["high"] < TOP else s
                        stop = min(start + k, s + np.searchsorted(falls, -w["low"], side="right") if w["low"] > BOTTOM else e)
                        out += [(a["row"], w["no"], int(found[t]), int(score[t])) for t in range(start, stop)]
                columns = zip(*out, strict=True) if out else [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["row", "no", "vec_id", "score"])

    return run


def search(index: DataFrame, sizes: DataFrame, wanted: DataFrame, same: bool, k: int) -> DataFrame:
    """row, no, rank, vec_id, score: the best k of each window of wanted (row, vec_id, label, dim, x, windows)."""
    spark = wanted.sparkSession
    chunks = wanted.count() // CHUNK + 1
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("no")
    packed = wanted.groupBy("dim", chunk).agg(F.collect_list(F.struct("row", "vec_id", "label", "x", "windows")).alias("chunk"))
    spread = packed.join(sizes.select("dim", "blocks"), "dim").select("dim", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    cells = index.join(spread, ["dim", "block"]).select("dim", "block", "kind", "ids", "labels", "xs", "chunk")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CELLS))
    found = materialise(cells.mapInArrow(search_batches(same, k), "row long, no int, vec_id long, score long"), "found")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    order = Window.partitionBy("row", "no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --------------------------------------------------------------------------- thresholds


def pace_batches(shared):
    """For mapInArrow over (row, vec_id, label, dim, x): those, and mean and spread of the scores with the sample's rows of the same and other labels."""
    names = ["row", "vec_id", "label", "dim", "x", "mean_same", "spread_same", "part_same", "mean_other", "spread_other", "part_other"]

    def run(batches):
        for b in batches:
            out = []
            for label, dim, x in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                labels, rows, n = shared.value.get(dim, (np.empty(0), np.empty((0, dim)), 1))
                score = rows @ np.frombuffer(x, np.float64)
                line = []
                for mine in (labels == label, labels != label):
                    some = score[mine] if mine.sum() >= 8 else score
                    line += [float(some.mean()), float(some.std()), float(mine.sum() / n)] if len(some) else [None, None, None]
                out.append(line)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[c] for r in out], pa.float64()) for c in range(6))], names=names)

    return run


def upper(p: Column) -> Column:
    """About the z that a standard normal value exceeds with probability p (fixed values: a published rational approximation)."""
    t = F.sqrt(-2 * F.ln(p))
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)


def whole(x: Column, bottom: Column) -> Column:
    """x rounded down to a long, ``bottom`` if it is unknown or lower."""
    fits = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**62)
    return F.greatest(F.when(fits, F.floor(x)).otherwise(bottom), bottom)


def filled(index: DataFrame, sizes: DataFrame, windows: DataFrame, anchors: DataFrame, threshold, same: bool, k: int) -> DataFrame:
    """row, no, rank, vec_id, score of each window of ``windows`` (row, no, bottom, high): its best k, all if there are fewer.

    threshold(round) gives a window's threshold from its bottom, high and the anchor's figures.
    """
    pending, out, turn = windows, None, 0
    while True:
        figures = anchors.drop("vec_id", "label", "x")
        low = pending.join(figures, "row").withColumn("low", threshold(turn)).select("row", "no", "bottom", "high", "low")
        low = materialise(low, "windows")
        asked = low.groupBy("row").agg(F.collect_list(F.struct("no", "low", "high")).alias("windows"))
        best = materialise(search(index, sizes, anchors.select("row", "vec_id", "label", "dim", "x").join(asked, "row"), same, k), "best")
        out = best if out is None else out.unionByName(best)
        count = best.groupBy("row", "no").agg(F.max("rank").alias("n"))
        state = low.join(count, ["row", "no"], "left")
        pending = materialise(state.filter((F.coalesce("n", F.lit(0)) < k) & (F.col("low") > F.col("bottom"))).select("row", "no", "bottom", "high"), "pending")
        if not pending.limit(1).count():
            return out.dropDuplicates(["row", "no", "rank"])  # a later round finds an earlier one's rows again, at the same ranks
        turn += 1


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = prepare(rows.sparkSession)
    label = F.col("label").cast("long")
    data = vectors(rows.withColumn("label", F.when(F.col("vec_id") % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)))
    index, sizes = blocks(data)
    some = data.select("dim", "label", "x").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    by_dim = {}
    for d in {r["dim"] for r in some}:
        mine = [r for r in some if r["dim"] == d]
        x = np.frombuffer(b"".join(r["x"] for r in mine), np.float64).reshape(len(mine), d)
        by_dim[d] = np.array([r["label"] for r in mine]), x, len(mine)
    figures = ", ".join(f"{f}_{c} double" for c in ("same", "other") for f in ("mean", "spread", "part"))
    anchors = data.filter(F.col("vec_id") % ANCHORS == 0).select("row", "vec_id", "label", "dim", "x")
    anchors = anchors.mapInArrow(pace_batches(spark.sparkContext.broadcast(by_dim)), f"row long, vec_id long, label long, dim int, x binary, {figures}")
    anchors = materialise(anchors.join(sizes.select("dim", "n"), "dim").select("row", "vec_id", "label", "dim", "x", "n", *(f.split()[0] for f in figures.split(", "))), "anchors")

    def first(turn: int) -> Column:
        p = F.lit(float(WANT * POSITIVES * STEP**turn)) / (F.col("n") * F.col("part_same"))
        return whole(F.when((p < 0.4) & (F.col("spread_same") > 0), F.col("mean_same") + F.col("spread_same") * upper(p)), F.col("bottom"))

    def below(turn: int) -> Column:
        z = (F.col("high") - F.col("mean_other")) / F.col("spread_other")
        dense = F.col("n") * F.col("part_other") * F.exp(-z * z / 2) / (F.col("spread_other") * 2.5066)
        return whole(F.when((F.col("spread_other") > 0) & (dense > 0), F.col("high") - F.lit(float(WANT * NEGATIVES * STEP**turn)) / dense), F.col("bottom"))

    start = anchors.select("row", F.lit(0).alias("no"), F.lit(BOTTOM).alias("bottom"), F.lit(TOP).alias("high"))
    positives = materialise(filled(index, sizes, start, anchors, first, True, POSITIVES), "positives")
    tens, ones = F.expr("score div 10"), F.expr("score % 10")
    low = LEAST * tens + F.floor((LEAST * ones + 9) / 10)
    high = MOST * tens + F.floor(MOST * ones / 10)
    start = positives.filter("score >= 0").select("row", F.col("rank").alias("no"), low.alias("bottom"), high.alias("high")).filter("bottom <= high")
    negatives = filled(index, sizes, start, anchors, below, False, NEGATIVES)
    pairs = positives.select("row", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(pairs, ["row", "no"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
