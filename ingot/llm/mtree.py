"""Operator 5: exact top-k search by inner product in an M-tree.

Inner products become distances: with M the greatest norm, a vector x gets one more coordinate
sqrt(M^2 - |x|^2) and a query a 0, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the greatest product is the
nearest vector.

The tree has a root of ROOTS routing objects, each the parent of some of LEAVES routing objects; each
of these keeps its distance to its parent and its covering radius. Both are chosen from a sample of SAMPLE
vectors (the bound on all that the driver and the tasks hold of the tree), but every vector is put below its nearest leaf
object, beside its distance to it. A leaf's vectors lie in pages of PAGE, by
a hash of the id, so one vector that a third of the rows share fills many pages and no task.

Search: a query goes to the leaf of its least bound first and takes the k-th best distance there as its radius. Then it goes
to each other leaf that this radius reaches. A whole subtree is left out when |d(q, parent) - d(parent, leaf)| - radius(leaf)
says so, without computing d(q, leaf); within a page, a vector when
|d(q, leaf) - d(leaf, x)| does. The results are exact: bounds only leave out what cannot come among the k best.

Queries go to pages in blocks, and a page returns k rows for each query at most.

Edge cases: a vector that is null or holds a null or a value that is not finite takes no part, nor does a row without id;
vectors of other lengths than the query's are no candidates; scores beyond 64 bits are held at their ends; rows that are equal in id and vector count once,
and no row with the query's own id is a candidate; fewer candidates than k give fewer rows; an
empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingot.llm.common import materialise, prepare, ships

ships(__name__)

K = 5  # fixed by the contract
EVERY = 50  # fixed by the contract: ids divisible by it are queries
SCALE = 256  # fixed by the contract

SAMPLE = 4096
ROOTS = 16
LEAVES = 256
PAGE = 2048  # vectors of a page, about
BLOCK = 1024  # queries of a block, about
SLACK = 1e-6  # of M: more than rounding can move a bound
TOP = 2**63 - 1  # scores beyond 64 bits are held at their ends


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id, v (components as floor(SCALE * x)), dim, norm (v.v): the rows that take part, each once."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    out = out.filter(F.col("vec_id").isNotNull() & fine).select("vec_id", v.alias("v")).dropDuplicates(["vec_id", "v"])
    return out.withColumns({
        "dim": F.size("v"), "norm": F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")),
    })


class Tree:
    """The routing objects of one vector length: small, so it goes to every task."""

    def __init__(self, sample: np.ndarray, top: int, leaves: int = LEAVES):
        self.top = float(top)  # M squared
        self.slack = SLACK * (1 + sqrt(top))
        picked = self._spread(sample, leaves)
        self.leaf = sample[picked].astype(float)
        roots = self._spread(sample[picked], ROOTS)
        self.root = self.leaf[roots]
        apart = self._between(self.leaf, self.root)
        self.parent = apart.argmin(axis=1)
        self.to_parent = apart[np.arange(len(self.leaf)), self.parent]
        self.radius = np.zeros(len(self.leaf))  # set when all vectors are in

    @classmethod
    def of(cls, state: dict) -> Tree:
        """A tree from ``vars()`` of one: plain arrays travel to tasks that don't have the library."""
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    def _extra(self, x):
        return np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))

    def _between(self, x, y):
        """Distances of vectors to routing objects, in the space with the further coordinate."""
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
        return np.sqrt(np.maximum(0.0, square + (self._extra(x)[:, None] - self._extra(y)[None]) ** 2))

    def _spread(self, x, most):
        """Greedy far-apart points, from the first: each is the one farthest from those before it."""
        x = np.asarray(x, float)
        picked, near = [0], self._between(x, x[:1])[:, 0]
        while len(picked) < min(most, len(x)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, self._between(x, x[picked[-1:]])[:, 0])
        return picked

    def place(self, x):
        """Per vector its leaf and its distance to it."""
        apart = self._between(x, self.leaf)
        leaf = apart.argmin(axis=1)
        return leaf, apart[np.arange(len(x)), leaf]

    def query_to(self, q, objects):
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + self.top - 2 * (q @ objects.T)))

    def reached(self, q, radius):
        """For one query the leaves its radius reaches, with their distances; whole subtrees fall by the parent's distance."""
        q = q[None]
        far = np.abs(self.query_to(q, self.root)[0][self.parent] - self.to_parent) - self.radius
        left = np.flatnonzero((far <= radius + self.slack) & (self.radius >= 0))
        d = self.query_to(q, self.leaf[left])[0]
        near = d - self.radius[left] <= radius + self.slack
        return left[near], d[near]


def _matrix(column) -> np.ndarray:
    return np.array([x.as_py() for x in column], dtype=np.int64).reshape(len(column), -1).astype(float)


def _by_dim(b, column: int):
    dims = np.asarray(b.column(column))
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def place_batches(trees):
    """For mapInArrow over (vec_id, v, dim): vec_id, v, dim, leaf, apart."""

    def run(batches):
        for b in batches:
            for dim, at in _by_dim(b, 2):
                part = b.take(pa.array(at))
                leaf, apart = Tree.of(trees.value[dim]).place(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(leaf.astype(np.int32)), pa.array(apart)], names=["vec_id", "v", "dim", "leaf", "apart"]
                )

    return run


def route_batches(trees, first: bool):
    """For mapInArrow over (query_id, q, dim, radius, seen): those, with leaf and away, for the leaves to visit.

    first: only the leaf with the least bound; or else all that the radius reaches but the one seen.
    """

    def run(batches):
        for b in batches:
            rows, leaves, away = [], [], []
            radius = b.column(3).to_pylist()
            seen = b.column(4).to_pylist()
            for dim, at in _by_dim(b, 2):
                tree = Tree.of(trees.value[dim])
                q = _matrix(b.column(1).take(pa.array(at)))
                for i, x in zip(at, q, strict=True):
                    got, d = tree.reached(x, float("inf") if first or radius[i] is None else radius[i])
                    if first:
                        best = int((d - tree.radius[got]).argmin())
                        got, d = got[best : best + 1], d[best : best + 1]
                    else:
                        d, got = d[got != seen[i]], got[got != seen[i]]
                    rows += [i] * len(got)
                    leaves += got.tolist()
                    away += d.tolist()
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(leaves, pa.int32()), pa.array(away, pa.float64())],
                names=["query_id", "q", "dim", "radius", "seen", "leaf", "away"],
            )

    return run


def search_page(k: int, slack: dict[int, float]):
    """For cogroup.applyInArrow of a page's vectors and a block of queries: query_id, leaf, vec_id, score; k at most for each query."""

    schema = pa.schema([("query_id", pa.int64()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(page: pa.Table, queries: pa.Table) -> pa.Table:
        if not page.num_rows or not queries.num_rows:
            return schema.empty_table()
        page = page.sort_by("apart")
        apart = np.asarray(page.column("apart"))
        ids = np.asarray(page.column("vec_id"))
        x = _matrix(page.column("v"))
        q = _matrix(queries.column("q"))
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53
        if not exact:  # beyond what doubles hold: whole numbers of any size
            x = np.array([r.as_py() for r in page.column("v")], dtype=object)
            q = np.array([r.as_py() for r in queries.column("q")], dtype=object)
        more = slack[queries.column("dim")[0].as_py()]
        out = []
        for i, (own, leaf, radius, away) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("query_id", "leaf", "radius", "away")), strict=True)):
            reach = float("inf") if radius is None else radius + more
            low, high = np.searchsorted(apart, [away - reach, away + reach], side="left")
            high = np.searchsorted(apart, away + reach, side="right")
            score = x[low:high] @ q[i]
            mine = ids[low:high]
            score, mine = score[mine != own], mine[mine != own]
            best = np.lexsort((mine, -score))[:k] if exact else sorted(range(len(mine)), key=lambda j: (-score[j], mine[j]))[:k]
            out += [(own, leaf, int(mine[j]), min(TOP, max(-TOP - 1, int(score[j])))) for j in best]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def top_k(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest products of each query, ties to the smaller vec_id."""
    spark = prepare(rows.sparkSession)
    data = materialise(scaled(rows), "vectors")
    lengths = data.groupBy("dim").agg(F.max("norm").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    tops = {r["dim"]: r["top"] for r in lengths}
    wanted = {r["dim"]: min(LEAVES, 1 + r["n"] // (PAGE // 8)) for r in lengths}
    sample = data.select("vec_id", "v", "dim").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    trees = {}
    for dim, top in tops.items():
        some = [r["v"] for r in sample if r["dim"] == dim] or [data.filter(F.col("dim") == dim).first()["v"]]
        trees[dim] = Tree(np.array(some, dtype=np.int64).reshape(len(some), dim).astype(float), top, wanted[dim])
    if not trees:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast({dim: vars(t) for dim, t in trees.items()})
    placed = data.select("vec_id", "v", "dim").mapInArrow(
        place_batches(shared), "vec_id long, v array<long>, dim int, leaf int, apart double"
    )
    placed = materialise(placed, "tree")
    leaves = placed.groupBy("dim", "leaf").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n"))
    leaves = leaves.collect()  # LEAVES for each length, at most
    for t in trees.values():
        t.radius[:] = -1.0  # a leaf without vectors
    for r in leaves:
        trees[r["dim"]].radius[r["leaf"]] = r["radius"]
    shared = spark.sparkContext.broadcast({dim: vars(t) for dim, t in trees.items()})
    sizes = spark.createDataFrame([(r["dim"], r["leaf"], -(-r["n"] // PAGE)) for r in leaves], "dim int, leaf int, pages long")
    pages = placed.join(F.broadcast(sizes), ["dim", "leaf"])
    pages = pages.withColumn("page", F.pmod(F.xxhash64("vec_id"), F.col("pages"))).drop("pages")

    queries = data.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", "norm")
    blocks = -(-queries.count() // BLOCK) or 1
    slack = {dim: t.slack for dim, t in trees.items()}

    def visit(routes: DataFrame) -> DataFrame:
        """The k best of each page that a query is routed to."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
        asked = routes.join(F.broadcast(sizes), ["dim", "leaf"]).select(
            "query_id", "q", "dim", "leaf", "radius", "away", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("page")
        )
        asked = materialise(asked)
        need = asked.select("dim", "leaf", "block").distinct().toDF("_d", "_l", "_b")  # blocks of a leaf, not queries
        held = pages.join(need, (F.col("dim") == F.col("_d")) & (F.col("leaf") == F.col("_l")))
        held = held.select("vec_id", "v", "apart", "dim", "leaf", "page", F.col("_b").alias("block"))
        key = ["dim", "leaf", "page", "block"]
        return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
            search_page(k, slack), "query_id long, leaf int, vec_id long, score long"
        )

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    route = "query_id long, q array<long>, dim int, radius double, seen int, leaf int, away double"
    start = queries.select("query_id", "q", "dim", F.lit(None).cast("double").alias("radius"), F.lit(None).cast("int").alias("seen"))
    opened = materialise(visit(start.mapInArrow(route_batches(shared, True), route)))
    # the k-th best so far is the radius of what else can matter
    kth = best(opened).groupBy("query_id").agg(
        F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"), F.first("leaf").alias("seen")
    )
    tops_at = spark.createDataFrame([(d, float(t)) for d, t in tops.items()], "dim int, top double")
    square = F.col("norm") + F.col("top") - 2.0 * F.col("least")
    radius = F.when(F.col("least").isNotNull(), F.sqrt(F.when(square > 0, square).otherwise(0.0)))
    rest = queries.join(kth, "query_id", "left").join(F.broadcast(tops_at), "dim").select("query_id", "q", "dim", radius.alias("radius"), "seen")
    more = visit(rest.mapInArrow(route_batches(shared, False), route))
    out = best(opened.union(more))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
