"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Every vector is projected on a few Gaussian directions; the squared projected distance of two vectors
is their squared distance times a chi-square variable. A kd-tree over the projections, fitted on a
bounded sample, deals all vectors into leaves, and leaves into blocks. A query first searches one block
of its own leaf, then all leaves near enough. Inside a block it verifies vectors in the order of their
projected distance until the chi-square test says that a nearer one is improbable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.tables import sized
from spanloom.session import staged

#: Directions, and the probability with which a true neighbour passes the stopping test.
DIRECTIONS, CERTAINTY = 8, 0.99
#: Vectors the tree is fitted on (about), vectors of a block (about), and leaves at most.
SAMPLE, BLOCK, LEAVES = 20_000, 4096, 1024
#: Queries of a block in one group (about), and vectors verified between two tests.
GROUP, STEP = 2000, 32


def chi_square_limit(directions: int, certainty: float) -> float:
    """The value that a chi-square variable with an even number of degrees exceeds with 1 - certainty."""
    half, lo, hi = directions // 2, 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(half))
        lo, hi = (mid, hi) if tail > 1 - certainty else (lo, mid)
    return hi


def directions_for(dims: int, count: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, count))


class Tree:
    """Median splits in heap order: node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(leaves, 1))))
        size = (1 << self.depth) - 1
        self.dim, self.value = np.zeros(size, dtype=np.int64), np.zeros(size)
        parts = {0: points}
        for i in range(size):
            own = parts.pop(i)
            if len(own):
                d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.dim[i], self.value[i] = d, np.median(own[:, d])
            left = own[:, self.dim[i]] <= self.value[i]
            parts[2 * i + 1], parts[2 * i + 2] = own[left], own[~left]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dim[at]] > self.value[at]
            at = 2 * at + 1 + right
        return at - ((1 << self.depth) - 1)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``, as doubles, of the vectors that take part.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do
    rows without id and vectors of another length than the most frequent one. Of rows that share an
    id the smallest vector stays.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1)


def _indexed(rows: DataFrame, projection: np.ndarray, tree: Tree) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column("v")) @ projection
                step = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(tree.leaf(p).astype(np.int32)), pa.ListArray.from_arrays(step, p.reshape(-1))],
                    ["id", "v", "leaf", "p"],
                )

    return rows.mapInArrow(run, f"id {kind}, v array<double>, leaf int, p array<double>")


def search_block(
    q_ids: np.ndarray, q: np.ndarray, qp: np.ndarray, bound: np.ndarray, ids: np.ndarray, v: np.ndarray, p: np.ndarray, k: int, limit: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of vectors, and distances, of each query's ``k`` nearest in a block.

    ``bound`` is a distance within which a query already has ``k`` neighbours. Vectors are verified in
    the order of their projected distance; the search of a query stops when the next squared projected
    distance is above ``limit`` times its squared ``k``-th distance.
    """
    out = []
    for i in range(len(q)):
        near = ((p - qp[i]) ** 2).sum(axis=1)
        reach = limit * bound[i] ** 2
        order = np.flatnonzero((near <= reach) & (ids != q_ids[i]))
        order = order[np.argsort(near[order], kind="stable")]
        best, dist, at = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        while at < len(order):
            if len(best) == k and near[order[at]] > limit * dist[-1] ** 2:
                break
            part = order[at : at + STEP]
            at += STEP
            best = np.append(best, part)
            dist = np.append(dist, np.sqrt(((v[part] - q[i]) ** 2).sum(axis=1)))
            first = np.lexsort((ids[best], dist))[:k]
            best, dist = best[first], dist[first]
        out.append((np.full(len(best), i), best, dist))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(points: DataFrame, visits: DataFrame, k: int, limit: float) -> DataFrame:
    """Each query's nearest in every block that it visits; ``visits`` is written."""
    kind = points.schema["id"].dataType.simpleString()
    groups = visits.groupBy("leaf", "block").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("groups"))
    groups = staged(groups, "visited-blocks")
    own = points.join(sized(groups), ["leaf", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = visits.join(sized(groups), ["leaf", "block"]).withColumn("part", F.pmod(F.xxhash64("q"), "groups").cast("int"))
    keys = ["leaf", "block", "part"]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if one.num_rows and two.num_rows:
            ids = np.asarray(one.column("id"))
            at, best, dist = search_block(
                np.asarray(two.column("q")), _matrix(two.column("v").combine_chunks()), _matrix(two.column("p").combine_chunks()),
                np.asarray(two.column("bound")), ids, _matrix(one.column("v").combine_chunks()), _matrix(one.column("p").combine_chunks()), k, limit,
            )
            return pa.table({"q": two.column("q").take(pa.array(at)), "id": one.column("id").take(pa.array(best)), "score": dist})
        return pa.table({"q": two.column("q").slice(0, 0), "id": one.column("id").slice(0, 0), "score": np.zeros(0)})

    found = own.select(*keys, "id", "v", "p").groupBy(*keys).cogroup(asked.select(*keys, "q", "v", "p", "bound").groupBy(*keys))
    return found.applyInArrow(run, f"q {kind}, id {kind}, score double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    certainty: float = CERTAINTY,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    directions: int = DIRECTIONS,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest vectors found for each id in ``queries``.

    ``queries`` has the ids, whole numbers, of the rows of ``vectors`` to search for; candidates are
    all rows but the query's own (see :func:`valid_vectors` for those that take part). ``score`` is
    the Euclidean distance in double precision; ties go to the smaller id. If there are at most ``k``
    candidates all are returned. A true neighbour is missed with a probability of about ``1 -
    certainty``; rows returned carry exact distances.
    """
    if directions % 2:
        raise ValueError("the number of directions must be even")
    rows = staged(valid_vectors(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dims)
    projection = directions_for(dims, directions)
    share = max(1, total // SAMPLE)
    sample = np.array([r.v for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").collect()], dtype=np.float64)
    tree = Tree((sample.reshape(-1, dims)) @ projection, min(LEAVES, max(1, total // BLOCK)))
    points = staged(_indexed(rows, projection, tree), "projected-vectors")
    bounds = points.groupBy("leaf").agg(
        F.count("*").alias("rows"),
        F.array(*[F.min(F.col("p")[i]) for i in range(directions)]).alias("low"),
        F.array(*[F.max(F.col("p")[i]) for i in range(directions)]).alias("high"),
    )
    bounds = staged(bounds.select("leaf", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), "low", "high"), "leaves")
    boxes = F.broadcast(bounds)  # at most LEAVES rows
    points = points.join(boxes.select("leaf", "blocks"), "leaf").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    points = staged(points, "blocks")
    asked = points.join(staged(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "queries"), "id", "left_semi")
    asked = staged(asked.withColumnRenamed("id", "q"), "query-vectors")

    limit = chi_square_limit(directions, certainty)
    first = _search(points, asked.withColumn("bound", F.lit(float("inf"))), k, limit)
    reached = first.groupBy("q").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    asked = staged(asked.drop("leaf", "block").join(reached, "q", "left").fillna(float("inf"), ["bound"]), "bounded-queries")

    # A leaf is visited if its box comes as near, in the projection, as the test would go on.
    leaves = bounds.select("leaf", "blocks", "low", "high").collect()
    low, high = (np.array([r[c] for r in leaves], dtype=np.float64).reshape(-1, directions) for c in ("low", "high"))
    names, counts = (np.array([r[c] for r in leaves], dtype=np.int64) for c in ("leaf", "blocks"))
    kind = points.schema["id"].dataType.simpleString()

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, bound = _matrix(batch.column("p")), np.asarray(batch.column("bound"))
            at, leaf = [], []
            for i in range(len(p)):
                gap = np.maximum(low - p[i], 0) + np.maximum(p[i] - high, 0)
                near = np.flatnonzero((gap**2).sum(axis=1) <= limit * bound[i] ** 2)
                at.append(np.full(len(near), i))
                leaf.append(near)
            at, leaf = np.concatenate(at), np.concatenate(leaf)
            block = np.concatenate([np.arange(counts[x]) for x in leaf]) if len(leaf) else np.zeros(0)
            at, leaf = np.repeat(at, counts[leaf]), np.repeat(leaf, counts[leaf])
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("q", "v", "p", "bound")), pa.array(names[leaf].astype(np.int32)), pa.array(block.astype(np.int32))],
                ["q", "v", "p", "bound", "leaf", "block"],
            )

    visits = asked.select("q", "v", "p", "bound").mapInArrow(
        visit, f"q {kind}, v array<double>, p array<double>, bound double, leaf int, block int"
    )
    found = _search(points, staged(visits, "visits"), k, limit)
    order = Window.partitionBy("q").orderBy("score", "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias("query_id"), "rank", "id", "score")


def nearest_report(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The nearest neighbours of the stated query set: every row whose id is divisible by ``every``."""
    queries = embeddings.where(F.col("vec_id") % every == 0).select("vec_id")
    return nearest(embeddings, queries, k).withColumnRenamed("id", "vec_id")
