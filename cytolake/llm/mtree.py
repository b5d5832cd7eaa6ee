"""Exact top-k search by inner product with an M-tree.

Inner products become distances: with one more component, sqrt(M^2 - |x|^2) for vectors (M the largest norm) and 0 for
queries, |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vector has the largest inner product, and the Euclidean metric
of that space carries the tree.

The root page holds routing vectors, a sample of fixed size. Each vector belongs to its nearest one; the ball around a
routing vector, cut into parts of bounded size, is a task's subtree of paged nodes. A node keeps its routing vector, its
covering radius and its distance to the parent's routing vector; a leaf keeps its entries by their distance to its
routing vector. By the triangle inequality on these stored distances, a query leaves out nodes and entries without
computing their distances.

A query first goes to the ball of its nearest routing vector, where it descends to one leaf and from there visits nodes
by rising lower bound. Its k-th score then decides which other balls it is sent to at all. Queries that visit the same
node are computed together, but each has bounds of its own.

Scores are integers and are compared exactly; the distances only steer, with slack for rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._common import stored
from cytolake.llm._vectors import best_of, matrix, rows_for, valid

#: Entries of a leaf, and children of an inner node.
PAGE, FANOUT = 128, 16
#: Routing vectors of the root page, at most.
ROUTES = 256
#: Vectors of a subtree, and queries that a task answers.
SHARD_ROWS, BLOCK_ROWS = 32768, 16384
#: float64 holds every integer up to this: vectors whose squared norms stay within it have exact inner products.
EXACT = 2.0**53
_NONE = -np.iinfo(np.int64).max
_LIMIT = 2**63 - 1


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x with one more component, so that all norms are most."""
    return np.c_[x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0.0))]


def distances(a: np.ndarray, square: np.ndarray | float, b: np.ndarray, most: float) -> np.ndarray:
    """From each row of a (square: its squared norm) to each of b (squared norm most)."""
    return np.sqrt(np.maximum(np.asarray(square)[..., None] + most - 2 * a @ b.T, 0.0))


class MTree:
    """An M-tree over integer vectors (as float64, rows in order of id). computed counts the pairs of vectors whose
    distance or product was computed in searches."""

    def __init__(self, x: np.ndarray, page: int = PAGE, fanout: int = FANOUT, seed: int = 5):
        self.x, self.page, self.fanout, self.computed = x, page, fanout, 0
        self.scale = max(float(np.abs(x).max(initial=0.0)), 1.0)
        small = x / self.scale
        self.most = float(np.einsum("ij,ij->i", small, small).max(initial=0.0))
        self.z = lifted(small, self.most)
        self.exact = self.most * self.scale**2 <= 0.999 * EXACT
        self.rng = np.random.default_rng(seed)
        # of each node: its routing row, covering radius, distance to the parent's routing vector, children or entries
        self.route: list[int] = []
        self.radius: list[float] = []
        self.parent: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.entries: list[tuple[np.ndarray, np.ndarray] | None] = []
        if len(x):
            self._grow(np.arange(len(x)), 0, 0.0)
        self.route, self.radius, self.parent = np.array(self.route, np.int64), np.array(self.radius), np.array(self.parent)
        self.routes = self.z[self.route]

    def _to(self, rows: np.ndarray, routes: np.ndarray) -> np.ndarray:
        return distances(self.z[rows], self.most, self.z[routes], self.most)

    def _grow(self, rows: np.ndarray, route: int, parent: float) -> int:
        own = self._to(rows, np.array([route]))[:, 0]
        node = len(self.route)
        self.route.append(route)
        self.radius.append(float(own.max()))
        self.parent.append(parent)
        self.children.append(None)
        self.entries.append(None)
        if len(rows) <= self.page:
            order = np.argsort(own, kind="stable")
            self.entries[node] = (rows[order], own[order])
            return node
        parts = self._split(rows, route)
        self.children[node] = np.array([self._grow(part, r, float(self._to(np.array([r]), np.array([route]))[0, 0])) for r, part in parts])
        return node

    def _split(self, rows: np.ndarray, route: int) -> list[tuple[int, np.ndarray]]:
        """Routing rows far from each other, each with the rows that are nearest to it."""
        wanted = min(self.fanout, -(-len(rows) // self.page))
        some = rows if len(rows) <= 1024 else self.rng.choice(rows, 1024, replace=False)
        seeds = [int(some[self.rng.integers(len(some))])]
        near = self._to(some, np.array(seeds))[:, 0]
        while len(seeds) < wanted and near.max() > 0:
            seeds.append(int(self.rng.choice(some, p=near**2 / (near**2).sum())))
            near = np.minimum(near, self._to(some, np.array(seeds[-1:]))[:, 0])
        own = np.concatenate([self._to(rows[lo : lo + 8192], np.array(seeds)).argmin(axis=1) for lo in range(0, len(rows), 8192)])
        parts = [(s, rows[own == k]) for k, s in enumerate(seeds) if (own == k).any()]
        if len(parts) == 1:  # all alike
            cuts = np.array_split(rows, wanted)
            parts = [(int(c[0]), c) for c in cuts]
        return parts

    def top(self, q: np.ndarray, skip: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k largest inner products, ties to the smaller row; rows skip[i, 0] to
        skip[i, 1] - 1 are left out. least: scores below this are not wanted."""
        nq = len(q)
        best, place = np.full((nq, k), _NONE, np.int64), np.full((nq, k), -1, np.int64)
        if not len(self.x) or not nq:
            return (np.zeros(0, np.int64),) * 3
        a = q / self.scale
        square = np.einsum("ij,ij->i", a, a)
        exact = self.exact and float(square.max()) * self.scale**2 <= 0.999 * EXACT
        slack = 1e-6 * (1.0 + np.sqrt(square + self.most))
        floor = np.full(nq, _NONE, np.int64) if least is None else least.astype(np.int64)
        z = np.c_[a, np.zeros(nq)]
        reach = np.full(nq, np.inf)
        known = np.full((nq, len(self.route)), np.nan)  # distances to routing vectors
        visited = np.zeros(nq, np.int64)

        def to_routes(g: np.ndarray, node: int) -> np.ndarray:
            new = g[np.isnan(known[g, node])]
            if len(new):
                known[new, node] = distances(z[new], square[new], self.routes[node : node + 1], self.most)[:, 0]
                self.computed += len(new)
            return known[g, node]

        def shorten(g: np.ndarray) -> None:
            kth = np.maximum(best[g].min(axis=1), floor[g])
            far = (kth <= _NONE + 1) | (not exact) & (kth <= -_LIMIT)
            reach[g] = np.where(far, np.inf, np.sqrt(np.maximum(square[g] + self.most - 2.0 * kth.astype(np.float64) / self.scale**2, 0.0)))

        def scan(leaf: int, g: np.ndarray) -> None:
            rows, parent = self.entries[leaf]
            d = to_routes(g, leaf)
            near = np.abs(d[:, None] - parent[None, :]) <= (reach[g] + slack[g])[:, None]
            near &= ~((rows >= skip[g, 0, None]) & (rows < skip[g, 1, None]))
            wide = np.flatnonzero(near.any(axis=1))
            if not len(wide):
                return
            column = np.flatnonzero(near.any(axis=0))
            g, near = g[wide], near[np.ix_(wide, column)]
            rows = rows[column]
            if exact and near.mean() > 0.25:  # one product for all
                self.computed += near.size
                scores = np.where(near, np.rint(q[g] @ self.x[rows].T).astype(np.int64), _NONE)
            else:
                i, j = np.nonzero(near)
                self.computed += len(i)
                scores = np.full(near.shape, _NONE, np.int64)
                scores[i, j] = products(q[g[i]], self.x[rows[j]], exact)
            kth = np.maximum(best[g].min(axis=1), floor[g])
            some = np.flatnonzero(((scores >= kth[:, None]) & (scores > _NONE)).any(axis=1))
            if not len(some):
                return
            h = g[some]
            both = np.concatenate([best[h], scores[some]], axis=1)
            where = np.concatenate([place[h], np.broadcast_to(rows, (len(h), len(rows)))], axis=1)
            first = np.lexsort((where, -both), axis=1)[:, :k]
            best[h], place[h] = np.take_along_axis(both, first, 1), np.take_along_axis(where, first, 1)
            shorten(h)

        def descend(node: int, g: np.ndarray) -> None:
            to_routes(g, node)
            if self.children[node] is None:
                scan(node, g)
                visited[g] = node
                return
            kids = self.children[node]
            near = np.stack([to_routes(g, c) for c in kids], axis=1).argmin(axis=1)
            for j in np.unique(near):
                descend(int(kids[j]), g[near == j])

        everyone = np.arange(nq)
        shorten(everyone)
        descend(0, everyone)
        heap, turn = [(0.0, 0, 0, everyone, np.maximum(known[:, 0] - self.radius[0], 0.0))], 0
        while heap:
            _, _, node, g, bound = heapq.heappop(heap)
            alive = bound <= reach[g] + slack[g]
            g, bound = g[alive], bound[alive]
            if not len(g):
                continue
            if self.children[node] is None:
                if len(g := g[visited[g] != node]):
                    scan(node, g)
                continue
            here = known[g, node]
            for c in self.children[node].tolist():
                least_far = np.maximum(bound, np.abs(here - self.parent[c]) - self.radius[c])
                pick = least_far <= reach[g] + slack[g]
                if not pick.any():
                    continue
                h = g[pick]
                least_far = np.maximum(least_far[pick], to_routes(h, c) - self.radius[c])
                pick = least_far <= reach[h] + slack[h]
                if pick.any():
                    turn += 1
                    heapq.heappush(heap, (float(least_far[pick].min()), turn, c, h[pick], least_far[pick]))
        query, column = np.nonzero((best != _NONE) & (best >= floor[:, None]))
        return query, place[query, column], best[query, column]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """The inner product of each pair of rows; beyond what doubles hold exactly, by Python integers, stopping at the
    limits of long."""
    if exact:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    out = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([max(1 - _LIMIT, min(_LIMIT, s)) for s in out], np.int64)


def _find(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids ascend. (place of the query, id, score)."""
    skip = np.c_[np.searchsorted(ids, qids), np.searchsorted(ids, qids, "right")]
    query, rows, scores = MTree(x).top(q, skip, k, least)
    return query, ids[rows], scores


class Root:
    """The root page: routing vectors in the space of all vectors, and each one's covering stretch of distances."""

    def __init__(self, routes: np.ndarray, scale: float, most: float):
        self.scale, self.most = scale, most
        self.routes = lifted(routes / scale, most)
        self.inner, self.outer, self.parts = np.zeros(len(routes)), np.full(len(routes), np.inf), np.ones(len(routes), np.int64)

    def fitted(self, x: np.ndarray) -> np.ndarray:
        width = self.routes.shape[1] - 1
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))) / self.scale

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The routing vector of each vector, and the distance to it."""
        z = lifted(self.fitted(x), self.most)
        d = distances(z, self.most, self.routes, self.most)
        return d.argmin(axis=1), d.min(axis=1, initial=np.inf)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query and ball: the distance to the routing vector, and the least to a vector of the ball; the
        queries' squared norms."""
        a = self.fitted(q)
        square = np.einsum("ij,ij->i", a, a)
        d = distances(np.c_[a, np.zeros(len(a))], square, self.routes, self.most)
        return d, np.maximum(np.maximum(d - self.outer, self.inner - d), 0.0), square


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k rows with the largest inner
    product of floor(scale * component), ties to the smaller id.

    Vectors that are null, or hold null or non-finite components, and rows without id take no part. Rows with a query's
    id are its own and no candidates; other repeated rows count each. Vectors of different lengths are filled up with
    zeros. Fewer than k candidates: all of them. Scores beyond 64 bits stop at their limits, and tie there. An empty
    table gives an empty result; other columns are ignored."""
    rows = valid(embeddings, id_column, vector).withColumn("v", F.transform("v", lambda x: _floor(x, scale)))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    largest = max(float(size["largest"] or 0.0), 1.0)
    shard_rows = rows_for(SHARD_ROWS, size["width"])
    n_routes = min(ROUTES, -(-size["n"] // shard_rows)) if size["width"] else 1
    blocks = max(1, -(-size["asked"] // BLOCK_ROWS))
    asked = rows.filter(F.col("id") % every == 0)
    if n_routes <= 1:
        data = rows.withColumn("ball", F.lit(0)).withColumn("part", F.lit(0))
        found = _answered(data, asked.select("id", "v", F.lit(0).alias("ball"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("least")), k, blocks)
        return best_of(found, k, True)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.lit(largest)) * (x / F.lit(largest)))
    most = float(rows.agg(F.max(norm)).first()[0])
    chosen = rows.orderBy(F.xxhash64("v", "id"), "id").limit(n_routes).collect()  # at most ROUTES vectors
    routes = np.zeros((len(chosen), size["width"]))
    for row, r in zip(routes, chosen, strict=True):
        row[: len(r["v"])] = r["v"]
    root = Root(routes, largest, most * (1 + 1e-12))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ball, d = root.nearest(matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(ball, pa.int32()), pa.array(d, pa.float64())], names=["id", "v", "ball", "d"])

    assigned = stored(rows.mapInArrow(assign, "id long, v array<double>, ball int, d double"), "mtree-balls")
    for r in assigned.groupBy("ball").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.count("*").alias("n")).collect():  # at most ROUTES rows
        root.inner[r["ball"]], root.outer[r["ball"]], root.parts[r["ball"]] = r["inner"], r["outer"], -(-r["n"] // shard_rows)
    parts = F.element_at(F.array(*[F.lit(int(p)) for p in root.parts]), F.col("ball") + 1)
    data = assigned.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts).cast("int")).select("id", "v", "ball", "part")

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d, bound, square = root.bounds(matrix(b.column("v")))
                home = d.argmin(axis=1)
                kth = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                if first:
                    query, ball = np.arange(len(home)), home
                else:
                    far = np.sqrt(np.maximum(square + root.most - 2.0 * kth / root.scale**2, 0.0))
                    far = np.where(np.isnan(kth) | (np.abs(kth) >= 2.0**62), np.inf, far) + 1e-6 * (1.0 + np.sqrt(square + root.most))
                    query, ball = np.nonzero((bound <= far[:, None]) & (np.arange(bound.shape[1]) != home[:, None]))
                n = root.parts[ball]
                query, ball, part = np.repeat(query, n), np.repeat(ball, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(query)), b.column("v").take(pa.array(query)), pa.array(ball, pa.int32()), pa.array(part, pa.int32()), b.column("least").take(pa.array(query))], names=["id", "v", "ball", "part", "least"])

        return run

    ddl = "id long, v array<double>, ball int, part int, least long"
    near = stored(best_of(_answered(data, asked.withColumn("least", F.lit(None).cast("long")).mapInArrow(routed(True), ddl), k, blocks), k, True), "mtree-near")
    full = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    a, f = asked.alias("a"), full.alias("f")
    again = a.join(f, F.col("a.id") == F.col("f.query_id"), "left").select("a.id", "a.v", "f.least")
    other = _answered(data, again.mapInArrow(routed(False), ddl), k, blocks)
    return best_of(near.select("query_id", "vec_id", "score").unionByName(other), k, True)


def _answered(data: DataFrame, asked: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each part of a ball for each query that is sent there."""
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            ids, qids = left.column("id").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, q = matrix(left.column("v"))[order], matrix(right.column("v"))
            width = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
            least = right.column("least").fill_null(_NONE).to_numpy()
            place, vec, best = _find(ids[order], x, qids, q, k, least)
            found = (qids[place], vec, best)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    key = ["ball", "part", "block"]
    return data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(answer, "query_id long, vec_id long, score long")


def _floor(x, scale: float):
    """floor as a double: F.floor() gives a long, which large values overflow."""
    y = F.lit(scale) * x
    return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y).otherwise(0.0)).cast("double")).otherwise(y)
