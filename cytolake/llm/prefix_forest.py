"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives a vector a long string of bits and keeps the strings as a sorted array: a prefix is a stretch of it.
The bits are sides of random hyperplanes through the shard's mean; a tree reads its own choice of them, in its own
order. A query descends every tree to its longest matching prefix, then all trees ascend together, one bit at a time,
until the stretches hold enough vectors. The distinct ones among them are the candidates, and only their distances are
computed. How far to ascend depends on the data: dense places stop at long prefixes, sparse ones at short ones.

The stop is a number of rows that grows with the root of the shard's rows (of which there are SHARD_ROWS at most,
whatever the size of the table), counted with repeats over the trees. Copies of the query, alike in all bits,
do not count, as they would use it up in every tree; and a query whose candidates are fewer than k distinct rows, its
own apart, ascends on until they are k or all. On vectors without structure (isotropic,
64 dimensions) near and far differ little, and a recall of 0.9 needs many candidates: see the README for figures.

Shards are not split by prefix: a forest over the whole table would send each vector once for each of the 256 trees,
where a shard needs it once for each block of queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._vectors import search, valid

#: Hyperplanes in all, trees, and bits of a string.
POOL, TREES, BITS = 512, 256, 48
#: Ascend until the trees' stretches together hold ENOUGH * sqrt(rows of the shard) rows, and at least LEAST.
ENOUGH, LEAST = 48.0, 512
SHARD_ROWS = 32768


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.x, self.bits = x, bits
        # a mean in doubles overflows for the largest floats: scale first
        self.scale = max(1.0, float(np.abs(x).max(initial=0.0)))
        self.mean = (x / self.scale).mean(axis=0) if len(x) else np.zeros(x.shape[1])
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((x.shape[1], POOL))
        # what each hyperplane adds to a tree's string: a power of two, or nothing
        self.weights = np.zeros((POOL, trees))
        for t in range(trees):
            self.weights[rng.permutation(POOL)[:bits], t] = 2.0 ** np.arange(bits)
        codes = self.codes(x)
        orders = [np.argsort(c, kind="stable").astype(np.int32) for c in codes]
        self.trees = [(c[order], order) for c, order in zip(codes, orders, strict=True)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of strings for each tree."""
        out = np.empty((self.weights.shape[1], len(x)), np.int64)
        for lo in range(0, len(x), 4096):
            side = ((x[lo : lo + 4096] / self.scale - self.mean) @ self.planes > 0).astype(np.float64)
            out[:, lo : lo + 4096] = (side @ self.weights).T  # below 2**BITS: exact
        return out

    def stretches(self, codes: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree, each query's stretch of strings that share its first level bits."""
        drop = (self.bits - level).astype(np.int64)
        return [(np.searchsorted(s, c >> drop << drop), np.searchsorted(s, (c >> drop) + 1 << drop)) for c, (s, _) in zip(codes, self.trees, strict=True)]

    def flags(self, codes: np.ndarray, level: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The vectors in any of a query's stretches: at its level in the first ``more`` trees, a bit below in others."""
        out = np.zeros((len(level), len(self.x)), bool)
        below = self.stretches(codes, np.minimum(level + 1, self.bits))
        for t, ((a, b), (c, d), (_, order)) in enumerate(zip(self.stretches(codes, level), below, self.trees, strict=True)):
            up = t < more
            for i, (lo, hi) in enumerate(zip(np.where(up, a, c).tolist(), np.where(up, b, d).tolist(), strict=True)):
                out[i, order[lo:hi]] = True
        return out

    def candidates(self, q: np.ndarray, enough: int, own: np.ndarray, k: int) -> np.ndarray:
        """A row of flags over the vectors for each query; own flags the rows that are the query's and no candidates."""
        codes = self.codes(q)
        alike = sum(b - a for a, b in self.stretches(codes, np.full(len(q), self.bits, np.int64)))
        enough = enough + np.maximum(alike - len(self.trees), 0)
        # the largest level at which the trees together hold enough: counts only grow on the way up
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.bits, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            held = sum(b - a for a, b in self.stretches(codes, middle))
            low, high = np.where(held >= enough, middle, low), np.where(held >= enough, high, middle - 1)
        # the last step up is taken tree by tree, until it is enough
        below = np.stack([b - a for a, b in self.stretches(codes, np.minimum(low + 1, self.bits))])
        gain = np.cumsum(np.stack([b - a for a, b in self.stretches(codes, low)]) - below, axis=0) + below.sum(axis=0)
        more = np.minimum((gain < enough).sum(axis=0) + 1, len(self.trees))
        flags = self.flags(codes, low, more) & ~own
        need = np.minimum(k, len(self.x) - own.sum(axis=1))
        while len(short := np.flatnonzero(flags.sum(axis=1) < need)):
            # first all trees at this level, then the next; level 0 holds every vector
            low[short] = np.where(more[short] < len(self.trees), low[short], low[short] - 1)
            more[short] = len(self.trees)
            flags[short] = self.flags(codes[:, short], low[short], more[short]) & ~own[short]
        return flags


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From a to each row of b."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((b - a) ** 2).sum(axis=1))
    wide = ~np.isfinite(d)
    if wide.any():  # squares overflow: scale
        s = max(np.abs(a).max(), np.abs(b[wide]).max())
        d[wide] = np.sqrt(((b[wide] / s - a / s) ** 2).sum(axis=1)) * s
    return d


def _find(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    forest = Forest(x)
    places, rows, scores = [], [], []
    enough = max(LEAST, int(ENOUGH * np.sqrt(len(x))))
    step = max(1, (32 << 20) // max(1, len(x)))
    for lo in range(0, len(q), step):
        part, own = q[lo : lo + step], qids[lo : lo + step]
        flags = forest.candidates(part, enough, ids[None, :] == own[:, None], k)
        for i in range(len(part)):
            c = np.flatnonzero(flags[i])
            d = _distances(part[i], x[c])
            if len(c) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                c, d = c[near], d[near]
            best = np.lexsort((ids[c], d))[:k]
            places += [lo + i] * len(best)
            rows.append(ids[c[best]])
            scores.append(d[best])
    return np.array(places, np.int64), np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(scores) if scores else np.zeros(0)


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k nearest rows found by
    Euclidean distance in doubles, nearest first, ties to the smaller id.

    Every row is indexed. Vectors that are null, zero or hold null or non-finite components, and rows without id, take
    no part. Rows with a query's id are its own and no candidates; other repeated rows count each. Vectors of different
    lengths are filled up with zeros. An empty table gives an empty result; other columns are ignored."""
    rows = valid(embeddings, id_column, vector).filter(F.exists("v", lambda x: x != 0))
    return search(rows, rows.filter(F.col("id") % every == 0), _find, k, False, "double", SHARD_ROWS)
