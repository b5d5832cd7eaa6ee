"""Searches of a stated set of query vectors against all vectors, in blocks.

Vectors are dealt by a hash into shards of at most about ``shard_rows``; queries into blocks. Each pair of a shard
and a block is one task that builds its index and answers; a last step keeps each query's best over all shards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector without null, NaN or infinite components, as doubles."""
    v = F.col(vector)
    # a null component makes the test null, and coalesce makes that false
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return df.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(width, int(n.max(initial=0)))
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


#: Bytes of vectors that one task holds, about.
SHARD_BYTES = 64 << 20


def rows_for(most: int, width: int | None) -> int:
    """Rows of a shard: at most so many, fewer if vectors are wide."""
    return max(1, min(most, SHARD_BYTES // (8 * max(1, width or 1))))


def search(vectors: DataFrame, queries: DataFrame, find: Search, k: int, largest: bool, score: str, shard_rows: int, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller id. vectors and queries are (id, v).

    find(ids, vectors, query ids, query vectors, k) answers for one shard: places of queries, ids found, scores."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, nq = size["n"], queries.count()
    shard_rows = rows_for(shard_rows, size["width"])
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = vectors.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).cast("int").alias("shard"), every(n_blocks).alias("block"))
    asked = queries.select("id", "v", every(n_shards).alias("shard"), F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("block"))
    kind = pa.float64() if score == "double" else pa.int64()

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            ids, qids = left.column("id").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, q = matrix(left.column("v"))[order], matrix(right.column("v"))
            width = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
            place, vec, best = find(ids[order], x, qids, q, k)
            found = (qids[place], vec, best)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], kind)})

    near = data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(answer, f"query_id long, vec_id long, score {score}")
    return best_of(near, k, largest)


def best_of(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
