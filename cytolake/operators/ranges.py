"""Order along chromosomes without a task that holds a whole one.

A chromosome is cut into ranges of positions. A window runs inside a range, and a second, small window over the ranges
of a chromosome carries totals and borders across. So a long chromosome is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WIDTH = 1 << 20


def _range(position: str, width: int) -> Column:
    return F.floor(F.col(position) / width).cast("long")


def running(df: DataFrame, totals: dict[str, Column], keys: tuple[str, ...] = ("chr",), position: str = "position", width: int = WIDTH) -> DataFrame:
    """df with running sums (rows up to and including each, by position): name -> value."""
    cut = df.withColumn("_range", _range(position, width)).withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in totals.items()})
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in totals])
    inside = Window.partitionBy(*keys, "_range").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(sums, [*keys, "_range"])
    return out.select(*df.columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_b_{n}")).alias(n) for n in totals])


def ordinal(df: DataFrame, name: str = "ordinal", keys: tuple[str, ...] = ("chr",), position: str = "position", width: int = WIDTH) -> DataFrame:
    """df with each row's place along its chromosome, from 0."""
    return running(df, {name: F.lit(1).cast("long")}, keys, position, width).withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, name: str = "previous", keys: tuple[str, ...] = ("chr",), position: str = "position", width: int = WIDTH, value: str | None = None) -> DataFrame:
    """df with the position (or another value) of the row before each along its chromosome; null for the first. Rows of
    one position stand by value, so neither their order in the input nor the ranges decide."""
    value = value or position
    cut = df.withColumn("_range", _range(position, width))
    end = F.max(position) if value == position else F.max_by(value, F.struct(position, value))
    last = cut.groupBy(*keys, "_range").agg(end.alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_last")
    inside = Window.partitionBy(*keys, "_range").orderBy(position, value)
    return cut.join(last, [*keys, "_range"]).select(*df.columns, F.when(F.row_number().over(inside) > 1, F.lag(value).over(inside)).otherwise(F.col("_before")).alias(name))


def islands(df: DataFrame, far: Column, name: str = "segment", keys: tuple[str, ...] = ("chr",), position: str = "position", width: int = WIDTH) -> DataFrame:
    """df with the number (from 0) of each row's island: a new one starts where far holds; far may use _previous."""
    flagged = previous(df, "_previous", keys, position, width).withColumn("_new", F.when(F.col("_previous").isNotNull() & far, 1).otherwise(0).cast("long"))
    return running(flagged, {name: F.col("_new")}, keys, position, width).select(*df.columns, name)


def gap_segments(sites: DataFrame, max_dist: int, keys: tuple[str, ...] = ("chr",), width: int = WIDTH) -> DataFrame:
    """Sites with the segment they belong to: cut where the next site is max_dist or more away."""
    return islands(sites, F.col("position") - F.col("_previous") >= max_dist, "segment", keys, "position", width)


def distance_parts(points: DataFrame, max_dist: int, position: str = "position", width: int = WIDTH) -> DataFrame:
    """Breakpoints with their part: cut where the next one is more than max_dist away."""
    return islands(points, F.col(position) - F.col("_previous") > max_dist, "part", ("chr",), position, width)


def cumulative_counts(sites: DataFrame, width: int = WIDTH) -> DataFrame:
    return running(sites, {"cum_m": F.col("count_m"), "cum_total": F.col("count_total")}, width=width)


def rechunk(sites: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """Sites with batch, the number of their chunk of size rows along the chromosome."""
    return ordinal(sites, "_o", width=width).withColumn("batch", F.floor(F.col("_o") / size).cast("long")).drop("_o")


def overlapping_chunks(sites: DataFrame, size: int, overlap: int, width: int = WIDTH) -> DataFrame:
    """Sites with chunk and final: chunk k holds size + overlap rows from row k * size on; the last one (final) holds
    what is left. Rows of an overlap come twice."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than a chunk")
    rows = ordinal(sites, "_o", width=width)
    n = rows.groupBy("chr").agg((F.max("_o") + 1).alias("_n"))
    last = F.when(F.col("_n") >= size + overlap, F.floor((F.col("_n") - overlap) / size)).otherwise(0).cast("long")
    own = F.floor(F.col("_o") / size).cast("long")
    first = F.greatest(F.lit(0), own - F.when(F.col("_o") % size < overlap, 1).otherwise(0)).cast("long")
    rows = rows.join(n, "chr").withColumn("_last", last)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.least(first, F.col("_last")), F.least(own, F.col("_last")))))
    return rows.withColumn("final", F.col("chunk") == F.col("_last")).select(*sites.columns, "chunk", "final")


def by_groups(df: DataFrame, keys: tuple[str, ...], order: str, f: Callable[[dict[str, np.ndarray]], list[tuple]], schema: StructType) -> DataFrame:
    """The rows that f makes of each group of keys: f gets its columns (nulls of numbers are NaN) in order.

    Tasks read their sorted rows as a stream and hold one group at a time, however many there are; there is no call of
    Python's worker per group."""
    wanted, arrow = df.columns, to_arrow_schema(schema)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        out: list[tuple] = []

        def finished() -> list[tuple]:
            whole = {n: np.concatenate([h[n] for h in held]) for n in wanted}
            held.clear()
            return f(whole)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type, from_pandas=True) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            columns = {n: b.column(n).to_numpy(zero_copy_only=False) for n in wanted}
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
                out += finished()
            edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                if i:
                    out += finished()
                held.append({n: c[lo:hi] for n, c in columns.items()})
            if len(out) >= 10_000:
                yield batch()
        if held:
            out += finished()
        yield batch()

    return rows.mapInArrow(run, schema)
