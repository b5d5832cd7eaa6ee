"""Sequential algorithms against brute force, and the pipelines on planted data."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytolake.config import MergeType
from cytolake.functions import algorithms as A
from cytolake.plans import dimred, dmr

# (fixed values) known smoothing results
FIRST = [1, 2.1, 5.2, 8.2, 1.4, 5.2, 6.2, 10.1]
SECOND = [111, 422.1, 145.2, 248.2, 871.4, 675.2, 436.2, 310.1]


@pytest.mark.parametrize(
    ("y", "lam", "expected"),
    [
        (FIRST, 3, [3.05, 3.05, 4.933333, 4.933333, 4.933333, 5.2, 6.2, 7.1]),
        (SECOND, 700, [402.425] * 8),
        (FIRST, 0, FIRST),
        (SECOND, 5, [116, 412.1, 155.2, 248.2, 861.4, 675.2, 436.2, 315.1]),
        ([], 1, []),
        ([4.0], 1, [4.0]),
    ],
)
def test_tv_golden(y, lam, expected):
    assert A.tv_denoise(y, lam) == pytest.approx(expected, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=40), st.floats(0.01, 4))
def test_tv_is_optimal(y, lam):
    """The dual certificate: running sums of the residual stay in the tube and touch it where x jumps."""
    x = A.tv_denoise(y, lam)
    u = np.cumsum(np.array(y) - x)
    assert abs(u[-1]) < 1e-7 and (np.abs(u) <= lam + 1e-7).all()
    jump = np.diff(x)
    assert all(abs(u[k] + lam * np.sign(j)) < 1e-6 for k, j in enumerate(jump) if abs(j) > 1e-6)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=9), st.floats(0.1, 6))
def test_pelt_finds_the_least_cost(rows, beta):
    m, n = [min(a, b) for a, b in rows], [max(a, b) for a, b in rows]

    def cost(cuts):
        e = [0, *cuts, len(m)]
        return sum(float(A.binomial_cost(np.array([sum(m[s:t])]), np.array([sum(n[s:t])]))[0]) for s, t in zip(e, e[1:])) + beta * len(cuts)

    cuts, total = A.pelt(m, n, beta, 1)
    best = min(cost(c) for k in range(len(m)) for c in itertools.combinations(range(1, len(m)), k))
    assert total == pytest.approx(best) and cost(cuts) == pytest.approx(best)


def test_pelt_sizes():
    m, n = [0] * 30 + [20] * 30, [20] * 60
    assert A.pelt(m, n, 1.0, 5)[0] == [30] and A.pelt([], []) == ([], 0.0)
    assert all(b - a >= 7 for a, b in itertools.pairwise([0, *A.pelt(list(np.random.default_rng(1).binomial(9, 0.5, 80)), [9] * 80, 0.1, 7, exact=True)[0], 80]))


def test_mann_whitney():
    a, b = [1.5, 2.3, 3.1, 4.8, 5.7, 5.6], [2.0, 3.5, 3.8, 4.0, 6.2, 3.5]
    assert A.mann_whitney(a, b) == A.mann_whitney(b, a)
    assert A.mann_whitney([], b) == (0.0, 1.0) and A.mann_whitney([1, 1], [1, 1])[1] == 1.0
    assert A.mann_whitney(range(20), range(100, 120))[1] < 1e-6
    assert A.mann_whitney([math.nan, 1.0], [2.0]) == A.mann_whitney([1.0], [2.0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(1, 6), st.integers(1, 4))
def test_dbscan_against_definition(values, eps, points):
    x = sorted(values)
    got = A.dbscan(x, eps, points)
    core = [sum(abs(a - b) < eps for b in x) >= points for a in x]
    for i, j in itertools.combinations(range(len(x)), 2):
        if core[i] and core[j] and abs(x[i] - x[j]) < eps:
            assert got[i] == got[j] >= 0
    for i in range(len(x)):
        reachable = core[i] or any(core[j] and abs(x[i] - x[j]) < eps for j in range(len(x)))
        assert (got[i] >= 0) == reachable


def test_segments_tile():
    rng = np.random.default_rng(2)
    a, b = rng.random(200), rng.random(200)
    b[60:120] = np.clip(a[60:120] + 0.6, 0, 2)
    tiles = A.segment_differences(a, b, min_cpg=5)
    assert tiles[0][0] == 0 and tiles[-1][1] == 200 and all(x[1] == y[0] for x, y in itertools.pairwise(tiles))
    assert all(0 <= p <= 1 for _, _, p in tiles) and A.segment_differences([], []) == []


def planted(spark, seed=1):
    """Two replicates in each of two groups; positions 3000 to 4500 differ."""
    rng, rows = np.random.default_rng(seed), []
    for sample, group in (("a1", 0), ("a2", 0), ("b1", 1), ("b2", 1)):
        for p in range(10, 9000, 30):
            rate = 0.85 if group and 3000 <= p < 4500 else 0.2
            total = int(rng.integers(15, 30))
            m = int(rng.binomial(total, rate))
            rows.append(("c", p, True, True, m, total, m / total, sample))
    return spark.createDataFrame(rows, "chr string, position long, strand boolean, context boolean, count_m long, count_total long, density double, sample string")


def test_dmr_finds_what_was_planted(spark):
    found = dmr.filtered(dmr.regions(planted(spark), F.col("sample").startswith("a"), F.col("sample").startswith("b"), 2, 2, width=1000)).collect()
    assert found and all(r["meth_diff"] < -0.05 and r["padj"] <= 0.05 for r in found)
    inside = sum(min(r["end"], 4500) - max(r["start"], 3000) for r in found if r["end"] > 3000 and r["start"] < 4500)
    assert inside > 1300 and sum(r["end"] - r["start"] for r in found) < 1.2 * inside


def test_missing_samples_are_dropped(spark):
    rows = planted(spark).filter("not (sample = 'a2' and position < 3000)")
    o = dmr.Options(n_missing=0)
    found = dmr.regions(rows, F.col("sample").startswith("a"), F.col("sample").startswith("b"), 2, 2, o, width=1000).collect()
    assert min(r["start"] for r in found) >= 3000


def test_shrink(spark):
    steps = dimred.shrink(planted(spark).filter("sample like 'b%'"), chunk=120, overlap=30, width=500).orderBy("start").collect()
    edges = {r["end"] for r in steps}
    assert any(abs(e - 3000) <= 60 for e in edges) and any(abs(e - 4500) <= 60 for e in edges)
    assert all(x["end"] == y["start"] for x, y in itertools.pairwise(steps)) and all(0 <= r["value"] <= 1 for r in steps)


def test_merge(spark):
    rows = spark.createDataFrame([("s", "c", 0, 100, 1.0), ("s", "c", 100, 200, 3.0), ("t", "c", 0, 98, 2.0), ("t", "c", 98, 200, 4.0), ("t", "d", 0, 9, 1.0)], "sample string, chr string, start long, end long, value double")
    full = dimred.merge(rows).collect()
    assert sorted((r["sample"], r["start"], r["value"]) for r in full if r["chr"] == "c") == [("s", 0, 1.0), ("s", 98, 1.0), ("s", 100, 3.0), ("t", 0, 2.0), ("t", 98, 4.0), ("t", 100, 4.0)]
    near = dimred.merge(rows, MergeType("dbscan", 5, 2, 50, "mean")).filter("chr = 'c' and sample = 's'").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in near] == [(0, 99), (99, 200)]


def test_pelt_with_another_cost():
    """Shifts of a mean; every segmentation of short data is tried."""
    from cytolake.functions.algorithms import normal_cost, pelt

    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.1, 4), rng.normal(3, 0.1, 5), rng.normal(1, 0.1, 3)]
    cuts, total = pelt(x, x * x, 0.5, 1, cost=normal_cost, more=(np.ones(len(x)),))
    assert cuts == [4, 9]

    def whole(edges):
        return sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in zip(edges, edges[1:])) + 0.5 * (len(edges) - 2)

    import itertools

    best = min(whole([0, *c, len(x)]) for k in range(4) for c in itertools.combinations(range(1, len(x)), k))
    assert total == pytest.approx(best)


def test_segments_of_a_shrink(spark):
    """Each segment's value is the mean of its sites, and segments end where change points are."""
    from cytolake.operators import bins
    from cytolake.plans import dimred

    rng = np.random.default_rng(1)
    rows = [("c", 3 * k, True, True, int(m), 20, float(m) / 20) for k, m in enumerate(np.r_[rng.binomial(20, 0.1, 150), rng.binomial(20, 0.8, 150)])]
    sites = spark.createDataFrame(rows, "chr string, position long, strand boolean, context boolean, count_m long, count_total long, density double")
    points = sorted(r["position"] for r in dimred.change_points(sites, chunk=100, overlap=20, width=64).collect())
    found = sorted(map(tuple, bins.shrunken(dimred.segmented(sites, chunk=100, overlap=20, width=64)).select("start", "end", "n", "value").collect()))
    starts = [0, *[p for p in points if p < 3 * 299]]
    assert [f[0] for f in found] == starts and any(abs(p - 450) <= 9 for p in points)
    for start, end, n, value in found:
        inside = [r[6] for r in rows if start <= r[1] <= end]
        assert n == len(inside) and value == pytest.approx(np.mean(inside))


def test_groups_of_a_stream(spark):
    """Groups larger and smaller than an Arrow batch come whole and in order, with nulls as NaN."""
    from pyspark.sql import types as T

    from cytolake.operators.ranges import by_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"k{k}", k % 3, p, None if p % 5 == 0 else float(p)) for k in range(6) for p in range(3 * k * k + 1)]
        df = spark.createDataFrame(rows, "a string, b long, position long, value double").repartition(3)
        schema = T.StructType().add("a", "string").add("b", "long").add("n", "long").add("ordered", "boolean").add("total", "double")
        run = lambda g: [(g["a"][0], int(g["b"][0]), len(g["a"]), bool((np.diff(g["position"]) > 0).all()), float(np.nansum(g["value"])))]
        got = {r["a"]: tuple(r)[1:] for r in by_groups(df, ("a", "b"), "position", run, schema).collect()}
        assert got == {f"k{k}": (k % 3, 3 * k * k + 1, True, float(sum(p for p in range(3 * k * k + 1) if p % 5))) for k in range(6)}
        assert by_groups(df.limit(0), ("a", "b"), "position", run, schema).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tolerance_runs():
    from cytolake.functions.algorithms import tolerance_runs

    rng = np.random.default_rng(5)
    for _ in range(200):
        values = np.sort(rng.integers(0, 12, rng.integers(0, 20))) * 0.4 if rng.random() < 0.7 else rng.integers(0, 4, rng.integers(0, 20)) * 0.7
        runs, start = [], 0
        for k in range(1, len(values) + 1):
            if k == len(values) or abs(values[k] - values[start]) > 1.0:
                runs.append((start, k))
                start = k
        assert tolerance_runs(values, 1.0) == (runs if len(values) else [])


def plain_rank_test(a, b, tolerance=1e-6):
    """(U, p): ranks by counting, ties by walking the sorted values."""
    import math

    pooled = sorted([*a, *b])
    if not len(a) or not len(b):
        return 0.0, 1.0
    rank, ties, k = {}, 0, 0
    while k < len(pooled):
        m = k
        while m < len(pooled) and pooled[m] - pooled[k] <= tolerance:
            m += 1
        for x in pooled[k:m]:
            rank[x] = (k + 1 + m) / 2
        ties += (m - k) ** 3 - (m - k)
        k = m
    n1, n2 = len(a), len(b)
    u = sum(rank[x] for x in a) - n1 * (n1 + 1) / 2
    u, n = min(u, n1 * n2 - u), n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    return u, min(1.0, math.erfc(abs((u - n1 * n2 / 2 + 0.5) / math.sqrt(var)) / math.sqrt(2))) if var > 0 else 1.0


def plain_segments(a, b, weight, least, coef, threshold, few, tolerance, alike):
    """Segments as sets of rows, level by level, from the description: smooth, cut, keep what is short, go on with what
    is clearer than its parent, then fill and join."""
    from cytolake.functions.algorithms import tv_denoise

    test = lambda rows: plain_rank_test([a[r] for r in rows], [b[r] for r in rows])[1]
    everything = range(len(a))
    stack, kept = [(everything, test(everything))], []
    while stack and weight >= least:
        rows, p = stack.pop()
        d = [x - y if abs(x - y) > threshold else 0.0 for x, y in zip(tv_denoise([a[r] for r in rows], weight), tv_denoise([b[r] for r in rows], weight))]
        cuts = [0]
        for k in range(1, len(d)):
            if abs(d[k] - d[cuts[-1]]) > tolerance:
                cuts.append(k)
        parts = [rows[s:e] for s, e in zip(cuts, [*cuts[1:], len(d)])]
        short = [(part, test(part)) for part in parts if len(part) <= few]
        clearer = [(part, q) for part in parts if len(part) > few and (q := test(part)) < p]
        if clearer:
            kept += short
            stack += clearer
        else:
            kept = [k for k in kept if k[0][0] not in rows] + [(rows, p)]
        weight /= coef
    owner, tiles = {r: (part, p) for part, p in kept for r in part}, []
    for r in everything:
        if r in owner:
            if owner[r][0][0] == r:
                tiles.append((list(owner[r][0]), owner[r][1]))
        elif r and r - 1 not in owner:
            tiles[-1][0].append(r)
        else:
            tiles.append(([r], None))
    tiles = [(rows, test(rows) if p is None else p) for rows, p in tiles]
    while True:
        joined = [tiles[0]]
        for rows, p in tiles[1:]:
            last = joined[-1][0]
            if plain_rank_test([a[r] - b[r] for r in last], [a[r] - b[r] for r in rows])[1] > alike:
                joined[-1] = (last + rows, test(last + rows))
            else:
                joined.append((rows, p))
        if len(joined) == len(tiles):
            return [(rows[0], rows[-1] + 1, p) for rows, p in joined]
        tiles = joined


@pytest.mark.parametrize("seed", range(12))
def test_segments_against_a_plain_version(seed):
    from cytolake.functions.algorithms import segment_differences

    rng = np.random.default_rng(seed)
    steps = rng.integers(5, 30, 6)
    a = np.clip(np.repeat(rng.random(6), steps) + rng.normal(0, 0.05, steps.sum()), 0, 1).round(rng.integers(1, 6))
    b = np.clip(np.repeat(rng.random(6), steps) + rng.normal(0, 0.05, steps.sum()), 0, 1).round(rng.integers(1, 6))
    got = segment_differences(a, b, 2.0, 1e-3, 1.5, 0.05, 5, 1e-6, 0.01)
    expected = plain_segments(a.tolist(), b.tolist(), 2.0, 1e-3, 1.5, 0.05, 5, 1e-6, 0.01)
    assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in expected]
    assert [p for *_, p in got] == pytest.approx([p for *_, p in expected])
