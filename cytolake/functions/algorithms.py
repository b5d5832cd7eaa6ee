"""Sequential algorithms in numpy, without Spark."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


#: What a stretch costs, from the sums of each data column over it: arrays in, an array out.
Cost = Callable[..., np.ndarray]


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def binomial_cost(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-2 log likelihood of m methylated of n reads at their own rate; 0 where the rate is 0, 1 or unknown."""
    m, n = np.asarray(m, float), np.asarray(n, float)
    return np.where((m > 0) & (m < n), 2 * (_x_log_x(n) - _x_log_x(m) - _x_log_x(n - m)), 0.0)


def normal_cost(x: np.ndarray, squares: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Squared distance from the mean, from sums of values, of their squares, and of ones."""
    return squares - x * x / np.maximum(n, 1)


def pelt(count_m, count_total, beta: float | None = None, min_size: int = 1, exact: bool = False, cost: Cost = binomial_cost, more: tuple = ()) -> tuple[list[int], float]:
    """Change points (first rows of segments, without 0), and the total cost. Another cost may read the columns as it
    likes, and more of them.

    Candidates r are kept while F(r) + cost(r, t) <= F(t); among equals the earliest wins. The usual pruning can drop a
    candidate before its segment has min_size rows; exact keeps those."""
    data = (count_m, count_total, *more)
    n = len(count_m)
    if n == 0:
        return [], 0.0
    beta = math.log(n) if beta is None else beta
    sums = [np.r_[0.0, np.cumsum(np.asarray(x, float))] for x in data]
    best, previous = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -beta
    # the candidates that live, with all that a step needs of them side by side
    live, score = np.zeros(n + 1, np.int64), np.zeros(n + 1)
    held = np.zeros((len(sums), n + 1))
    live[0], score[0], count = 0, -beta, 1
    for k, s in enumerate(sums):
        held[k, 0] = s[0]
    for t in range(1, n + 1):
        value = score[:count] + cost(*[s[t] - h[:count] for s, h in zip(sums, held, strict=True)])
        # candidates ascend: those that are far enough back come first
        old = int(np.searchsorted(live[:count], t - min_size, "right"))
        if old:
            k = int(np.argmin(value[:old]))
            best[t], previous[t] = value[k] + beta, live[k]
        keep = value <= best[t]
        if exact:
            keep[old:] = True
        if not keep.all():
            rows = np.flatnonzero(keep)
            count = len(rows)
            live[:count], score[:count] = live[rows], score[rows]
            held[:, :count] = held[:, rows]
        live[count], score[count] = t, best[t]
        for k, s in enumerate(sums):
            held[k, count] = s[t]
        count += 1
    out, t = [], n
    while t > 0:
        t = int(previous[t])
        if t:
            out.append(t)
    return sorted(out), float(best[n])


def tv_denoise(y, lam: float) -> np.ndarray:
    """argmin of sum (x - y)^2 / 2 + lam * sum |x[i+1] - x[i]|: the slopes of a string pulled taut through a tube of
    radius lam around the running sums of y.

    From the last bend, two bounds on the slope are kept: the least upward and the greatest downward one that stay in
    the tube. When they cross, the string bends where the violated bound was met."""
    y = np.asarray(y, float)
    n = len(y)
    if n == 0 or lam <= 0:
        return y.copy()
    total = np.cumsum(y)
    high, low = (total + lam).tolist(), (total - lam).tolist()
    high[-1] = low[-1] = float(total[-1])
    x, at, level = np.empty(n), 0, 0.0  # the string is fixed up to the sum of the first `at` values
    while at < n:
        most, least, at_most, at_least, k = math.inf, -math.inf, at, at, at
        while True:
            up, down = (high[k] - level) / (k + 1 - at), (low[k] - level) / (k + 1 - at)
            if down > most:  # the tube rises above the slope that its roof allows: bend at the roof
                slope, end = most, at_most
                break
            if up < least:
                slope, end = least, at_least
                break
            if up <= most:
                most, at_most = up, k + 1
            if down >= least:
                least, at_least = down, k + 1
            if k == n - 1:
                slope, end = (high[k] - level) / (n - at), n
                break
            k += 1
        x[at:end] = slope
        level += slope * (end - at)
        at = end
    return x


def mann_whitney(a, b, tolerance: float = 1e-6) -> tuple[float, float]:
    """(U, p), two-sided; values within tolerance of a run's first are ties. (0, 1) where a group is empty."""
    a, b = (np.asarray(v, float) for v in (a, b))
    a, b = a[~np.isnan(a)], b[~np.isnan(b)]
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0, 1.0
    pooled = np.r_[a, b]
    order = np.argsort(pooled, kind="stable")
    values = pooled[order]
    edges = np.array([0, *[hi for _, hi in tolerance_runs(values, tolerance)]])
    size = np.diff(edges).astype(float)
    ranks = np.empty(len(values))
    ranks[order] = np.repeat((edges[:-1] + 1 + edges[1:]) / 2, np.diff(edges))
    ties = float((size**3 - size).sum())
    u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    u, n = min(u1, n1 * n2 - u1), n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    z = (u - n1 * n2 / 2 + 0.5) / math.sqrt(variance) if variance > 0 else 0.0
    return float(u), min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def tolerance_runs(values, tolerance: float) -> list[tuple[int, int]]:
    """(from, to) of runs whose values stay within tolerance of the run's first."""
    values = np.asarray(values, float)
    if not len(values):
        return []
    # equal neighbours are in one run whatever the tolerance: only changes can end one
    steps = np.flatnonzero(values[1:] != values[:-1]) + 1
    if len(steps) and (np.abs(values[steps] - values[steps - 1]) > tolerance).all():  # every change ends a run
        edges = [0, *steps.tolist(), len(values)]
        return list(zip(edges, edges[1:], strict=False))
    out, start, first = [], 0, values[0]
    for k, v in zip(steps.tolist(), values[steps].tolist(), strict=True):
        if abs(v - first) > tolerance:
            out.append((start, k))
            start, first = k, v
    return [*out, (start, len(values))]


def segment_differences(a, b, initial_l: float = 2.0, l_min: float = 1e-3, coef: float = 1.5, diff_threshold: float = 0.05, min_cpg: int = 10, tolerance: float = 1e-6, merge_p: float = 0.01, max_rounds: int = 1000) -> list[tuple[int, int, float]]:
    """Runs (from, to, p) that tile the rows of two density arrays, by repeated total-variation smoothing.

    The last waiting segment is smoothed in both groups; runs of the thresholded difference that are short stay as they
    are, longer ones wait if their p is lower than the segment's; if none does, the segment stays whole. The smoothing
    weight falls with every segment taken. Rows that nothing covers at the end form segments of their own, and
    neighbours whose differences do not differ are joined."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = len(a)
    if n == 0:
        return []
    waiting, done, lam, rounds = [(0, n, mann_whitney(a, b)[1])], [], initial_l, 0
    while waiting and rounds < max_rounds and lam >= l_min:
        lo, hi, p = waiting.pop()
        d = tv_denoise(a[lo:hi], lam) - tv_denoise(b[lo:hi], lam)
        d[np.abs(d) <= diff_threshold] = 0.0
        better = []
        for s, e in tolerance_runs(d, tolerance):
            if e - s <= min_cpg:
                done.append((lo + s, lo + e, mann_whitney(a[lo + s : lo + e], b[lo + s : lo + e])[1]))
            elif (q := mann_whitney(a[lo + s : lo + e], b[lo + s : lo + e])[1]) < p:
                better.append((lo + s, lo + e, q))
        if better:
            waiting += better
        else:
            done = [x for x in done if not lo <= x[0] < hi]
            done.append((lo, hi, p))
        lam /= coef
        rounds += 1
    # gaps between what is done
    tiles, at = [], 0
    for s, e, p in [*sorted(done), (n, n, 1.0)]:
        if s > at:
            tiles.append((at, s, mann_whitney(a[at:s], b[at:s])[1]))
        if e > s:
            tiles.append((s, e, p))
        at = max(at, e)
    return merged_neighbours(a, b, tiles, merge_p)


def merged_neighbours(a: np.ndarray, b: np.ndarray, tiles: list[tuple[int, int, float]], merge_p: float) -> list[tuple[int, int, float]]:
    """Adjacent tiles whose differences are alike (p over merge_p) joined, until none are."""
    diff = a - b
    changed = True
    while changed and len(tiles) > 1:
        changed, out = False, [tiles[0]]
        for s, e, p in tiles[1:]:
            ls, le, _ = out[-1]
            if mann_whitney(diff[ls:le], diff[s:e])[1] > merge_p:
                out[-1] = (ls, e, mann_whitney(a[ls:e], b[ls:e])[1])
                changed = True
            else:
                out.append((s, e, p))
        tiles = out
    return tiles


def dbscan(values, eps: float, min_points: int) -> np.ndarray:
    """Cluster numbers of sorted values, -1 for noise. Neighbours are nearer than eps; a core has min_points of them,
    itself and equal values included. A border value joins the cluster of its nearest core, the left one of two."""
    x = np.asarray(values, float)
    out = np.full(len(x), -1, np.int64)
    if not len(x):
        return out
    lo, hi = np.searchsorted(x, x - eps, "right"), np.searchsorted(x, x + eps, "left")
    cores = np.flatnonzero(np.maximum(hi, lo) - lo >= min_points) if eps > 0 else np.zeros(0, np.int64)
    if not len(cores):
        return out
    out[cores] = np.cumsum(np.r_[0, np.diff(x[cores]) >= eps])
    for k in np.flatnonzero(out < 0):
        right = int(np.searchsorted(cores, k))
        near = [(abs(x[k] - x[c]), c) for c in (cores[right - 1] if right else -1, cores[right] if right < len(cores) else -1) if c >= 0 and abs(x[k] - x[c]) < eps]
        if near:
            out[k] = out[min(near)[1]]
    return out
