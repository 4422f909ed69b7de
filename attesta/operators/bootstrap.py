"""Bootstrap counts without drawing single slots.

How often each of k clusters comes up among m draws is a splitting tree: of the draws that fall on a range of clusters,
a binomial number falls on its left half. Every node's number is the inverse of a uniform hash of (seed, replicate,
node), so any task finds the counts of its own clusters by going down from the root, and all tasks agree.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from attesta.functions.numeric import draw
from attesta.operators.ordered import Ordered
from attesta.operators.resample import index_percentiles
from attesta.session import stage

BLOCK = 512  # runs of equal clusters whose counts a task finds together
SD = 14.0  # the inverse looks no further than so many deviations from the mean; what lies beyond is below 1e-40


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1: the series of Stirling, after a shift of small x."""
    small = x < 12
    y = np.where(small, x + 12, x)
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return out - np.where(small, sum(np.log(np.where(small, x + k, 1.0)) for k in range(12)), 0.0)


def binomial_inverse(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least x with P(X <= x) >= u for X binomial (m, p). Equal m share a table of the distribution."""
    m = np.asarray(m, np.int64)
    out = np.zeros(len(m), np.int64)
    if p >= 1:
        return m.copy()
    if p <= 0:
        return out
    order = np.argsort(m, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(m[order]) > 0, [True]))) if len(m) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        n = int(m[rows[0]])
        if not n:
            continue
        half = SD * math.sqrt(n * p * (1 - p)) + SD
        x = np.arange(max(0, math.floor(n * p - half)), min(n, math.ceil(n * p + half)) + 1)
        log = _log_gamma(np.array([n + 1.0])) - _log_gamma(x + 1.0) - _log_gamma(n - x + 1.0) + x * math.log(p) + (n - x) * math.log1p(-p)
        below = np.cumsum(np.exp(log))
        # For very large m the logarithms are off by a common factor, which the total takes out.
        out[rows] = x[np.minimum(np.searchsorted(below, u[rows] * below[-1]), len(x) - 1)]
    return out


def _uniform(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A number in (0, 1) by hash of a replicate's key and a node."""
    x = key + (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def replicate_keys(seed: int, group: int, reps: int) -> np.ndarray:
    start = np.array([seed & 0xFFFFFFFF, group & 0xFFFFFFFFFFFFFFFF], np.uint64)
    base = np.uint64(int(start[0]) * 0xC2B2AE3D27D4EB4F + int(start[1]) & 0xFFFFFFFFFFFFFFFF)
    return base + np.arange(reps, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def tree_counts(k: int, draws: int, lo: int, hi: int, keys: np.ndarray) -> np.ndarray:
    """Counts of clusters lo..hi-1 of k among `draws` draws, one row a replicate.

    A node is named by its level's first place in the tree and its own; ranges are halved at their middle.
    """
    out = np.zeros((len(keys), hi - lo), np.int64)
    a, b, node, m = np.array([0]), np.array([k]), np.array([0], np.uint64), np.full((1, len(keys)), draws, np.int64)
    while len(a):
        leaf = b - a == 1
        out[:, a[leaf] - lo] = m[leaf].T
        a, b, node, m = a[~leaf], b[~leaf], node[~leaf], m[~leaf]
        mid, left = (a + b) // 2, np.zeros_like(m)
        for size in np.unique(b - a).tolist():  # two sizes at most, so ranges of one size share tables
            same = b - a == size
            u = _uniform(keys[None, :], node[same][:, None])
            left[same] = binomial_inverse(m[same].ravel(), (size // 2) / size, u.ravel()).reshape(u.shape)
        a, b, node, m = np.concatenate((a, mid)), np.concatenate((mid, b)), np.concatenate((2 * node + 1, 2 * node + 2)), np.concatenate((left, m - left))
        seen = (a < hi) & (b > lo)
        a, b, node, m = a[seen], b[seen], node[seen], m[seen]
    return out


def tree_sums(k: int, draws: int, ends: np.ndarray, lo: int, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sums of `values` over the draws that fall on runs of equal clusters, one row a replicate.

    The runs follow each other from place `lo`; run r ends before ends[r] and all its clusters have values[r]. The tree
    is that of `tree_counts`, but a range inside one run needs no further split.
    """
    out, hi = np.zeros((len(keys), values.shape[1])), int(ends[-1])
    a, b, node, m = np.array([0]), np.array([k]), np.array([0], np.uint64), np.full((1, len(keys)), draws, np.int64)
    while len(a):
        run = np.searchsorted(ends, a, "right")
        done = (a >= lo) & (b <= hi) & (run == np.searchsorted(ends, b - 1, "right"))
        out += m[done].T @ values[run[done]]
        a, b, node, m = a[~done], b[~done], node[~done], m[~done]
        mid, left = (a + b) // 2, np.zeros_like(m)
        for size in np.unique(b - a).tolist():
            same = b - a == size
            u = _uniform(keys[None, :], node[same][:, None])
            left[same] = binomial_inverse(m[same].ravel(), (size // 2) / size, u.ravel()).reshape(u.shape)
        a, b, node, m = np.concatenate((a, mid)), np.concatenate((mid, b)), np.concatenate((2 * node + 1, 2 * node + 2)), np.concatenate((left, m - left))
        seen = (a < hi) & (b > lo)
        a, b, node, m = a[seen], b[seen], node[seen], m[seen]
    return out


def counted_bootstrap(
    df: DataFrame, cluster: str, sums: Mapping[str, Column], statistic: Column, by: Sequence[str] = (), reps: int = 4000, seed: int = 13,
    draws: int | None = None, floor_share: float | None = 0.25,
) -> DataFrame:
    """(by, point, lo, hi, n_valid): percentile interval of a statistic of sums, resampling whole clusters.

    Rows collapse to one row of sums a cluster, and clusters of equal sums, which are interchangeable, to one run. Tasks
    hold BLOCK runs at a time and pass on their share of each replicate's sums; no row stands for a single draw, and
    clusters that differ in nothing cost one. `draws` is the number of clusters drawn, all of them if None.
    """
    names = list(sums)
    per = df.groupBy(*by, cluster).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    runs = per.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__m"))
    one = F.lit(1).cast("bigint")
    runs = Ordered(runs, list(by), names).running({"__hi": ("sum", F.col("__m")), "__run": ("sum", one)}, {"__k": ("sum", F.col("__m"))}).rows()
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    rows = stage(runs.withColumns({"__block": F.floor((F.col("__run") - 1) / BLOCK), "__group": group}), "clusters")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "".join(f"{b} {types[b]}, " for b in by) + "rep int, " + ", ".join(f"{n} double" for n in names)

    def replicates(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("__hi").to_numpy())
        k, ends = table.column("__k")[0].as_py(), table.column("__hi").to_numpy()[order]
        values = np.stack([table.column(n).to_numpy(zero_copy_only=False) for n in names], 1)[order]
        keys = replicate_keys(seed, table.column("__group")[0].as_py(), reps)
        lo = int(ends[0] - table.column("__m").to_numpy()[order[0]])
        total = tree_sums(k, draws or k, ends, lo, np.nan_to_num(values), keys)
        head = table.select(by).slice(0, 1) if by else None
        first = [head.column(b).take(pa.array([0] * reps)) for b in by]
        return pa.table([*first, pa.array(np.arange(reps, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], [*by, "rep", *names])

    # The rows are few and small, but their work is not: as many tasks as there are blocks, up to four a core.
    blocks = rows.select(*by, "__block").distinct().count()
    tasks = max(1, min(blocks, 4 * df.sparkSession.sparkContext.defaultParallelism))
    parts = rows.repartition(tasks, *by, "__block").groupBy(*by, "__block").applyInArrow(replicates, schema)
    vals = parts.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names]).select(*by, statistic.alias("value"))
    point = per.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names]).select(*by, statistic.alias("point"))
    ci = index_percentiles(vals, by, "value", reps, floor_share)
    return point.join(ci, list(by), "left") if by else point.join(F.broadcast(ci), how="left")


@F.pandas_udf(LongType())
def binomial_draw(n: pd.Series, k: pd.Series, u: pd.Series) -> pd.Series:
    """Successes among n draws of a group of n rows with k successes, from a uniform number."""
    n, k, u = (x.to_numpy() for x in (n, k, u))
    out = np.zeros(len(n), np.int64)
    for a, b in set(zip(n.tolist(), k.tolist())):  # one pair a group
        rows = (n == a) & (k == b)
        out[rows] = binomial_inverse(np.full(rows.sum(), a), b / a, u[rows])
    return pd.Series(out)


def binomial_bootstrap(groups: DataFrame, k: str, n: str, by: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(by, lo, hi): row bootstrap of a proportion from (k, n) alone: one binomial number a replicate."""
    many = groups.where(F.col(n) > 0).select(*by, F.col(k).cast("long").alias("__k"), F.col(n).cast("long").alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    u = (draw(seed, *[F.col(b) for b in by], F.col("rep")) + 0.5) / F.lit(2.0**32)
    vals = many.select(*by, (binomial_draw("__n", "__k", u) / F.col("__n")).alias("value"))
    return index_percentiles(vals, by, "value", reps, None).select(*by, "lo", "hi")
