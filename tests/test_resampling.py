"""Shuffles and bootstraps by their laws: bijections, even spread, exact counts."""

import math
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions.numeric import draw
from attesta.operators import bootstrap as B
from attesta.operators import resample as R
from attesta.operators import shuffles as SH


def test_places_are_permuted():
    for n in [*range(1, 60), 97, 1000, 4096, 4097]:
        for key in (0, 1, 12345, SH.LEHMER - 1):
            out = SH.moved(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out.tolist()) == list(range(n))


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_permutations_are_equally_likely(n):
    keys = np.random.default_rng(n).integers(0, SH.LEHMER, 30_000)
    table = np.stack([SH.moved(np.full(len(keys), k), np.full(len(keys), n), keys) for k in range(n)], 1)
    seen = Counter(map(tuple, table.tolist()))
    assert set(seen) == set(permutations(range(n)))
    mean = len(keys) / math.factorial(n)
    chi = sum((c - mean) ** 2 / mean for c in seen.values())
    free = math.factorial(n) - 1
    assert chi < free + 5 * math.sqrt(2 * free)


def test_pairs_of_places_spread_evenly():
    n, keys = 40, np.random.default_rng(9).integers(0, SH.LEHMER, 40_000)
    to = [SH.moved(np.full(len(keys), k), np.full(len(keys), n), keys) for k in (0, 1, 17, 39)]
    for a in range(4):
        for b in range(a):
            seen = np.bincount(to[a] * n + to[b], minlength=n * n).reshape(n, n)
            assert not seen.diagonal().any()
            mean = len(keys) / (n * (n - 1))
            chi = ((seen - mean) ** 2 / mean).sum() - n * mean
            assert abs(chi - n * (n - 1)) < 6 * math.sqrt(2 * n * (n - 1))


def test_shuffled_labels_keep_the_counts_of_each_stratum(spark):
    rows = [(i, "a" if i % 3 else None, None if i % 7 == 0 else f"l{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s string, lab string")
    out = SH.shuffled_labels(df, ["s"], "id", "lab", 1, 4).collect()
    stratum = {i: s for i, s, _ in rows}
    want = Counter((s, lab) for _, s, lab in rows if lab is not None)
    by_rep = {k: Counter((stratum[r.id], r.lab) for r in out if r.rep == k) for k in range(4)}
    assert all(c == want for c in by_rep.values())
    forms = {tuple(sorted((r.id, r.lab) for r in out if r.rep == k)) for k in range(4)}
    assert len(forms) == 4


def test_shuffle_test_against_enumeration(spark):
    values, labels = [0.3, 2.1, 1.7, 0.2, 3.4, 2.8], [False, True, False, False, True, True]
    df = spark.createDataFrame([(k, v, x) for k, (v, x) in enumerate(zip(values, labels))], "id int, v double, lab boolean")
    r = SH.shuffle_test(df, [], "id", "lab", "v", 3000, 5).first()
    diffs = []
    for p in set(permutations(labels)):
        a, b = [v for v, x in zip(values, p) if x], [v for v, x in zip(values, p) if not x]
        diffs.append(sum(a) / 3 - sum(b) / 3)
    observed = sum(v for v, x in zip(values, labels) if x) / 3 - sum(v for v, x in zip(values, labels) if not x) / 3
    assert r.observed == pytest.approx(observed)
    share = sum(x >= observed - 1e-12 for x in diffs) / len(diffs)
    assert r.p_greater == pytest.approx(share, abs=0.02)
    other = SH.shuffle_test(df, [], "id", "lab", "v", 500, 5, lambda x, v: F.corr(x.cast("double"), v)).first()
    assert other.observed > 0.5 and other.p_greater == pytest.approx(share, abs=0.04)


def test_binomial_inverse_is_exact():
    for m in (0, 1, 2, 7, 40, 300):
        for p in (0.5, 0.3, 1 / 3, 0.99):
            pmf = [math.comb(m, x) * p**x * (1 - p) ** (m - x) for x in range(m + 1)]
            below = np.cumsum(pmf)
            u = np.random.default_rng(m).random(400)
            want = np.minimum(np.searchsorted(below, u), m)
            assert (B.binomial_inverse(np.full(400, m), p, u) == want).all()
    big = B.binomial_inverse(np.full(5, 10**9), 0.5, np.array([1e-9, 0.25, 0.5, 0.75, 1 - 1e-9]))
    z = (big - 5e8) / math.sqrt(2.5e8)
    assert z == pytest.approx([-5.998, -0.6745, 0, 0.6745, 5.998], abs=2e-3)


def test_tree_counts_follow_the_multinomial_law():
    keys = B.replicate_keys(3, 0, 60_000)
    for k, draws in ((2, 3), (3, 3), (5, 2)):
        seen = Counter(map(tuple, B.tree_counts(k, draws, 0, k, keys).tolist()))
        chi = free = 0
        for form in {tuple(np.bincount(x, minlength=k)) for x in product(range(k), repeat=draws)}:
            p = math.factorial(draws) / math.prod(map(math.factorial, form)) / k**draws
            chi += (seen[form] - p * len(keys)) ** 2 / (p * len(keys))
            free += 1
        assert sum(seen.values()) == len(keys) and chi < free + 5 * math.sqrt(2 * free)


def test_tasks_agree_on_the_counts():
    keys = B.replicate_keys(1, 7, 50)
    whole = B.tree_counts(1000, 1000, 0, 1000, keys)
    assert (whole.sum(1) == 1000).all() and (whole >= 0).all()
    for lo, hi in ((0, 1), (0, 256), (333, 700), (999, 1000)):
        assert (B.tree_counts(1000, 1000, lo, hi, keys) == whole[:, lo:hi]).all()


def test_counted_bootstrap_against_drawn_samples(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(int(c), g, float(v)) for g in ("a", "b") for c, v in zip(rng.integers(0, 25, 400), rng.normal(size=400) + (g == "b"))]
    df = spark.createDataFrame(rows, "c int, g string, v double")
    sums = {"s": F.col("v"), "n": F.lit(1)}
    got = {r.g: r for r in B.counted_bootstrap(df, "c", sums, F.expr("s / n"), ["g"], 3000, 5).collect()}
    for g in ("a", "b"):
        per = np.zeros((25, 2))
        for c, h, v in rows:
            if h == g:
                per[c] += (v, 1)
        per = per[per[:, 1] > 0]
        pick = rng.integers(0, len(per), (20_000, len(per)))
        stat = per[pick, 0].sum(1) / per[pick, 1].sum(1)
        lo, hi = np.quantile(stat, [0.025, 0.975])
        assert got[g].point == pytest.approx(per[:, 0].sum() / per[:, 1].sum()) and got[g].n_valid == 3000
        assert (got[g].lo, got[g].hi) == pytest.approx((lo, hi), abs=0.15 * (hi - lo))
    one = B.counted_bootstrap(df.where("c = 3 AND g = 'a'"), "c", sums, F.expr("s / n"), [], 50, 5).first()
    assert one.lo == one.hi == one.point
    assert B.counted_bootstrap(df.where("false"), "c", sums, F.expr("s / n"), ["g"], 50, 5).isEmpty()


def test_runs_of_equal_clusters_cost_one_range():
    keys, rng = B.replicate_keys(4, 2, 40), np.random.default_rng(5)
    ends = np.unique(rng.integers(1, 1000, 30))
    ends = np.append(ends[ends < 1000], 1000)
    values = rng.normal(size=(len(ends), 2))
    counts = B.tree_counts(1000, 1000, 0, 1000, keys)
    which = np.searchsorted(ends, np.arange(1000), "right")
    assert np.allclose(B.tree_sums(1000, 1000, ends, 0, values, keys), counts @ values[which])
    for a, b in [(0, 7), (7, 20), (20, len(ends))]:
        lo = int(ends[a - 1]) if a else 0
        mine = (which >= a) & (which < b)
        assert np.allclose(B.tree_sums(1000, 1000, ends[a:b], lo, values[a:b], keys), counts[:, mine] @ values[which[mine]])
    # A million equal clusters are one range, whatever is drawn.
    assert (B.tree_sums(10**6, 10**6, np.array([10**6]), 0, np.array([[2.0]]), keys) == 2e6).all()


def test_row_bootstrap_spreads_its_draws(spark):
    df = spark.createDataFrame([("a", 30, 100), ("b", 5000, 9000), (None, 0, 3), ("c", 0, 0)], "g string, k long, n long")
    want = {}
    for g, k, n in (("a", 30, 100), ("b", 5000, 9000), (None, 0, 3)):
        v = sorted(np.mean(R.slot_draws(5, rep, 0, n) % n < k) for rep in range(80))
        want[g] = (pytest.approx(v[2]), pytest.approx(v[77]))
    assert {r.g: (r.lo, r.hi) for r in R.row_bootstrap_proportion(df, "k", "n", ["g"], 80, 5).collect()} == want
    assert R.slot_draws(5, 7, 3, 6).tolist() == [r.x for r in spark.range(3, 6).select(draw(5, F.lit(7), F.col("id")).alias("x")).collect()]
    sizes = spark.createDataFrame([(50_000,)], "k long")
    blocks = R.draw_blocks(sizes, 200, 50_000)
    blocks.collect()
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
