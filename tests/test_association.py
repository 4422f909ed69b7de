"""Association, selection and rank tests against independent formulas and planted signals."""

import math
import pathlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attesta.functions import numeric as N
from attesta.operators import association as A
from attesta.operators import ordered as O
from attesta.operators import selection as S
from attesta.operators import tiles as T
from attesta.operators.rings import shifted_products
from attesta.session import shared_dir, stage


def samples(spark, n=400, p=6, q=5, seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 4, n)
    c = np.column_stack([np.ones(n), *[(group == g).astype(float) for g in (1, 2, 3)], (group == 1).astype(float)])  # repeated column
    x = (rng.random((n, p)) < 0.3).astype(float)
    y = rng.normal(size=(n, q)) + group[:, None] * 0.5
    y[:, 2] -= 0.9 * x[:, 1]  # planted
    xm = x.copy()
    if missing:
        xm[rng.random((n, p)) < missing] = np.nan
    rows = [(i, [None if math.isnan(v) else float(v) for v in xm[i]], y[i].tolist(), c[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, c array<double>").repartition(5)
    return df, xm, y, c


def ols(x, y, c):
    ok = np.isfinite(x)
    x, y, c = x[ok], y[ok], c[ok]
    q, s, _ = np.linalg.svd(c, full_matrices=False)
    q = q[:, s > s[0] * max(c.shape) * np.finfo(float).eps]
    xr, yr = x - q @ (q.T @ x), y - q @ (q.T @ y)
    df = len(x) - q.shape[1] - 1
    beta = xr @ yr / (xr @ xr)
    se = math.sqrt(((yr - beta * xr) ** 2).sum() / df / (xr @ xr))
    return beta, se, df


@pytest.mark.parametrize("missing", [0.0, 0.25])
def test_associate_matches_least_squares(spark, missing):
    df, x, y, c = samples(spark, missing=missing)
    out = A.associate(df, "x", "y", "c", [f"x{i}" for i in range(6)], [f"y{j}" for j in range(5)]).collect()
    assert len(out) == 30
    for r in out:
        beta, se, dof = ols(x[:, int(r.feature[1:])], y[:, int(r.outcome[1:])], c)
        assert r.df == dof
        assert r.beta == pytest.approx(beta, abs=1e-10) and r.se == pytest.approx(se, rel=1e-8)
        t = beta / se
        assert r.t == pytest.approx(t, rel=1e-6)
    best = min(out, key=lambda r: r.p)
    assert (best.feature, best.outcome) == ("x1", "y2") and best.beta < -0.5


def small_tiles(monkeypatch):
    for name, value in (("ROWS", 37), ("COLUMNS", 2), ("BLOCKS", 2), ("SUMS", 2)):
        monkeypatch.setattr(T, name, value)


def test_association_over_many_small_tiles(spark, monkeypatch):
    """Masks on both sides, several levels of partial sums, and an input that is evaluated once."""
    small_tiles(monkeypatch)
    df, x, y, c = samples(spark, n=600)
    rng = np.random.default_rng(4)
    gone_x, gone_y = rng.random((600, 6)) < 0.3, rng.random((600, 5)) < 0.2
    gone_x[:, 3], gone_y[:, 4] = gone_x[:, 1], gone_y[:, 0]  # columns of one mask
    x, y = np.where(gone_x, np.nan, x), np.where(gone_y, np.nan, y)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, *[[None if math.isnan(v) else float(v) for v in m[i]] for m in (x, y, c)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>, c array<double>").repartition(3)
    empty = spark.createDataFrame([(-1, None, None, [1.0, 0.0, 0.0, 0.0, 0.0]), (-2, [1.0] * 6, [1.0] * 5, None)], df.schema)
    df = df.mapInArrow(count, df.schema).unionByName(empty)  # rows that lack an array change nothing
    out = A.associate(df, "x", "y", "c", [f"x{i}" for i in range(6)], [f"y{j}" for j in range(5)]).collect()
    assert len(out) == 30 and seen.value == 600
    for r in out:
        xi, yj = x[:, int(r.feature[1:])], y[:, int(r.outcome[1:])]
        both = np.isfinite(yj)
        beta, se, dof = ols(xi[both], yj[both], c[both])
        assert (r.df, r.n) == (dof, (np.isfinite(xi) & both).sum())
        assert r.beta == pytest.approx(beta, abs=1e-10) and r.se == pytest.approx(se, rel=1e-8)
    masks = T.column_masks(df.where("id >= 0"), ["x", "y"])
    assert len(set(masks["x"])) == 5 and masks["x"][3] == masks["x"][1] and len(set(masks["y"])) == 4


@pytest.mark.parametrize("alpha", [0.0, 0.02, 0.3, 1.0])
def test_significant_pairs_are_those_of_the_full_table(spark, monkeypatch, alpha):
    small_tiles(monkeypatch)
    df, *_ = samples(spark, missing=0.25)
    names = [f"x{i}" for i in range(6)], [f"y{j}" for j in range(5)]
    full = O.benjamini_hochberg(A.associate(df, "x", "y", "c", *names).where("substring(feature, 2, 1) <> substring(outcome, 2, 1)"), "p").where(F.col("q") <= alpha)
    want = {(r.feature, r.outcome): (r.p, r.q) for r in full.collect()}
    got = {(r.feature, r.outcome): (r.p, r.q) for r in A.associate_significant(df, "x", "y", "c", *names, alpha, lambda a, b: a != b).collect()}
    assert got.keys() == want.keys() and (alpha == 0 or got)
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-12)


def test_no_samples(spark):
    df = spark.createDataFrame([], "x array<double>, y array<double>, c array<double>")
    with pytest.raises(ValueError):
        A.associate(df, "x", "y", "c", ["x0"], ["y0"])


def test_unidentified_column_reports_no_effect(spark):
    df, *_ = samples(spark)
    df = df.withColumn("x", F.concat(F.array(F.col("c")[1]), F.slice("x", 2, 5)))
    out = A.associate(df, "x", "y", "c", [f"x{i}" for i in range(6)], [f"y{j}" for j in range(5)])
    for r in out.where("feature = 'x0'").collect():
        assert (r.beta, r.r, r.p) == (0.0, 0.0, 1.0) and math.isinf(r.se)


def test_held_out_pairs(spark):
    df, x, y, c = samples(spark, missing=0.1)
    df = df.withColumn("tier", F.when(F.col("id") < 300, "A").otherwise("B"))
    out = {(r.tier, r.pair): r for r in A.test_pairs(df, "x", "y", "c", [("hit", 1, 2), ("none", 0, 0)], "tier").collect()}
    assert len(out) == 4
    beta, se, dof = ols(x[:300, 1], y[:300, 2], c[:300])
    r = out[("A", "hit")]
    assert r.df == dof and r.beta == pytest.approx(beta, abs=1e-10) and r.se == pytest.approx(se, rel=1e-8)
    few = A.test_pairs(df, "x", "y", "c", [("hit", 1, 2)], "tier", min_n=10_000).collect()
    assert all(r.p is None and r.beta is None for r in few)


def test_tails(spark):
    # Known values: t = 2.228 at 10 df is two-sided 0.05; binomial by exact sums.
    df = spark.createDataFrame([(2.2281388519649385, 10.0), (0.0, 5.0), (-12.706204736432095, 1.0)], "t double, df double")
    p = [r[0] for r in df.select(N.student_t_p("t", "df")).collect()]
    assert p == pytest.approx([0.05, 1.0, 0.05], abs=1e-9)
    rows = [(k, n, pr) for n in (1, 7, 30) for k in range(0, n + 2, 3) for pr in (0.1, 0.5)]
    b = spark.createDataFrame([(float(k), float(n), pr) for k, n, pr in rows], "k double, n double, p double")
    got = [r[0] for r in b.select(N.binomial_upper("k", "n", "p")).collect()]
    want = [sum(math.comb(n, i) * pr**i * (1 - pr) ** (n - i) for i in range(k, n + 1)) for k, n, pr in rows]
    assert got == pytest.approx(want, abs=1e-10)


def test_mann_whitney_exact_by_enumeration(spark):
    import itertools

    pos, neg = [0.1, 0.35, 0.6], [0.2, 0.5, 0.7, 0.9, 1.1]
    df = spark.createDataFrame([(v, True) for v in pos] + [(v, False) for v in neg], "v double, pos boolean")
    r = A.mann_whitney(df, [], "v", "pos").first()
    u_of = lambda s, rest: sum(a > b for a in s for b in rest)
    allv = pos + neg
    obs = u_of(pos, neg)
    us = [u_of([allv[i] for i in s], [allv[i] for i in range(8) if i not in s]) for s in itertools.combinations(range(8), 3)]
    assert r.u == obs and r.p_less == pytest.approx(sum(u <= obs for u in us) / len(us))


def test_partial_correlation_many_covariates(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 4))
    x, y = z @ [1, 2, 0, 1] + rng.normal(size=300), z @ [0, 1, 1, 1] + rng.normal(size=300)
    rows = [tuple(map(float, (a, b, *c))) for a, b, c in zip(x, y, z)]
    df = spark.createDataFrame(rows, "x double, y double, z0 double, z1 double, z2 double, z3 double")
    zz = np.column_stack([np.ones(300), z])
    res = lambda v: v - zz @ np.linalg.lstsq(zz, v, rcond=None)[0]
    want = np.corrcoef(res(x), res(y))[0, 1]
    assert A.partial_correlation(df, [], "x", "y", ["z0", "z1", "z2", "z3"]).first().partial_r == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("leg, block", [(0, 0), (4, 8), (16, 4)])
def test_shifted_products_for_every_shift(spark, leg, block):
    """Rings of many lengths, dealt over one or many tasks, against direct sums."""
    rng = np.random.default_rng(6)
    rings = {(n, arm): rng.normal(size=(4, n)) for n in (1, 2, 3, 16, 17, 45, 64) for arm in ("a", "b")}
    rows = [(f"r{n}", arm, k, n, *map(float, v[:, k])) for (n, arm), v in rings.items() for k in range(n)]
    ring = spark.createDataFrame(rows, "part string, arm string, ring_pos long, ring_len long, m0 double, m1 double, f0 double, f1 double")
    shifts = spark.createDataFrame([(f"r{n}", arm, s, s) for n, arm in rings for s in range(n)], "part string, arm string, rep int, offset long")
    got = {}
    for r in shifted_products(ring, ["part", "arm"], ["m0", "m1"], ["f0", "f1"], shifts, leg, block).collect():
        key = (int(r.part[1:]), r.arm, r.rep)
        got[key] = got.get(key, 0) + np.array(r.s)
    assert len(got) == sum(n for n, _ in rings)
    for (n, arm), v in rings.items():
        for s in range(n):
            want = [v[a] @ np.roll(v[2 + b], -s) for a in range(2) for b in range(2)]
            assert got[n, arm, s] == pytest.approx(want, abs=1e-9)


def test_spatial_null_recovers_planted_and_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=(8, 60)), axis=1)
    y, w = x + rng.normal(size=x.shape), rng.normal(size=x.shape)
    rows = [(f"c{c}", i, float(x[c, i]), arm, float(v[c, i])) for arm, v in (("hit", y), ("noise", w)) for c in range(8) for i in range(60)]
    df = spark.createDataFrame(rows, "chrom string, pos int, x double, arm string, v double")
    out = {r.arm: r for r in A.spatial_null(df, "chrom", ["pos"], "x", "v", [], 199, 1, by=["arm"]).collect()}
    assert out["hit"].p_pos == pytest.approx(1 / 200) and out["hit"].observed > 0.5
    rank = lambda m: (np.argsort(np.argsort(m.ravel())) + 1.0).reshape(m.shape)
    xr, wr, draws = rank(x), rank(w), np.random.default_rng(0)
    null = [np.corrcoef(np.stack([np.roll(xr[c], draws.integers(10, 51)) for c in range(8)]).ravel(), wr.ravel())[0, 1] for _ in range(3000)]
    r = out["noise"]
    assert r.observed == pytest.approx(np.corrcoef(xr.ravel(), wr.ravel())[0, 1], abs=1e-9)
    assert r.null_mean == pytest.approx(np.mean(null), abs=0.006) and r.null_sd == pytest.approx(np.std(null), rel=0.2)


def test_bh_and_holm_examples(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.324, 0.4262, 0.5719, 0.6528, 0.759, 1.0, 0.0344]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    q, run = {}, 1.0
    for rank in range(n, 0, -1):
        run = min(run, p[order[rank - 1]] * n / rank)
        q[order[rank - 1]] = run
    h, top = {}, 0.0
    for s, i in enumerate(order):
        top = max(top, min(1.0, (n - s) * p[i]))
        h[i] = top
    got = {r.i: (r.q, r.p_holm) for r in O.holm(O.benjamini_hochberg(df, "p"), "p").collect()}
    for i in range(n):
        assert got[i][0] == pytest.approx(q[i]) and got[i][1] == pytest.approx(h[i])


def greedy_rule(rows, strata, caps):
    left, used, out = dict(strata), {g: {} for g in caps}, set()
    for s in strata:
        for r in sorted((r for r in rows if r["s"] == s), key=lambda r: (-r["score"], r["id"])):
            if left[s] > 0 and all(used[g].get(r[g], 0) < c for g, c in caps.items()):
                out.add(r["id"])
                left[s] -= 1
                for g in caps:
                    used[g][r[g]] = used[g].get(r[g], 0) + 1
    return out


@pytest.mark.parametrize("seed,batch", [(1, 1000), (2, 7), (3, 3)])
def test_greedy_capped_equals_sequential_rule(spark, seed, batch):
    rnd = random.Random(seed)
    # One group holds most rows.
    rows = [{"id": i, "s": rnd.choice("ab"), "g": rnd.choice([0] * 8 + [1, 2, 3]), "d": rnd.randrange(6), "score": float(rnd.randrange(40))} for i in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, s string, g int, d int, score double")
    got = {r.id for r in S.greedy_capped(df, "id", "s", {"b": 9, "a": 7}, "score", {"g": 3, "d": 5}, batch=batch).collect()}
    assert got == greedy_rule(rows, {"b": 9, "a": 7}, {"g": 3, "d": 5})


def test_average_rank_with_one_hot_group(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.randrange(50) * 1.0, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {r.i: r["rank"] for r in O.average_rank(df, ["g"], "v").collect()}
    by = {}
    for g, v, _ in rows:
        by.setdefault(g, []).append(v)
    for g, v, i in rows:
        below, same = sum(x < v for x in by[g]), sum(x == v for x in by[g])
        assert got[i] == below + (same + 1) / 2


def test_replication_rule(spark):
    cases = [  # disc_beta, disc_lb, disc_sd, beta, p, hold_sd -> verdict
        ((-0.5, 0.3, 1.0, -0.4, 0.01, 1.0), True), ((-0.5, 0.3, 1.0, 0.4, 0.01, 1.0), False), ((-0.5, 0.3, 1.0, -0.4, 0.11, 1.0), False),
        ((-0.5, 0.9, 1.0, -0.4, 0.01, 1.0), False), ((-0.5, 0.8, 1.0, -0.4, 0.01, 1.0), True), ((-0.5, 0.3, 1.0, None, None, 1.0), None),
        ((-0.5, 0.3, 0.0, -0.1, 0.01, 1.0), True),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "a double, b double, c double, d double, e double, f double")
    got = [r[0] for r in df.select(N.replicated(*[F.col(x) for x in "abcdef"])).collect()]
    assert got == [v for _, v in cases]
    closed = df.select(N.replicated(*[F.col(x) for x in "abcdef"], fail_closed=True)).collect()[-1][0]
    assert closed is False


def test_wide_rows_reach_python_in_small_batches(spark):
    cells = lambda seed: F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.when((F.col("id") + k) % 7 != 0, F.rand(seed) + k))
    df = spark.range(0, 700, 1, 1).select("id", cells(1).alias("x"), F.slice(cells(2), 1, 300).alias("y")).cache()
    sizes = T.pieces(df, ["x", "y"], [2000, 300]).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in bs), "n long")
    assert sizes.count() > 0 and sizes.agg(F.max("n")).first()[0] <= 10_000 * T.PIECE * 9
    want = [np.array([[np.nan if v is None else v for v in r] for r in m]) for m in zip(*df.orderBy("id").select("x", "y").collect())]
    batches = T.pieces(df, ["x", "y"], [2000, 300]).toArrow().to_batches(max_chunksize=37)
    got = [np.vstack(m) for m in zip(*[[p.copy() for p in parts] for parts in T.matrices(batches, [2000, 300], 64)])]
    assert all(np.array_equal(np.sort(a, axis=0), np.sort(b, axis=0), equal_nan=True) for a, b in zip(got, want))
    with pytest.raises(ValueError, match="lengths"):
        list(T.matrices(batches, [2000, 299], 64))


def test_stored_tiles_have_small_row_groups(spark):
    df = spark.range(0, 300, 1, 1).select(F.to_binary(F.repeat(F.sha2(F.col("id").cast("string"), 256), 2000), F.lit("hex")).alias("v"))
    groups = lambda d: [pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(0).total_byte_size for f in d.inputFiles()]
    assert max(groups(stage(df, "wide", 1))) < 3 << 20 < max(groups(stage(df, "plain")))


def stored(spark):
    return {f: f.stat().st_size for f in pathlib.Path(shared_dir(spark), "attesta").glob("*/*.parquet")}


def test_wide_rows_are_multiplied_where_they_are_made(spark, monkeypatch):
    """Arrays made from narrow rows are never stored; bands of columns and tasks of few rows change no result."""
    for name, value in (("BAND", 70), ("TASK_ROWS", 100), ("COLUMNS", 32), ("SUMS", 2)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 4))
    gone = rng.random(900) < 0.2
    rows = [(r.tolist(), None if g else 1.0, [1.0, float(i % 3 == 0)]) for i, (r, g) in enumerate(zip(v, gone))]
    df = spark.createDataFrame(rows, "v array<double>, there double, c array<double>").repartition(7)
    x = F.flatten(F.transform("v", lambda u: F.array(*[(u > k / 10).cast("double") for k in range(20)])))
    y = F.flatten(F.transform("v", lambda u: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (u - k / 10) * (u - k / 10) * F.when(k < 5, F.col("there")).otherwise(1.0))))
    names = [f"x{i}" for i in range(80)], [f"y{j}" for j in range(80)]
    before = stored(spark)
    got = {(r.feature, r.outcome): r for r in A.associate(df, x, y, "c", *names).collect()}
    new = {f: n for f, n in stored(spark).items() if f not in before}
    assert not any(f.parent.name.startswith("tiles") for f in new)
    assert sum(n for f, n in new.items() if f.parent.name.startswith("assoc")) < 900 * 160 * 8 / 4
    assert len(got) == 6400
    for i, j in ((0, 0), (25, 3), (79, 64), (41, 79), (60, 22)):
        a = (v[:, i // 20] > i % 20 / 10).astype(float)
        b = (v[:, j // 20] - j % 20 / 10) ** 2
        use = ~gone if j % 20 < 5 else np.ones(900, bool)
        beta, se, dof = ols(a[use], b[use], np.array([r[2] for r in rows])[use])
        r = got[f"x{i}", f"y{j}"]
        assert (r.df, r.n) == (dof, use.sum()) and r.beta == pytest.approx(beta, rel=1e-9) and r.se == pytest.approx(se, rel=1e-8)
    assert [len(b) for b in T.bands([np.arange(32)] * 5, 2)] == [2, 2, 1]
