"""Cases that once lost data or answered wrongly."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attesta.functions.numeric import exact_mean
from attesta.operators import aggregates, association, contacts, intervals, ordered, selection
from attesta.plans import studies
from attesta.plans.queries_aggregates import long_matrix


def test_greedy_capped_with_null_groups(spark):
    rows = [(i, "s" if i % 2 else "t", None if i % 10 < 3 else i % 4, i % 5, float(i * 37 % 101)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, stratum string, a int, b int, score double")
    for batch in (2, 5, 1000):
        got = {r.id for r in selection.greedy_capped(df, "id", "stratum", {"s": 10, "t": 6}, "score", {"a": 2, "b": 4}, batch).collect()}
        left, used, want = {"s": 10, "t": 6}, {}, set()
        for i, s, a, b, _ in sorted(rows, key=lambda r: (r[1], -r[4], r[0])):
            if left[s] and used.get(("a", a), 0) < 2 and used.get(("b", b), 0) < 4:
                want.add(i)
                left[s] -= 1
                used["a", a], used["b", b] = used.get(("a", a), 0) + 1, used.get(("b", b), 0) + 1
        assert got == want


@pytest.mark.parametrize("missing", ["zero", "pairwise"])
def test_correlation_matrix_with_missing_cells(spark, missing):
    rng = np.random.default_rng(3)
    v = rng.normal(1e3, 1, (200, 5)) @ np.diag([1, 2, 1, 3, 1])
    v[:, 1] += v[:, 0]
    v[:, 4] = 7.0
    gone = rng.random(v.shape) < 0.2
    cells = [[None if g else float(x) for x, g in zip(r, m)] for r, m in zip(v, gone)]
    df = spark.createDataFrame([(r,) for r in cells] + [(None,)], "x array<double>").repartition(5)
    got = {(r.a, r.b): r.r for r in association.correlation_matrix(df, "x", list("abcde"), missing).collect()}
    filled, there = np.where(gone, 0.0, v), ~gone
    filled, there = np.vstack((filled, np.zeros(5))), np.vstack((there, np.zeros(5, bool)))
    for a, b in itertools.combinations(range(5), 2):
        both = there[:, a] & there[:, b] if missing == "pairwise" else np.ones(len(filled), bool)
        if missing == "pairwise" and b == 4:
            assert (a, b) not in got
        else:
            assert got[a, b] == pytest.approx(np.corrcoef(filled[both, a], filled[both, b])[0, 1], abs=1e-9)


def test_exact_mann_whitney_tail():
    for n1, n2 in ((1, 1), (3, 5), (4, 9), (5, 6)):
        us = [sum(r) - n1 * (n1 + 1) // 2 for r in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(-1, n1 * n2 + 1):
            assert association._exact_less(u, n1, n2) == pytest.approx(sum(x <= u for x in us) / len(us), abs=1e-12)
    # With many controls the exact tail meets the normal one, far beyond any arm size once allowed.
    n1, n2 = 8, 5000
    z = 1.5
    u = n1 * n2 / 2 - z * math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert association._exact_less(u, n1, n2) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=0.05)


def test_size_factors_take_the_median_of_ratios(spark):
    n = {"a": (1, 8, 9), "b": (4, 2, 9), "c": (3, 3, 3), "d": (10, 1, 2)}
    rows = [(f, f"L{k}", x) for f, xs in n.items() for k, x in enumerate(xs)]
    got = dict(aggregates.size_factors(spark.createDataFrame(rows, "feature string, library string, n int"), "feature", "library", "n").collect())
    ratios = np.array([[x / math.prod(xs) ** (1 / 3) for x in xs] for xs in n.values()])
    f = np.median(ratios, axis=0)
    f /= np.exp(np.log(f).mean())
    assert [got[f"L{k}"] for k in range(3)] == pytest.approx(f.tolist())


def test_contrast_counts_absent_cells_as_zero(spark):
    full = [("a", "c1", 5), ("a", "c2", 7), ("a", "k1", 3), ("a", "k2", 0), ("b", "c1", 5), ("b", "c2", 0), ("b", "k1", 7), ("b", "k2", 10)]
    frame = lambda rows: spark.createDataFrame(rows, "feature string, library string, n int")
    run = lambda rows: sorted(aggregates.normalised_contrast(frame(rows), "feature", "library", "n", F.col("library").startswith("c")).collect())
    for a, b in zip(run(full), run([r for r in full if r[2]]), strict=True):
        assert list(a[1:4]) == pytest.approx(list(b[1:4])) and a[4] == b[4]


def test_overlapping_intervals_are_refused(spark):
    iv = spark.createDataFrame([("x", 0, 10, 1.0), ("x", 9, 20, 2.0)], "chrom string, s long, e long, v double")
    sizes = spark.createDataFrame([("x", 100)], "chrom string, length long")
    with pytest.raises(ValueError, match="overlap"):
        intervals.tile_means(iv, sizes, [], "chrom", "s", "e", "v", "length", 50)
    apart = iv.withColumn("s", F.when(F.col("s") == 9, 10).otherwise(F.col("s")))
    assert intervals.tile_means(apart, sizes, [], "chrom", "s", "e", "v", "length", 20).first()["mean"] == pytest.approx(1.5)


def test_eigenvector_without_a_gap(spark):
    rng = np.random.default_rng(11)
    n = 60
    oe = np.exp(rng.normal(0, 0.3, (n, n)))
    oe = (oe + oe.T) / 2
    rows = [("x", i, j, float(oe[i, j])) for i in range(n) for j in range(i, n)]
    mask = spark.createDataFrame([("x", i) for i in range(n)], "chrom string, i long")
    df = spark.createDataFrame(rows, "chrom string, i long, j long, oe double")
    got = {r.i: r for r in contacts.leading_eigenvector(df, mask, ["chrom"]).collect()}
    value, vector = np.linalg.eigh(np.corrcoef(oe))
    v = vector[:, -1] / vector[:, -1].std()
    v *= -1 if v.sum() < 0 else 1
    assert [got[i].pc1 for i in range(n)] == pytest.approx(v.tolist(), abs=1e-4)
    assert got[0].eigen_share == pytest.approx(value[-1] / n, rel=1e-6)
    with pytest.raises(RuntimeError):
        contacts.leading_eigenvector(df, mask, ["chrom"], max_rounds=2)


def test_means_on_a_threshold_do_not_hang_on_the_order(spark):
    cents = [9, 0, 10, 1, 3, 4] * 5  # mean 0.045: the threshold itself
    for k in range(6):
        rows = [(c / 100,) for c in np.random.default_rng(k).permutation(cents).tolist()]
        df = spark.createDataFrame(rows, "v double").repartition(3)
        assert df.agg(exact_mean(F.col("v")).alias("m")).first().m == 0.045
    odd = spark.createDataFrame([("a", 0.1), ("a", None), ("a", 0.2), ("b", None), ("c", math.inf), ("c", 1.0), ("d", math.nan), ("e", 1e300), ("e", 3e300)], "g string, v double")
    got = {r.g: r.m for r in odd.groupBy("g").agg(exact_mean(F.col("v")).alias("m")).collect()}
    assert got["a"] == 0.15 and got["b"] is None and got["c"] == math.inf and math.isnan(got["d"]) and got["e"] == 2e300


def test_quantile_map_rounds_as_it_is_written(spark):
    df = spark.createDataFrame([(float(k), y) for k, y in enumerate([25.1, 25.895, 25.9, 26.7, 27.3])], "x double, y double")
    ys, m = sorted([25.1, 25.895, 25.9, 26.7, 27.3]), 5
    got = {r.x: r.mapped for r in ordered.quantile_map(df, [], "x", "y").collect()}
    for k in range(m):
        h = (k + 1 - 0.5) / m * (m - 1)
        a, b = ys[math.floor(h)], ys[math.ceil(h)]
        assert got[float(k)] == a + (b - a) * (h - math.floor(h))


def test_matched_controls_do_not_hang_on_how_rows_are_dealt(spark):
    rows = [(i, "ab"[i % 2], 900 + i * 389 % 1000 / 10, i % 20 < 2, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, part string, price double, anchor boolean, y double").cache()
    want = None
    for n in (1, 3, 5, 13, 21):
        dealt = df.repartition(n, F.xxhash64("id", F.lit(n)))
        found = intervals.matched_controls(dealt, "id", "part", "id", ["price"], F.col("anchor"), "y", 0, 3)
        got = sorted((r.anchor_id, r.matched_difference) for r in found.collect())
        want = want or got
        assert got == want and len(got) == 200


def test_sample_qc_reads_its_rows_once(spark):
    rng = np.random.default_rng(5)
    cells = {(s, p, k): None if rng.random() < 0.1 else int(rng.integers(0, 40)) + k * (s != 3) for s in range(5) for p in "ab" for k in range(60) if rng.random() < 0.9}
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame([(*c, v) for c, v in cells.items()], "sample int, part string, pos int, raw long")
    df = df.withColumn("v", counted("raw")).withColumn("ref", F.col("sample") < 3)
    got = {(r.sample, r.part): r for r in aggregates.sample_qc(df, "sample", "part", "pos", "v", "ref", 0.3, 20, 1).collect()}
    assert seen.value == len(cells)
    for s, p in itertools.product(range(5), "ab"):
        xy = []
        for (a, b, k), v in cells.items():
            others = [cells[t, p, k] for t in range(3) if t != s and cells.get((t, p, k)) is not None]
            if (a, b) == (s, p) and v is not None and others:
                xy.append((v, sum(others) / len(others)))
        ranks = [[sum(w < v for w in c) + (sum(w == v for w in c) + 1) / 2 for v in c] for c in zip(*xy)]
        rho = np.corrcoef(*ranks)[0, 1]
        assert got[s, p].n == len(xy) and got[s, p].rho == pytest.approx(rho, abs=1e-9) and got[s, p].failed == (rho < 0.3)
    assert all(r.partition_excluded and r.run_failed for r in got.values())


def test_sensitivity_grid_reads_its_rows_once(spark):
    rng = np.random.default_rng(12)
    some = lambda v: None if rng.random() < 0.1 else round(float(v), 1)
    rows = [(f"c{k % 4}", k, some(v[0]), some(v[0] + v[1]), some(v[1] + v[2])) for k, v in enumerate(rng.normal(size=(200, 3)))]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame(rows, "part string, pos int, x0 double, y double, z double").cache()
    got = {r.arm: r for r in studies.sensitivity_grid(df.withColumn("x", counted("x0")), "part", ["pos"], "x", "y", "z", 39, 3).collect()}
    assert seen.value == len(rows)
    one = lambda d, a, b, g, w, **k: association.spatial_null(d, "part", ["pos"], a, b, g, 39, 3, w, **k).first()
    num = df.withColumnRenamed("x0", "x")
    scored = ordered.partition_zscore(ordered.partition_zscore(num, ["part"], "x", "zx"), ["part"], "y", "zy").cache()
    curve = association.ranked(ordered.rank_spline(num, [], "z"), ["x", "y"])
    want = {
        "raw": one(num, "x", "y", ["z"], ["z"]), "swapped": one(num, "y", "x", ["z"], ["z"]), "scale_free": one(scored, "zx", "zy", ["z"], ["z"]),
        "flexible": one(curve, "r_x", "r_y", ["u1", "u2", "u3", "k1", "k2", "k3"], [], rank=False),
    }
    assert set(got) == set(want)
    for arm, w in want.items():
        for c in ("n", "observed", "p_neg", "p_pos", "null_mean", "null_sd", "z"):
            assert got[arm][c] == pytest.approx(w[c], rel=1e-7, abs=1e-9)


def test_means_on_thresholds_do_not_hang_on_how_rows_are_dealt(spark, tmp_path):
    """Discounts around the threshold in many small files: the mean of a cell adds them up as they are stored."""
    rng = np.random.default_rng(12)
    rows = [(p, p % 20, float(v) / 100) for v in rng.integers(0, 11, 30) for p in range(200)]
    for k in range(24):
        part = rows[k * len(rows) // 24 : (k + 1) * len(rows) // 24]
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.table(list(zip(*part)), ["l_partkey", "l_suppkey", "l_discount"]), tmp_path / f"lineitem.parquet/p{k:02d}.parquet")
    pq.write_table(pa.table([list(range(200)), [f"b{p // 20}" for p in range(200)], [1] * 200], ["p_partkey", "p_brand", "p_size"]), tmp_path / "part.parquet")
    sums = {}
    for p, s, v in rows:
        total, n = sums.get((s, f"b{p // 20}:1"), (0.0, 0))
        sums[s, f"b{p // 20}:1"] = total + v, n + 1
    want = {k: total / n * 20 - 1.4 for k, (total, n) in sums.items()}
    for dealt in (None, 1 << 12):
        with_bytes = {"spark.sql.files.maxPartitionBytes": dealt, "spark.sql.files.openCostInBytes": 0} if dealt else {}
        for k, v in with_bytes.items():
            spark.conf.set(k, v)
        try:
            got = {(r.row_id, r.col_id): r.value for r in long_matrix(spark, str(tmp_path)).collect()}
        finally:
            for k in with_bytes:
                spark.conf.unset(k)
        assert got == want
