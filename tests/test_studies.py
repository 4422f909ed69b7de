"""Whole studies on planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import rings as rings_of
from attesta.plans import studies


@pytest.fixture(scope="module")
def tracks(spark):
    """Ten partitions of 120 places: y follows x, w is noise, base shifts both."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(1, 11):
        x, base, e, w = (rng.normal(size=120) for _ in range(4))
        for k in range(120):
            rows.append((f"Part#{c}", c, k, float(x[k] + base[k]), float(0.8 * x[k] + base[k] + 0.5 * e[k]), float(w[k]), float(base[k])))
    return spark.createDataFrame(rows, "chrom string, number int, pos int, x double, y double, w double, base double").cache()


def test_split_screen_confirms_the_planted_pair(tracks):
    got = {(r.predictor, r.outcome): r for r in studies.split_screen(tracks, "chrom", ["pos"], ["x", "y", "w"], ["base"], F.col("number"), 99, 5).collect()}
    hit = next(r for k, r in got.items() if set(k) == {"x", "y"})
    assert hit.survived and hit.confirmed and hit.disc_rho > 0.5 and hit.conf_rho > 0.5 and hit.p_directional <= 0.05
    assert not any(r.confirmed for k, r in got.items() if "w" in k)


def test_sensitivity_grid_arms_agree(tracks):
    got = {r.arm: r for r in studies.sensitivity_grid(tracks, "chrom", ["pos"], "x", "y", "base", 99, 9).collect()}
    assert set(got) == {"raw", "scale_free", "swapped", "flexible"}
    assert all(r.observed > 0.5 and r.p_pos == pytest.approx(0.01) and r.z > 3 for r in got.values())
    none = {r.arm: r for r in studies.sensitivity_grid(tracks, "chrom", ["pos"], "w", "y", "base", 99, 9).collect()}
    assert all(abs(r.observed) < 0.15 for r in none.values())


def test_noise_matches_the_observed_correlation(tracks):
    r = studies.noise_matched(tracks.withColumn("seen", F.col("x") + F.col("w")), ["chrom", "pos"], "x", "y", "seen", 3, 6).first()
    assert r.n == 1200 and r.noise_sd > 0 and r.matched_rho == pytest.approx(r.target_rho, abs=1e-3)


def test_fine_and_coarse_scales(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(4):
        level = np.repeat(rng.normal(size=12) * 3, 10)
        fine, z = rng.normal(size=120), rng.normal(size=120)
        for k in range(120):
            rows.append((f"c{c}", k // 10, k, float(level[k] + fine[k]), float(level[k] - fine[k] + 0.3 * rng.normal()), float(z[k])))
    rows += [("short", 0, k, float(k), float(k), 0.0) for k in range(60)]
    df = spark.createDataFrame(rows, "chrom string, tile int, pos int, x double, y double, z double")
    got = {r.scale: r for r in studies.fine_coarse(df, "chrom", "tile", ["pos"], "x", "y", "z", 5, 50, 21).collect()}
    assert got["fine"].rho < -0.8 and got["fine"].z < -3 and got["coarse"].rho > 0.5
    assert got["fine"].n == 480  # a partition too short to be shifted by the margin is in neither value


def test_association_study_replicates_planted_effects(spark):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 2, (600, 6)).astype(float)
    y = rng.normal(size=(600, 6))
    y[:, 1] += 1.5 * x[:, 0]
    y[:, 3] -= 1.5 * x[:, 2]
    s = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist(), [1.0]) for k in range(600)], "vec_id long, x array<double>, y array<double>, c array<double>")
    got = {r.pair: r for r in studies.association_study(s, 6, 2, 3).collect()}
    assert got["x0~y1"].replicated and got["x0~y1"].stratum == "up"
    assert got["x2~y3"].replicated and got["x2~y3"].stratum == "down"
    assert sum(bool(r.replicated) for r in got.values()) <= 3


def test_fine_scale_without_gaps_equals_the_general_form(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", k // 10, k, float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.integers(0, 5))) for c in range(3) for k in range(123)]
    df = spark.createDataFrame(rows, "chrom string, tile int, pos int, x double, y double, z double")
    run = lambda: {r.scale: r for r in studies.fine_coarse(df, "chrom", "tile", ["pos"], "x", "y", "z", 5, 20, 21).collect()}
    whole = run()
    monkeypatch.setattr(studies, "_fine_whole", studies._fine_with_gaps)
    general = run()
    assert whole["fine"].n == general["fine"].n == 360
    assert (whole["fine"].rho, whole["fine"].z) == pytest.approx((general["fine"].rho, general["fine"].z), rel=1e-9)


@pytest.mark.parametrize("equal", [True, False])
def test_ranks_of_shifted_values_in_small_stretches(spark, equal):
    rng = np.random.default_rng(6)
    rings, rows, shifts = {"a": 143, "b": 37, "c": 64}, [], []
    still = []
    for name, size in rings.items():
        x = rng.integers(-4, 5, size) if equal else rng.normal(size=size)
        rows += [(name, k, float(x[k])) for k in range(size)]
        shifts += [(name, size, rep, int(rng.integers(1, size)) if rep else 0) for rep in range(6)]
        # Tiles of seven places; every fourth one does not count.
        still += [(name, k, k // 7 * 7) for k in range(size // 7 * 7) if k // 7 % 4 != 2]
    y, z = (2 * rng.permutation(len(still)) - len(still) + 1 for _ in range(2))
    frame = lambda r, t: spark.createDataFrame(r, t).repartition(3)
    args = [frame(rows, "part string, ring_pos int, x double"), "part", "x", frame([(*r, int(a), int(b)) for r, a, b in zip(still, y, z)], "part string, ring_pos int, tile_from int, y long, z long")]
    out = rings_of.shifted_rank_sums(*args, frame(shifts, "part string, ring_len int, rep int, offset int"), "y", "z", [-1.0, 0.0, 0.25], 16).collect()
    value = {(p, k): v for p, k, v in rows}
    assert sorted(r.rep for r in out) == list(range(6))
    for r in out:
        offset = {p: (size, o) for p, size, rep, o in shifts if rep == r.rep}
        moved = {(p, k): value[p, (k - offset[p][1]) % offset[p][0]] for p, k, _ in still}
        mean = {t: np.mean([moved[p, k] for p, k, f in still if (p, f) == t]) for t in {(p, f) for p, _, f in still}}
        v = np.array([moved[p, k] - mean[p, f] for p, k, f in still])
        rank = (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) - 1) / 2
        rank -= rank.mean()
        assert (r.n, r.xx, r.xy, r.xz) == pytest.approx((len(v), rank @ rank, rank @ y / 2, rank @ z / 2))


def test_fine_scale_with_broken_or_long_tiles_takes_the_general_form(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"c{c}", k % 9, k, *map(float, rng.normal(size=3))) for c in range(2) for k in range(110)]
    df = spark.createDataFrame(rows, "chrom string, tile int, pos int, x double, y double, z double")
    run = lambda d: {r.scale: r for r in studies.fine_coarse(d, "chrom", "tile", ["pos"], "x", "y", "z", 5, 10, 21).collect()}["fine"]
    stretches = df.withColumn("tile", F.floor(F.col("pos") / 11))
    broken, whole = run(df), run(stretches)
    monkeypatch.setattr(rings_of, "STRETCH", 10)
    long = run(stretches)
    assert (long.n, long.rho, long.z) == pytest.approx((whole.n, whole.rho, whole.z), rel=1e-9)
    monkeypatch.setattr(studies, "_fine_whole", studies._fine_with_gaps)
    general = run(df)
    assert (broken.n, broken.rho, broken.z) == pytest.approx((general.n, general.rho, general.z), rel=1e-9)
