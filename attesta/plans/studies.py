"""Whole analyses composed from the operators: screens, confirmation, sensitivity arms, the contact pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import numeric as N
from attesta.operators import association as A
from attesta.operators import contacts as C
from attesta.operators import joins as J
from attesta.operators import ordered as O
from attesta.operators import rings as R
from attesta.operators import selection as S
from attesta.session import stage


def welch_lower(df: DataFrame, keys: Sequence[str], value: str, case: Column, control: Column, minimum_effect: float = 0.5, min_n: int = 3):
    """Lower-tail Welch test of mean(case) - mean(control) + minimum_effect; zero variance or small arms give p = 1."""
    v = F.col(value)
    arm = lambda c, f: f(F.when(c, v))
    g = df.groupBy(*keys).agg(
        arm(case, F.avg).alias("m1"), arm(case, F.var_samp).alias("v1"), arm(case, F.count).alias("n1"),
        arm(control, F.avg).alias("m0"), arm(control, F.var_samp).alias("v0"), arm(control, F.count).alias("n0"),
    )
    ok = (F.col("n1") >= min_n) & (F.col("n0") >= min_n) & (F.least("v1", "v0") > 0)
    g = g.withColumn("w", N.welch(F.col("m1"), F.col("v1"), F.col("n1"), F.col("m0"), F.col("v0"), F.col("n0"), minimum_effect))
    g = g.select(*keys, (F.col("m1") - F.col("m0")).alias("delta"), F.when(ok, F.col("w.t")).alias("t"), F.when(ok, F.col("w.df")).alias("df"))
    p = N.student_t_lower(F.coalesce("t", F.lit(0.0)), F.coalesce("df", F.lit(1.0)))
    return g.withColumn("__p", p).withColumn("p_lower", F.when(F.col("t").isNull(), 1.0).otherwise(F.col("__p"))).drop("__p")


def intersection_union(tests: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """A claim over several clones is as strong as its weakest: the largest p."""
    return tests.groupBy(*keys).agg(F.max(p).alias("p_max"), F.count(F.lit(1)).alias("n_tests"))


def panel_direction(panel: DataFrame, measures: DataFrame, symbol: str, contrasts: Sequence[Column]) -> DataFrame:
    """Check a frozen panel's predicted down direction; repeated and absent symbols are statuses, not failures."""
    down = F.lit(True)
    for c in contrasts:
        down = down & (c < 0)
    g = measures.groupBy(symbol).agg(F.count(F.lit(1)).alias("k"), F.bool_and(down).alias("down"))
    j = panel.join(g, symbol, "left")
    status = (
        F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "ambiguous").when(F.col("down"), "corroborated").otherwise("not_corroborated")
    )
    return j.select(symbol, status.alias("status"), (status == "corroborated").alias("pass"))


def association_study(samples: DataFrame, dims: int, per_outcome: int = 3, quota: int = 40) -> DataFrame:
    """Screen, BH over all pairs, capped selection, held-out tests, replication rule.

    The only global barrier is the q-value; the selected list is capped by its quota, so it can
    be frozen on the driver and sent to the held-out pass.
    """
    s = stage(samples, "samples")
    xs, ys = [f"x{i}" for i in range(dims)], [f"y{i}" for i in range(dims)]
    disc = A.associate(s.where("vec_id % 2 = 0"), "x", "y", "c", xs, ys)
    disc = O.benjamini_hochberg(disc.where(F.substring("feature", 2, 9) != F.substring("outcome", 2, 9)), "p")
    cand = disc.withColumn("beta_lb", S.lower_bound(F.col("beta"), F.col("se"))).withColumn("pair", F.concat_ws("~", "feature", "outcome"))
    cand = cand.withColumn("stratum", F.when(F.col("beta") > 0, "up").otherwise("down"))
    sel = S.greedy_capped(cand, "pair", "stratum", {"up": quota, "down": quota}, "beta_lb", {"outcome": per_outcome, "feature": per_outcome})
    sel = stage(sel.select("pair", "feature", "outcome", "stratum", "beta", "beta_lb", "q"), "selected")
    sd = s.where("vec_id % 2 = 0").select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.stddev_pop("v").alias("disc_sd"))
    frozen = sel.select("pair", F.substring("feature", 2, 9).cast("int").alias("xi"), F.substring("outcome", 2, 9).cast("int").alias("yi")).orderBy("pair").limit(2 * quota).collect()
    hold = A.test_pairs(s.where("vec_id % 2 = 1").withColumn("tier", F.lit("A")), "x", "y", "c", [tuple(r) for r in frozen], "tier")
    hold = hold.select("pair", F.col("beta").alias("hold_beta"), F.col("p").alias("hold_p"), "dep_sd")
    j = sel.withColumn("k", F.substring("outcome", 2, 9).cast("int")).join(sd, "k").join(hold, "pair", "left")
    rep = N.replicated(F.col("beta"), F.col("beta_lb"), F.col("disc_sd"), F.col("hold_beta"), F.col("hold_p"), F.col("dep_sd"))
    out = j.select("pair", "stratum", "beta", "beta_lb", "q", "hold_beta", "hold_p", rep.alias("replicated"))
    return out.withColumns({c: F.round(c, 9) for c in ("beta", "beta_lb", "q", "hold_beta", "hold_p")})


def split_screen(
    tiles: DataFrame, part: str, order: Sequence[str], features: Sequence[str], covariates: Sequence[str], number: Column, reps: int, seed: int,
    min_rho: float = 0.05, p_max: float = 0.05,
) -> DataFrame:
    """Discovery on odd partitions; survivors confirmed on even ones, Bonferroni by their number.

    All pairs of one half are stacked as arms and tested in a single job.
    """
    base = stage(tiles.withColumn("__odd", number % 2 == 1), "tiles")
    pairs = J.fold_pairs(features, features)

    def arms(df, chosen):
        rows = F.array(*[F.struct(F.lit(a).alias("predictor"), F.lit(b).alias("outcome"), F.col(a).cast("double").alias("__x"), F.col(b).cast("double").alias("__y")) for a, b in chosen])
        return df.select(part, *order, *covariates, F.inline(rows))

    def run(df, chosen, s):
        return A.spatial_null(arms(df, chosen), part, order, "__x", "__y", covariates, reps, s, by=["predictor", "outcome"])

    disc = stage(run(base.where("__odd"), pairs, seed), "discovery")
    hit = (F.abs("observed") >= min_rho) & (F.least("p_neg", "p_pos") <= p_max)
    found = {(r["predictor"], r["outcome"]) for r in disc.where(hit).select("predictor", "outcome").collect()}  # at most one row per pair of columns
    survivors = [p for p in pairs if p in found]
    d = disc.select("predictor", "outcome", F.col("observed").alias("disc_rho"), hit.alias("survived"))
    if not survivors:
        return d.withColumns({"conf_rho": F.lit(None).cast("double"), "p_directional": F.lit(None).cast("double"), "confirmed": F.lit(False)})
    conf = run(base.where("NOT __odd"), survivors, seed + 1).select("predictor", "outcome", F.col("observed").alias("conf_rho"), "p_neg", "p_pos")
    j = d.join(conf, ["predictor", "outcome"], "left")
    p = F.when(F.col("disc_rho") < 0, F.col("p_neg")).otherwise(F.col("p_pos"))
    ok = (F.signum("disc_rho") * F.col("conf_rho") >= min_rho) & (p <= p_max / len(survivors))
    return j.select("predictor", "outcome", "disc_rho", "survived", "conf_rho", p.alias("p_directional"), F.coalesce(ok, F.lit(False)).alias("confirmed"))


def _sensitivity(tiles: DataFrame, part: str, order: Sequence[str], x: str, y: str, base: str, reps: int, seed: int, flexible: bool) -> DataFrame:
    """Arms of one contrast. They have the same complete rows, so a column is ranked once and all arms share one ring."""
    num = stage(tiles.select(part, *order, *[F.col(c).cast("double").alias(c) for c in (x, y, base)]), "tracks")
    z = O.partition_zscore(O.partition_zscore(num, [part], x, "zx"), [part], y, "zy")
    # Written once: sums of doubles can differ in their last bits from one evaluation to the next, and ranks are joined by value.
    z = stage(O.rank_spline(z, [], base) if flexible else z, "scores")
    r = A.ranked(z, [x, y, base, "zx", "zy"])
    rx, ry, rb = f"r_{x}", f"r_{y}", f"r_{base}"
    tests = {"raw": (rx, ry, [rb], [rb]), "scale_free": ("r_zx", "r_zy", [rb], [rb]), "swapped": (ry, rx, [rb], [rb])}
    if flexible:
        tests["flexible"] = (rx, ry, ["u1", "u2", "u3", "k1", "k2", "k3"], [])
    return A.spatial_nulls(r, part, order, tests, reps, seed)


def sensitivity_arms(tiles: DataFrame, part: str, order: Sequence[str], x: str, y: str, base: str, reps: int, seed: int) -> DataFrame:
    """One contrast under several arms: raw, per-partition standardised, and swapped roles (placebo direction)."""
    return _sensitivity(tiles, part, order, x, y, base, reps, seed, False)


def sensitivity_grid(tiles: DataFrame, part: str, order: Sequence[str], x: str, y: str, base: str, reps: int, seed: int) -> DataFrame:
    """The arms of `sensitivity_arms`, and one that adjusts for a flexible curve of the base."""
    return _sensitivity(tiles, part, order, x, y, base, reps, seed, True)


def hashed_normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller from two hash draws of the key."""
    u1 = (N.draw(seed, *keys, F.lit("a")) + 0.5) / F.lit(2.0**32)
    u2 = (N.draw(seed, *keys, F.lit("b")) + 0.5) / F.lit(2.0**32)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def _rank_correlations(df: DataFrame, key: str, value: str, other: str, size: str, spread: float) -> DataFrame:
    """(key, rho) of the ranks of a value with centred ranks `other` of given sum of squares; no row is joined again."""
    folded = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.sum(other).alias("o"), F.max(size).alias("m"))
    r = O.Ordered(folded, [key], [value]).running({"hi": ("sum", F.col("n"))}).rows()
    r = r.withColumn("r", F.col("hi") - (F.col("n") - 1) / 2 - (F.col("m") + 1) / 2)
    rho = F.try_divide(F.sum(F.col("r") * F.col("o")), F.sqrt(F.sum(F.col("n") * F.col("r") * F.col("r")) * F.lit(spread)))
    return r.groupBy(key).agg(rho.alias("rho"))


def noise_matched(df: DataFrame, keys: Sequence[str], sim: str, ref: str, observed: str, seed: int, rounds: int = 4, steps: int = 16) -> DataFrame:
    """Noise scale at which sim + noise tracks the reference as well as the observed track does.

    Rank correlation falls with the scale, so the bracket is narrowed by testing `steps` scales in
    one job per round.
    """
    rows = A.listwise(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in (sim, ref, observed)]), [sim, ref, observed])
    rows = O.average_rank(rows.withColumn("e", hashed_normal(seed, *[F.col(k) for k in keys])), [], ref, "__r", "__n")
    # Ranks of the reference are the same at every scale; centred, they are summed where the other ranks are found.
    rows = stage(rows.withColumn("__r", F.col("__r") - (F.col("__n") + 1) / 2), "noise")
    spread = rows.agg(F.sum(F.col("__r") * F.col("__r"))).first()[0]
    target = A.spearman(rows, [], observed, ref).first()["spearman"]
    lo, hi = 0.0, 20.0 * rows.agg(F.stddev_pop(sim)).first()[0]
    for _ in range(rounds):
        grid = [lo + (hi - lo) * (k + 1) / (steps + 1) for k in range(steps)]
        noisy = rows.select("__r", "__n", F.explode(F.array(*[F.lit(g) for g in grid])).alias("s"), F.col(sim).alias("v"), "e").withColumn("v", F.col("v") + F.col("s") * F.col("e"))
        rho = {r["s"]: r["rho"] for r in _rank_correlations(noisy, "s", "v", "__r", "__n", spread).collect()}
        above = [g for g in grid if rho[g] > target]
        lo, hi = (above[-1] if above else lo), next((g for g in grid if not above or g > above[-1]), hi)
    scale = (lo + hi) / 2
    got = A.spearman(rows.withColumn("v", F.col(sim) + F.lit(scale) * F.col("e")), [], "v", ref)
    return got.select(F.lit(scale).alias("noise_sd"), F.lit(target).alias("target_rho"), F.col("spearman").alias("matched_rho"), "n")


def _fine_with_gaps(ring: DataFrame, shifts: DataFrame, part: str, tile: str, x: str, y: str, z: str, min_count: int) -> DataFrame:
    """(rep, n, partial_r) where missing values make the rows of a tile differ from shift to shift."""
    cols = [x, y, z]
    moved = ring.select(part, "ring_pos", x).join(shifts, part)
    moved = moved.select(part, "rep", F.pmod(F.col("ring_pos") + F.col("offset"), F.col("ring_len")).alias("ring_pos"), x)
    here = moved.join(ring.select(part, tile, "ring_pos", y, z), [part, "ring_pos"])
    w = Window.partitionBy("rep", part, tile)  # a tile is a stretch of fixed length
    resid = A.listwise(here, cols).select("rep", *[(F.col(c) - F.avg(c).over(w)).alias(f"d_{c}") for c in cols], F.count(F.lit(1)).over(w).alias("k")).where(F.col("k") >= min_count)
    resid = stage(resid, "resid")  # ranks are joined by value, so sums of doubles must not be made twice
    return A.partial_spearman(resid, ["rep"], f"d_{x}", f"d_{y}", [f"d_{z}"])


def _fine_whole(ring: DataFrame, shifts: DataFrame, part: str, tile: str, x: str, y: str, z: str, min_count: int) -> DataFrame:
    """(rep, n, partial_r) without missing values: tiles, y and z stay, so their ranks are found once for all shifts.

    Tiles that are no stretches of the ring, or longer than a task's stretch, are left to the general form.
    """
    w = Window.partitionBy(part, tile)
    placed = ring.select(part, "ring_pos", F.min("ring_pos").over(w).alias("tile_from"), F.max("ring_pos").over(w).alias("last"), F.count(F.lit(1)).over(w).alias("k"), *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in (x, y, z)])
    placed = stage(placed.where(F.col("k") >= min_count), "still")
    if placed.agg(F.max((F.col("last") - F.col("tile_from") >= F.col("k")) | (F.col("k") > R.STRETCH))).first()[0]:
        return _fine_with_gaps(ring, shifts, part, tile, x, y, z, min_count)
    ranks = A.ranked(placed.select(part, "tile_from", "ring_pos", x, y, z), [y, z])
    size = ranks.count()
    double = lambda c: (2 * F.col(c) - (size + 1)).cast("long")
    ranks = stage(ranks.select(part, "tile_from", "ring_pos", x, double(f"r_{y}").alias("ry"), double(f"r_{z}").alias("rz")), "still")
    buckets = -(-size // R.RANKED)
    splits = ranks.agg(F.percentile_approx(x, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    sums = R.shifted_rank_sums(ring, part, x, ranks, shifts, "ry", "rz", sorted(set(splits)))
    own = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b)) / 4
    fixed = ranks.agg(own("ry", "ry").alias("__y__y"), own("rz", "rz").alias("__z__z"), own("ry", "rz").alias("__y__z"))
    sums = sums.select("rep", "n", F.col("xx").alias("__x__x"), F.col("xy").alias("__x__y"), F.col("xz").alias("__x__z"))
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("z", "z"), ("y", "z")]
    return sums.join(F.broadcast(fixed)).select("rep", "n", A.partial_from_sums("x", "y", ["z"], pairs).alias("partial_r"))


def fine_coarse(df: DataFrame, part: str, tile: str, order: Sequence[str], x: str, y: str, z: str, min_count: int, reps: int, seed: int, margin: int = 50) -> DataFrame:
    """Within-tile and between-tile partial rank correlation of x and y given z.

    The null shifts x itself round its partition, by `margin` places at least, and only then takes tile means out: means
    and ranks of shifted values differ from shift to shift. Rows with a missing value are places of the ring, but
    neither they nor places that receive a missing value count. Partitions of fewer than 2 * margin + 1 rows and tiles
    with fewer than `min_count` rows are in no value.
    """
    cols = [x, y, z]
    rows = df.where(F.col(part).isNotNull()).select(part, tile, *order, *[F.col(c).cast("double").alias(c) for c in cols])
    ring = stage(O.ring_positions(rows, [part], order).where(F.col("ring_len") >= 2 * margin + 1), "fine")
    offset = F.when(F.col("rep") > 0, A.shift_offset("margin", seed, F.col("rep"), F.col(part), F.col("ring_len"), margin)).otherwise(F.lit(0))
    shifts = ring.select(part, "ring_len").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("offset", offset)
    gaps = ring.where(F.greatest(*[F.col(c).isNull() for c in cols])).limit(1).count()
    shift = _fine_with_gaps if gaps else _fine_whole
    rho = stage(shift(ring, shifts, part, tile, x, y, z, min_count), "rho")
    null = rho.where("rep > 0").agg(F.avg("partial_r").alias("m"), F.stddev_pop("partial_r").alias("sd"))
    fine = rho.where("rep = 0").join(F.broadcast(null)).select(
        F.lit("fine").alias("scale"), "n", F.col("partial_r").alias("rho"), F.try_divide(F.col("partial_r") - F.col("m"), F.col("sd")).alias("z")
    )
    means = A.listwise(rows, cols).groupBy(part, tile).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_count)
    coarse = A.partial_spearman(stage(means, "means"), [], x, y, [z]).select(F.lit("coarse").alias("scale"), "n", F.col("partial_r").alias("rho"), F.lit(None).cast("double").alias("z"))
    return fine.unionByName(coarse)


def contact_compartments(pairs: DataFrame, keys: Sequence[str], pos1: str, pos2: str, width: int, density: DataFrame, min_nnz: int = 10, max_rounds: int = 200):
    """Contacts to oriented first eigenvector for every (sample, partition) in one run.

    `density` holds (keys, i, density).
    """
    m = stage(C.bin_pairs(pairs, keys, pos1, pos2, width), "contacts")
    balanced, bias = C.balance(m, keys, min_nnz, max_rounds)
    mask = bias.select(*keys, "i")
    oe = C.observed_over_expected(stage(balanced, "balanced"), mask, keys)
    pc1 = C.leading_eigenvector(oe, mask, keys)
    j = pc1.join(density, [*keys, "i"], "left")
    return O.orient(j, keys, "pc1", "density", min_rho=0.2, min_rows=3)
