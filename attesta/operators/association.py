"""Correlation, covariate-adjusted association and spatial nulls.

Samples are rows with packed ARRAY<DOUBLE> blocks. Tasks multiply tiles of columns over blocks of rows
and pass on partial sums only (see `tiles`), so samples and columns can grow without limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attesta.functions.numeric import clean, draw, normal_upper, student_t_p
from attesta.operators import pairwise as P
from attesta.operators import tiles as T
from attesta.operators.ordered import average_rank, ring_positions, value_counts
from attesta.operators.rings import shifted_products
from attesta.session import stage


# --- rank correlation --------------------------------------------------------------------------


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation per group over rows where both are present."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    pearson = both.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))
    r = average_rank(average_rank(both, keys, x, "__rx"), keys, y, "__ry")
    rho = r.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"))
    return pearson.join(rho, list(keys)) if keys else pearson.join(F.broadcast(rho))


def listwise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def ranked(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add average ranks `r_<col>` for every column, on listwise complete rows."""
    out = rows = listwise(df, cols)
    for c in cols:
        out = average_rank(out, keys, c, f"r_{c}", among=rows)
    return out


def _partial_r(pairs: dict, x: str, y: str, given: tuple[str, ...]) -> Column:
    """Recursive first-order formula; a covariate that does not vary adjusts nothing."""
    if not given:
        return pairs[frozenset((x, y))]
    z, rest = given[-1], given[:-1]
    rxy, rxz, ryz = (_partial_r(pairs, a, b, rest) for a, b in ((x, y), (x, z), (y, z)))
    left = (F.lit(1.0) - rxz * rxz) * (F.lit(1.0) - ryz * ryz)
    return F.when(left > 1e-24, (rxy - rxz * ryz) / F.sqrt(left))


@F.pandas_udf(DoubleType())
def _partial_by_inverse(upper: pd.Series) -> pd.Series:
    """Partial correlation of the first two variables from the upper triangle of a correlation matrix."""
    if not len(upper):
        return pd.Series([], dtype=float)
    tri = np.stack(upper.to_numpy()).astype(float)
    k = int((1 + math.isqrt(1 + 8 * tri.shape[1])) // 2)
    full = np.tile(np.eye(k), (len(tri), 1, 1))
    i, j = np.triu_indices(k, 1)
    full[:, i, j] = full[:, j, i] = tri
    # Residual covariance of the pair given the rest; the pseudo-inverse copes with collinear covariates.
    top, cross, rest = full[:, :2, :2], full[:, :2, 2:], full[:, 2:, 2:]
    cov = top - cross @ np.linalg.pinv(rest, rcond=1e-10, hermitian=True) @ np.swapaxes(cross, 1, 2)
    den = np.sqrt(np.clip(cov[:, 0, 0], 0, None) * np.clip(cov[:, 1, 1], 0, None))
    return pd.Series(np.where(den > 1e-12, cov[:, 0, 1] / np.where(den > 1e-12, den, 1.0), np.nan))


def partial_from_sums(x: str, y: str, given: Sequence[str], sums: Sequence[tuple[str, str]]) -> Column:
    """Partial correlation from columns `__a__b` of sums of products of centred columns."""
    of = {frozenset(p): F.col("__%s__%s" % p) for p in sums}
    names = [x, y, *given]
    pairs = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            den = F.sqrt(of[frozenset((a,))] * of[frozenset((b,))])
            pairs[frozenset((a, b))] = F.when(den > 0, of[frozenset((a, b))] / den).otherwise(F.lit(0.0))
    if len(given) <= 2:
        return _partial_r(pairs, x, y, tuple(given))
    return _partial_by_inverse(F.array(*pairs.values()))


def partial_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, given: Sequence[str]) -> DataFrame:
    """Partial Pearson correlation of x and y given covariates, from pairwise moments of one aggregate.

    Up to two covariates use the closed formula; more use a small matrix inverse per group.
    """
    names = [x, y, *given]
    aggs, pairs = [], {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            aggs.append(F.corr(a, b).alias(f"__{a}__{b}"))
            pairs[frozenset((a, b))] = F.coalesce(F.nanvl(F.col(f"__{a}__{b}"), F.lit(0.0)), F.lit(0.0))
    g = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n"))
    if len(given) <= 2:
        return g.select(*keys, "n", _partial_r(pairs, x, y, tuple(given)).alias("partial_r"))
    return g.select(*keys, "n", _partial_by_inverse(F.array(*pairs.values())).alias("partial_r"))


def partial_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, given: Sequence[str]) -> DataFrame:
    r = ranked(df.select(*keys, x, y, *given), [x, y, *given], keys)
    return partial_correlation(r, keys, f"r_{x}", f"r_{y}", [f"r_{g}" for g in given])


# --- spatial null ------------------------------------------------------------------------------


def shift_offset(policy: str, seed: int, rep: Column, part: Column, size: Column, margin: int = 20) -> Column:
    """Ring offset per (replicate, partition).

    screen: at least 10 places either way on rings above 20, any non-zero shift on 3 to 20.
    any: any non-zero shift. margin: at least `margin` places either way; shorter rings are left out by the caller.
    """
    d = draw(seed, rep, part)
    if policy == "screen":
        return F.when(size > 20, d % (size - 19) + 10).when(size > 2, d % (size - 1) + 1).otherwise(F.lit(0))
    if policy == "any":
        return F.when(size > 1, d % (size - 1) + 1).otherwise(F.lit(0))
    if policy == "margin":
        return d % (size - (2 * margin - 1)) + margin
    raise ValueError(policy)


def spatial_null(
    df: DataFrame, part: str, order: Sequence[str], x: str, y: str, given: Sequence[str], reps: int, seed: int,
    shift_with_x: Sequence[str] = (), policy: str = "screen", by: Sequence[str] = (), rank: bool = True, margin: int = 20,
) -> DataFrame:
    """Partial rank correlation against circular shifts of the predictor inside partitions.

    With the margin policy, partitions of fewer than 2 * margin + 1 rows are in neither the null nor the observed value.

    Ranks do not change under shifts, so they are computed once. The sums of products under every shift come from
    `rings`; a replicate then is a lookup and a sum over partitions. Rows without a partition take no part.
    `by` runs several independent tests (arms) in the same job.
    """
    cols = [x, y, *given]
    if policy == "margin":
        rows = listwise(df.select(*by, part, *order, *cols), cols)
        long = rows.groupBy(*by, part).count().where(F.col("count") >= 2 * margin + 1).drop("count")
        df = rows.join(long, [*by, part], "left_semi")
    df = df.where(F.col(part).isNotNull())
    if rank:
        base = ranked(df.select(*by, part, *order, *cols), cols, by)
        name = {c: f"r_{c}" for c in cols}
    else:
        base = listwise(df.select(*by, part, *order, *cols), cols)
        name = {c: c for c in cols}
    names = list(dict.fromkeys(name[c] for c in cols))
    moving = list(dict.fromkeys([name[x], *[name[g] for g in shift_with_x]]))
    fixed = [c for c in names if c not in moving]
    # Shifting changes neither a column's moments nor the products of columns that move together. Centred columns
    # leave no large sums to subtract, and the rest of a replicate is one sum of products a pair and partition.
    ring = stage(ring_positions(base.select(*by, part, *order, *names), [*by, part], order), "ring")
    means = ring.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in names])
    ring = ring.join(means, list(by)) if by else ring.join(F.broadcast(means))
    ring = ring.select(*by, part, "ring_pos", "ring_len", *[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in names])
    observed = partial_correlation(ring, by, name[x], name[y], [name[g] for g in given]).withColumnRenamed("partial_r", "observed")
    pair = lambda a, b: F.sum(F.col(a) * F.col(b))
    kept = [(a, b) for k, a in enumerate(names) for b in names[k:] if (a in moving) == (b in moving)]
    still = ring.groupBy(*by).agg(*[pair(a, b).alias(f"__{a}__{b}") for a, b in kept])
    sizes = ring.select(*by, part, "ring_len").distinct()
    offset = shift_offset(policy, seed, F.col("rep"), F.col(part), F.col("ring_len"), margin)
    shifts = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select(*by, part, "rep", offset.alias("offset"))
    moved = shifted_products(ring, [*by, part], moving, fixed, shifts)
    cross = [(a, b) for a in moving for b in fixed]
    null = moved.groupBy(*by, "rep").agg(*[F.sum(F.col("s")[k]).alias(f"__{a}__{b}") for k, (a, b) in enumerate(cross)])
    null = null.join(still, list(by)) if by else null.join(F.broadcast(still))
    null = null.select(*by, "rep", partial_from_sums(name[x], name[y], [name[g] for g in given], [*kept, *cross]).alias("partial_r"))
    # A shift can reproduce the observed arrangement; count equal values as ties despite rounding.
    j = null.join(observed.drop("n"), list(by)) if by else null.join(F.broadcast(observed.drop("n")))
    eps = 1e-12
    tails = j.groupBy(*by).agg(
        ((1 + F.count_if(F.col("partial_r") <= F.col("observed") + eps)) / F.lit(1 + reps)).alias("p_neg"),
        ((1 + F.count_if(F.col("partial_r") >= F.col("observed") - eps)) / F.lit(1 + reps)).alias("p_pos"),
        F.avg("partial_r").alias("null_mean"), F.stddev_pop("partial_r").alias("null_sd"),
    )
    out = observed.join(tails, list(by)) if by else observed.join(F.broadcast(tails))
    return out.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")))


def spatial_nulls(
    df: DataFrame, part: str, order: Sequence[str], tests: dict[str, tuple[str, str, Sequence[str], Sequence[str]]], reps: int, seed: int, policy: str = "screen",
) -> DataFrame:
    """`spatial_null` for several tests of ranked columns over the same complete rows: arm -> (x, y, given, shift_with_x).

    Rings are laid once, a column is transformed once and a pair of columns is summed once for all arms; the arms share
    their shifts.
    """
    names = list(dict.fromkeys(c for x, y, given, _ in tests.values() for c in (x, y, *given)))
    base = listwise(df.where(F.col(part).isNotNull()).select(part, *order, *names), names)
    ring = stage(ring_positions(base, [part], order), "ring")
    means = ring.agg(*[F.avg(c).alias(f"__m_{c}") for c in names])
    ring = ring.join(F.broadcast(means)).select(part, "ring_pos", "ring_len", *[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in names])
    still, cross, arms = {}, {}, {}
    for arm, (x, y, given, with_x) in tests.items():
        mine, moving = [x, y, *given], {x, *with_x}
        pairs = [(a, b) for k, a in enumerate(mine) for b in mine[k:]]
        shifted = [(a, b) if a in moving else (b, a) for a, b in pairs if (a in moving) != (b in moving)]
        arms[arm] = x, y, given, pairs, shifted
        still |= {frozenset(p): p for p in pairs}
        cross |= dict.fromkeys(shifted)
    at_rest = {k: f"__s{i}" for i, k in enumerate(still)}
    sums = stage(ring.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(at_rest[k]) for k, (a, b) in still.items()]), "sums")  # one row
    sizes = ring.select(part, "ring_len").distinct()
    offset = shift_offset(policy, seed, F.col("rep"), F.col(part), F.col("ring_len"))
    shifts = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select(part, "rep", offset.alias("offset"))
    moved = shifted_products(ring, [part], list(dict.fromkeys(a for a, _ in cross)), list(dict.fromkeys(b for _, b in cross)), shifts, pairs=list(cross))
    at = {p: f"__c{k}" for k, p in enumerate(cross)}
    moved = stage(moved.groupBy("rep").agg(*[F.sum(F.col("s")[k]).alias(c) for k, c in enumerate(at.values())]), "moved")  # a row a replicate
    eps, out = 1e-12, None
    for arm, (x, y, given, pairs, shifted) in arms.items():
        rest = {p: F.col(at_rest[frozenset(p)]) for p in pairs}
        column = lambda p: "__%s__%s" % p
        observed = sums.where("n > 0").select("n", *[c.alias(column(p)) for p, c in rest.items()]).select("n", partial_from_sums(x, y, given, pairs).alias("observed"))
        kept = [p for p in pairs if p not in shifted and p[::-1] not in shifted]
        null = moved.join(F.broadcast(sums)).select("rep", *[rest[p].alias(column(p)) for p in kept], *[F.col(at[p]).alias(column(p)) for p in shifted])
        null = null.select(partial_from_sums(x, y, given, [*kept, *shifted]).alias("partial_r"))
        tails = null.join(F.broadcast(observed)).agg(
            ((1 + F.count_if(F.col("partial_r") <= F.col("observed") + eps)) / F.lit(1 + reps)).alias("p_neg"),
            ((1 + F.count_if(F.col("partial_r") >= F.col("observed") - eps)) / F.lit(1 + reps)).alias("p_pos"),
            F.avg("partial_r").alias("null_mean"), F.stddev_pop("partial_r").alias("null_sd"),
        )
        got = observed.join(F.broadcast(tails)).select(F.lit(arm).alias("arm"), "n", "observed", "p_neg", "p_pos", "null_mean", "null_sd")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")))


# --- two-sample tests --------------------------------------------------------------------------


def _exact_less(u: float, n1: int, n2: int) -> float:
    """P(U <= u) without ties, from the generating function prod (1 - q^(n2 + i)) / (1 - q^i), i = 1..n1.

    Only the smaller tail is summed, so a large arm costs n1 passes over at most n1 * n2 / 2 numbers.
    """
    if n1 > n2:
        n1, n2 = n2, n1
    u = math.floor(u)
    if u > n1 * n2 / 2:
        return 1.0 - _exact_less(n1 * n2 - u - 1, n1, n2)
    if u < 0:
        return 0.0
    ways = np.zeros(u + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i <= u:
            ways[n2 + i :] -= ways[: u + 1 - n2 - i].copy()
        rows = -(-(u + 1) // i)
        ways = np.pad(ways, (0, rows * i - u - 1)).reshape(rows, i).cumsum(axis=0).ravel()[: u + 1]
    return float(ways.sum() / math.comb(n1 + n2, n1))


@F.pandas_udf(DoubleType())
def _mw_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([_exact_less(a, int(b), int(c)) if b == b and b > 0 else np.nan for a, b, c in zip(u, n1, n2)])


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, positive: str, min_arm: int = 3) -> DataFrame:
    """One-sided test that positives rank lower; NULL p below `min_arm` rows in either arm.

    Exact without ties when an arm has at most 8 rows, otherwise normal with tie and continuity correction.
    """
    ok = df.where(F.col(value).isNotNull() & F.col(positive).isNotNull()).select(*keys, value, positive)
    ties = value_counts(ok, keys, value).groupBy(*keys).agg(
        F.sum(F.col("__n").cast("double") * (F.col("__n") * F.col("__n") - 1)).alias("tie_term")
    )
    r = average_rank(ok, keys, value, "rk")
    g = r.groupBy(*keys).agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg"), F.sum(F.when(F.col(positive), F.col("rk"))).alias("rank_sum"),
    )
    g = (g.join(ties, list(keys)) if keys else g.join(F.broadcast(ties))).withColumn(
        "u", F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    )
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = (F.col("u") + 0.5 - n1 * n2 / 2) / F.nullif(sd, F.lit(0.0))
    small = (F.least("n_pos", "n_neg") <= 8) & (F.col("tie_term") == 0)
    enough = (F.col("n_pos") >= min_arm) & (F.col("n_neg") >= min_arm)
    g = g.withColumns({"__small": small & enough, "__z": z})
    exact = _mw_exact(F.when(F.col("__small"), F.col("u")), F.when(F.col("__small"), n1), F.when(F.col("__small"), n2))
    g = g.withColumns({"__exact": exact, "__normal": normal_upper(-F.coalesce(F.col("__z"), F.lit(0.0)))})
    p = F.when(F.col("__small"), F.col("__exact")).when(enough, F.col("__normal"))
    return g.withColumn("p_less", p).drop("__small", "__z", "__exact", "__normal", "rank_sum")


# --- covariate design --------------------------------------------------------------------------


def covariate_design(
    df: DataFrame, row_id: str, categorical: Sequence[str] = (), continuous: Sequence[str] = (), log1p: Sequence[str] = (),
    flags: Sequence[str] = (), min_level: int = 3,
) -> tuple[DataFrame, list[str]]:
    """(row_id, c ARRAY<DOUBLE>) with intercept, level indicators, standardised values and flags.

    Level tables, medians and SDs come from aggregates; the number of levels with at least
    `min_level` rows bounds the width of the array.
    """
    n = df.count()
    cols, names = [F.lit(1.0)], ["intercept"]
    for c in categorical:
        level = F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
        counts = df.groupBy(level.alias("lv")).count().where(F.col("count") >= min_level)
        # One column a level: the caller asks for as many covariates as there are levels.
        levels = sorted((r["lv"], r["count"]) for r in counts.collect())
        if len(levels) < 2:
            continue
        dropped = max(levels, key=lambda t: (t[1], t[0]))[0]
        for lv, _ in levels:
            if lv != dropped:
                cols.append((level == lv).cast("double"))
                names.append(f"{c}={lv}")
    from attesta.operators.ordered import quantiles

    for c in [*log1p, *continuous]:
        v = F.log1p(c) if c in log1p else F.col(c).cast("double")
        present = df.select(v.alias("v"))
        row = quantiles(present, [], "v", {"med": 0.5}, "m").first()
        if row is None or row["m"] == 0:
            continue
        filled = F.coalesce(v, F.lit(row["med"]))
        s = df.select(filled.alias("v")).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).first()
        if s["sd"] > 0:
            cols.append((filled - s["mu"]) / s["sd"])
            names.append(c)
        if min_level <= n - row["m"] <= n - min_level:
            cols.append(v.isNull().cast("double"))
            names.append(f"{c}:imputed")
    for c in flags:
        f = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        total = df.agg(F.sum(f)).first()[0]
        if 0 < total < n:
            cols.append(f)
            names.append(c)
    return df.select(row_id, F.array(*cols).alias("c")), names


# --- all-pairs association ---------------------------------------------------------------------


def _block(pdf: pd.DataFrame, col: str) -> np.ndarray:
    """Rows' arrays as one matrix; Arrow hands missing elements over as NaN."""
    return np.stack(pdf[col].to_numpy()).astype(float)


def few_tasks(df: DataFrame) -> DataFrame:
    """At most four tasks per core, merged without a shuffle, so partial sums stay few on a huge scan."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def associate(
    df: DataFrame, x: str | Column, y: str | Column, c: str, x_names: Sequence[str], y_names: Sequence[str], min_df: int = 20, joint_share: float = 0.8
) -> DataFrame:
    """Covariate-adjusted association of every x column with every y column, one row a pair.

    When at least `joint_share` of the rows have all of x, those rows serve all columns; otherwise every pair uses the
    rows that both of its columns have. Pairs with fewer than `min_df` degrees of freedom are left out.
    """
    return P.every_pair(association_sums(df, x, y, c, len(x_names), len(y_names), min_df, joint_share), x_names, y_names, min_df)


def associate_significant(
    df: DataFrame, x: str | Column, y: str | Column, c: str, x_names: Sequence[str], y_names: Sequence[str], alpha: float, among=None, min_df: int = 20, joint_share: float = 0.8
) -> DataFrame:
    """The rows of `associate` whose BH q over all pairs is at most alpha, with q; other pairs are never written."""
    return P.significant(association_sums(df, x, y, c, len(x_names), len(y_names), min_df, joint_share), x_names, y_names, alpha, min_df, among)


def association_sums(df: DataFrame, x: str | Column, y: str | Column, c: str, n_x: int, n_y: int, min_df: int = 20, joint_share: float = 0.8) -> P.Sums:
    """The stored sums behind `associate`; `df` is evaluated once. Rows without covariates take no part.

    Arrays made from narrower columns come as Column: then the rows of `df` are stored as they are, and the arrays are
    made where they are multiplied.
    """
    rows = df.where(F.col(c).isNotNull())
    made = isinstance(x, Column) or isinstance(y, Column)
    arrays = [T.whole_rows(F.col(v) if isinstance(v, str) else v, n).alias(k) for v, n, k in ((x, n_x, "x"), (y, n_y, "y"))]
    if made:
        data = stage(rows, "assoc", T.GROUP_MB).select(*arrays, F.col(c).alias("c"))
    else:
        data = stage(rows.select(*arrays, F.col(c).alias("c")), "assoc", T.GROUP_MB)
    complete = ~F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v))
    shares = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("ok"), F.max(F.size("c")).alias("width")).first()
    joint = shares["ok"] >= joint_share * shares["n"]
    sums = P.all_sums(data.where(complete) if joint else data, "x", "y", "c", n_x, n_y, shares["width"] or 0, shares["ok"] if joint else shares["n"])
    if joint:
        most = sums.each(lambda xs, ys, s: pa.record_batch([pa.array([s["df"].max(initial=-1.0)])], ["df"]), "df double").agg(F.max("df")).first()[0]
        if most is None or most < min_df:
            raise ValueError(f"df too small: {most}")
    return sums


def _statistics(s: DataFrame) -> DataFrame:
    ident = F.col("sxx") > F.greatest(F.lit(P.IDENT_FRACTION) * F.col("sxx_raw"), F.lit(P.IDENT_FLOOR))
    beta = F.when(ident, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    denom = F.sqrt(F.col("sxx") * F.col("syy"))
    r = F.when(ident & (denom > 0), F.greatest(F.lit(-P.R_CLIP), F.least(F.lit(P.R_CLIP), F.col("sxy") / denom))).otherwise(F.lit(0.0))
    s = s.withColumns({"beta": beta, "r": r, "__ident": ident})
    t = F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r")))
    resvar = F.greatest(F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx"), F.lit(0.0)) / F.col("df")
    se = F.when(F.col("__ident"), F.sqrt(resvar / F.col("sxx"))).otherwise(F.lit(float("inf")))
    s = s.withColumns({"t": t, "se": se})
    return s.withColumn("p", student_t_p("t", "df")).drop("sxy", "sxx", "sxx_raw", "syy", "__ident")


def test_pairs(
    df: DataFrame, x: str, y: str, c: str, pairs: Sequence[tuple[str, int, int]], tier: str, min_n: int = 20, min_pos: int = 5, min_df: int = 10
) -> DataFrame:
    """Held-out test of listed (pair, x index, y index) in every tier; NULL statistics mean not tested.

    The pair list is the frozen selection, so it is small; rows stay distributed and each task
    adds up per-(tier, pair) moments of its own rows.
    """
    data = stage(df.select(tier, x, y, c), "pairs")
    width = data.select(F.size(c).alias("w")).first()["w"]
    k = len(pairs)
    xi, yi = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
    w2 = width * width
    cols = w2 + 2 * width + 6

    def per_tier(fn, ncol):
        def run(batches):
            acc: dict = {}
            for pdf in batches:
                for name, g in pdf.groupby(tier):
                    part = fn(name, _block(g, x)[:, xi], _block(g, y)[:, yi], _block(g, c))
                    acc[name] = part if name not in acc else acc[name] + part
            for name, m in acc.items():
                i, j = np.nonzero(m)
                yield pd.DataFrame({"tier": str(name), "i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j]})

        return few_tasks(data).mapInPandas(run, "tier string, i int, j int, v double").groupBy("tier", "i", "j").agg(F.sum("v").alias("v"))

    def first(_, X, Y, C):
        ok = np.isfinite(X) & np.isfinite(Y)
        M, X0, Y0 = ok.astype(float), np.where(ok, X, 0), np.where(ok, Y, 0)
        cc = np.einsum("nf,nr,ns->frs", M, C, C).reshape(k, w2)
        return np.hstack([cc, X0.T @ C, Y0.T @ C, np.column_stack([
            M.sum(0), X0.sum(0), Y0.sum(0), (ok & (X == 1)).sum(0), (ok & (X == 0)).sum(0), np.zeros(k)])])

    sums = per_tier(first, cols).toPandas()  # tiers x pairs x covariates^2 numbers
    coef, info = {}, []
    for name, g in sums.groupby("tier"):
        m = np.zeros((k, cols))
        m[g["i"], g["j"]] = g["v"]
        b = np.zeros((k, 2, width))
        for f in range(k):
            W, rank = P.orthonormal(m[f, :w2].reshape(width, width))
            b[f] = [W @ (W.T @ m[f, w2 : w2 + width]), W @ (W.T @ m[f, w2 + width : w2 + 2 * width])]
            n = m[f, -6]
            info.append((name, f, int(n), int(m[f, -3]), int(m[f, -2]), float(n - rank - 1)))
        coef[name] = (b, m[:, -5] / np.maximum(m[:, -6], 1), m[:, -4] / np.maximum(m[:, -6], 1))

    def second(name, X, Y, C):
        b, mx, my = coef[str(name)]
        ok = np.isfinite(X) & np.isfinite(Y)
        xr, yr = np.where(ok, X - C @ b[:, 0].T, 0), np.where(ok, Y - C @ b[:, 1].T, 0)
        return np.column_stack([(xr * yr).sum(0), (xr * xr).sum(0), (np.where(ok, X - mx, 0) ** 2).sum(0), (yr * yr).sum(0), (np.where(ok, Y - my, 0) ** 2).sum(0)])

    s = per_tier(second, 5)
    wide = s.groupBy("tier", "i").agg(*[
        F.coalesce(F.sum(F.when(F.col("j") == j, F.col("v"))), F.lit(0.0)).alias(nm) for j, nm in enumerate(("sxy", "sxx", "sxx_raw", "syy", "syy_raw"))])
    spark = df.sparkSession
    names = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, pair string")
    meta = spark.createDataFrame(info, "tier string, i int, n bigint, n_pos bigint, n_neg bigint, df double")
    j = meta.join(names, "i").join(wide, ["tier", "i"], "left").fillna(0.0, ["sxy", "sxx", "sxx_raw", "syy", "syy_raw"])
    out = _statistics(j.withColumn("dep_sd", F.sqrt(F.col("syy_raw") / F.col("n")))).drop("i", "syy_raw")
    tested = (F.col("n") >= min_n) & (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_pos) & (F.col("df") >= min_df)
    return out.withColumns({v: F.when(tested, F.col(v)) for v in ("beta", "r", "t", "se", "p")})


test_pairs.__test__ = False  # not a pytest case


def correlation_matrix(df: DataFrame, x: str, names: Sequence[str], missing: str = "zero") -> DataFrame:
    """(a, b, r) for all column pairs a < b; pairs in which a column has no variance are left out.

    A missing cell counts as zero over all rows (`zero`), or a pair uses the rows that have both (`pairwise`). Only
    pairs of tiles on or above the diagonal are multiplied; a task holds two tiles, and no task all columns.
    """
    if missing not in ("zero", "pairwise"):
        raise ValueError(missing)
    tiles = [np.arange(at, min(at + T.COLUMNS, len(names))) for at in range(0, len(names), T.COLUMNS)]
    whole = T.whole_rows(F.col(x), len(names))
    data = df.select((F.transform(whole, lambda v: F.coalesce(clean(v), F.lit(0.0))) if missing == "zero" else whole).alias("x"))

    def own(_, v):
        there = np.isfinite(v)
        return np.concatenate([np.where(there, v, 0.0).sum(0), there.sum(0).astype(float)])

    cells = T.cut(data, [("x", tiles)], None, own)
    blocks = max(1, cells.where("tile = 0").count())
    groups = T.groups_of(blocks)
    # Centring by means keeps the sums of products accurate; any constant gives the same r.
    sums = T.added(cells.select("side", "tile", F.pmod(F.xxhash64("block"), F.lit(blocks)).cast("int").alias("g"), F.col("own").alias("v")), ["side", "tile"], blocks)
    side = cells.drop("own", "c").join(stage(sums.select("tile", F.col("v").alias("fit")), "means"), "tile")

    def multiply(a: pa.Table, b: pa.Table) -> np.ndarray | None:
        def parts(table):
            for block, v, fit in zip(*(table.column(c).to_pylist() for c in ("block", "v", "fit"))):
                total, n = np.frombuffer(fit, float).reshape(2, -1)
                v = np.frombuffer(v, float).reshape(-1, len(n)) - total / np.maximum(n, 1)
                there = np.isfinite(v)
                yield block, (np.where(there, v, 0.0), there.astype(float))

        right, total = dict(parts(b)), None
        for block, (v, w) in parts(a):
            if block in right:
                u, z = right[block]
                part = np.stack([w.T @ z, v.T @ z, w.T @ u, (v * v).T @ z, w.T @ (u * u), v.T @ u])
                total = part if total is None else total + part
        return total

    last = len(tiles) - 1
    made = T.cells(side, side, F.sequence("tile", F.lit(last)), F.sequence(F.lit(0), "tile"), groups, multiply)

    def finish(batches):
        for batch in batches:
            for i, j, v in zip(*(batch.column(k).to_pylist() for k in ("i", "j", "v"))):
                n, sa, sb, qa, qb, ab = np.frombuffer(v, float).reshape(6, len(tiles[i]), len(tiles[j]))
                with np.errstate(all="ignore"):
                    va, vb = qa - sa * sa / n, qb - sb * sb / n
                    r = (ab - sa * sb / n) / np.sqrt(va * vb)
                ok = (va > 1e-12 * qa) & (vb > 1e-12 * qb) & np.isfinite(r) & (tiles[i][:, None] < tiles[j])
                p, q = np.nonzero(ok)
                yield pa.record_batch([pa.array(tiles[i][p].astype(np.int32)), pa.array(tiles[j][q].astype(np.int32)), pa.array(r[p, q])], ["a", "b", "r"])

    return T.added(made, ["i", "j"], groups).select("i", "j", "v").mapInArrow(finish, "a int, b int, r double")
