"""Study aggregates: replicate collapse, filters over long matrices, normalisation, verdict tables.

Matrices are long (row_id, col_id, value) tables with NULL for missing. Everything is a
partial-then-final aggregate; exact medians come from the ordered scan so that one huge
group is never gathered in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from attesta.operators import ordered as O
from attesta.session import stage


def replicate_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def replicate_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return O.quantiles(df, keys, value, {"value": 0.5}, "n")


# --- counts -----------------------------------------------------------------------------------


def presence_filter(
    counts: DataFrame, feature: str, library: str, n: str, totals: DataFrame, min_libraries: int = 4
) -> DataFrame:
    """Features above 0.26 counts per million in at least `min_libraries`, compared in integers.

    count / total * 1e6 > 0.26 is count * 1e8 > 26 * total; DECIMAL keeps the product exact.
    """
    big = "decimal(38,0)"
    j = counts.join(totals, library)
    present = F.col(n).cast(big) * F.lit(100_000_000).cast("decimal(10,0)") > F.lit(26).cast("decimal(2,0)") * F.col("total").cast(big)
    return j.groupBy(feature).agg(F.count_if(present).alias("n_present")).withColumn(
        "kept", F.col("n_present") >= min_libraries
    )


def observed_totals(counts: DataFrame, library: str, n: str) -> DataFrame:
    return counts.groupBy(library).agg(F.sum(n).alias("total"))


def normalised_contrast(counts: DataFrame, feature: str, library: str, n: str, case: Column) -> DataFrame:
    """log2(CPM + 0.5) means per arm, case minus control, and leave-one-library-out direction.

    For every feature, dropping any single library must keep the contrast negative for
    `loo_all_negative`; sums and counts per arm give all of these without a second pass. A library
    without a row for a feature has count zero there.
    """
    totals = observed_totals(counts, library, n)
    arms = counts.select(library, case.alias("is_case")).distinct().agg(F.count_if("is_case").alias("lc"), F.count_if(~F.col("is_case")).alias("l0"))
    v = F.log2(F.col(n) * F.lit(1e6) / F.col("total") + 0.5)
    x = counts.join(totals, library).select(feature, library, v.alias("v"), case.alias("is_case"))
    arm = lambda c, f: f(F.when(c, F.col("v")))
    is_case = F.col("is_case")
    s = x.groupBy(feature).agg(
        arm(is_case, F.sum).alias("sc"), F.count_if(is_case).alias("nc"),
        arm(~is_case, F.sum).alias("s0"), F.count_if(~is_case).alias("n0"),
        arm(is_case, F.max).alias("max_c"), arm(is_case, F.min).alias("min_c"),
        arm(~is_case, F.max).alias("max_0"), arm(~is_case, F.min).alias("min_0"),
    )
    # Absent cells: log2(0 + 0.5) is -1.
    s = s.join(F.broadcast(arms)).withColumns({
        "sc": F.coalesce("sc", F.lit(0.0)) - (F.col("lc") - F.col("nc")), "s0": F.coalesce("s0", F.lit(0.0)) - (F.col("l0") - F.col("n0")),
        "min_c": F.when(F.col("nc") < F.col("lc"), -1.0).otherwise(F.col("min_c")),
        "max_0": F.when(F.col("n0") < F.col("l0"), F.greatest("max_0", F.lit(-1.0))).otherwise(F.col("max_0")),
    }).withColumns({"nc": F.col("lc"), "n0": F.col("l0")})
    full = F.col("sc") / F.col("nc") - F.col("s0") / F.col("n0")
    # The largest leave-one-out contrast drops the smallest case value or the largest control value.
    drop_case = (F.col("sc") - F.col("min_c")) / F.nullif(F.col("nc") - 1, F.lit(0)) - F.col("s0") / F.col("n0")
    drop_ctrl = F.col("sc") / F.col("nc") - (F.col("s0") - F.col("max_0")) / F.nullif(F.col("n0") - 1, F.lit(0))
    return s.select(
        feature,
        (F.col("s0") / F.col("n0")).alias("control_mean"),
        full.alias("contrast"),
        F.greatest(drop_case, drop_ctrl).alias("loo_max"),
        (F.greatest(drop_case, drop_ctrl) < 0).alias("loo_all_negative"),
    )


def size_factors(counts: DataFrame, feature: str, library: str, n: str) -> DataFrame:
    """Median-of-ratios factors over features positive in every library, rescaled to geometric mean 1."""
    n_lib = counts.select(library).distinct().agg(F.count(F.lit(1)).alias("n_lib"))
    geo = counts.groupBy(feature).agg(
        F.avg(F.when(F.col(n) > 0, F.log(n))).alias("mean_log"), F.count_if(F.col(n) > 0).alias("n_pos")
    )
    ok = geo.join(F.broadcast(n_lib)).where(F.col("n_pos") == F.col("n_lib")).select(feature, "mean_log")
    ratios = counts.join(ok, feature).select(library, F.exp(F.log(n) - F.col("mean_log")).alias("r"))
    med = O.median(ratios, [library], "r", "f")
    centre = med.agg(F.avg(F.log("f")).alias("c"))
    return med.join(F.broadcast(centre)).select(library, (F.col("f") / F.exp("c")).alias("size_factor"))


def tile_mean_change(features: DataFrame, keys: Sequence[str], base: str, change: str, min_base: float, min_n: int = 2):
    g = features.where(F.col(base) >= min_base).groupBy(*keys).agg(F.avg(change).alias("mean_change"), F.count(change).alias("n"))
    return g.where(F.col("n") >= min_n)


# --- long-matrix filters ----------------------------------------------------------------------


def qualify_contexts(
    long: DataFrame, col: str, positive: str, stratum: str, n_rows: int,
    min_pos: int = 15, max_share: float = 0.4, min_in_stratum: int = 3, min_strata: int = 2,
) -> DataFrame:
    """Context columns with enough positives and negatives, spread over several strata.

    `positive` is 1, 0 or NULL. Counts per (column, stratum) are summed again per column.
    """
    per = long.groupBy(col, stratum).agg(
        F.count_if(F.col(positive) == 1).alias("pos"), F.count_if(F.col(positive) == 0).alias("neg")
    )
    g = per.groupBy(col).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count_if(F.col("pos") >= min_in_stratum).alias("n_strata")
    )
    ok = (
        (F.col("n_pos") >= min_pos) & (F.col("n_pos") <= int(max_share * n_rows))
        & (F.col("n_neg") >= min_pos) & (F.col("n_strata") >= min_strata)
    )
    return g.withColumn("qualifies", ok)


def behaved_columns(long: DataFrame, col: str, value: str, n_rows: int, max_missing=0.05, min_sd=0.2, hit_at=-0.5, min_hits=3):
    """Columns with few missing cells, enough spread and a minimum number of strong hits."""
    g = long.groupBy(col).agg(
        F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), F.avg(value).alias("mean"),
        F.count_if(F.col(value) <= hit_at).alias("hits"),
    )
    keep = ((n_rows - F.col("n")) / F.lit(n_rows) < max_missing) & (F.col("sd") >= min_sd) & (F.col("hits") >= min_hits)
    return g.withColumn("kept", keep)


def impute_mean(long: DataFrame, stats: DataFrame, col: str, value: str) -> DataFrame:
    """Missing cells take their column mean; `imputed` marks them."""
    return long.join(stats.where("kept").select(col, "mean"), col).select(
        *[c for c in long.columns if c != value],
        F.coalesce(F.col(value), F.col("mean")).alias(value),
        F.col(value).isNull().alias("imputed"),
    )


def duplicate_columns(long: DataFrame, row: str, col: str, value: str, ordinal: str) -> DataFrame:
    """Columns with identical content share a representative, the one with the smallest ordinal.

    A column's signature is an order-free sum of two independent 64-bit hashes per cell (as exact
    decimals) plus its cell count, so even a column of billions of rows is never gathered.
    """
    cell = F.coalesce(F.col(value).cast("string"), F.lit("missing"))
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col(row), cell).cast("decimal(20,0)"))
    sig = long.groupBy(col).agg(h("a").alias("h1"), h("b").alias("h2"), F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("ord"))
    rep = sig.groupBy("h1", "h2", "n").agg(F.min_by(col, "ord").alias("representative"), F.count(F.lit(1)).alias("copies"))
    return sig.join(rep, ["h1", "h2", "n"]).select(col, "representative", "copies")


def correlation_groups(corr: DataFrame, cols: DataFrame, min_r: float = 0.95) -> DataFrame:
    """Give each column the group of the first earlier column with |r| above the bound.

    `corr` holds (a, b, r) with integer column positions. First hits form a forest, followed to
    its roots by pointer doubling.
    """
    from attesta.session import stage

    hit = corr.where((F.abs("r") > min_r) & (F.col("a") < F.col("b"))).groupBy(F.col("b").alias("col")).agg(F.min("a").alias("up"))
    cur = stage(cols.select("col").join(hit, "col", "left").select("col", F.coalesce("up", "col").alias("up")), "forest")
    while True:
        nxt = cur.alias("x").join(cur.alias("y"), F.col("x.up") == F.col("y.col")).select("x.col", F.col("y.up").alias("up"), F.col("x.up").alias("was"))
        nxt = stage(nxt, "forest")
        moved = not nxt.where("up <> was").isEmpty()
        cur = nxt.drop("was")
        if not moved:
            return cur.withColumnRenamed("up", "group")


# --- group summaries --------------------------------------------------------------------------


def replicated_entities(df: DataFrame, entity: str, dataset: str, hit: Column, min_datasets: int = 2) -> DataFrame:
    g = df.where(hit).select(entity, dataset).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_datasets"))
    return g.where(F.col("n_datasets") >= min_datasets)


def pooled_thresholds(df: DataFrame, keys: Sequence[str], values: Sequence[str], prob: float = 0.05, min_n: int = 100):
    """Quantile of several columns pooled per group; NULL below the minimum count."""
    pooled = df.select(*keys, F.explode(F.array(*values)).alias("v"))
    q = O.quantiles(pooled, keys, "v", {"threshold": prob}, "n")
    return q.withColumn("threshold", F.when(F.col("n") >= min_n, F.col("threshold")))


def enrichment_ratio(df: DataFrame, unit: Sequence[str], hit: Column, selected: Column) -> DataFrame:
    """Selected rows' hit rate over the mean background rate of the units they come from."""
    s, h = F.coalesce(selected, F.lit(False)), F.coalesce(hit, F.lit(False))
    per = df.groupBy(*unit).agg(
        F.avg(h.cast("int")).alias("rate"), F.count_if(s).alias("n_sel"), F.count_if(s & h).alias("n_hit")
    )
    g = per.agg(
        F.sum("n_sel").alias("selected"), F.sum("n_hit").alias("selected_hits"),
        F.avg(F.when(F.col("n_sel") > 0, F.col("rate"))).alias("background_rate"),
    )
    return g.selectExpr("*", "try_divide(try_divide(selected_hits, selected), background_rate) AS ratio")


def composition(df: DataFrame, keys: Sequence[str], category: str, top: int = 10) -> DataFrame:
    """Shares of the most common values per group; NULL counts as UNKNOWN."""
    counts = df.groupBy(*keys, F.coalesce(F.col(category), F.lit("UNKNOWN")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = O.top_k(counts, keys, [F.col("n").desc(), F.col("value")], top)
    return ranked.join(total, list(keys)).withColumn("share", F.round(F.col("n") / F.col("total"), 4)).drop("total")


def tier_membership(df: DataFrame, model: str, library: str) -> DataFrame:
    """Tiers from the set of libraries each model was screened with (a small fixed vocabulary)."""
    has = lambda x: F.bool_or(F.col(library) == x)
    g = df.groupBy(model).agg(
        has("KY").alias("ky"), has("AV").alias("av"), has("CD").alias("cd"),
        F.bool_and(F.coalesce(F.col(library) == "KY", F.lit(False))).alias("only_ky"),
    )
    return g.select(
        model, F.col("ky").alias("tier_a"), (F.col("ky") & F.col("av")).alias("tier_a_shared"),
        F.col("only_ky").alias("tier_b"), F.col("cd").alias("tier_c"),
    )


def testability(pairs: DataFrame, long: DataFrame, context: str, row: str, positive: str, tiers: DataFrame, min_pos: int, min_neg: int):
    """Per tier and pair: positives and negatives among tier members, from metadata only.

    `tiers` holds (tier, row). Counts are formed per (tier, context), then joined to the pairs.
    """
    c = long.join(tiers, row).groupBy("tier", context).agg(
        F.count_if(F.col(positive) == 1).alias("n_pos"), F.count_if(F.col(positive) == 0).alias("n_neg")
    )
    return pairs.join(c, context).withColumn("testable", (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg))


def decile_contrast(df: DataFrame, predictor: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean outcome in the lowest and highest decile of the predictor."""
    ok = df.where(F.col(predictor).isNotNull() & F.col(outcome).isNotNull())
    q = O.quantiles(ok, keys, predictor, {"q10": 0.1, "q90": 0.9})
    j = ok.join(q, list(keys)) if keys else ok.join(F.broadcast(q))
    return j.groupBy(*keys).agg(
        F.avg(F.when(F.col(predictor) <= F.col("q10"), F.col(outcome))).alias("bottom"),
        F.avg(F.when(F.col(predictor) >= F.col("q90"), F.col(outcome))).alias("top"),
    ).withColumn("difference", F.col("top") - F.col("bottom"))


def scale_ratio(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """SD ratio of two tracks per partition, with the median ratio and the pooled ratio beside it."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    per = both.groupBy(key).agg((F.stddev_pop(a) / F.nullif(F.stddev_pop(b), F.lit(0.0))).alias("ratio"))
    med = O.median(per, [], "ratio", "median_ratio")
    pooled = both.agg((F.stddev_pop(a) / F.nullif(F.stddev_pop(b), F.lit(0.0))).alias("pooled_ratio"))
    return per.join(F.broadcast(med)).join(F.broadcast(pooled))


def slopes(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_count(y, x).alias("n"))


def standardised_slopes(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), y_scale: float = 1.0) -> DataFrame:
    """Slopes of y on jointly fitted z-scored predictors, one row per predictor, from pairwise moments.

    With z-scored predictors the normal equations are the correlation matrix, so one aggregate
    feeds a small solve per group.
    """
    rows = df
    for c in (y, *xs):
        rows = rows.where(F.col(c).isNotNull())
    names = list(xs)
    aggs = [F.corr(a, b).alias(f"__{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    aggs += [F.corr(a, y).alias(f"__y_{i}") for i, a in enumerate(names)]
    g = rows.groupBy(*keys).agg(*aggs, F.stddev_pop(y).alias("__sd"), F.count(F.lit(1)).alias("n"))
    packed = F.array(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in g.columns if c.startswith("__") and c != "__sd"])
    b = g.select(*keys, "n", "__sd", _solve_correlations(packed, F.lit(len(names))).alias("b"))
    term = F.array(*[F.lit(n) for n in names])
    return b.select(*keys, "n", "__sd", F.posexplode("b").alias("k", "v")).select(
        *keys, term[F.col("k")].alias("term"), (F.col("v") * F.col("__sd") / y_scale).alias("slope"), "n"
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _solve_correlations(packed: pd.Series, k: pd.Series) -> pd.Series:
    out = []
    for v, n in zip(packed, k):
        m = np.eye(n)
        i, j = np.triu_indices(n, 1)
        m[i, j] = m[j, i] = v[: len(i)]
        out.append((np.linalg.pinv(m, rcond=1e-10, hermitian=True) @ np.asarray(v[len(i) :])).tolist())
    return pd.Series(out)


def positive_median(long: DataFrame, contexts: DataFrame, row: str, keys: Sequence[str], value: str) -> DataFrame:
    """Median value of each key among rows whose context is positive."""
    return O.median(long.join(contexts.where("positive = 1").select(row, "context"), row), ["context", *keys], value)


def rate_block(df: DataFrame, sets: str, tested: Column, hit: Column) -> DataFrame:
    """Nominated, tested and replicated counts with the rate, per pair set."""
    t = F.coalesce(tested, F.lit(False))
    return df.groupBy(sets).agg(
        F.count(F.lit(1)).alias("nominated"), F.count_if(t).alias("tested"),
        F.count_if(t & F.coalesce(hit, F.lit(False))).alias("replicated"),
    ).selectExpr("*", "try_divide(replicated, tested) AS rate")


def verdict(table: DataFrame, cases: Sequence[tuple[str, Column]], otherwise: str, name: str = "verdict") -> DataFrame:
    """First true case names the outcome; a NULL condition counts as not met."""
    expr = None
    for label, cond in cases:
        c = F.coalesce(cond, F.lit(False))
        expr = F.when(c, label) if expr is None else expr.when(c, label)
    return table.withColumn(name, expr.otherwise(otherwise))


# The registered outcome labels (all criteria met, nothing met) per study form.
STUDY_LABELS = {
    "context": ("CROSS_PLATFORM_REPLICATED", "LOW_YIELD"),
    "rnai": ("RNAI_REPLICATED", "NO_TRANSFER"),
    "paralog": ("DOUBLEKO_REPLICATED", "LOW_YIELD"),
    "pharmaco": ("PHARMACO_REPLICATED", "NO_TRANSFER"),
}


def study_verdict(table: DataFrame, study: str = "context") -> DataFrame:
    """Registered label precedence from denominators and pass flags.

    context and rnai: n_primary, n_placebo, n_independent, n_self, p1..p5 (rnai ignores p3).
    paralog: n_primary, n_placebo, n_self, placebo_nominated, p4_evaluable, p1..p5.
    pharmaco: n_primary, n_placebo, n_self, p1_anchor, p1_other, p2, p5.
    """
    c = F.col
    zero = lambda *names: _any([c(n) == 0 for n in names])
    top, bottom = STUDY_LABELS[study]
    breach, some, partial = ~c("p2"), c("p1") if study != "pharmaco" else c("p1_anchor") | c("p1_other"), "PARTIAL_REPLICATION"
    if study == "pharmaco":
        not_eval, full = zero("n_primary", "n_self"), c("p1_anchor") & c("p1_other")
        breach, partial = breach & (c("n_placebo") > 0), "PARTIAL_TRANSFER"
    elif study == "paralog":
        not_eval = zero("n_primary", "n_self") | ((c("n_placebo") == 0) & (c("placebo_nominated") > 0))
        full = c("p1") & c("p3") & (c("p4") | ~c("p4_evaluable"))
    else:
        not_eval = zero("n_primary", "n_placebo", "n_independent", "n_self")
        full = c("p1") & c("p4") if study == "rnai" else c("p1") & c("p3") & c("p4")
    cases = [("NOT_EVALUABLE", not_eval), ("UNDERPOWERED", ~c("p5")), ("PLACEBO_BREACH", breach), (top, full), (partial, some)]
    return verdict(table, cases, bottom)


def compartment_verdict(table: DataFrame) -> DataFrame:
    """Precedence over boolean columns pipeline_failure, tier_b, tier_a, opposite, direction_consistent.

    Tier B needs tier A as well.
    """
    c = F.col
    cases = [
        ("PIPELINE_FAILURE", c("pipeline_failure")), ("TIER_B_PASS", c("tier_a") & c("tier_b")), ("TIER_A_PASS", c("tier_a")),
        ("OPPOSITE", c("opposite")), ("NOT_PASSED_DIRECTION_CONSISTENT", c("direction_consistent")),
    ]
    return verdict(table, cases, "NOT_PASSED")


def _any(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def sample_qc(
    tracks: DataFrame, sample: str, partition: str, position: str, value: str, is_reference: str,
    min_rho: float, min_rows: int, max_excluded: int,
) -> DataFrame:
    """Rank concordance of each sample with the mean of the *other* reference samples, per partition.

    A partition is excluded when any sample fails in it; the run fails when too many are.
    The leave-one-out mean comes from sums, so nothing is self-joined.
    """
    v, keys = F.col(value), [sample, partition]
    own = F.col(is_reference) & v.isNotNull()
    here = Window.partitionBy(partition, position)  # one row a sample
    others = F.nullif(F.count(F.when(F.col(is_reference), v)).over(here) - own.cast("int"), F.lit(0))
    ref = (F.sum(F.when(F.col(is_reference), v)).over(here) - F.when(own, v).otherwise(F.lit(0))) / others
    j = tracks.where(F.col(partition).isNotNull() & F.col(position).isNotNull()).select(*keys, v.alias("x"), ref.alias("y"))
    j = stage(j.where("x IS NOT NULL AND y IS NOT NULL"), "concordance")
    # Rows need the ranks of x only; centred, they are summed for each y, whose own ranks never go back to the rows.
    r = O.average_rank(j, keys, "x", "rx", "m").withColumn("rx", F.col("rx") - (F.col("m") + 1) / 2)
    folded = r.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("k"), F.sum("rx").alias("o"), F.sum(F.col("rx") * F.col("rx")).alias("xx"), F.max("m").alias("m"))
    c = O.Ordered(folded, keys, ["y"]).running({"hi": ("sum", F.col("k"))}).rows()
    c = c.withColumn("ry", F.col("hi") - (F.col("k") - 1) / 2 - (F.col("m") + 1) / 2)
    spread = F.sqrt(F.sum("xx") * F.sum(F.col("k") * F.col("ry") * F.col("ry")))
    rho = c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("o") * F.col("ry")), spread).alias("rho"), F.sum("k").alias("n"))
    bad = (F.col("n") < min_rows) | F.col("rho").isNull() | (F.col("rho") < min_rho)
    per = stage(rho.withColumn("failed", bad), "rho")  # a row per sample and partition, read three times
    parts = per.groupBy(partition).agg(F.bool_or("failed").alias("partition_excluded"))
    total = parts.agg((F.count_if("partition_excluded") > max_excluded).alias("run_failed"))
    return per.join(parts, partition).join(F.broadcast(total))


def control_set(controls: DataFrame, universe: DataFrame, contexts: DataFrame, kinds: Sequence[str], min_pos: int) -> DataFrame:
    """First available context kind per control, and why a control is unavailable.

    `controls` (context_gene, target), `universe` (target), `contexts` (context_gene, kind, n_pos).
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    best = contexts.where(rank > 0).groupBy("context_gene").agg(F.min_by(F.struct("kind", "n_pos"), rank).alias("b"))
    j = (
        controls.join(universe.select("target").distinct().withColumn("in_universe", F.lit(True)), "target", "left")
        .join(best, "context_gene", "left")
        .select("context_gene", "target", "in_universe", "b.kind", "b.n_pos")
    )
    why = (
        F.when(F.col("in_universe").isNull(), "target outside universe")
        .when(F.col("kind").isNull(), "no context measured")
        .when(F.col("n_pos") < min_pos, "below prevalence floor")
    )
    return j.withColumn("why", why).withColumn("available", F.col("why").isNull()).drop("in_universe")


def agreement(df: DataFrame, disc: str, hold: str, by: Sequence[str], min_n: int = 3) -> DataFrame:
    """Sign agreement and effect correlation between discovery and held-out estimates."""
    ok = F.col(disc).isNotNull() & F.col(hold).isNotNull()
    return df.where(ok).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.signum(disc) == F.signum(hold)).cast("int")).alias("sign_agreement"),
        F.corr(disc, hold).alias("__r"),
    ).withColumn("effect_corr", F.when(F.col("n") > min_n, F.col("__r"))).drop("__r")
