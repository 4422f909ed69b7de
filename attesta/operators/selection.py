"""Screen filters and order-dependent greedy selection, decided without a sequential pass over all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ordered import quantiles
from attesta.session import stage

# Candidate thresholds per study form.
SCREEN_LIMITS = {
    "context": {"min_abs_beta": 0.30, "min_lb": 0.20, "max_q": 0.01},
    "paralog": {"max_beta": -0.30, "min_lb": 0.20, "max_q": 0.01, "arm_beta": -0.15, "arm_p": 0.05},
    "drug": {"max_beta": -0.35, "min_lb": 0.0, "max_q": 0.01},
}


def lower_bound(beta: Column, se: Column, z: float = 1.96) -> Column:
    return F.abs(beta) - z * se


def screen_filter(assoc: DataFrame, study: str = "context") -> DataFrame:
    """Rows that pass the study's effect, bound and q limits; ranking key `beta_lb` added."""
    lim = SCREEN_LIMITS[study]
    a = assoc.withColumn("beta_lb", lower_bound(F.col("beta"), F.col("se")))
    ok = F.col("q") <= lim["max_q"]
    if study == "context":
        return a.where(ok & (F.abs("beta") >= lim["min_abs_beta"]) & (F.col("beta_lb") >= lim["min_lb"]))
    ok = ok & (F.col("beta") <= lim["max_beta"])
    if study == "drug":
        return a.where(ok & (F.col("beta_lb") > lim["min_lb"]))
    arm = (F.col("arm_beta") <= lim["arm_beta"]) & (F.col("arm_p_one_sided") < lim["arm_p"])
    return a.where(ok & (F.col("beta_lb") >= lim["min_lb"]) & arm)


def percentile_screen(df: DataFrame, value: str, baseline: Column, prob: float = 0.9) -> DataFrame:
    """Rows whose positive value reaches the percentile of the baseline-eligible rows."""
    cut = quantiles(df.where(baseline), [], value, {"cut": prob})
    return df.join(F.broadcast(cut)).where(baseline & (F.col(value) > 0) & (F.col(value) >= F.col("cut")))


def greedy_capped(
    df: DataFrame, row_id: str, stratum: str, strata: Mapping[str, int], score: str, caps: Mapping[str, int], batch: int = 1000
) -> DataFrame:
    """Greedy selection in (stratum order, score descending, id) order under quotas and shared caps.

    The choice is as long as the quotas allow, so only its bookkeeping lives on the driver. Every
    round asks Spark for the best `batch` rows that are not yet blocked (a distributed top-k) and
    decides them in order. A row refused there sits in a full group or stratum, and those are
    filtered out of the next round, so each round moves strictly forward and the result is exact.
    """
    order = F.create_map(*[v for i, s in enumerate(strata) for v in (F.lit(s), F.lit(i))])[F.col(stratum)]
    pool = stage(df.where(F.col(stratum).isin(*strata)).withColumn("__o", order), "greedy")
    light = pool.select(row_id, stratum, score, "__o", *[c for c in caps if c != stratum])
    left = dict(strata)
    used: dict[str, dict] = {g: {} for g in caps}
    chosen: list = []
    while any(n > 0 for n in left.values()):
        open_rows = light.where(F.col(stratum).isin(*[s for s, n in left.items() if n > 0]))
        for g, cap in caps.items():
            full = [k for k, n in used[g].items() if n >= cap]
            named = [k for k in full if k is not None]
            if named:
                open_rows = open_rows.where(F.col(g).isNull() | ~F.col(g).isin(*named))
            if None in full:  # rows without a value share one group
                open_rows = open_rows.where(F.col(g).isNotNull())
        if chosen:
            open_rows = open_rows.where(~F.col(row_id).isin(*chosen))
        rows = open_rows.orderBy("__o", F.col(score).desc(), row_id).limit(batch).collect()
        for r in rows:
            if left[r[stratum]] > 0 and all(used[g].get(r[g], 0) < cap for g, cap in caps.items()):
                chosen.append(r[row_id])
                left[r[stratum]] -= 1
                for g in caps:
                    used[g][r[g]] = used[g].get(r[g], 0) + 1
        if len(rows) < batch:
            break
    return pool.where(F.col(row_id).isin(*chosen)).drop("__o") if chosen else pool.limit(0).drop("__o")


def greedy_spacing(df: DataFrame, row_id: str, partition: str, pos: str, order: Sequence[str], spacing: int, maximum: int):
    """Best rows first, skipping those within `spacing` of a chosen one in the same partition.

    At most `maximum` rows are chosen, so the chosen list is tiny: each round takes the best row
    still allowed with one distributed minimum. All rows come back with a status.
    """
    pool = stage(df, "spacing")
    key = F.struct(*order, row_id)
    chosen: list = []

    def near(r):
        return (F.col(partition) == r[partition]) & (F.abs(F.col(pos) - r[pos]) < spacing)

    allowed = pool
    for _ in range(maximum):
        best = allowed.agg(F.min_by(F.struct(partition, pos, row_id), key).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
        allowed = allowed.where(~near(best))
    rank, blocked = F.lit(None).cast("int"), F.lit(False)
    for i, r in enumerate(chosen):
        rank = F.when(F.col(row_id) == r[row_id], i + 1).otherwise(rank)
        blocked = blocked | near(r)
    status = F.when(rank.isNotNull(), "selected").when(blocked, "excluded_spacing").otherwise("beyond_maximum")
    return pool.withColumns({"status": status, "candidate_rank": rank})


def nested_samples(df: DataFrame, row_id: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """(size, row) for nested prefixes of one seeded order: a smaller sample is part of every larger one.

    Only the largest size has to be ordered; Spark keeps that many rows per task (top-k), never a full sort.
    """
    from attesta.functions.numeric import draw_order

    top = df.withColumn("__h", draw_order(seed, F.col(row_id))).orderBy("__h", row_id).limit(max(sizes))
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy("__h", row_id)))
    grid = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rn"))
    return ranked.withColumn("size", F.explode(grid)).drop("__h")
