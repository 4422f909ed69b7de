"""Bootstrap and permutation operators, deterministic in (seed, replicate, key).

Draws are hashes, not random streams, so a lost executor recomputes the same draw and
another engine can reproduce the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.numeric import draw, draw_order
from attesta.operators.ordered import numbered
from attesta.session import stage

BROADCAST_ROWS = 500_000
SLOTS_PER_TASK_ROW = 4096
DRAWS_PER_TASK = 2_000_000


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a counted table under the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def draw_blocks(sizes: DataFrame, reps: int, total: int) -> DataFrame:
    """`sizes` (k and other columns) with `blk` and `rep`: fixed blocks of slots, spread over tasks. `total` is the sum of k."""
    blocks = sizes.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("k") - 1) / SLOTS_PER_TASK_ROW))).alias("blk")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    # The blocks are few bytes, and adaptive execution would merge them into one task: the number of tasks is given.
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total * reps // DRAWS_PER_TASK))
    return blocks.repartition(tasks, F.col("rep"), F.col("blk"))


def cluster_draws(sizes: DataFrame, by: Sequence[str], reps: int, seed: int, total: int) -> DataFrame:
    """(by, rep, idx): every replicate draws as many cluster indexes as there are clusters.

    `sizes` holds (by, k); `total` is the sum of k.
    """
    spread = draw_blocks(sizes.select(*by, "k"), reps, total)
    start = F.col("blk") * SLOTS_PER_TASK_ROW
    stop = F.least(start + SLOTS_PER_TASK_ROW, F.col("k")) - 1
    slots = spread.select(*by, "k", "rep", F.explode(F.sequence(start, stop)).alias("slot"))
    return slots.select(*by, "rep", (draw(seed, F.col("rep"), F.col("slot")) % F.col("k")).alias("idx"))


def index_percentiles(vals: DataFrame, by: Sequence[str], value: str, reps: int, floor_share: float | None) -> DataFrame:
    """Order-statistic picks int(.025 m) and int(.975 m) over the m defined replicates.

    At most `reps` rows per group arrive here, which bounds the window.
    """
    w = Window.partitionBy(*by).orderBy(value)
    ranked = vals.where(F.col(value).isNotNull()).select(
        *by, value, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("m")
    )
    out = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("i") == F.floor(F.lit(0.025) * F.col("m")), F.col(value))).alias("lo"),
        F.max(F.when(F.col("i") == F.floor(F.lit(0.975) * F.col("m")), F.col(value))).alias("hi"),
        F.max("m").alias("n_valid"),
    )
    if floor_share is None:
        return out
    enough = F.col("n_valid") >= int(reps * floor_share)
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("lo", "hi")})


def cluster_bootstrap(
    df: DataFrame,
    cluster: str,
    sums: Mapping[str, Column],
    statistic: Column,
    by: Sequence[str] = (),
    reps: int = 4000,
    seed: int = 13,
    floor_share: float | None = 0.25,
    linear: bool = False,
) -> DataFrame:
    """Percentile interval of a ratio statistic, resampling whole clusters.

    Rows collapse to one row of sufficient sums per cluster before anything is resampled,
    so the work after the first aggregate depends on clusters and replicates only.
    `statistic` is an expression over the summed columns. `linear` interpolates the quantiles
    instead of picking order statistics (the spatial block form).
    """
    per = df.groupBy(*by, cluster).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    indexed = stage(numbered(per, list(by), [cluster], "idx", "k").withColumn("idx", F.col("idx") - 1), "clusters")
    n_clusters = indexed.count()
    sizes = indexed.select(*by, "k").distinct()
    draws = cluster_draws(sizes, by, reps, seed, n_clusters)
    picked = draws.join(bounded_broadcast(indexed.drop("k", cluster), n_clusters), [*by, "idx"])
    rep_sums = picked.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in sums])
    vals = rep_sums.select(*by, statistic.alias("value"))
    point = per.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums]).select(*by, statistic.alias("point"))
    if linear:
        # At most `reps` values per group, so an exact percentile fits in one buffer.
        ci = vals.groupBy(*by).agg(
            F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.count("value").alias("n_valid")
        )
    else:
        ci = index_percentiles(vals, by, "value", reps, floor_share)
    return point.join(ci, list(by), "left") if by else point.join(F.broadcast(ci), how="left")


def lift_statistic(n: str = "n", e: str = "e", f: str = "f", c: str = "c") -> Column:
    return F.expr(f"try_divide(try_divide({c}, {e}), try_divide({f}, {n}))")


def slot_draws(seed: int, rep: int, start: int, stop: int) -> np.ndarray:
    """`functions.numeric.draw` of (seed, rep, slot) for slots start..stop-1."""
    head = f"{seed}|{rep}|".encode()
    return np.frombuffer(b"".join([md5(head + b"%d" % slot).digest()[:4] for slot in range(start, stop)]), ">u4").astype(np.int64)


def row_bootstrap_proportion(groups: DataFrame, k: str, n: str, by: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Row bootstrap of a proportion from counts alone, with floor/ceil index picks.

    `groups` holds one (by, k, n) row per group. A drawn row is a success when its index is below k. Groups share the
    draws of a replicate, so a task hashes a block of slots once for all of them and passes on counts.
    """
    sizes = stage(groups.where(F.col(n) > 0).select(*by, F.col(n).cast("long").alias("k"), F.col(k).cast("long").alias("__succ")), "groups")
    total = sizes.agg(F.sum("k")).first()[0] or 0
    blocks = draw_blocks(sizes, reps, total).sortWithinPartitions("rep", "blk")
    types = {f.name: f.dataType.simpleString() for f in sizes.schema}

    def count(batches):
        at, drawn = None, np.zeros(0, np.int64)
        for batch in batches:
            hits = []
            for size, succ, blk, rep in zip(*(batch.column(c).to_pylist() for c in ("k", "__succ", "blk", "rep"))):
                start, stop = blk * SLOTS_PER_TASK_ROW, min((blk + 1) * SLOTS_PER_TASK_ROW, size)
                if at != (rep, blk) or len(drawn) < stop - start:
                    at, drawn = (rep, blk), slot_draws(seed, rep, start, stop)
                hits.append(int(np.count_nonzero(drawn[: stop - start] % size < succ)))
            yield pa.record_batch([*[batch.column(c) for c in (*by, "k", "rep")], pa.array(hits, pa.int64())], [*by, "k", "rep", "hits"])

    schema = "".join(f"{b} {types[b]}, " for b in by) + "k long, rep int, hits long"
    vals = blocks.mapInArrow(count, schema).groupBy(*by, "rep").agg((F.sum("hits") / F.max("k")).alias("v"))
    w = Window.partitionBy(*by).orderBy("v")
    ranked = vals.select(*by, "v", (F.row_number().over(w) - 1).alias("i"))
    lo_i, hi_i = int(0.025 * reps), min(reps - 1, -int(-(0.975 * reps) // 1) - 1)
    return ranked.groupBy(*by).agg(
        F.max(F.when(F.col("i") == lo_i, F.col("v"))).alias("lo"), F.max(F.when(F.col("i") == hi_i, F.col("v"))).alias("hi")
    )


def permute_within(df: DataFrame, strata: Sequence[str], row_id: str, label: str, seed: int, reps: int) -> DataFrame:
    """(rep, row_id, label): labels shuffled inside strata, once per replicate.

    The k-th row of a stratum receives the label of the row with the k-th smallest hash.
    """
    base = stage(df.select(*strata, row_id, label), "permute")
    own = numbered(base.drop(label), strata, [row_id], "__k")
    reps_df = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    hashed = reps_df.withColumn("__h", draw_order(seed, F.col("rep"), F.col(row_id)))
    shuffled = numbered(hashed, [*strata, "rep"], ["__h", row_id], "__k").select(*strata, "rep", "__k", label)
    return shuffled.join(own, [*strata, "__k"]).drop("__k")


def permutation_test(
    df: DataFrame, strata: Sequence[str], row_id: str, label: str, value: str, reps: int, seed: int
) -> DataFrame:
    """Difference in mean value between label true and false, against within-stratum permutations.

    p is (1 + #) / (1 + reps), so never zero.
    """
    diff = F.avg(F.when(F.col(label), F.col(value))) - F.avg(F.when(~F.col(label), F.col(value)))
    observed = df.agg(diff.alias("observed"))
    perm = permute_within(df, strata, row_id, label, seed, reps).join(df.select(row_id, value), row_id)
    null = perm.groupBy("rep").agg(diff.alias("null"))
    # Sums over differently ordered rows may differ in the last bits; treat those as ties.
    eps = F.abs(F.col("observed")) * 1e-12 + 1e-300
    return null.join(F.broadcast(observed)).agg(
        F.max("observed").alias("observed"),
        ((1 + F.count_if(F.col("null") >= F.col("observed") - eps)) / F.lit(1 + reps)).alias("p_greater"),
        ((1 + F.count_if(F.col("null") <= F.col("observed") + eps)) / F.lit(1 + reps)).alias("p_less"),
        ((1 + F.count_if(F.abs("null") >= F.abs("observed") - eps)) / F.lit(1 + reps)).alias("p_two_sided"),
    )


def resample_at_sizes(
    df: DataFrame, row_id: str, sums: Mapping[str, Column], statistic: Column, sizes: Sequence[int], reps: int, seed: int
) -> DataFrame:
    """Distribution of a statistic over samples of n rows drawn with replacement, for several n."""
    rows = stage(numbered(df.select(row_id, *[c.alias(n) for n, c in sums.items()]), [], [row_id], "idx"), "rows")
    total = rows.count()
    grid = df.sparkSession.range(reps).select(F.col("id").alias("rep"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("n_draw"))
    slots = grid.select("rep", "n_draw", F.explode(F.sequence(F.lit(0), F.col("n_draw") - 1)).alias("slot"))
    idx = draw(seed, F.col("rep"), F.col("n_draw"), F.col("slot")) % F.lit(total) + 1
    picked = slots.select("rep", "n_draw", idx.alias("idx")).join(bounded_broadcast(rows.drop(row_id), total), "idx")
    vals = picked.groupBy("n_draw", "rep").agg(*[F.sum(n).alias(n) for n in sums]).select("n_draw", statistic.alias("value"))
    out = index_percentiles(vals, ["n_draw"], "value", reps, None)
    mean = vals.groupBy("n_draw").agg(F.avg("value").alias("mean"))
    return mean.join(out, "n_draw", "left")


def holdout_reach(items: DataFrame, item: str, hit: Column, qualifies: Column, seeds: int, share: float, seed: int) -> DataFrame:
    """Hits among the held-out qualifying items over many seeded splits: mean, least and most."""
    rows = stage(items.select(item, hit.alias("hit"), qualifies.alias("q")), "holdout")
    n = rows.count()
    cut = int(n * (1 - share))
    splits = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("split")).withColumn(
        "__h", draw_order(seed, F.col("split"), F.col(item))
    )
    ranked = numbered(splits, ["split"], ["__h", item], "pos").where(F.col("pos") > cut)
    per = ranked.groupBy("split").agg(
        F.count_if(F.col("hit") & F.col("q")).alias("hits"), F.count_if("q").alias("held_out")
    )
    return per.agg(
        F.avg("hits").alias("mean_hits"), F.min("hits").alias("min_hits"), F.max("hits").alias("max_hits"),
        F.avg("held_out").alias("mean_held_out"),
    )
