"""Random permutations as keyed bijections of places, so that a shuffle is a lookup and nothing is sorted.

A round pairs every place x of 0..n-1 with (K - x) mod n and swaps a pair or not, by a keyed bit of the larger of both.
That is one-to-one for any n, and after some tens of rounds the permutation is as good as drawn. Any engine with
whole-number arithmetic gives the same one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from attesta.functions.numeric import draw
from attesta.operators.ordered import numbered
from attesta.session import stage

ROUNDS = 48
PRIME, LEHMER, FIRST, SECOND, THIRD = 1048573, 2147483647, 48271, 69621, 40503

# DuckDB text of `moved`: place k of n under a 31-bit key ky.
DUCK_MOVED = f"""list_reduce(list_prepend([k, 0, 0], list_transform(range(1, {ROUNDS + 1}), lambda i: [0, (ky + i * 7919) % {LEHMER} * {FIRST} % {LEHMER}, (ky + i * 7919) % {LEHMER} * {SECOND} % {LEHMER}])),
   lambda s, r: list_transform([((r[2] * {LEHMER} + r[3]) % n - s[1] + n) % n], lambda y: CASE WHEN ((greatest(y, s[1]) + greatest(y, s[1]) // {PRIME} * {THIRD} + r[2]) % {PRIME}) * ((greatest(y, s[1]) + greatest(y, s[1]) // {PRIME} * {THIRD} + r[2]) % {PRIME}) % {PRIME}
   * (2 * (r[3] % 32768) + 1) // 64 % 2 = 1 THEN y ELSE s[1] END))[1]"""


def moved(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each place of 0..n-1 goes under its key.

    What depends on the key and n alone is found once for all places that share them.
    """
    x, n = place.astype(np.int64), n.astype(np.int64)
    if not len(x):
        return x
    order = np.lexsort((n, key))
    first = np.ones(len(x), bool)
    first[1:] = (np.diff(key[order]) != 0) | (np.diff(n[order]) != 0)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(first) - 1
    keys, sizes, large = key[order][first].astype(np.int64), n[order][first], n.max() > PRIME
    for i in range(1, ROUNDS + 1):
        u = (keys + i * 7919) % LEHMER
        a, b = u * FIRST % LEHMER, u * SECOND % LEHMER
        y = ((a * LEHMER + b) % sizes)[which] - x
        y += np.where(y < 0, n, 0)
        top = np.maximum(x, y)
        t = top + (a % PRIME)[which]
        if large:
            t += top // PRIME * THIRD
        t %= PRIME
        x = np.where(t * t % PRIME * (2 * (b % 32768) + 1)[which] >> 6 & 1, y, x)
    return x


@F.pandas_udf(LongType())
def moved_place(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(moved(place.to_numpy(np.int64), n.to_numpy(np.int64), key.to_numpy(np.int64)))


def replicate_key(stratum_key: Column, rep: Column) -> Column:
    return (stratum_key + rep * F.lit(104_729)) % F.lit(LEHMER)


def _replicates(rows: DataFrame, reps: int) -> DataFrame:
    """Rows (with __k, __n, __key) once a replicate, with `__to`, the place that their label comes from."""
    many = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return many.withColumn("__to", moved_place("__k", "__n", replicate_key(F.col("__key"), F.col("rep"))))


def _placed(df: DataFrame, strata: Sequence[str], order: Sequence[str], seed: int) -> DataFrame:
    rows = numbered(df, strata, order, "__k", "__n").withColumn("__k", F.col("__k") - 1)
    return stage(rows.withColumn("__key", draw(seed, *[F.col(s) for s in strata]) if strata else F.lit(seed).cast("bigint")), "places")


def shuffled_labels(df: DataFrame, strata: Sequence[str], row_id: str, label: str, seed: int, reps: int) -> DataFrame:
    """(rep, row_id, label): labels of any type shuffled within strata, among the rows that have one.

    Rows without a label stay without and are not listed; ids must be unique within a stratum.
    """
    rows = _placed(df.where(F.col(label).isNotNull()).select(*strata, row_id, label), strata, [row_id], seed)
    source = rows.select(*[F.col(s).alias(f"__s_{s}") for s in strata], F.col("__k").alias("__from"), F.col(label).alias("__label"))
    cond = F.col("__to") == F.col("__from")
    for s in strata:
        cond = cond & F.col(s).eqNullSafe(F.col(f"__s_{s}"))
    return _replicates(rows.drop(label), reps).join(source, cond).select("rep", row_id, F.col("__label").alias(label))


def mean_difference(label: Column, value: Column) -> Column:
    return F.avg(F.when(label, value)) - F.avg(F.when(~label, value))


def shuffle_test(
    df: DataFrame, strata: Sequence[str], row_id: str, label: str, value: str, reps: int, seed: int,
    statistic: Callable[[Column, Column], Column] = mean_difference,
) -> DataFrame:
    """An aggregate of (boolean label, value) against its values under shuffles of the labels within strata.

    Rows without a label or value take no part. Within a stratum the rows with a true label come first, so a shuffled
    label is true where the place it comes from is among those: no join and no sort a replicate. p is
    (1 + #) / (1 + reps).
    """
    both = df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(*strata, row_id, value, label, (~F.col(label)).alias("__not"))
    rows = _placed(both, strata, ["__not", row_id], seed)
    true = rows.groupBy(*strata).agg(F.count_if(label).alias("__true"))
    if strata:
        true = true.toDF(*[f"__s_{s}" for s in strata], "__true")
        cond = F.lit(True)
        for s in strata:
            cond = cond & F.col(s).eqNullSafe(F.col(f"__s_{s}"))
        rows = rows.join(true, cond)
    else:
        rows = rows.join(F.broadcast(true))
    observed = both.agg(statistic(F.col(label), F.col(value)).alias("observed"))
    many = _replicates(rows.select("__k", "__n", "__key", "__true", value), reps)
    null = many.groupBy("rep").agg(statistic(F.col("__to") < F.col("__true"), F.col(value)).alias("null"))
    # Sums over differently ordered rows may differ in the last bits; treat those as ties.
    eps = F.abs(F.col("observed")) * 1e-12 + 1e-300
    return null.join(F.broadcast(observed)).agg(
        F.max("observed").alias("observed"),
        ((1 + F.count_if(F.col("null") >= F.col("observed") - eps)) / F.lit(1 + reps)).alias("p_greater"),
        ((1 + F.count_if(F.col("null") <= F.col("observed") + eps)) / F.lit(1 + reps)).alias("p_less"),
        ((1 + F.count_if(F.abs("null") >= F.abs("observed") - eps)) / F.lit(1 + reps)).alias("p_two_sided"),
    )


def shuffled_holdout(items: DataFrame, item: str, hit: Column, qualifies: Column, splits: int, share: float, seed: int) -> DataFrame:
    """Hits among the held-out qualifying items over many splits: mean, least and most.

    A split holds out the items whose place goes beyond the first (1 - share) of all places.
    """
    rows = _placed(items.select(item, hit.alias("hit"), qualifies.alias("q")), [], [item], seed)
    many = _replicates(rows, splits)
    held = many.where(F.col("__to") >= F.floor(F.col("__n") * F.lit(1 - share)))
    per = held.groupBy("rep").agg(F.count_if(F.col("hit") & F.col("q")).alias("hits"), F.count_if("q").alias("held_out"))
    return per.agg(
        F.avg("hits").alias("mean_hits"), F.min("hits").alias("min_hits"), F.max("hits").alias("max_hits"), F.avg("held_out").alias("mean_held_out")
    )
