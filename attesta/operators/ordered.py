"""Ordered computations that do not need a whole group in one task.

A plain `Window.partitionBy(group).orderBy(v)` sorts each group in a single task, so
one group holding a third of the rows sets the running time. Here rows are range
partitioned by (group, order) instead, every range gets a bucket id, windows run
inside buckets, and the per-bucket totals (one row per bucket and group, so bounded by
the number of partitions plus groups) supply the offsets. Ranks, quantiles, step-up and
step-down corrections, lags and ring positions all come from this one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import stage

BUCKET = "__bucket"

_FOLD = {
    "sum": (F.sum, lambda off, loc: F.coalesce(off, F.lit(0)) + loc),
    "min": (F.min, lambda off, loc: F.least(off, loc)),
    "max": (F.max, lambda off, loc: F.greatest(off, loc)),
}


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.col(f"{left}.{BUCKET}") == F.col(f"{right}.{BUCKET}")
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


class Ordered:
    """Rows with a stable bucket id; `running` adds inclusive running aggregates."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], _staged: bool = False):
        self.keys, self.order = list(keys), list(order)
        if _staged:
            self.df = df
        else:
            ranged = df.repartitionByRange(*[F.col(c) for c in (*self.keys, *self.order)])
            self.df = stage(ranged.withColumn(BUCKET, F.spark_partition_id()), "ordered")

    def running(
        self,
        aggs: dict[str, tuple[str, Column]] | None = None,
        totals: dict[str, tuple[str, Column]] | None = None,
        reverse: bool = False,
    ) -> Ordered:
        """Add running (`aggs`) and whole-group (`totals`) columns.

        Each value is (fold, input column) with fold one of sum, min, max.
        """
        aggs, totals = aggs or {}, totals or {}
        order = [F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_first() for c in self.order]
        local = (
            Window.partitionBy(*self.keys, BUCKET)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        per_bucket = self.df.groupBy(*self.keys, BUCKET).agg(
            *[_FOLD[f][0](c).alias(f"__b_{n}") for n, (f, c) in {**aggs, **totals}.items()]
        )
        step = F.col(BUCKET).desc() if reverse else F.col(BUCKET).asc()
        before = Window.partitionBy(*self.keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        offsets = per_bucket.select(
            *self.keys,
            BUCKET,
            *[_FOLD[f][0](f"__b_{n}").over(before).alias(f"__o_{n}") for n, (f, _) in aggs.items()],
            *[_FOLD[f][0](f"__b_{n}").over(whole).alias(n) for n, (f, _) in totals.items()],
        )
        rows = self.df.select("*", *[_FOLD[f][0](c).over(local).alias(f"__l_{n}") for n, (f, c) in aggs.items()])
        joined = rows.alias("r").join(offsets.alias("o"), _same("r", "o", self.keys))
        out = joined.select(
            *[F.col(f"r.{c}") for c in self.df.columns],
            *[_FOLD[f][1](F.col(f"__o_{n}"), F.col(f"__l_{n}")).alias(n) for n, (f, _) in aggs.items()],
            *[F.col(f"o.{n}") for n in totals],
        )
        return Ordered(out, self.keys, self.order, _staged=True)

    def rows(self) -> DataFrame:
        return self.df.drop(BUCKET)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", size: str | None = None):
    """Row numbers from 1 inside each group; `order` must be unique inside the group."""
    one = F.lit(1).cast("bigint")
    return Ordered(df, keys, order).running({name: ("sum", one)}, {size: ("sum", one)} if size else None).rows()


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], prefix: str = "prev_"):
    """Previous row's columns, by an equi-join on row numbers (no per-group sort task)."""
    rows = stage(numbered(df, keys, order, "__rn"), "lag")
    prev = rows.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        (F.col("__rn") + 1).alias("__next"),
        *[F.col(c).alias(prefix + c) for c in cols],
    )
    cond = rows["__rn"] == prev["__next"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(prev[f"__k_{k}"])
    return rows.join(prev, cond, "left").drop("__rn", "__next", *[f"__k_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(group, value) -> n. The map-side combine folds hot values before any shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))


def cumulative(df: DataFrame, keys: Sequence[str], value: str) -> Ordered:
    """Distinct values with `__hi` = rows at or below, `__total` = rows in the group."""
    n = F.col("__n")
    return Ordered(value_counts(df, keys, value), keys, [value]).running(
        {"__hi": ("sum", n)}, {"__total": ("sum", n)}
    )


def _back(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Attach per-distinct-value results to rows; AQE splits a hot value's partition."""
    table = table.select(*[F.col(c).alias(f"__t_{c}" if c in (*keys, value) else c) for c in table.columns])
    cond = df[value] == table[f"__t_{value}"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(table[f"__t_{k}"])
    return df.join(table, cond, "left").drop(*[f"__t_{c}" for c in (*keys, value)])


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", size: str | None = None, among: DataFrame | None = None):
    """Rank with ties sharing their mean rank; NULL values get NULL.

    `among` are the same rows where `df` is a longer plan, which then is not made once more to count values.
    """
    c = cumulative(df if among is None else among, keys, value).rows()
    mid = F.col("__hi") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)
    out = c.select(*keys, value, mid.alias(name), *([F.col("__total").alias(size)] if size else []))
    return _back(df, out, keys, value)


def rank_fraction(df: DataFrame, keys: Sequence[str], value: str, direction: Column, name: str = "frac"):
    """Average rank over group size; `direction` < 0 ranks ascending, otherwise descending."""
    ranked = average_rank(df, keys, value, "__r", "__m")
    up = F.col("__r") / F.col("__m")
    down = (F.col("__m") + 1 - F.col("__r")) / F.col("__m")
    return ranked.withColumn(name, F.when(direction < 0, up).otherwise(down)).drop("__r", "__m")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], size: str | None = None):
    """Exact linear-interpolation quantiles per group, one row per group."""
    c = cumulative(df, keys, value).rows()
    lo, hi, n, v = F.col("__hi") - F.col("__n"), F.col("__hi"), F.col("__total"), F.col(value)
    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (n - 1)
        for tag, k in (("a", F.floor(h)), ("b", F.ceil(h))):
            picks.append(F.max(F.when((lo <= k) & (k < hi), v)).alias(f"__{tag}_{name}"))
    agg = c.groupBy(*keys).agg(F.max("__total").alias("__m"), *picks)
    cols = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("__m") - 1)
        a, b = F.col(f"__a_{name}").cast("double"), F.col(f"__b_{name}").cast("double")
        cols.append((a + (b - a) * (h - F.floor(h))).alias(name))
    return agg.select(*keys, *cols, *([F.col("__m").alias(size)] if size else []))


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median"):
    return quantiles(df, keys, value, {name: 0.5})


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str] = (), name: str = "q", total: int | None = None) -> DataFrame:
    """Step-up q-values. Tied p share the largest rank, so distinct p-values suffice.

    `total` is the number of tests where `df` holds only those of the smallest p.
    """
    # Written once: the suffix minimum reads the cumulative counts twice (rows and bucket minima).
    c = cumulative(df, keys, p)
    c = Ordered(stage(c.df.drop("__n"), "bh"), c.keys, c.order, _staged=True)
    raw = F.col(p) * (F.col("__total") if total is None else F.lit(total)) / F.col("__hi")
    q = c.running({"__q": ("min", raw)}, reverse=True).rows()
    return _back(df, q.select(*keys, p, F.least(F.col("__q"), F.lit(1.0)).alias(name)), keys, p)


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p. A tie's first member carries the largest multiplier."""
    c = cumulative(df, keys, p)
    raw = F.least(F.lit(1.0), (F.col("__total") - (F.col("__hi") - F.col("__n"))) * F.col(p))
    adj = c.running({"__h": ("max", raw)}).rows()
    return _back(df, adj.select(*keys, p, F.col("__h").alias(name)), keys, p)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """k first rows per group. Spark prunes inside map tasks (WindowGroupLimit) before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def modal_value(df: DataFrame, keys: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """Most frequent value per group; ties go to the value seen first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))
    best = F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first_seen")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{value}", "b.n")


def partition_zscore(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(v - mean) / population SD inside each group; SD 0 gives 0."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.stddev_pop(value).alias("__sd"))
    z = F.when(F.col(value).isNull(), None).when(F.col("__sd") > 0, (F.col(value) - F.col("__mu")) / F.col("__sd"))
    return df.join(s, list(keys)).withColumn(name, z.otherwise(F.lit(0.0))).drop("__mu", "__sd")


def demean(df: DataFrame, keys: Sequence[str], value: str, min_count: int, name: str = "resid"):
    """Value minus its group mean, in groups with at least `min_count` present values."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.count(value).alias("__n"))
    keep = F.when(F.col("__n") >= min_count, F.col(value) - F.col("__mu"))
    return df.join(s, list(keys)).withColumn(name, keep).drop("__mu", "__n")


def leave_group_out_mean(df: DataFrame, group: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """For each group, the mean of all other groups' rows, from sums alone."""
    g = df.groupBy(*within, group).agg(F.sum(value).alias("part"), F.count(value).alias("n_part"))
    tot = df.groupBy(*within).agg(F.sum(value).alias("whole"), F.count(value).alias("n_whole"))
    j = g.join(tot, list(within)) if within else g.join(F.broadcast(tot))  # without `within`, one row
    return j.select(*within, group, F.expr("try_divide(whole - part, n_whole - n_part)").alias("loo_mean"))


def ring_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Zero-based `ring_pos` and `ring_len` per group."""
    return numbered(df, keys, order, "ring_pos", "ring_len").withColumn("ring_pos", F.col("ring_pos") - 1)


def circular_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, offset: Column, name: str):
    """Give each row the value `offset` places back round its group's ring."""
    ring = stage(ring_positions(df, keys, order), "ring")
    src = ring.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.pmod(F.col("ring_pos") + offset, F.col("ring_len")).alias("__to"),
        F.col(value).alias(name),
    )
    cond = ring["ring_pos"] == src["__to"]
    for k in keys:
        cond = cond & ring[k].eqNullSafe(src[f"__k_{k}"])
    return ring.join(src, cond).drop("__to", *[f"__k_{k}" for k in keys])


def quantile_map(df: DataFrame, keys: Sequence[str], source: str, target: str, name: str = "mapped"):
    """Rank-preserving map of the source onto the target's empirical distribution, on rows with both.

    A source of average rank r among n takes the target quantile at (r - 0.5) / n, linearly
    interpolated between the two neighbouring order statistics.
    """
    both = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    src = average_rank(both, keys, source, "__r", "__m")
    h = (F.col("__r") - 0.5) / F.col("__m") * (F.col("__m") - 1)
    want = src.withColumn("__h", h).withColumn("__need", F.explode(F.array_distinct(F.array(F.floor("__h"), F.ceil("__h")))))
    # The value at a position is the latest distinct target starting at or before it: one scan over
    # targets and wanted positions, so a target tied a billion times is still one row.
    tgt = cumulative(both, keys, target).rows()
    start = F.col("__hi") - F.col("__n")
    marks = tgt.select(*keys, start.alias("__at"), F.lit(0).alias("__kind"), F.struct(start.alias("s"), F.col(target).alias("v")).alias("__iv"))
    asked = want.select(*keys, F.col("__need").alias("__at")).distinct().select(
        *keys, "__at", F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__iv"].dataType).alias("__iv")
    )
    run = Ordered(marks.unionByName(asked), keys, ["__at", "__kind"]).running({"__last": ("max", F.col("__iv"))}).rows()
    cover = run.where("__kind = 1").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__at").alias("__rank"), F.col("__last.v").alias("__v")
    )
    cond = F.col("__need") == F.col("__rank")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    ends = want.join(cover, cond).groupBy(*df.columns, "__h").agg(
        F.max(F.when(F.col("__need") == F.floor("__h"), F.col("__v"))).alias("__a"), F.max(F.when(F.col("__need") == F.ceil("__h"), F.col("__v"))).alias("__b")
    )
    return ends.select(*df.columns, (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__h") - F.floor("__h"))).alias(name))



def rank_spline(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Flexible basis of centred ranks: u, u^2, u^3 and cubics truncated at the quartiles of u."""
    r = average_rank(df.where(F.col(value).isNotNull()), keys, value, "__r", "__m")
    r = r.withColumn("u1", F.col("__r") / F.col("__m") - 0.5)
    q = quantiles(r, keys, "u1", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    j = r.join(q, list(keys)) if keys else r.join(F.broadcast(q))
    u = F.col("u1")
    cut = [F.pow(F.greatest(u - F.col(f"q{i}"), F.lit(0.0)), 3).alias(f"k{i}") for i in (1, 2, 3)]
    return j.select(*df.columns, "u1", (u * u).alias("u2"), (u * u * u).alias("u3"), *cut)


def orient(df: DataFrame, keys: Sequence[str], value: str, density: str, min_rho: float = 0.2, min_rows: int = 10):
    """Flip a partition's sign when its rank correlation with the density is negative.

    Partitions that correlate weakly, or on too few rows, become NULL.
    """
    both = df.where(F.col(value).isNotNull() & F.col(density).isNotNull())
    r = average_rank(average_rank(both, keys, value, "__rv"), keys, density, "__rd")
    rho = r.groupBy(*keys).agg(F.corr("__rv", "__rd").alias("rho"), F.count(F.lit(1)).alias("__n"))
    ok = (F.col("__n") >= min_rows) & (F.abs("rho") >= min_rho)
    flipped = F.when(ok & (F.col("rho") < 0), -F.col(value)).when(ok, F.col(value))
    return df.join(rho, list(keys), "left").withColumn("oriented", flipped).drop("__n")


def consensus_rank(df: DataFrame, track: str, position: Sequence[str], value: str, min_tracks: int = 4) -> DataFrame:
    """Mean of rank / (n + 1) over tracks, where enough tracks are present."""
    r = average_rank(df.where(F.col(value).isNotNull()), [track], value, "__r", "__m")
    g = r.groupBy(*position).agg(F.avg(F.col("__r") / (F.col("__m") + 1)).alias("consensus"), F.count(F.lit(1)).alias("n_tracks"))
    return g.withColumn("consensus", F.when(F.col("n_tracks") >= min_tracks, F.col("consensus")))
