"""Interval, tile and point operators on half-open coordinates.

No theta joins: overlaps become equi-joins on (partition, tile), and "latest interval at or
before a point" becomes one ordered scan over the union of intervals and points. Both stay
linear in rows plus output, also when one partition holds most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ordered import Ordered, lagged
from attesta.session import stage


def tile_grid(sizes: DataFrame, chrom: str, length: str, width: int) -> DataFrame:
    """Tiles [k w, min((k+1) w, L)) of every partition."""
    last = F.floor((F.col(length) - 1) / F.lit(width))
    t = sizes.select(chrom, length, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("tile"))
    return t.select(
        chrom, "tile", (F.col("tile") * width).alias("tile_start"),
        F.least((F.col("tile") + 1) * width, F.col(length)).alias("tile_end"),
    )


def _split(iv: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per (interval, touched tile) with `ov`, the overlap with that tile's full width."""
    first, last = F.floor(F.col(start) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width))
    s = iv.where(F.col(end) > F.col(start)).withColumn("tile", F.explode(F.sequence(first, last)))
    return s.withColumn("ov", F.least(F.col(end), (F.col("tile") + 1) * width) - F.greatest(F.col(start), F.col("tile") * width))


def tile_means(
    iv: DataFrame, sizes: DataFrame, keys: Sequence[str], chrom: str, start: str, end: str, value: str,
    length: str, width: int, min_coverage: float = 0.5,
) -> DataFrame:
    """Coverage-weighted mean per tile; NULL below the minimum coverage or where nothing covers.

    Rows with a missing value add no coverage. Overlapping intervals are refused, since they would
    count a base twice. The result holds touched tiles; join `tile_grid` for the rest.
    """
    valued = iv.where(F.col(value).isNotNull() & (F.col(end) > F.col(start)))
    # Intervals that overlap do so in some tile, and there two neighbours by start overlap. The aggregate below needs
    # no other shuffle, and a tile without overlaps has at most `width` rows.
    inside = Window.partitionBy(*keys, chrom, "tile").orderBy(start, end)
    parts = _split(valued, start, end, width).withColumn("__bad", F.coalesce(F.lag(end).over(inside) > F.col(start), F.lit(False)))
    g = stage(parts.groupBy(*keys, chrom, "tile").agg(
        F.sum("ov").alias("covered"), F.sum(F.col("ov") * F.col(value)).alias("__area"), F.bool_or("__bad").alias("__bad")
    ), "tiles")
    if not g.where("__bad").isEmpty():
        raise ValueError("intervals overlap")
    j = g.join(sizes.select(chrom, length), chrom)
    tile_len = F.least((F.col("tile") + 1) * width, F.col(length)) - F.col("tile") * width
    cov = F.col("covered") / tile_len
    return j.select(
        *keys, chrom, "tile", "covered", cov.alias("coverage"),
        F.when((cov >= min_coverage) & (F.col("covered") > 0), F.col("__area") / F.col("covered")).alias("mean"),
    )


def overlapping_rows(iv: DataFrame, keys: Sequence[str], start: str, end: str, tiebreak: Sequence[str]) -> DataFrame:
    """Rows that start before an earlier row of the same group has ended."""
    o = Ordered(iv, list(keys), [start, end, *tiebreak])
    run = o.running({"__max_end": ("max", F.col(end))}).rows()
    prev = lagged(run, list(keys), [start, end, *tiebreak], ["__max_end"])
    return prev.where(F.col(start) < F.col("prev___max_end")).drop("__max_end", "prev___max_end")


def overlap_fraction(iv: DataFrame, keys: Sequence[str], chrom: str, start: str, end: str, width: int) -> DataFrame:
    """Share of each touched tile's width that intervals cover (overlaps add up)."""
    return _split(iv, start, end, width).groupBy(*keys, chrom, "tile").agg((F.sum("ov") / F.lit(width)).alias("fraction"))


def majority_category(iv: DataFrame, chrom: str, start: str, end: str, category: str, width: int) -> DataFrame:
    """Category covering at least half a tile; the one with the later start where two qualify."""
    parts = _split(iv, start, end, width).where(F.col("ov") >= width / 2)
    return parts.groupBy(chrom, "tile").agg(F.max_by(category, F.struct(start, end, category)).alias("category"))


def arm_position(pos: Column, lo: Column, hi: Column, size: Column) -> Column:
    """Relative distance from the anchor pair towards either end; 0 between the anchors."""
    return (
        F.when(lo.isNull(), None).when(pos < lo, (lo - pos) / lo).when(pos > hi, (pos - hi) / (size - hi)).otherwise(F.lit(0.0))
    )


def points_per_tile(points: DataFrame, grid: DataFrame, chrom: str, pos: str, width: int) -> DataFrame:
    """Number of points in every tile of the grid, zero included."""
    n = points.groupBy(chrom, F.floor(F.col(pos) / F.lit(width)).alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [chrom, "tile"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def neighbour_counts(points: DataFrame, keys: Sequence[str], pos: str, distance: int) -> DataFrame:
    """Points within +-distance of each distinct position (inclusive, self counted).

    Cumulative counts at pos + d and pos - d - 1 come from one scan over positions and query
    coordinates, so a crowded group never pairs its members.
    """
    here = points.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("n"))
    c = F.col(pos).cast("bigint")
    ev = lambda at, kind, n, sign: F.struct(
        at.alias("at"), F.lit(kind).alias("kind"), n.alias("n"), F.lit(sign).alias("sign"), c.alias("origin")
    )
    zero = F.lit(0).cast("bigint")
    events = here.select(*keys, F.inline(F.array(ev(c, 0, F.col("n"), 0), ev(c + distance, 1, zero, 1), ev(c - distance - 1, 2, zero, -1))))
    run = Ordered(events, list(keys), ["at", "kind"]).running({"cum": ("sum", F.col("n"))}).rows()
    q = run.where("kind > 0").groupBy(*keys, F.col("origin").alias(pos)).agg(F.sum(F.col("cum") * F.col("sign")).alias("n_near"))
    return q


def as_of(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, start: str, payload: Sequence[str]
) -> DataFrame:
    """For every point, the payload of the interval with the latest start at or before it.

    `points` must carry a unique `point_id`. Intervals must not share a start within a group.
    """
    iv = intervals.select(*keys, F.col(start).cast("bigint").alias("__at"), F.struct(F.col(start).alias("__s"), *payload).alias("__iv"))
    empty = F.lit(None).cast(iv.schema["__iv"].dataType)
    pt = points.select(*keys, F.col(pos).cast("bigint").alias("__at"), "point_id")
    both = iv.withColumns({"point_id": F.lit(None).cast(points.schema["point_id"].dataType), "__kind": F.lit(0)}).unionByName(
        pt.withColumns({"__iv": empty, "__kind": F.lit(1)})
    )
    run = Ordered(both, list(keys), ["__at", "__kind", "point_id"]).running({"__last": ("max", F.col("__iv"))}).rows()
    hit = run.where("__kind = 1").select("point_id", *[F.col(f"__last.{p}").alias(p) for p in payload])
    return points.join(hit, "point_id")


def lift_points(points: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Map (point_id, chrom, pos) through (chrom, src_start, src_end, dst_chrom, dst_start) blocks.

    `reason` is lifted, unmapped or chrom_change; a target beyond its partition's end is unmapped.
    """
    j = as_of(points, blocks, ["chrom"], "pos", "src_start", ["src_start", "src_end", "dst_chrom", "dst_start"])
    inside = F.col("src_start").isNotNull() & (F.col("pos") < F.col("src_end"))
    j = j.withColumn("new_pos", F.when(inside, F.col("dst_start") + F.col("pos") - F.col("src_start")))
    j = j.join(sizes.select(F.col("chrom").alias("dst_chrom"), F.col("length").alias("dst_length")), "dst_chrom", "left")
    reason = (
        F.when(F.col("new_pos").isNull(), "unmapped")
        .when(F.col("dst_chrom") != F.col("chrom"), "chrom_change")
        .when(F.coalesce(F.col("new_pos") >= F.col("dst_length"), F.lit(True)), "unmapped")
        .otherwise("lifted")
    )
    return j.withColumn("reason", reason).drop("src_start", "src_end", "dst_start", "dst_length")


def lifted_tile_means(lifted: DataFrame, value: str, width: int, min_points: float) -> DataFrame:
    ok = lifted.where("reason = 'lifted'")
    g = ok.groupBy("dst_chrom", F.floor(F.col("new_pos") / F.lit(width)).alias("tile")).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.select("dst_chrom", "tile", "n", F.when(F.col("n") >= min_points, F.col("m")).alias("mean"))


def common_segments(tracks: DataFrame, names: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Segments between consecutive endpoints of all tracks, with each track's value there.

    `tracks` holds (track, chrom, start, end, value), non-overlapping within a track. A segment is
    valid when every track covers it with a present value.
    """
    live = tracks.where("value IS NOT NULL AND end > start")
    at = lambda pos, t, sign, iv: F.struct(pos.alias("at"), t.alias("track"), F.lit(sign).alias("sign"), iv.alias("iv"))
    iv = F.struct(F.col("start").alias("s"), F.col("value").alias("v"))
    ends = live.select("chrom", F.inline(F.array(at(F.col("start"), F.col("track"), 1, iv), at(F.col("end"), F.col("track"), -1, F.lit(None).cast(f"struct<s:{dict(tracks.dtypes)['start']},v:{dict(tracks.dtypes)['value']}>")))))
    edges = sizes.select("chrom", F.explode(F.array(F.lit(0).cast("bigint"), F.col("length").cast("bigint"))).alias("at"))
    per = []
    for i, n in enumerate(names):
        mine = F.col("track") == n
        per += [F.coalesce(F.sum(F.when(mine, F.col("sign"))), F.lit(0)).alias(f"d{i}"), F.max(F.when(mine, F.col("iv"))).alias(f"iv{i}")]
    all_ends = ends.unionByName(edges, allowMissingColumns=True)
    points = all_ends.groupBy("chrom", "at").agg(*per)
    aggs = {}
    for i in range(len(names)):
        aggs[f"c{i}"] = ("sum", F.col(f"d{i}"))
        aggs[f"l{i}"] = ("max", F.col(f"iv{i}"))
    run = Ordered(points, ["chrom"], ["at"]).running(aggs).rows()
    # The next endpoint: number the edges and shift by one through an equi-join.
    run = run.withColumn("__neg", -F.col("at"))
    nxt = lagged(run.drop(*[f"d{i}" for i in range(len(names))], *[f"iv{i}" for i in range(len(names))]), ["chrom"], ["__neg"], ["at"])
    valid = F.lit(True)
    for i in range(len(names)):
        valid = valid & (F.col(f"c{i}") > 0)
    return nxt.where("prev_at IS NOT NULL").select(
        "chrom", F.col("at").alias("start"), F.col("prev_at").alias("end"), valid.alias("valid"),
        *[F.when(valid, F.col(f"l{i}.v")).alias(n) for i, n in enumerate(names)],
    )


def window_integrals(segments: DataFrame, names: Sequence[str], points: DataFrame, sizes: DataFrame, half: Sequence[int], min_coverage: float = 0.9):
    """Mean of every track over [p - h, p + h) using only commonly covered bases.

    Prefix areas at both window edges come from one ordered scan of segments and edges.
    `points` holds (point_id, chrom, pos).
    """
    w = points.join(sizes, "chrom").withColumn("h", F.explode(F.array(*[F.lit(x).cast("bigint") for x in half])))
    w = w.select(
        "point_id", "chrom", "h", F.greatest(F.col("pos") - F.col("h"), F.lit(0)).alias("lo"), F.least(F.col("pos") + F.col("h"), F.col("length")).alias("hi")
    )
    q = w.select("point_id", "chrom", "h", F.inline(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")))))
    width = (F.col("end") - F.col("start")).cast("double")
    rates = [F.col("valid").cast("double"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]]
    seg = segments.select(
        "chrom", F.col("start").alias("at"), F.lit(0).alias("kind"),
        *[(r * width).alias(f"a{i}") for i, r in enumerate(rates)],
        F.struct(F.col("start"), F.col("end"), *[r.alias(f"r{i}") for i, r in enumerate(rates)]).alias("seg"),
    )
    both = seg.unionByName(q.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    aggs = {f"p{i}": ("sum", F.coalesce(F.col(f"a{i}"), F.lit(0.0))) for i in range(len(rates))}
    aggs["last"] = ("max", F.col("seg"))
    run = Ordered(both, ["chrom"], ["at", "kind", "point_id", "h", "sign"]).running(aggs).rows().where("kind = 1")
    # The scan counts the whole segment the coordinate lies in; take back what lies beyond it.
    beyond = F.greatest(F.col("last.end") - F.col("at"), F.lit(0)).cast("double")
    at_edge = [(F.col(f"p{i}") - F.coalesce(F.col(f"last.r{i}") * beyond, F.lit(0.0))) * F.col("sign") for i in range(len(rates))]
    g = run.select("point_id", "chrom", "h", *[e.alias(f"e{i}") for i, e in enumerate(at_edge)]).groupBy("point_id", "chrom", "h").agg(
        *[F.sum(f"e{i}").alias(f"t{i}") for i in range(len(rates))]
    )
    j = w.join(g, ["point_id", "chrom", "h"])
    cov = F.col("t0") / (F.col("hi") - F.col("lo"))
    ok = F.round(cov, 9) >= min_coverage
    return j.select(
        "point_id", "chrom", "h", F.col("t0").alias("covered"), cov.alias("coverage"),
        F.when(ok, "evaluable").otherwise("insufficient_common_coverage").alias("status"),
        *[F.when(ok, F.col(f"t{i + 1}") / F.col("t0")).alias(n) for i, n in enumerate(names)],
    )


MAX_ANCHORS_PER_PASS = 20_000


def matched_controls(
    rows: DataFrame, row_id: str, partition: str, pos: str, features: Sequence[str], is_anchor: Column, outcome: str,
    min_distance: int, k: int = 5,
) -> DataFrame:
    """For each anchor the k nearest non-anchors (squared z distance, ties by id) of its partition,
    farther than `min_distance`; fewer than k gives a status row.

    Anchors travel to the controls in counted batches; each task keeps only its best k per anchor,
    so neither pairs nor groups are ever shuffled whole.
    """
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    # The last digits of a mean hang on how rows are dealt over tasks, and would decide between controls equally far.
    steady = {c: float(f"{v or 0.0:.12g}") for c, v in stats.asDict().items()}
    z = [
        (F.when(F.lit(steady[f"s_{f}"] > 0), (F.col(f) - steady[f"m_{f}"]) / (steady[f"s_{f}"] or 1.0)).otherwise(0.0)) for f in features
    ]
    base = stage(
        rows.select(row_id, partition, F.col(pos).cast("bigint").alias("pos"), F.array(*z).alias("z"), F.col(outcome).cast("double").alias("y"), is_anchor.alias("anchor")),
        "match",
    )
    anchors = stage(base.where("anchor").withColumn("batch", F.floor(F.abs(F.xxhash64(row_id)) % 1_000_003)), "anchors")
    n = anchors.count()
    passes = max(1, -(-n // MAX_ANCHORS_PER_PASS))
    out = None
    for i in range(passes):
        part = _nearest(base, anchors.where(F.col("batch") % passes == i), row_id, partition, min_distance, k)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("anchor_id").orderBy("dist", "control_id")
    best = out.withColumn("rn", F.row_number().over(w))
    agg = best.groupBy("anchor_id").agg(
        F.sum("available").alias("available"),
        F.avg(F.when(F.col("rn") <= k, F.col("control_y"))).alias("control_mean"),
        F.max(F.when(F.col("rn") <= k, F.col("dist"))).alias("max_distance"),
    )
    j = anchors.select(F.col(row_id).alias("anchor_id"), "y").join(agg, "anchor_id", "left")
    enough = F.coalesce(F.col("available"), F.lit(0)) >= k
    return j.select(
        "anchor_id", F.coalesce(F.col("available"), F.lit(0).cast("bigint")).alias("available"),
        F.when(enough, "matched").otherwise("fewer_than_k_controls").alias("status"),
        F.when(enough, F.col("y") - F.col("control_mean")).alias("matched_difference"),
        F.when(enough, F.col("max_distance")).alias("max_distance"),
    )


def _nearest(base: DataFrame, anchors: DataFrame, row_id: str, partition: str, min_distance: int, k: int) -> DataFrame:
    pdf = anchors.select(row_id, partition, "pos", "z").toPandas()  # at most one counted batch
    groups = {key: (g[row_id].to_numpy(), g["pos"].to_numpy(), np.stack(g["z"].to_numpy())) for key, g in pdf.groupby(partition)}
    shared = base.sparkSession.sparkContext.broadcast(groups)
    id_type = dict(base.dtypes)[row_id]

    def best(batches):
        kept: dict = {}
        for b in batches:
            for key, g in b.groupby(partition):
                if key not in shared.value:
                    continue
                a_id, a_pos, a_z = shared.value[key]
                c_id, c_pos, c_y, c_z = g[row_id].to_numpy(), g["pos"].to_numpy(), g["y"].to_numpy(), np.stack(g["z"].to_numpy())
                step = max(1, 4_000_000 // max(1, len(c_id)))
                for s in range(0, len(a_id), step):
                    d = ((a_z[s : s + step, None, :] - c_z[None, :, :]) ** 2).sum(axis=2)
                    far = np.abs(a_pos[s : s + step, None] - c_pos[None, :]) > min_distance
                    for i in range(d.shape[0]):
                        idx = np.flatnonzero(far[i])
                        if idx.size == 0:
                            continue
                        order = idx[np.lexsort((c_id[idx], d[i, idx]))[:k]]
                        old = kept.setdefault(a_id[s + i], [0, []])
                        old[0] += int(idx.size)
                        old[1] = sorted(old[1] + [(d[i, j], c_id[j], c_y[j]) for j in order])[:k]
        rows = [(a, dist, c, y, n if r == 0 else 0) for a, (n, best_k) in kept.items() for r, (dist, c, y) in enumerate(best_k)]
        yield pd.DataFrame(rows, columns=["anchor_id", "dist", "control_id", "control_y", "available"])

    schema = f"anchor_id {id_type}, dist double, control_id {id_type}, control_y double, available bigint"
    return base.where("NOT anchor").mapInPandas(best, schema)
