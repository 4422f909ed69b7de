"""Sums of products of ring-shaped columns under circular shifts, for any shift, by Fourier transforms.

A ring of n rows is filled up with zeros to M >= 2 n places, M a power of two, so a circular sum is the sum of two
linear ones. M is split into M1 * M2: place M2 * n1 + n2 is transformed along n1 by tasks that hold one n2, along n2 by
tasks that hold a few frequencies k1, which also multiply the spectra and go half the way back, and along k1 back to
places. So a ring of any length is spread over tasks of bounded size, and the work is N log N for all shifts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEG = 1 << 14  # places in a task of the first and last step
BLOCK = 1 << 18  # numbers a column in a task of the middle step
STRETCH, RANKED, DEALT_MB = 1 << 14, 1 << 18, 64  # places of a stretch of a ring; values ranked at once; MB of a task that ranks


def _layout(length: int, leg: int, block: int) -> tuple[int, int, int]:
    """(M1, M2, frequencies k1 in a task of the middle step)."""
    m = 1 << (2 * length - 1).bit_length()
    m1 = min(m, leg)
    m2 = m // m1
    return m1, m2, max(1, min(m1, block // m2))


def _head(table: pa.Table, keys: Sequence[str], n: int) -> list:
    first = table.select(keys).slice(0, 1)
    return [first.column(k).take(pa.array([0] * n, pa.int64())) for k in keys]


def shifted_products(
    ring: DataFrame, keys: Sequence[str], moving: Sequence[str], fixed: Sequence[str], shifts: DataFrame, leg: int = 0, block: int = 0,
    pairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """(keys, rep, s): for each wanted shift, the sums over the ring of moving[k] * fixed[k + shift], moving by fixed.

    With `pairs` of columns (moving, fixed), only those, in their order; a column may then be on both sides.
    `ring` has keys, `ring_pos` from 0, `ring_len` and the columns; `shifts` has keys, `rep` and `offset` below the
    ring's length. Both have a row for the same rings, and keys are never null.
    """
    leg, block = leg or LEG, block or BLOCK
    wish = list(pairs) or [(a, b) for a in moving for b in fixed]
    columns, pairs = list(dict.fromkeys([*moving, *fixed])), len(wish)
    left, right = [columns.index(a) for a, _ in wish], [columns.index(b) for _, b in wish]
    types = {f.name: f.dataType.simpleString() for f in ring.schema}
    key_schema = "".join(f"{k} {types[k]}, " for k in keys)
    m = F.expr("shiftleft(1L, CAST(length(bin(2 * ring_len - 1)) AS INT))")
    m2 = F.greatest(m / F.lit(leg), F.lit(1)).cast("long")

    def forward(key, table):
        length, n2 = table.column("ring_len")[0].as_py(), key[-1].as_py()
        m1, m2, few = _layout(length, leg, block)
        a = np.zeros((len(columns), m1))
        a[:, table.column("ring_pos").to_numpy() // m2] = np.stack([table.column(c).to_numpy() for c in columns])
        f = np.fft.fft(a, axis=1) * np.exp(-2j * np.pi * (n2 * np.arange(m1) % (m1 * m2)) / (m1 * m2))
        parts = [np.ascontiguousarray(f[:, at : at + few]).tobytes() for at in range(0, m1, few)]
        return pa.table(
            [*_head(table, keys, len(parts)), pa.array([length] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array([n2] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
            [*keys, "ring_len", "k1", "n2", "v"],
        )

    def middle(key, table):
        length, part = table.column("ring_len")[0].as_py(), key[-1].as_py()
        m1, m2, few = _layout(length, leg, block)
        f = np.zeros((m2, len(columns), few), complex)
        for n2, v in zip(table.column("n2").to_pylist(), table.column("v").to_pylist()):
            f[n2] = np.frombuffer(v, complex).reshape(len(columns), few)
        f = np.fft.fft(f, axis=0)
        g = np.fft.ifft(f[:, left].conj() * f[:, right], axis=0)
        k1 = part * few + np.arange(few)
        places = np.arange(m2)
        g *= np.exp(2j * np.pi * (places[:, None] * k1 % (m1 * m2)) / (m1 * m2))[:, None, :]
        return pa.table(
            [*_head(table, keys, m2), pa.array([length] * m2, pa.int64()), pa.array(places), pa.array([part] * m2, pa.int64()), pa.array([x.tobytes() for x in g], pa.binary())],
            [*keys, "ring_len", "n2", "k1", "v"],
        )

    def back(key, table, wanted):
        names = [*keys, "rep", "s"]
        if not wanted.num_rows or not table.num_rows:
            return pa.table([*(wanted if wanted.num_rows else table).slice(0, 0).select(keys).columns, pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], names)
        m1, m2, few = _layout(table.column("ring_len")[0].as_py(), leg, block)
        g = np.zeros((pairs, m1), complex)
        for part, v in zip(table.column("k1").to_pylist(), table.column("v").to_pylist()):
            g[:, part * few : (part + 1) * few] = np.frombuffer(v, complex).reshape(pairs, few)
        x = np.fft.ifft(g, axis=1).real
        s = np.ascontiguousarray(x[:, wanted.column("place").to_numpy() // m2].T)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * pairs), pa.array(s.ravel()))
        return pa.table([*[wanted.column(k) for k in keys], wanted.column("rep"), flat], names)

    rows = ring.select(*keys, "ring_pos", F.col("ring_len").cast("long").alias("ring_len"), *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("n2", F.col("ring_pos") % m2)
    head = f"{key_schema}ring_len long, "
    spectra = rows.groupBy(*keys, "n2").applyInArrow(forward, f"{head}k1 long, n2 long, v binary")
    half = spectra.groupBy(*keys, "k1").applyInArrow(middle, f"{head}n2 long, k1 long, v binary")
    lengths = ring.select(*keys, F.col("ring_len").cast("long").alias("ring_len")).distinct()
    # The shift's own place, and that of its other part round the end of the ring.
    both = F.array_distinct(F.array("offset", F.when(F.col("offset") > 0, m - F.col("ring_len") + F.col("offset")).otherwise(F.col("offset"))))
    wanted = shifts.join(lengths, list(keys)).select(*keys, F.col("rep").cast("long").alias("rep"), F.explode(both).alias("place"), m2.alias("__m2"))
    wanted = wanted.withColumn("n2", F.col("place") % F.col("__m2")).drop("__m2")
    return half.groupBy(*keys, "n2").cogroup(wanted.groupBy(*keys, "n2")).applyInArrow(back, f"{key_schema}rep long, s array<double>")


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers as four bytes each where they fit, else eight bytes each."""
    with np.errstate(invalid="ignore"):
        small = v.astype(np.int32)
    return (small if np.array_equal(small, v) else v).tobytes()


def shifted_rank_sums(
    ring: DataFrame, part: str, x: str, still: DataFrame, shifts: DataFrame, y: str, z: str, splits: Sequence[float], stretch: int = 0,
) -> DataFrame:
    """(rep, n, xx, xy, xz): sums of products of centred ranks of x, shifted and less its tile means, with y and z.

    `ring` has part, `ring_pos` from 0 and x without gaps; `shifts` has part, `ring_len`, `rep` and `offset`. `still` has
    the places that count: part, `ring_pos`, `tile_from` (the first place of its tile, whose places follow each other)
    and whole numbers y and z that add up to zero, twice their centred ranks. Ranks run over all rings.

    Whole tiles make a stretch of a ring, and x reaches it as slices of packed stretches, not as rows. A task takes the
    tile means out, sorts, and passes the values on in pieces between `splits`; equal values fold to their number and
    sums where they are many. Another task ranks what lies between two splits, for all rings at once.
    """
    span = stretch or STRETCH
    types = {f.name: f.dataType.simpleString() for f in ring.schema}
    key = f"{part} {types[part]}"
    edges = np.array(splits, float)

    def pack(table: pa.Table) -> pa.Table:
        v = np.empty(table.num_rows)
        v[table.column("ring_pos").to_numpy() % span] = table.column(x).to_numpy()
        return table.select([part, "source"]).slice(0, 1).append_column("v", pa.array([_packed(v)], pa.binary())).append_column("size", pa.array([len(v)], pa.int64()))

    rows = ring.select(part, F.col("ring_pos").cast("long").alias("ring_pos"), F.col(x).cast("double").alias(x)).withColumn("source", F.floor(F.col("ring_pos") / span))
    sources = rows.groupBy(part, "source").applyInArrow(pack, f"{key}, source long, v binary, size long")

    placed = still.select(part, F.floor(F.col("tile_from") / span).alias("goal"), F.col("ring_pos").cast("long").alias("ring_pos"), F.col("tile_from").cast("long").alias("tile_from"), F.col(y).cast("long").alias("y"), F.col(z).cast("long").alias("z"))
    goals = placed.groupBy(part, "goal").agg(F.min("ring_pos").alias("lo"), (F.max("ring_pos") + 1).alias("hi"))
    # What a goal receives: one stretch of the ring, or two where it runs over the ring's end, in places of packed sources.
    begin, n, size = F.pmod(F.col("lo") - F.col("offset"), F.col("ring_len")), F.col("hi") - F.col("lo"), F.col("ring_len")
    arc = lambda a, b, at: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), at.cast("long").alias("at"))
    arcs = F.array(arc(begin, F.least(begin + n, size), F.lit(0)), arc(F.lit(0), begin + n - size, size - begin))
    wanted = goals.join(shifts, part).select(part, "goal", F.col("rep").cast("int").alias("rep"), F.explode(F.filter(arcs, lambda r: r["b"] > r["a"])).alias("arc")).select(part, "goal", "rep", "arc.*")
    wanted = wanted.withColumn("source", F.explode(F.sequence(F.floor(F.col("a") / span), F.floor((F.col("b") - 1) / span))))
    first = F.greatest(F.col("a"), F.col("source") * span)
    wanted = wanted.select(part, "goal", "rep", "source", (F.col("at") + first - F.col("a")).alias("at"), (first - F.col("source") * span).alias("skip"), (F.least(F.col("b"), (F.col("source") + 1) * span) - first).alias("take"))
    width = (F.length("v") / F.col("size")).cast("int")
    slices = wanted.join(sources, [part, "source"]).select(part, "goal", "rep", "at", "take", F.col("v").substr((F.col("skip") * width + 1).cast("int"), (F.col("take") * width).cast("int")).alias("v"))

    names = ["rep", "bucket", "v", "n", "y", "z"]
    empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 4)], names)

    def spread(places: pa.Table, moved: pa.Table) -> pa.Table:
        if not places.num_rows or not moved.num_rows:
            return empty
        places = places.sort_by("ring_pos")
        at = places.column("ring_pos").to_numpy()
        starts = np.flatnonzero(np.diff(places.column("tile_from").to_numpy(), prepend=-1))
        counts = np.diff(starts, append=len(at))
        ys, zs = (places.column(c).to_numpy() for c in ("y", "z"))
        found, line, at = [], np.empty(at[-1] - at[0] + 1), at - at[0]
        moved = moved.sort_by("rep")
        columns = [moved.column(c).to_pylist() for c in ("rep", "at", "take")]
        for k, (rep, to, take) in enumerate(zip(*columns)):
            v = moved.column("v")[k].as_buffer()
            line[to : to + take] = np.frombuffer(v, np.int32 if v.size == 4 * take else float)
            if k + 1 < moved.num_rows and columns[0][k + 1] == rep:
                continue
            value = line[at]
            value -= np.repeat(np.add.reduceat(value, starts) / counts, counts)
            value += 0.0  # no negative zeros
            order = np.argsort(value)
            value, a, b, one = value[order], ys[order], zs[order], None
            own = np.flatnonzero(np.diff(value, prepend=np.nan) != 0)
            if 2 * len(own) < len(value):
                one, value, a, b = np.diff(own, append=len(value)), value[own], np.add.reduceat(a, own), np.add.reduceat(b, own)
            ends = [0, *np.searchsorted(value, edges), len(value)]
            for bucket, (i, j) in enumerate(zip(ends, ends[1:])):
                if j > i:
                    found.append((rep, bucket, value[i:j].tobytes(), None if one is None else one[i:j].astype(np.int64).tobytes(), _packed(a[i:j]), _packed(b[i:j])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), empty.schema.types)], names)

    def ranks(table: pa.Table) -> pa.Table:
        value, one, sums = [], [], ([], [])
        for v, n, *both in zip(*(table.column(c) for c in ("v", "n", "y", "z"))):
            value.append(np.frombuffer(v.as_buffer(), float))
            m = len(value[-1])
            one.append(np.frombuffer(n.as_buffer(), np.int64) if n.is_valid else np.ones(m, np.int64))
            for k, w in enumerate(both):
                w = w.as_buffer()
                sums[k].append(np.frombuffer(w, np.int32 if w.size == 4 * m else np.int64).astype(float))
        value = np.concatenate(value)
        order = np.argsort(value)
        value, one, (a, b) = value[order], np.concatenate(one)[order], (np.concatenate(s)[order] for s in sums)
        own = np.flatnonzero(np.diff(value, prepend=np.nan) != 0)
        one, a, b = np.add.reduceat(one, own), np.add.reduceat(a, own), np.add.reduceat(b, own)
        r = np.cumsum(one) - (one - 1) / 2
        found = [one.sum(), one @ r, one @ (r * r), a.sum(), b.sum(), r @ a, r @ b]
        head = table.select(["rep", "bucket"]).slice(0, 1)
        for name, s in zip(("n", "r", "rr", "y", "z", "ry", "rz"), found):
            head = head.append_column(name, pa.array([float(s)]))
        return head

    slices = slices.toDF(*slices.columns)  # columns of its own: the goals came from the places
    pieces = placed.groupBy(part, "goal").cogroup(slices.groupBy(part, "goal")).applyInArrow(spread, "rep int, bucket int, v binary, n binary, y binary, z binary")
    tasks = max(ring.sparkSession.sparkContext.defaultParallelism, (still.count() * shifts.select("rep").distinct().count() * 16 >> 20) // DEALT_MB)
    ranked = pieces.repartition(tasks, "rep", "bucket").groupBy("rep", "bucket").applyInArrow(ranks, "rep int, bucket int, n double, r double, rr double, y double, z double, ry double, rz double")
    # Ranks inside a bucket are moved on by what lies below it; both windows are over buckets, not rows.
    below = F.sum("n").over(Window.partitionBy("rep").orderBy("bucket")) - F.col("n") - (F.sum("n").over(Window.partitionBy("rep")) + 1) / 2
    on = ranked.withColumn("o", below)
    return on.groupBy("rep").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("rr") + 2 * F.col("o") * F.col("r") + F.col("n") * F.col("o") * F.col("o")).alias("xx"),
        (F.sum(F.col("ry") + F.col("o") * F.col("y")) / 2).alias("xy"), (F.sum(F.col("rz") + F.col("o") * F.col("z")) / 2).alias("xz"))
