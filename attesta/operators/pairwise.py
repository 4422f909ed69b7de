"""Covariate-adjusted association of all pairs of columns, and what is significant among them.

Columns with the same missing rows form a mask group and share covariate sums, since tiles never mix masks. The rows
of a pair are those that both of its columns have. Each column is first reduced to its residual on its own rows, so
that what is left to subtract for the common rows is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.numeric import t_two_sided
from attesta.operators import tiles as T
from attesta.operators.ordered import benjamini_hochberg
from attesta.session import stage

# Identification and clipping limits of the association statistic.
IDENT_FRACTION = 1e-6
IDENT_FLOOR = 1e-12
R_CLIP = 0.999999

STATISTICS = ("n", "df", "n_pos", "n_neg", "beta", "r", "t", "se", "p")


def orthonormal(gram: np.ndarray) -> tuple[np.ndarray, int]:
    """W with (C W)'(C W) = I over the column space of C, rank-safe, from C'C."""
    scale = np.sqrt(np.clip(np.diag(gram), 0, None))
    scale[scale == 0] = 1.0
    val, vec = np.linalg.eigh(gram / np.outer(scale, scale))
    keep = val > val.max(initial=0.0) * len(val) * 1e-12
    return (vec[:, keep] / np.sqrt(val[keep])) / scale[:, None], int(keep.sum())


def finished(v: bytes, w: int, p: int, q: int) -> dict[str, np.ndarray]:
    """Statistics of all pairs of a tile of p and one of q columns, from their sums with w covariates."""
    v = np.frombuffer(v, float)
    a, v = v[: (w + p) * (w + q)].reshape(w + p, w + q), v[(w + p) * (w + q) :]
    (x2, x1, raw, pos, neg), y2, n = v[: 5 * p].reshape(5, p), v[5 * p : 5 * p + q], v[-1]
    W, rank = orthonormal(a[:w, :w])
    xw, wy = a[w:, :w] @ W, W.T @ a[:w, w:]
    sxy = a[w:, w:] - xw @ wy
    sxx, syy = x2 - (xw * xw).sum(1), y2 - (wy * wy).sum(0)
    dof = n - rank - 1
    with np.errstate(all="ignore"):
        known = (sxx > np.maximum(IDENT_FRACTION * (raw - x1 * x1 / n), IDENT_FLOOR))[:, None]
        beta = np.where(known, sxy / sxx[:, None], 0.0)
        den = np.sqrt(sxx[:, None] * syy)
        r = np.where(known & (den > 0), np.clip(sxy / den, -R_CLIP, R_CLIP), 0.0)
        t = r * np.sqrt(dof / (1 - r * r))
        se = np.where(known, np.sqrt(np.maximum(syy - beta * beta * sxx[:, None], 0.0) / dof / sxx[:, None]), np.inf)
        prob = t_two_sided(t, np.full(t.shape, float(dof))) if dof > 0 else np.full(t.shape, np.nan)
    full = lambda c: np.broadcast_to(np.asarray(c, float), (p, q))
    return dict(zip(STATISTICS, (full(n), full(dof), full(pos[:, None]), full(neg[:, None]), beta, r, t, se, prob)))


class Sums:
    """Stored sums of every pair of tiles with the column numbers of the tiles."""

    def __init__(self, table: DataFrame, x_tiles: list[np.ndarray], y_tiles: list[np.ndarray], width: int):
        self.table, self.x_tiles, self.y_tiles, self.width = table, x_tiles, y_tiles, width

    def each(self, fn: Callable[[np.ndarray, np.ndarray, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
        """`fn(x columns, y columns, statistics)` of every pair of tiles, flat and in the same order."""

        xt, yt, width = self.x_tiles, self.y_tiles, self.width

        def run(batches):
            for batch in batches:
                for i, j, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    s = {k: x.ravel() for k, x in finished(v, width, len(xt[i]), len(yt[j])).items()}
                    xs, ys = (c.ravel() for c in np.meshgrid(xt[i], yt[j], indexing="ij"))
                    if (out := fn(xs, ys, s)) is not None:
                        yield out

        return self.table.select("i", "j", "v").mapInArrow(run, schema)


def all_sums(data: DataFrame, x: str, y: str, c: str, n_x: int, n_y: int, width: int, rows: int) -> Sums:
    """Sums for every of n_x columns of x with every of n_y of y, both with missing cells, given covariates c without any.

    The `rows` rows are read for the masks, for the fits of columns, and once for each pair of bands of columns. A task
    multiplies its rows by blocks and passes on the sums of the bands; rows are neither stored nor shuffled.
    """
    masks = T.column_masks(data, [x, y], [n_x, n_y])
    xt, yt = T.tile_columns(masks[x]), T.tile_columns(masks[y])

    def own(sums, parts):
        C = np.column_stack([parts[2], np.ones(len(parts[2]))])
        for side, tiles in enumerate((xt, yt)):
            for t, columns in enumerate(tiles):
                v = parts[side][:, columns]
                there = np.isfinite(v[:, 0])
                part = (np.column_stack([C[:, :-1], v, C[:, -1]])[there]).T @ C[there]
                sums[side, t] = sums[side, t] + part if (side, t) in sums else part

    def fit(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                z = np.frombuffer(v, float).reshape(-1, width + 1)
                W, _ = orthonormal(z[:width, :width])
                b = W @ (W.T @ z[width:-1, :width].T)
                out.append(np.vstack([b, z[width:-1, width] / max(z[-1, -1], 1.0)]).tobytes())
            yield pa.record_batch([batch.column("side"), batch.column("tile"), pa.array(out, pa.binary())], ["side", "tile", "fit"])

    lone = T.in_place(data, [x, y, c], [n_x, n_y, width], rows, own, ["side", "tile"])
    fits = stage(lone.mapInArrow(fit, "side int, tile int, fit binary"), "fits")

    def products(left: list[int], right: list[int]) -> DataFrame:
        wanted = fits.where((F.col("side") == 0) & F.col("tile").isin(left) | (F.col("side") == 1) & F.col("tile").isin(right))
        found = {(r["side"], r["tile"]): np.frombuffer(r["fit"], float).reshape(width + 1, -1) for r in wanted.collect()}  # of two bands
        sides = [T.chosen(name, n, np.concatenate([tiles[t] for t in mine])) for name, n, tiles, mine in ((x, n_x, xt, left), (y, n_y, yt, right))]
        widths = [sum(len(tiles[t]) for t in mine) for tiles, mine in ((xt, left), (yt, right))]
        starts = [np.cumsum([0, *(len(tiles[t]) for t in mine)]) for tiles, mine in ((xt, left), (yt, right))]

        def reduced(side, mine, part, C):
            for t, at, end in zip(mine, starts[side], starts[side][1:]):
                v, f = part[:, at:end], found.get((side, t))
                if f is not None:
                    yield t, np.isfinite(v[:, 0]), v, v - C @ f[:-1], f[-1]

        def multiply(sums, parts):
            X, Y, C = parts
            ys = list(reduced(1, right, Y, C))
            for i, in_x, v, x0, mean in reduced(0, left, X, C):
                for j, in_y, _, y0, _ in ys:
                    both = in_x & in_y
                    if not both.any():
                        continue
                    b = slice(None) if both.all() else both
                    xv, a, z = v[b], np.hstack([C[b], x0[b]]), np.hstack([C[b], y0[b]])
                    centred = xv - mean
                    by_x = np.stack([(a[:, width:] ** 2).sum(0), centred.sum(0), (centred * centred).sum(0), (xv == 1).sum(0), (xv == 0).sum(0)])
                    part = np.concatenate([(a.T @ z).ravel(), by_x.ravel(), (z[:, width:] ** 2).sum(0), [len(a)]])
                    if (i, j) in sums:
                        sums[i, j] += part
                    else:
                        sums[i, j] = part

        return stage(T.in_place(data.select(*sides, c), [x, y, c], [*widths, width], rows, multiply, ["i", "j"]), "products")

    made = [products(left, right) for left in T.bands(xt, width) for right in T.bands(yt, width)]
    table = reduce(DataFrame.unionByName, made) if made else lone.sparkSession.createDataFrame([], "i int, j int, v binary")
    return Sums(table, xt, yt, width)


PAIR = "feature string, outcome string, n long, df double, beta double, r double, t double, se double, p double"


def _batch(x_names: Sequence[str], y_names: Sequence[str]) -> Callable:
    """Record batches in the columns of PAIR from chosen pairs of two tiles."""
    xn, yn = np.array(list(x_names), object), np.array(list(y_names), object)

    def batch(xs, ys, s, ok):
        names = [pa.array(n[c[ok]].tolist(), pa.string()) for n, c in ((xn, xs), (yn, ys))]
        values = [pa.array(s[k][ok]) for k in ("df", "beta", "r", "t", "se", "p")]
        return pa.record_batch([*names, pa.array(s["n"][ok].astype(np.int64)), *values], [c.split()[0] for c in PAIR.split(", ")])

    return batch


def every_pair(sums: Sums, x_names: Sequence[str], y_names: Sequence[str], min_df: int) -> DataFrame:
    """One row a pair with enough degrees of freedom."""
    batch = _batch(x_names, y_names)
    return sums.each(lambda xs, ys, s: batch(xs, ys, s, s["df"] >= min_df), PAIR)


def significant(
    sums: Sums, x_names: Sequence[str], y_names: Sequence[str], alpha: float, min_df: int,
    among: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """The pairs whose q over all tested pairs is at most alpha, with that exact q; no other pair is ever a row.

    A first pass counts p in fixed bins by their leading bits. In bins where even the smallest p is too large for the
    number of p up to the bin's end nothing can pass, so pairs below the highest other bin's end are enough: what lies
    above has p * m / rank > alpha and cannot lower the q of what passes. `among(x columns, y columns)` says which
    pairs are tested at all.
    """

    def tested(xs, ys, s):
        ok = (s["df"] >= min_df) & np.isfinite(s["p"])
        return ok & among(xs, ys) if among else ok

    def bins(xs, ys, s):
        n = np.bincount((s["p"][tested(xs, ys, s)].view(np.int64) >> 48).astype(np.int64))
        k = np.flatnonzero(n)
        return pa.record_batch([pa.array(k.astype(np.int32)), pa.array(n[k])], ["k", "n"])

    counted = sums.each(bins, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = sorted((r["k"], r["n"]) for r in counted.collect())  # 2^14 bins at most
    m, below, top = sum(n for _, n in found), 0, None
    edge = lambda k: np.int64(k << 48).view(np.float64).item()
    for k, n in found:
        below += n
        if edge(k) <= alpha * below / m:
            top = edge(k + 1)
    batch = _batch(x_names, y_names)
    # Without a bin in which anything can pass, no pair is taken.
    chosen = lambda xs, ys, s: batch(xs, ys, s, tested(xs, ys, s) & (s["p"] < (-1.0 if top is None else top)))
    candidates = stage(sums.each(chosen, PAIR), "candidates")
    return benjamini_hochberg(candidates, "p", total=m).where(F.col("q") <= alpha)
