"""Contact pairs to balanced matrices and their leading eigenvector, for all partitions at once.

Matrices are sparse long tables (keys..., i, j, w) with i <= j. Vectors over bins are small
tables, written to shared storage once per round, so iterations keep a flat plan. A matrix is
stored once with both triangles, range partitioned by row; a round sends it the vector, which is
bounded by the bin grid, and no entry of the matrix is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.numeric import draw
from attesta.session import stage


def bin_pairs(pairs: DataFrame, keys: Sequence[str], pos1: str, pos2: str, width: int) -> DataFrame:
    """Symmetric sparse counts; 1-based positions go to bin (pos - 1) div width."""
    b = lambda p: F.floor((F.col(p) - 1) / F.lit(width))
    return pairs.groupBy(*keys, F.least(b(pos1), b(pos2)).alias("i"), F.greatest(b(pos1), b(pos2)).alias("j")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )


def mirrored(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both triangles, the diagonal once."""
    other = m.where("i <> j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return m.select(*keys, "i", "j", "w").unionByName(other)


def by_row(full: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The matrix stored so that sums over a row are almost done in the task that reads it."""
    return stage(full.repartitionByRange(*keys, "i"), label)


def of_columns(vector: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A vector (keys, i, ...) of the bins, small beside the matrix, to be joined on its columns j."""
    return F.broadcast(vector.withColumnRenamed("i", "j"))


def balance(
    m: DataFrame, keys: Sequence[str], min_nnz: int = 10, max_rounds: int = 200, tol: float = 1e-5
) -> tuple[DataFrame, DataFrame]:
    """(balanced matrix, kept bins with their bias).

    Bins with few non-zero entries or no signal are masked until every kept bin has kept signal.
    Then s = row sums / mean row sum and w / (s_i s_j), until all |s - 1| < tol. Only the bias
    vector changes between rounds; the matrix itself is written once. Entries of masked bins find
    no bias and drop out.
    """
    keys = list(keys)
    full = by_row(mirrored(m.where("w <> 0"), keys), keys, "full")
    rows = full.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("nnz"), F.sum("w").alias("s"))
    mask = stage(rows.where((F.col("nnz") >= min_nnz) & (F.col("s") > 0)).select(*keys, "i"), "mask")
    n = mask.count()
    while n:
        sums = full.join(of_columns(mask, keys), [*keys, "j"], "left_semi").groupBy(*keys, "i").agg(F.sum("w").alias("s"))
        nxt = stage(sums.where("s > 0").join(mask, [*keys, "i"], "left_semi").select(*keys, "i"), "mask")
        n_next = nxt.count()
        mask = nxt
        if n_next == n:
            break
        n = n_next
    bias = stage(mask.withColumn("b", F.lit(1.0)), "bias")
    for _ in range(max_rounds if n else 0):
        raw = full.join(of_columns(bias, keys), [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("w") / F.col("b")).alias("s"))
        raw = bias.join(raw, [*keys, "i"]).withColumn("s", F.col("s") / F.col("b"))
        mean = raw.groupBy(*keys).agg(F.avg("s").alias("mean"))
        step = raw.join(mean, keys).withColumn("s", F.col("s") / F.col("mean"))
        step = stage(step.select(*keys, "i", (F.col("b") * F.col("s")).alias("b"), F.abs(F.col("s") - 1).alias("err")), "bias")
        bias = step.drop("err")
        if step.agg(F.max("err")).first()[0] < tol:
            break
    else:
        if n:
            raise RuntimeError(f"not balanced to {tol} after {max_rounds} rounds")
    bi, bj = F.broadcast(bias.withColumnRenamed("b", "bi")), of_columns(bias.withColumnRenamed("b", "bj"), keys)
    out = full.where("i <= j").join(bi, [*keys, "i"]).join(bj, [*keys, "j"])
    return out.select(*keys, "i", "j", (F.col("w") / (F.col("bi") * F.col("bj"))).alias("w")), bias


def diagonal_pair_counts(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d, n_pairs): kept bin pairs at each distance, zeros of the matrix included.

    A group is one partition's bin list, bounded by the bin grid and not by the contacts; its
    pair counts are an autocorrelation, done by FFT.
    """
    types = dict(mask.dtypes)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i = pdf["i"].to_numpy()
        x = np.zeros(int(i.max()) + 1)
        x[i] = 1.0
        size = 1 << int(2 * len(x)).bit_length()
        f = np.fft.rfft(x, size)
        n = np.rint(np.fft.irfft(f * np.conj(f), size)[: len(x)]).astype("int64")
        d = np.flatnonzero(n > 0)
        out = pd.DataFrame({"d": d.astype("int64"), "n_pairs": n[d]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["d bigint", "n_pairs bigint"])
    return mask.select(*keys, "i").groupBy(*keys).applyInPandas(count, schema)


def observed_over_expected(m: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Divide by the mean of the diagonal over all kept pairs; a diagonal without signal becomes 1.

    Result (keys, i, j, oe) with i <= j holds every kept pair that is not zero.
    """
    keys = list(keys)
    d = F.col("j") - F.col("i")
    sums = m.groupBy(*keys, d.alias("d")).agg(F.sum("w").alias("total"))
    exp = diagonal_pair_counts(mask, keys).join(sums, [*keys, "d"], "left").select(
        *keys, "d", F.coalesce(F.col("total") / F.col("n_pairs"), F.lit(0.0)).alias("expected")
    )
    exp = stage(exp, "expected")
    signal = m.withColumn("d", d).join(F.broadcast(exp.where("expected > 0")), [*keys, "d"]).select(*keys, "i", "j", (F.col("w") / F.col("expected")).alias("oe"))
    flat = exp.where("expected <= 0").select(*keys, "d")
    end = mask.groupBy(*keys).agg(F.max("i").alias("__end"))
    starts = flat.join(mask.select(*keys, "i").join(end, keys), keys).where(F.col("i") + F.col("d") <= F.col("__end")).select(*keys, "i", (F.col("i") + F.col("d")).alias("j"))
    ones = starts.join(mask.select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi")
    return signal.unionByName(ones.select(*keys, "i", "j", F.lit(1.0).alias("oe")))


def leading_eigenvector(
    oe: DataFrame, mask: DataFrame, keys: Sequence[str], block: int = 4, max_rounds: int = 60, tol: float = 1e-7, seed: int = 7
) -> DataFrame:
    """Leading eigenvector of the correlation matrix of O/E rows, per partition, by block Lanczos.

    The correlation matrix is never formed: one product with it is two sparse products with O/E plus a
    centring term, done for `block` vectors in one round of joins. The vectors of one partition (bins x
    basis numbers) then meet in a task that makes them orthogonal and solves the small projected problem.
    Rounds go on until every partition's residual is below `tol` times its eigenvalue; after `max_rounds`
    an error is raised. Rows without variance are dropped. The vector has unit population variance and a
    non-negative sum; `eigen_share` is eigenvalue over kept rows.
    """
    keys, qs = list(keys), [f"q{k}" for k in range(block)]
    types = dict(mask.dtypes)
    full = by_row(oe.select(*keys, "i", "j", "oe").unionByName(
        oe.where("i <> j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "oe")
    ), keys, "oe")
    size = mask.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    stats = full.groupBy(*keys, "i").agg(F.sum("oe").alias("s"), F.sum(F.col("oe") * F.col("oe")).alias("ss"))
    stats = stats.join(size, keys).withColumn("mu", F.col("s") / F.col("k"))
    stats = stats.withColumn("sd", F.sqrt(F.greatest(F.col("ss") / F.col("k") - F.col("mu") * F.col("mu"), F.lit(0.0))))
    stats = stage(stats.where("sd > 1e-12 AND k >= 3").select(*keys, "i", "k", "mu", "sd"), "rows")

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        """Adds the block's images, and finds the next block orthogonal to all so far."""
        pdf = pdf.sort_values("i", ignore_index=True)
        basis, images = (np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in ("basis", "images"))
        new, image = pdf[qs].to_numpy(float), pdf[[f"y{k}" for k in range(block)]].to_numpy(float)
        used = (new * new).sum(0) > 0.5
        basis, images = np.hstack((basis, new[:, used])), np.hstack((images, image[:, used]))
        value, small = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        v = basis @ small[:, -1]
        left = np.linalg.norm(images @ small[:, -1] - value[-1] * v)
        rest = image[:, used]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        u, weight, _ = np.linalg.svd(rest, full_matrices=False)
        u = u[:, weight > 1e-10 * max(1.0, value[-1])]
        done = left <= tol * max(abs(value[-1]), 1e-300) or u.shape[1] == 0
        out = pdf[[*keys, "i", "k", "mu", "sd"]].copy()
        for k, q in enumerate(qs):
            out[q] = u[:, k] if k < u.shape[1] and not done else 0.0
        return out.assign(basis=list(basis), images=list(images), v=v, eigenvalue=value[-1], done=done)

    fields = [f"{c} {types[c]}" for c in keys] + ["i bigint", "k bigint", "mu double", "sd double", *[f"{q} double" for q in qs]]
    schema = ", ".join([*fields, "basis array<double>", "images array<double>", "v double", "eigenvalue double", "done boolean"])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        q, _ = np.linalg.qr(pdf[qs].to_numpy(float))
        for k, c in enumerate(qs):
            pdf[c] = q[:, k] if k < q.shape[1] else 0.0
        return pdf

    start = stats.select("*", *[(draw(seed + k, *[F.col(c) for c in keys], F.col("i")) / F.lit(2.0**31) - 1).alias(q) for k, q in enumerate(qs)])
    state = start.groupBy(*keys).applyInPandas(first, start.schema)
    state = stage(state.withColumns({"basis": F.array().cast("array<double>"), "images": F.array().cast("array<double>")}), "vec")
    for _ in range(max_rounds):
        # With a = q / sd and c0 = sum(mu a): (Z Z' q)_i = (sum_j oe_ij U_j / k - c0 mu_i) / sd_i, U = O/E' a.
        a = state.select(*keys, "i", *[(F.col(q) / F.col("sd")).alias(q) for q in qs])
        c0 = state.groupBy(*keys).agg(*[F.sum(F.col("mu") * F.col(q) / F.col("sd")).alias(f"c{k}") for k, q in enumerate(qs)])
        # O/E is symmetric: both products join on columns and sum over rows.
        u = full.join(of_columns(a, keys), [*keys, "j"]).groupBy(*keys, "i").agg(*[F.sum(F.col("oe") * F.col(q)).alias(q) for q in qs])
        y = full.join(of_columns(u, keys), [*keys, "j"]).groupBy(*keys, "i").agg(*[F.sum(F.col("oe") * F.col(q)).alias(f"y{k}") for k, q in enumerate(qs)])
        new = state.join(y, [*keys, "i"], "left").join(c0, keys).withColumns(
            {f"y{k}": (F.coalesce(f"y{k}", F.lit(0.0)) / F.col("k") - F.col(f"c{k}") * F.col("mu")) / F.col("sd") for k in range(block)}
        )
        new = new.select(*keys, "i", "k", "mu", "sd", *qs, "basis", "images", *[f"y{k}" for k in range(block)])
        out = stage(new.groupBy(*keys).applyInPandas(project, schema), "vec")
        if out.where("NOT done").isEmpty():
            break
        state = out.drop("v", "eigenvalue", "done")
    else:
        raise RuntimeError(f"no eigenvector to {tol} after {max_rounds} rounds")
    g = out.groupBy(*keys).agg(F.stddev_pop("v").alias("vsd"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("rows"))
    sign = F.when(F.col("total") < 0, -1.0).otherwise(1.0)
    return out.select(*keys, "i", "v", "eigenvalue").join(g, keys).select(
        *keys, "i", (F.col("v") / F.col("vsd") * sign).alias("pc1"), (F.col("eigenvalue") / F.col("rows")).alias("eigen_share")
    )
