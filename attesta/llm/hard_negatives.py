"""Hard negatives of anchor vectors, with inner products bounded by summaries of vector segments.

A vector is cut into segments of 64, 16 and 4 components. Of each segment the mean and the deviation from it are stored.
For two segments of length n the inner product lies within n * (product of means) plus or minus n * (product of deviations),
so sums over segments bound a pair's score. Pairs that no bound rules out are refined from long segments to
short ones, and what is left is scored exactly.

Rows and anchors meet in a grid of cells of bounded size: rows are dealt to cells by a hash of their id and are repeated once
for each part of the anchors, anchors are repeated once for each cell of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.store import drop, kept

LENGTHS = (64, 16, 4)
ROWS, ANCHORS = 1 << 14, 1 << 12  # about so many rows and anchors in a cell
CHUNK, PAIRS = 2048, 1 << 21  # rows, and pairs, looked at together
LEAST = np.iinfo(np.int64).min + 1  # marks pairs that are not open; it can be negated
EXACT = 2.0**53
LONG = (LEAST + 1, np.iinfo(np.int64).max)


def matrix(column: pa.ChunkedArray, multiple: int = 1) -> np.ndarray:
    """List rows as a matrix, short ones filled up with zeros; the width is a multiple of `multiple`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(at)
    width = -(-int(size.max(initial=0)) // multiple) * multiple
    out = np.zeros((len(size), width))
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), inner] = flat[at[0] : at[-1]] if len(size) else flat[:0]
    return out


def summary(v: np.ndarray) -> list[np.ndarray]:
    """Per length of segments the means, then the deviations, both times the square root of the length."""
    out = []
    for length in LENGTHS:
        parts = v.reshape(len(v), -1, length)
        mean = parts.mean(2)
        out += [mean * math.sqrt(length), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))]
    return out


def summarised(rows: DataFrame) -> DataFrame:
    """(id, label, v) with the summaries of v in `s`, level after level."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), LENGTHS[0])
            s = np.hstack(summary(v)) if v.size else np.zeros((len(v), 0))
            wide = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * s.shape[1], pa.array(s.ravel()))
            yield pa.record_batch([*batch.columns, wide], [*batch.schema.names, "s"])

    return rows.mapInArrow(run, "id long, label long, v array<double>, s array<double>")


@dataclass
class Vectors:
    """Vectors in order of (label, id) with their summaries."""

    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    s: list[np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> Vectors:
        rows = rows.sort_by([("label", "ascending"), ("id", "ascending")])
        v = matrix(rows.column("v"), LENGTHS[0])
        # A row's summary has one width for its own length; widths of this cell follow from the longest vector.
        flat, at, out = rows.column("s").combine_chunks(), 0, []
        counts = [v.shape[1] // n for n in LENGTHS for _ in range(2)]
        s = matrix(flat)
        if s.shape[1] != sum(counts) or len({x for x in np.diff(flat.offsets.to_numpy())}) > 1:
            s = np.hstack(summary(v)) if v.size else np.zeros((len(v), sum(counts)))
        for n in counts:
            out.append(s[:, at : at + n])
            at += n
        return cls(rows.column("id").to_numpy(), rows.column("label").to_numpy(), v, out)

    def wide(self, width: int) -> Vectors:
        """The same with zeros at the end up to `width` components."""
        if self.v.shape[1] == width:
            return self
        fill = lambda x, n: np.hstack([x, np.zeros((len(x), n - x.shape[1]))])
        return Vectors(self.id, self.label, fill(self.v, width), [fill(x, width // LENGTHS[k // 2]) for k, x in enumerate(self.s)])

    def at(self, rows) -> Vectors:
        return Vectors(self.id[rows], self.label[rows], self.v[rows], [x[rows] for x in self.s])


def open_pairs(q: Vectors, x: Vectors, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of x still open, mask of pairs) whose score can lie between `low` and `high` of its anchor.

    Each level looks only at rows that the levels before left open for some anchor.
    """
    columns = np.flatnonzero(want.any(0))
    want = want[:, columns]
    for k in range(0, len(q.s), 2):
        if not len(columns):
            break
        near = q.s[k] @ x.s[k][columns].T
        far = q.s[k + 1] @ x.s[k + 1][columns].T
        far += 1e-9 * (far + np.abs(near)) + 1e-6  # more than the sums can be wrong by
        want = want & (near + far >= low[:, None]) & (near - far <= high[:, None])
        some = want.any(0)
        columns, want = columns[some], want[:, some]
    return columns, want


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; values beyond 64 bits become the nearest that fit."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    big = [np.array([[int(c) for c in r] for r in m], object) for m in (q, x)]
    return np.array([[min(max(int(c), LONG[0]), LONG[1]) for c in r] for r in big[0] @ big[1].T], np.int64).reshape(len(q), len(x))


def first(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, open ones only; of equal scores those further left."""
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(score)), order.shape[1])
    order = order.ravel()
    there = score[row, order] > LEAST
    return row[there], order[there]


def merged(held: list[np.ndarray], row: np.ndarray, id_: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """(row, id, score) of the k best of each row among those held and the new ones."""
    row, id_, score = (np.concatenate(x) for x in zip(held, (row, id_, score)))
    order = np.lexsort((id_, -score, row))
    row, id_, score = row[order], id_[order], score[order]
    begin = np.searchsorted(row, row, "left")
    stay = np.arange(len(row)) - begin < k
    return [row[stay], id_[stay], score[stay]]


def _none() -> list[np.ndarray]:
    return [np.zeros(0, np.int64) for _ in range(3)]


def nearest_alike(q: Vectors, x: Vectors, k: int) -> list[np.ndarray]:
    """(anchor row, id, score) of each anchor's k best rows of its own label with another id."""
    out = [_none()]
    for label in np.intersect1d(q.label, x.label):
        mine = slice(*np.searchsorted(q.label, [label, label + 1]))
        theirs = slice(*np.searchsorted(x.label, [label, label + 1]))
        a, rows = q.at(mine), x.at(theirs)
        held = _none()
        step = max(1, min(CHUNK, PAIRS // len(a.id)))
        for at in range(0, len(rows.id), step):
            part = rows.at(slice(at, at + step))
            worst = np.full(len(a.id), -np.inf)  # the k-th best so far bounds what can still come in
            full = np.flatnonzero(np.bincount(held[0], minlength=len(a.id)) == k)
            worst[full] = held[2][np.searchsorted(held[0], full, "right") - 1]
            columns, want = open_pairs(a, part, worst, np.full(len(a.id), np.inf), a.id[:, None] != part.id)
            exact = np.where(want, scores(a.v, part.v[columns]), LEAST)
            row, column = first(exact, k)
            held = merged(held, row, part.id[columns][column], exact[row, column], k)
        out.append([held[0] + mine.start, *held[1:]])
    return [np.concatenate(x) for x in zip(*out)]


def nearest_unlike(q: Vectors, x: Vectors, tops: list[list[int]], share: tuple[int, int], k: int) -> list[np.ndarray]:
    """(anchor row, top, id, score) of each anchor's k best rows of another label for each of its `tops`: scores from
    share of the top up to the top."""
    num, den = share
    width = max(map(len, tops), default=0)
    top = np.full((len(tops), width), LEAST)  # no score reaches down to this
    for i, t in enumerate(tops):
        top[i, : len(t)] = t
    floor = np.where(top >= 0, (top // den) * num - (-(top % den) * num) // den, 1)  # the least whole score of the share
    high = top.max(1, initial=LEAST).astype(float)
    low = np.where(top >= 0, floor, LONG[1]).min(1, initial=LONG[1]).astype(float)
    out = [[np.zeros(0, np.int64) for _ in range(4)]]
    step = max(1, PAIRS // CHUNK)
    for a in range(0, len(q.id), step):
        mine = slice(a, a + step)
        part = q.at(mine)
        held = [_none() for _ in range(width)]
        for at in range(0, len(x.id), CHUNK):
            rows = x.at(slice(at, at + CHUNK))
            rows = rows.at(np.argsort(rows.id, kind="stable"))
            columns, want = open_pairs(part, rows, low[mine], high[mine], part.label[:, None] != rows.label)
            if not len(columns):
                continue
            exact = np.where(want, scores(part.v, rows.v[columns]), LEAST)
            order = np.argsort(-exact, axis=1, kind="stable")
            ranked, ids = np.take_along_axis(exact, order, 1), rows.id[columns]
            for j in range(width):
                p, least = top[mine, j], floor[mine, j]
                begin = (ranked > p[:, None]).sum(1)
                place = begin[:, None] + np.arange(k)
                inside = place < ranked.shape[1]
                place = np.minimum(place, ranked.shape[1] - 1)
                s = np.take_along_axis(ranked, place, 1)
                row, c = np.nonzero(inside & (s >= least[:, None]) & (s > LEAST) & (p >= 0)[:, None])
                held[j] = merged(held[j], row, ids[order[row, place[row, c]]], s[row, c], k)
        for j in range(width):
            row, id_, s = held[j]
            out.append([row + a, top[row + a, j], id_, s])
    return [np.concatenate(x) for x in zip(*out)]


def usable(rows: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v) of rows with an id, a label and a vector of finite numbers; v is floor(scale * component).

    Of rows that repeat an id one counts, that with the smallest label, then vector.
    """
    v = F.col(vector)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    good = rows.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & whole)
    scaled = F.transform(v, lambda c: F.lit(float(scale)) * c.cast("double"))
    number = F.transform(scaled, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))  # larger ones are whole
    one = F.min(F.struct(F.col(label).cast("long").alias("label"), number.alias("v")))
    return good.groupBy(F.col(id_).cast("long").alias("id")).agg(one.alias("x")).select("id", "x.label", "x.v")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, v) of `usable`.

    `anchors` picks the anchor rows. An anchor's positives are its best other rows of the same label; for each of them
    the best rows of other labels follow whose score is at least the share of the positive's and at most that. Order
    is by score, then smaller id. Negative positive scores have no such rows; vectors of different lengths are filled
    up with zeros, and scores beyond 64 bits are held at the nearest that fits. No anchors or no rows: no result.
    """
    spark = rows.sparkSession
    data = kept(summarised(rows.select("id", "label", "v")), "vectors")
    size = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(anchors).alias("a")).first()
    parts = max(1, -(-size["a"] // ANCHORS))
    cells = max(1, min(size["n"], 4 * spark.sparkContext.defaultParallelism), -(-size["n"] // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A copy with columns of its own, since both sides of the grid come from one table.
    dealt = data.toDF(*data.columns).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")).withColumn("part", every(parts))
    asked = data.where(anchors).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    grid = lambda a: dealt.groupBy("part", "cell").cogroup(a.withColumn("cell", every(cells)).groupBy("part", "cell"))

    def meet(left: pa.Table, right: pa.Table) -> tuple[Vectors, Vectors]:
        x, q = Vectors.of(left), Vectors.of(right)
        width = max(x.v.shape[1], q.v.shape[1])
        return x.wide(width), q.wide(width)

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = meet(left, right)
        row, id_, score = nearest_alike(q, x, positives)
        return pa.table({"anchor_id": q.id[row], "positive_id": id_, "positive_score": score})

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("label", "ascending"), ("id", "ascending")])
        x, q = meet(left, right)
        row, top, id_, score = nearest_unlike(q, x, right.column("tops").to_pylist(), share, negatives)
        return pa.table({"anchor_id": q.id[row], "positive_score": top, "negative_id": id_, "negative_score": score})

    def best(df: DataFrame, by: list[str], id_: str, score: str, k: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col(score).desc(), id_)
        return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)

    found = grid(asked).applyInArrow(alike, "anchor_id long, positive_id long, positive_score long")
    alike_rows = kept(best(found, ["anchor_id"], "positive_id", "positive_score", positives, "place").drop("place"), "positives")
    tops = alike_rows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("tops"))
    found = grid(asked.join(tops, "id")).applyInArrow(unlike, "anchor_id long, positive_score long, negative_id long, negative_score long")
    ranked = best(found, ["anchor_id", "positive_score"], "negative_id", "negative_score", negatives, "rank")
    out = kept(
        alike_rows.join(ranked, ["anchor_id", "positive_score"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"),
        "negatives",
    )
    drop(data, alike_rows)
    return out
