"""Sums of products of many columns with many columns, as a grid of tiles.

Rows hold their columns in ARRAY<DOUBLE>. They are cut once into blocks of rows and tiles of columns, one stored row a
(tile, block). A cell of the grid is a pair of tiles over a few blocks: it meets in one task, which multiplies the
tiles and passes on one partial sum. Partial sums of a pair of tiles are added level by level, a few at a time.
So no task holds more than a few tiles and a few sums, however many rows or columns there are.

Where rows are many times as wide as what they are made from, they are not cut and stored: `in_place` sums a band of
columns by a band of columns over a task's own rows, and only these sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import stage

ROWS, COLUMNS = 2048, 256  # of a tile
BAND, BAND_MB, TASK_ROWS = 3072, 32, 1 << 16  # columns of a band; MB of a block of its rows; rows of a task that sums in place
BLOCKS, SUMS = 8, 32  # blocks in a cell; partial sums added in a task
PIECE, GROUP_MB = 256, 32  # cells of a wide row that go to Python as one row; MB of a stored group of tiles


def whole_rows(column: Column, width: int) -> Column:
    """The array, or one of missing cells where there is none."""
    return F.coalesce(column, F.array_repeat(F.lit(None).cast("double"), width))


def chosen(name: str, width: int, numbers: np.ndarray) -> Column:
    """The array with the cells of the numbers alone, in their order."""
    if np.array_equal(numbers, np.arange(width)):
        return F.col(name)
    return F.transform(F.lit(numbers.tolist()), lambda k: F.get(name, k)).alias(name)


def pieces(data: DataFrame, columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """The arrays of a row one after the other, in pieces of at most PIECE cells that follow each other.

    Batches for Python count rows, so thousands of whole wide rows would be in memory at once.
    """
    parts = [F.slice(c, at + 1, PIECE if at + PIECE < w else 1 << 30) for c, w in zip(columns, widths) for at in range(0, w, PIECE)]
    return data.select(F.explode(F.array(*parts) if parts else F.array().cast("array<array<double>>")).alias("v"))


def matrices(batches, widths: Sequence[int], rows: int):
    """Lists of one matrix an array, of `rows` rows (the last: fewer), from batches of pieces; missing elements are NaN.

    The next list overwrites the one before.
    """
    lengths = np.array([min(PIECE, w - at) for w in widths for at in range(0, w, PIECE)])
    total, ends, seen, have = sum(widths), np.cumsum(widths)[:-1], 0, 0
    whole = np.empty(rows * total)
    for batch in batches:
        column = batch.column(0)
        if (np.diff(column.offsets.to_numpy()) != lengths[(seen + np.arange(len(column))) % len(lengths)]).any():
            raise ValueError(f"arrays of other lengths than {list(widths)}")
        seen += len(column)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        while len(flat):
            taken = flat[: len(whole) - have]
            whole[have : have + len(taken)] = taken
            have, flat = have + len(taken), flat[len(taken) :]
            if have == len(whole):
                yield np.split(whole.reshape(rows, total), ends, axis=1)
                have = 0
    if have:
        yield np.split(whole[:have].reshape(-1, total), ends, axis=1)


def column_masks(data: DataFrame, columns: Sequence[str], widths: Sequence[int] = ()) -> dict[str, list]:
    """A signature of the missing cells of every column of each array; equal signatures mean equal missing rows.

    Every row has two random numbers. A column's signature joins those of its missing rows by exclusive or.
    `widths` are the lengths of the arrays, looked up if not given.
    """
    widths = list(widths) or [n or 0 for n in data.agg(*[F.max(F.size(c)) for c in columns]).first()]

    def run(batches):
        draw, found = np.random.default_rng(1 + TaskContext.get().partitionId()), {}
        for parts in matrices(batches, widths, 512):
            key = draw.integers(1, 1 << 63, (2, len(parts[0]), 1), dtype=np.int64)
            for side, part in enumerate(parts):
                marks = np.bitwise_xor.reduce(np.where(~np.isfinite(part), key, 0), axis=1)
                found[side] = marks if side not in found else found[side] ^ marks
        for side, (a, b) in found.items():
            yield pa.record_batch([pa.array(np.full(len(a), side, np.int32)), pa.array(np.arange(len(a), dtype=np.int32)), pa.array(a), pa.array(b)], ["side", "k", "a", "b"])

    marks = pieces(data, columns, widths).mapInArrow(run, "side int, k int, a long, b long").groupBy("side", "k").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    out: dict[str, list] = {c: [] for c in columns}
    for r in sorted(marks.collect()):  # one row a column, as many as there are names
        out[columns[r["side"]]].append((r["a"], r["b"]))
    return out


def tile_columns(masks: Sequence, width: int = 0) -> list[np.ndarray]:
    """Column numbers by tile; columns of one tile have the same mask."""
    width, out = width or COLUMNS, []
    for _, same in groupby(sorted(range(len(masks)), key=lambda k: (masks[k], k)), key=lambda k: masks[k]):
        same = list(same)
        out += [np.array(same[at : at + width]) for at in range(0, len(same), width)]
    return out


def cut(
    data: DataFrame, sides: Sequence[tuple[str, list[np.ndarray]]], carried: str | None = None,
    own: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, rows: int = 0, carried_width: int = 0,
) -> DataFrame:
    """(side, tile, block, v, c, own), stored: a tile's cells of one block of rows, by row.

    `carried` names an array of `carried_width` cells that goes along with the tiles of the first side. `own(carried,
    tile)` is an array of numbers of the tile alone that is stored beside it.
    """
    names, size = [n for n, _ in sides] + ([carried] if carried else []), rows or ROWS
    widths = [sum(map(len, tiles)) for _, tiles in sides] + ([carried_width] if carried else [])

    def emit(block, parts):
        c = np.ascontiguousarray(parts[-1]) if carried else None
        for side, (_, tiles) in enumerate(sides):
            for t, columns in enumerate(tiles):
                v = np.ascontiguousarray(parts[side][:, columns])
                yield pa.record_batch(
                    [
                        pa.array([side], pa.int32()), pa.array([t], pa.int32()), pa.array([block], pa.int64()), pa.array([v.tobytes()], pa.binary()),
                        pa.array([c.tobytes() if carried and side == 0 else None], pa.binary()), pa.array([own(c, v).tobytes() if own else None], pa.binary()),
                    ],
                    ["side", "tile", "block", "v", "c", "own"],
                )

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, parts in enumerate(matrices(batches, widths, size)):
            yield from emit(first + k, parts)

    schema = "side int, tile int, block long, v binary, c binary, own binary"
    return stage(pieces(data, names, widths).mapInArrow(run, schema), "tiles", GROUP_MB)


def added(sums: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """(keys, v): the sum over g of arrays packed in v, at most SUMS of them at a time."""
    names = ", ".join(f"{k} int" for k in keys)

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("v"):
            part = np.frombuffer(v.as_buffer(), float)
            total = part.copy() if total is None else np.add(total, part, out=total)
        head = table.select([*keys, "g"]).slice(0, 1)
        return head.append_column("v", pa.array([total.tobytes()], pa.binary()))

    out, left = sums, blocks
    while True:
        out = out.withColumn("g", F.floor(F.col("g") / SUMS).cast("int") if left > SUMS else F.lit(0))
        out = out.groupBy(*keys, "g").applyInArrow(add, f"{names}, g int, v binary")
        left = -(-left // SUMS)
        if left <= 1:
            return out.drop("g")


def cells(left: DataFrame, right: DataFrame, mates: Column, partners: Column, groups: int, multiply, schema: str = "v binary") -> DataFrame:
    """(i, j, g, v): `multiply(left rows, right rows)` of every cell, as packed numbers.

    `mates` is the array of right tiles that a left tile meets, `partners` the array of left tiles that a right one meets.
    """

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        v = multiply(a, b) if a.num_rows and b.num_rows else None
        rows = [] if v is None else [v.tobytes()]
        names = ["i", "j", "g"]
        return pa.table([*[pa.array([key[k].as_py()] * len(rows), pa.int32()) for k in range(3)], pa.array(rows, pa.binary())], [*names, "v"])

    right = right.toDF(*right.columns)  # columns of its own: both sides may come from one table
    g = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g")
    a = left.select(F.col("tile").alias("i"), F.explode(mates).alias("j"), g, *[c for c in left.columns if c not in ("side", "tile")])
    b = right.select(F.explode(partners).alias("i"), F.col("tile").alias("j"), g, *[c for c in right.columns if c not in ("side", "tile")])
    return a.groupBy("i", "j", "g").cogroup(b.groupBy("i", "j", "g")).applyInArrow(run, f"i int, j int, g int, {schema}")


def bands(tiles: Sequence[np.ndarray], extra: int) -> list[list[int]]:
    """Tile numbers in runs of at most BAND columns, `extra` of them added for each tile."""
    out, size = [], 0
    for t, columns in enumerate(tiles):
        size += len(columns) + extra
        if not out or size > BAND:
            out.append([])
            size = len(columns) + extra
        out[-1].append(t)
    return out


def in_place(data: DataFrame, columns: Sequence[str], widths: Sequence[int], rows: int, add: Callable[[dict, list[np.ndarray]], None], keys: Sequence[str]) -> DataFrame:
    """(keys, v): sums that tasks gather over their own rows, so that no row is ever shuffled or stored.

    `add(sums, matrices)` adds a block of rows to the task's arrays by key, which it holds all at once. There are `rows`
    rows, and at least TASK_ROWS of them to a task once every core has one, so that sums stay few on a huge table.
    """
    tasks = max(data.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    block = max(1, min(ROWS, (BAND_MB << 17) // max(1, sum(widths))))

    def run(batches):
        sums: dict = {}
        for parts in matrices(batches, widths, block):
            add(sums, parts)
        g = pa.array([TaskContext.get().partitionId()], pa.int32())
        for key, v in sums.items():
            yield pa.record_batch([*(pa.array([k], pa.int32()) for k in key), g, pa.array([v.tobytes()], pa.binary())], [*keys, "g", "v"])

    schema = "".join(f"{k} int, " for k in keys) + "g int, v binary"
    return added(pieces(data.coalesce(tasks), columns, widths).mapInArrow(run, schema), keys, tasks)


def groups_of(blocks: int) -> int:
    return max(1, -(-blocks // BLOCKS))
