"""Language-model scores by a weighted backoff automaton, learnt from and applied to whole corpora.

States are histories seen in training. From history h, the arc of word w weighs
log10((c(hw) + mass * P(w)) / (c(h) + mass)), where P is the model of the next shorter history; words without an
arc take h's failure arc, which weighs log10(mass / (c(h) + mass)), and go on from the shorter history. The root
has an arc for every word, P(w) = (c(w) + 1) / (N + V + 1). The weights of all words from a state add up to one.

The automaton of a large corpus fits nowhere, so each block of documents gets the arcs it can use. A block sends its
distinct n-grams with their training counts; those that other blocks changed come back with the total. One
left-to-right traversal of each text then carries the state and adds up the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.store import kept
from attesta.llm.words import Words, mix, signed

BLOCK_BYTES = 4 << 20
SMALL = 100  # counts up to this travel in a byte each
PACKED_ROWS = 1 << 18
_START, _END = np.uint64(0x51AB7E0F3C2D4A69), np.uint64(0x2E6D9C81B7F30A55)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 7. A null id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class _Tokens:
    """The tokens of a block: each row's words, lower-cased, then an end token; and the keys of its n-grams."""

    def __init__(self, text: pa.Array, order: int):
        words = Words(text, lower=True)
        self.count = words.count + 1
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.count)
        token = np.full(self.first[-1], _END)
        token[words.row + np.arange(len(words.row))] = words.hashes()
        # keys[k - 1]: the k-gram ending at each token, with a start mark where the text has fewer before it.
        # One bit tells unigrams from longer ones.
        self.keys, last = [mix(token) | np.uint64(1)], token
        for k in range(2, order + 1):
            before = np.full(len(token), _START)
            before[1:] = last[:-1]
            before[self.place == 0] = _START
            last = mix(before * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(k))
            self.keys.append(last & ~np.uint64(1))

    def history(self, values: np.ndarray, start: float) -> np.ndarray:
        """Of each token's history, the value of the n-gram that ends before it; `start` at the start."""
        out = np.full(len(values), start, np.float64)
        out[1:] = values[:-1]
        out[self.place == 0] = start
        return out


def _counts(keys: list[np.ndarray], train: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their counts among training tokens, and the place of each token's keys among them."""
    flat = np.concatenate(keys)
    distinct, place = np.unique(flat, return_inverse=True)
    count = np.bincount(place, np.tile(train, len(keys)), len(distinct)).astype(np.int64)
    return distinct, count, np.split(place, len(keys))


def score(docs: DataFrame, order: int = 2, mass: float = 10.0, hold: Callable[[int | None], bool] = held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text, ...).

    The model learns from all rows but those that `hold` takes out and scores every row. `order` is the longest n-gram,
    `mass` the weight of the shorter history. base_score is that of the root alone. Null and empty texts consist of
    the end token. Rows without an id train; repeated rows train and are scored as often as they come. If nothing
    trains, every token is unknown with probability 1. An empty table gives none.
    """
    if order < 1 or mass <= 0:
        raise ValueError("order >= 1 and mass > 0 are needed")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))

    def trains(table: pa.Table) -> np.ndarray:
        return np.array([not hold(i) for i in table.column("doc_id").to_pylist()], bool)

    # Keys travel in lists, one for each range of keys that a block has: half the bytes of one row a key.
    bits = min(16, max(8, blocks.bit_length()))

    def count(table: pa.Table) -> pa.Table:
        tokens = _Tokens(table.column("text").combine_chunks(), order)
        distinct, n, _ = _counts(tokens.keys, trains(table)[tokens.row])
        block, parts = table.column("block")[0].as_py(), []
        for kind, some in ((np.int8, n <= SMALL), (np.int32, n > SMALL)):
            key, count = distinct[some], n[some].astype(kind)
            at = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            keys, counts = (pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (signed(key), count))
            empty = pa.nulls(1 << bits, pa.list_(pa.int32() if kind is np.int8 else pa.int8()))
            small, large = (counts, empty) if kind is np.int8 else (empty, counts)
            part = pa.table({"range": np.arange(1 << bits, dtype=np.int32), "block": np.full(1 << bits, block, np.int32), "key": keys, "small": small, "large": large})
            parts.append(part.filter(pa.array(np.diff(at) > 0)))
        return pa.concat_tables(parts)

    packed = dealt.groupBy("block").applyInArrow(count, "range int, block int, key array<long>, small array<tinyint>, large array<int>")
    n = F.coalesce(F.col("small").cast("array<int>"), "large").alias("n")
    grams = packed.repartition("range").select("range", "block", "key", n).select("range", "block", F.inline(F.arrays_zip("key", "n")))
    same = Window.partitionBy("range", "key")
    totals = grams.select(
        "range", "key", "block", "n", F.sum("n").over(same).alias("total"), (F.min("block").over(same) == F.col("block")).alias("owner")
    )
    # A block keeps its own count unless others add to it. One row of each trained unigram counts for N and V.
    changed, counts = F.col("total") != F.col("n"), F.col("owner") & (F.col("key").bitwiseAND(1) == 1) & (F.col("total") > 0)
    shared = kept(totals.select("key", "block", "total", counts.alias("counts"), changed.alias("changed")).where("changed or counts"), "totals")
    sums = shared.where("counts").agg(F.count("*"), F.sum("total")).first()
    kinds, tokens_n = sums[0], sums[1] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, key, total) as lists, one a block for every PACKED_ROWS rows or so."""
        held, rows_held = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows_held += batch.num_rows
            if held and (batch is None or rows_held >= PACKED_ROWS):
                block, key, total = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("block", "key", "total"))
                order = np.argsort(block, kind="stable")
                names, at = np.unique(block[order], return_index=True)
                cut = pa.array(np.append(at, len(block)).astype(np.int32))
                yield pa.record_batch([pa.array(names), *(pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (key, total))], ["block", "key", "total"])
                held, rows_held = [], 0

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([not hold(i) for i in batch.column("doc_id").to_pylist()], pa.bool_())], ["trains"])

    texts_n = rows.select("doc_id").mapInArrow(marks, "trains boolean").where("trains").count()

    def walk(table: pa.Table, arcs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        tokens = _Tokens(table.column("text").combine_chunks(), order)
        train = trains(table)
        distinct, n, place = _counts(tokens.keys, train[tokens.row])
        for key, total in zip(arcs.column("key").chunks, arcs.column("total").chunks):
            n[np.searchsorted(distinct, key.flatten().to_numpy().view(np.uint64))] = total.flatten().to_numpy()
        seen = [n[p].astype(np.float64) for p in place]
        weight = np.log10((seen[0] + 1) / (tokens_n + kinds + 1))
        base = weight
        # From short histories to long ones: a state's own arcs where it has one, else its failure arc and what follows.
        for k in range(1, order):
            state = tokens.history(seen[k - 1], texts_n)
            if k > 1:
                state[tokens.place == 0] = texts_n
            fail = np.log10(mass / (state + mass))
            weight = np.where(seen[k] > 0, np.log10((seen[k] + mass * 10.0**weight) / (state + mass)), fail + weight)
        add = lambda x: np.add.reduceat(x, tokens.first[:-1])
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": ~train, "n_tokens": tokens.count.astype(np.int64),
            "n_known": add((seen[0] > 0).astype(np.int64)), "base_score": add(base), "score": add(weight),
        })

    arcs = shared.where("changed").select("block", "key", "total").mapInArrow(pack, "block int, key array<long>, total array<long>")
    scored = dealt.groupBy("block").cogroup(arcs.groupBy("block")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens_n).cast("long").alias("train_tokens"), "base_score", "score")
