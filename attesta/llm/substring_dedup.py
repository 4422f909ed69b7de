"""Removal of repeated word sequences by difference-cover anchors.

Two occurrences of a window of 20 words, wherever they start, have a shift below 13 at which both positions lie in
the cover {0, 1, 3, 9} modulo 13, because every difference modulo 13 is one between members. So an 8-word anchor
is hashed at cover positions only, and any repeated window holds an anchor that is repeated too. Only windows
around repeated anchors are extended to their full length and compared, by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.store import drop, kept
from attesta.llm.words import Words, mix, signed, slices

# A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _singles(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that stand for their key in this batch, rows whose key is in it more than once, row that stands for each)."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    size = np.diff(np.append(np.flatnonzero(fresh), len(key)))
    first, many, lead = np.zeros(len(key), bool), np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    first[order[fresh]] = True
    many[order] = np.repeat(size > 1, size)
    lead[order] = np.repeat(order[fresh], size)
    return first, many, lead


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos) of the anchors whose words occur at another cover position, in any document.

    A batch sends one row for each of its anchors. What repeats inside a batch is known there: those rows carry the
    weight 2 and all but one of them go out under a key of their own, so a key has at most as many rows as batches.
    """
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy()
            words = Words(batch.column("text"))
            at = np.flatnonzero(words.whole(length) & _IN_COVER[words.place % PERIOD])
            key = words.sequences(words.hashes(), length)[at]
            first, many, _ = _singles(key)
            doc, place = ids[words.row[at]], words.place[at]
            own = mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
            yield pa.record_batch(
                [pa.array(signed(np.where(first, key, own))), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(many)],
                ["key", "doc_id", "pos", "known"],
            )

    found = docs.mapInArrow(run, "key long, doc_id long, pos int, known boolean")
    many = F.count("*").over(Window.partitionBy("key")) > 1
    return found.withColumn("again", many | F.col("known")).where("again").select("doc_id", "pos")


def repeated_starts(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos) of the windows whose word sequence also starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy()
            words = Words(batch.column("text"))
            marks = batch.column("anchors")
            row = np.repeat(np.arange(len(ids)), marks.value_lengths().to_numpy(zero_copy_only=False))
            near = np.zeros(len(words.start) + 1, np.int64)
            near[words.first[row] + marks.flatten().to_numpy() + 1] = 1
            near = np.cumsum(near)  # anchors before each word
            ends = np.minimum(np.arange(len(words.start)) + PERIOD, np.repeat(words.first[1:], words.count))
            at = np.flatnonzero(words.whole(window) & (near[ends] > near[:-1]))
            high, low = (words.sequences(words.hashes(k), window, k)[at] for k in (0, 1))
            doc, place = ids[words.row[at]], words.place[at]
            order = np.lexsort((place, doc))
            high, low, doc, place = high[order], low[order], doc[order], place[order]
            first, _, lead = _singles(high ^ mix(low))
            # Later windows are known to go; those of a repeated row are the same window again.
            some = first | (doc != doc[lead]) | (place != place[lead])
            high, low, doc, place, first = high[some], low[some], doc[some], place[some], first[some]
            own = mix(doc.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64))
            yield pa.record_batch(
                [pa.array(signed(np.where(first, high, own))), pa.array(signed(np.where(first, low, own))), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(~first)],
                ["high", "low", "doc_id", "pos", "known"],
            )

    lists = anchors.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("anchors"))
    found = docs.join(lists, "doc_id").select("doc_id", "text", "anchors").mapInArrow(run, "high long, low long, doc_id long, pos int, known boolean")
    turn = F.rank().over(Window.partitionBy("high", "low").orderBy("doc_id", "pos"))
    return found.withColumn("turn", turn).where("turn > 1 or known").select("doc_id", "pos")


def _removed(text: str, starts: list[int], window: int) -> tuple[int, int, str]:
    """(words, removed words, the rest) of a text whose windows at `starts` go."""
    words = text.encode().split()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts, np.int64) + window, -1)
    stay = np.cumsum(change)[:-1] == 0
    left = [w for w, s in zip(words, stay.tolist()) if s]
    return len(words), len(words) - len(left), b" ".join(left).decode()


def deduplicated(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of `docs` (doc_id, text, any others).

    Each word goes that a window of `window` words covers whose word sequence also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. Null and empty texts have no words.
    Rows without an id neither lose words nor make others lose any. Repeated rows (same id and text) count as one
    document and are all reported alike; an id must not stand for different texts. An empty table gives none.
    """
    if window < PERIOD:
        raise ValueError(f"a window must have at least {PERIOD} words")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    anchors = kept(repeated_anchors(named, window), "anchors")
    starts = kept(repeated_starts(named, anchors, window), "starts")
    drop(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lists = batch.column("text").to_pylist(), batch.column("starts")
            found = [_removed(t, s or [], window) for t, s in zip(texts, lists.to_pylist())]
            n, gone, left = zip(*found)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    lists = starts.groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    joined = rows.join(lists, "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
