"""Near copies by SimHash fingerprints that meet in fuzzy keys of the binary Golay code.

A fingerprint has 64 bits in three segments. Of three differing bits or fewer, two segments hold at most one
each. The perfect [23,12] code assigns each segment to one codeword. An indexed fingerprint has one key for
each pair of segments; a probing one has the keys of all words one bit away, so both meet in some key.
Every meeting is verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.components import connected, forest
from attesta.llm.store import kept
from attesta.llm.words import LOWER_TABLE, Words, mix, slices

# Generator polynomial of the binary Golay code, and (first bit, bits) of the segments.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if over half of the shingles' XXH64 values, repeats included, have it. No words: 0."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = np.array(hashes[at : at + 4096], np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of bytes at the three places of a word, and the error pattern of each remainder."""

    def rest(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    table = np.array([[rest(b << 8 * k) if b << 8 * k < 1 << 23 else 0 for b in range(256)] for k in range(3)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[rest(pattern)] = pattern
    return table, errors


_REST, _ERROR = _remainders()


def codeword(word: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    rest = _REST[0][word & 255] ^ _REST[1][word >> 8 & 255] ^ _REST[2][word >> 16]
    return (word ^ _ERROR[rest]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, key, whether it is the index key). Keys that repeat within a row appear once."""
    near, own = [], []
    for first, bits in SEGMENTS:
        word = (fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
        codes = np.sort(codeword(word[:, None] ^ flips), axis=1)
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        near.append((codes, fresh))
        own.append(codeword(word))
    rows, keys, index = [], [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        r, p, q = np.nonzero(near[i][1][:, :, None] & near[j][1][:, None, :])
        rows += [np.arange(len(fp)), r]
        keys += [own[i] << 12 | own[j] | k << 24, near[i][0][r, p] << 12 | near[j][0][r, q] | k << 24]
        index += [np.ones(len(fp), bool), np.zeros(len(r), bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(index)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, key, index = fuzzy_keys(part)
            yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(index), pa.array(part[row].view(np.int64))], ["key", "indexed", "fp"])


def _meet(key: np.ndarray, indexed: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows sorted by key, thinned to a forest with the same reach."""
    left, right = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    order = np.lexsort((~indexed, key))
    key, indexed, fp = key[order], indexed[order], fp[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    entries = np.bincount(group, indexed, len(start)).astype(np.int64)
    rows = np.flatnonzero(~indexed & (entries[group] > 0))
    work = np.concatenate(([0], np.cumsum(entries[group[rows]])))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(work, work[at] + PAIRS_AT_ONCE, "right")) - 1)
        part = rows[at:end]
        n = entries[group[part]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(fp[part], n), fp[np.repeat(start[group[part]], n) + inner]
        close = (a != b) & (np.bitwise_count(a ^ b) <= most)
        if close.any():
            left, right = forest(np.concatenate((left, a[close])), np.concatenate((right, b[close])))
        at = end
    return left, right


def linked(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the reach of all pairs at most `most` <= 3 bits apart.

    Rows are dealt and sorted by key. A task holds a few whole keys at a time, compares their index entries with
    their probes in blocks and passes on a forest, so a crowded key costs comparisons but no pair rows.
    """
    if not 0 <= most <= 3:
        raise ValueError("the segments guarantee a meeting for at most three differing bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 18:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield edges(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size = whole.num_rows - cut
        if size:
            yield edges(pa.Table.from_batches(held))

    def edges(rows: pa.Table) -> pa.RecordBatch:
        a, b = _meet(rows.column("key").to_numpy(), rows.column("indexed").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), most)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    spread = fps.select("fp").mapInArrow(_spread, "key int, indexed boolean, fp long")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text, any others).

    Equal fingerprints are one node, whatever number of documents has them. Null texts count as empty; texts
    without words share fingerprint zero and link like any other. component_id is the smallest id reachable; a row
    without an id is reported with the component of its fingerprint but never names one (null if none has an id).
    Repeated rows are reported as often as they come. An empty table gives an empty result.
    """
    own = kept(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = kept(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(linked(nodes, most))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(lowest, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near texts -----------------------------------------------------------------------------------

# Texts whose sets of five-word shingles have a similarity of 0.8 differ in 15 % of their fingerprint's bits in the mean,
# far more than fuzzy keys of three segments can bridge. Long fingerprints have many segments, and any two of them whose
# words decode to the same codewords are a key.
LANES = 5  # 64-bit words of a long fingerprint
LONG_SEGMENTS = tuple((k * 23, 23) for k in range(13)) + ((299, 21),)
NEAR_BITS = 50  # of 320: the mean at a similarity of 0.8 is 48, its deviation 6; at 0.7 the mean is 61


def long_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp) of every row; fp holds 320 bits. Bit i is set if over half of the distinct shingles' hashes have it.

    Words are told apart without the case of A-Z. Texts of fewer words than a shingle have one of all their words;
    texts without words have fingerprint zero.
    """
    step = np.random.default_rng(9).integers(1, 1 << 63, LANES, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            words = Words(batch.column("text"), lower=True)
            hashes = words.hashes()
            whole = words.whole(shingle)
            value = words.sequences(hashes, shingle)
            row = words.row[whole]
            value = value[whole]
            short = np.flatnonzero((words.count > 0) & (words.count < shingle))
            sums = np.zeros(len(short), np.uint64)
            for j, r in enumerate(short.tolist()):
                for k, h in enumerate(hashes[words.first[r] : words.first[r + 1]]):
                    sums[j] += mix(h + np.uint64(k))
            row, value = np.concatenate((row, short)), np.concatenate((value, sums))
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            row, value = row[fresh], value[fresh]
            out = np.zeros((batch.num_rows, LANES), np.uint64)
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(row)))
            for lane in range(LANES):
                total = np.zeros((len(start), 64), np.int64)
                # Whole rows' shingles at a time, so that no more than some MB of bits are held.
                at = 0
                while at < len(start):
                    to = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 16), "right")) - 1) if start[-1] > start[at] + (1 << 16) else len(start)
                    end = start[to] if to < len(start) else len(row)
                    bits = np.unpackbits(mix(value[start[at] : end] + step[lane]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    total[at:to] = np.add.reduceat(bits, start[at:to] - start[at], axis=0, dtype=np.int64)
                    at = to
                packed = np.packbits(2 * total > size[:, None], axis=1, bitorder="little")
                out[row[start], lane] = packed.view(np.uint64)[:, 0] if len(start) else 0
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


def long_keys(fp: np.ndarray) -> np.ndarray:
    """The keys of each long fingerprint: codewords of any two segments, and which two."""
    codes = []
    for first, bits in LONG_SEGMENTS:
        lane, shift = divmod(first, 64)
        word = fp[:, lane] >> np.uint64(shift)
        if shift + bits > 64:
            word = word | fp[:, lane + 1] << np.uint64(64 - shift)
        codes.append(codeword((word & np.uint64((1 << bits) - 1)).astype(np.int64)))
    return np.stack([codes[i] << 12 | codes[j] | k << 24 for k, (i, j) in enumerate(combinations(range(len(codes)), 2))], axis=1)


def long_linked(nodes: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) that share a key and are at most `most` bits apart, thinned to forests by key.

    A task holds a few keys at a time. Members of a key are compared in blocks and only a forest is passed on.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)
                keys = long_keys(fp)
                which = pa.array(np.repeat(np.arange(len(fp)), keys.shape[1]))
                yield pa.record_batch([pa.array(keys.ravel().astype(np.int32)), part.column("node").take(which), part.column("fp").take(which)], ["key", "node", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield edges(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    def edges(rows: pa.Table) -> pa.RecordBatch:
        key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy().view(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        left, right = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        some = np.flatnonzero(size > 1)
        if len(some):
            fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)
            # Member d places on in the key, for all keys together; keys with no such member drop out.
            d, start, size = 1, start[some], size[some]
            while len(start):
                n = size - d
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for k in range(0, len(at), 1 << 18):
                    a = at[k : k + (1 << 18)]
                    close = np.bitwise_count(fp[a] ^ fp[a + d]).sum(1) <= most
                    if close.any():
                        left, right = forest(np.concatenate((left, node[a[close]])), np.concatenate((right, node[a[close] + d])))
                d += 1
                start, size = start[size > d], size[size > d]
        return pa.record_batch([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

    dealt = nodes.select("node", "fp").mapInArrow(spread, "key int, node long, fp binary")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def near_texts(docs: DataFrame, shingle: int = 5, most: int = NEAR_BITS) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id of texts reachable by links of near texts.

    Texts are linked if their long fingerprints of five-word shingles differ in at most `most` of 320 bits, as those of
    texts with a shingle similarity of 0.8 or more mostly do (README has the measured recall), and share a key. Texts with equal fingerprints are one
    node. Nulls, repeated rows and rows without an id count as in `near_copies`.
    """
    own = kept(long_fingerprints(docs, shingle).withColumn("node", F.xxhash64("fp")), "long_fingerprints")
    nodes = kept(own.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")), "long_nodes")
    roots = connected(long_linked(nodes, most))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_each(docs: DataFrame, shingle: int = 5, most: int = NEAR_BITS) -> DataFrame:
    """One row of each group of near texts, that of the smallest id, with all its columns.

    Of rows that repeat an id one stays. Rows without an id can't be told apart and all stay. Null and texts without
    words are near each other; an empty table stays empty.
    """
    chosen = near_texts(docs, shingle, most).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))
