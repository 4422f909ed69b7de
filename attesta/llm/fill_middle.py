"""Fill-in-middle texts: each text is cut twice by hash and its middle moved to the end.

A text is a row of units (a run of ASCII letters, or one other code point). It is laid out in blocks of fixed size in
bytes. Two Fenwick trees over the blocks hold how many units and code points begin in each. A cut after k units is
found by binary-lifting descent to the block where unit k begins, and then inside that block alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import slices

BLOCK = 1 << 10  # bytes of a text block
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FIRST = np.ones(256, bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False


class Fenwick:
    """Prefix sums over blocks for several counts at once; row k of `counts` belongs to block k."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.total = counts.sum(0)
        self.tree = np.zeros((n + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        step = 1
        while step < n:  # the nodes of one level take in their children's sums together
            at = np.arange(2 * step, n + 1, 2 * step)
            self.tree[at] += self.tree[at - step]
            step *= 2
        self.top = 1 << max(0, n.bit_length() - 1)

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The block that holds item k (from 0) of the first count, and the sums of all counts before it."""
        at, before, step = 0, np.zeros(self.tree.shape[1], np.int64), self.top
        while step:
            to = at + step
            if to < len(self.tree) and before[0] + self.tree[to, 0] <= k:
                at, before = to, before + self.tree[to]
            step >>= 1
        return at, before


class Blocks:
    """A text in bytes with its units and code points counted by block."""

    def __init__(self, text: np.ndarray, block: int = BLOCK):
        self.block, self.size = block, len(text)
        self.point = _FIRST[text]
        letter = _LETTER[text]
        self.unit = self.point.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        starts = np.arange(0, max(1, self.size), block)
        if self.size:
            counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (self.unit, self.point)], 1)
        else:
            counts = np.zeros((1, 2), np.int64)
        self.tree = Fenwick(counts)
        self.units, self.points = map(int, self.tree.total)

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit k begins; the end of the text for the number of units."""
        if k >= self.units:
            return self.size, self.points
        at, before = self.tree.descend(k)
        lo = at * self.block
        inside = int(np.flatnonzero(self.unit[lo : lo + self.block])[k - before[0]])
        return lo + inside, int(before[1]) + int(np.count_nonzero(self.point[lo : lo + inside]))


@dataclass(frozen=True)
class Cuts:
    """Shares in percent, and the seed of the hash that draws cuts and forms."""

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20

    def draws(self, doc_id: int | None) -> list[int]:
        """The first four 8-digit groups of the hex SHA-256 of `seed:id`; a row without an id has an empty one."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arranged(text: bytes, doc_id: int | None, cuts: Cuts = Cuts(), block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    laid = Blocks(np.frombuffer(text, np.uint8), block)
    n = laid.units
    h1, h2, h3, h4 = cuts.draws(doc_id)
    if not text or h3 % 100 >= cuts.plain_from or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    (a, ca), (b, cb) = (laid.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < cuts.spm_below:
        return n, "spm", ca, cb - ca, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return n, "psm", ca, cb - ca, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that `output` was made from. Texts with a mark stay plain, so the first mark found is the right one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, cuts: Cuts = Cuts(), block: int = BLOCK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of every row of `docs` (doc_id, text, any others).

    Null texts count as empty; empty texts are plain with no units. Repeated rows come as often as they are there and
    are cut alike; rows without an id are cut by the hash of an empty id. An empty table gives an empty result. A very
    long text costs time and a few bytes of memory in proportion to its length; a task holds one slice of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            made = [arranged(t, i, cuts, block) for i, t in zip(ids, texts)]
            n, form, head, middle, output = zip(*made)
            back = [restored(o, f) for o, f in zip(output, form)]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(head, pa.int64()), pa.array(middle, pa.int64())]
            texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (output, back)]
            yield pa.record_batch([*columns, *texts], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
