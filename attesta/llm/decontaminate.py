"""Benchmark passages in documents, also with other numbers, names or units.

Texts become templates: numbers, names and units give way to typed placeholders, one for a run of words of a kind
("New York", "twenty five"). A capitalised word that opens a sentence may be a name or not, so its windows come in
both forms. Windows of eight template tokens are hash-joined between documents and items. Windows of neighbouring
diagonals count together, so words may be put in or left out between them. A window counts if its slots agree with the
others: each value of the item stands for one value of the document and the other way round, by most of its places,
or is unchanged. Together the windows need as many words of their own, unchanged values or values that stand for the
same one again as make up three fifths of a window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.store import kept
from attesta.llm.words import mix, signed, slices

BROADCAST_WINDOWS = 1 << 20  # item windows that each task may hold: 8 MB

# Marks around words, written numbers and units.
MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^@"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh"
).split()
_KINDS = dict.fromkeys(UNITS, 3) | dict.fromkeys(NUMBERS, 1)
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_CAPITAL, _STOP, _MARKED = 4, 8, 16


class _Codes(dict):
    """What a word is: bits of its hash, then whether it ends in a mark or a sentence, is capitalised, and its kind."""

    def __missing__(self, key: bytes) -> int:
        word = key.decode()
        core = word.strip(MARKS)
        low, first, last = core.lower(), core[:1], word[-1]
        kind = _NUMBER if first.isdigit() else _KINDS.get(low, _LITERAL)
        code = xxhash.xxh64_intdigest(low, 7) >> 5 << 5 | kind
        if first.isupper() and not core.isupper():
            code |= _CAPITAL
        if last in MARKS:
            code |= _MARKED | _STOP if last in ".!?:" or not core else _MARKED
        if len(self) > 1 << 18:
            self.clear()
        self[key] = code
        return code


class Coded:
    """Words of texts by their codes, and which of them open a sentence."""

    def __init__(self, texts: list[str | None], codes: _Codes):
        words = [(t or "").encode().split() for t in texts]
        self.words = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(self.words)))
        self.code = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.uint64, first[-1])
        self.row = np.repeat(np.arange(len(words)), self.words)
        self.place = np.arange(len(self.code)) - np.repeat(first[:-1], self.words)
        self.opens = self.place == 0
        self.opens[1:] |= (self.code[:-1] & np.uint64(_STOP)) > 0


class Templates:
    """Template tokens of texts: hash of the token or of its kind, whether it is a slot, its own value, its words.

    Words of one kind of slot with no mark between them are one token. `opened`: capitalised words that open a sentence
    are names, and only windows with one of them are listed.
    """

    def __init__(self, texts: Coded, opened: bool = False):
        code, row, place, self.words = texts.code, texts.row, texts.place, texts.words
        kind = code & np.uint64(3)
        name = (kind == _LITERAL) & ((code & np.uint64(_CAPITAL)) > 0)
        asked = name & texts.opens if opened else np.ones(len(code), bool)
        kind = np.where(name if opened else name & ~texts.opens, np.uint64(_NAME), kind)
        more = np.zeros(len(code), bool)
        more[1:] = (kind[1:] != _LITERAL) & (kind[1:] == kind[:-1]) & (place[1:] > 0) & ((code[:-1] & np.uint64(_MARKED)) == 0)
        start = np.flatnonzero(~more)
        size = np.diff(np.append(start, len(code)))
        power = np.cumprod(np.full(size.max(initial=1), 0x9E3779B97F4A7C15, np.uint64))
        value = mix(code >> np.uint64(5)) * power[np.arange(len(code)) - np.repeat(start, size)]
        self.value = np.add.reduceat(value, start) if len(start) else value
        self.row, self.at, self.to = row[start], place[start], place[start] + size
        self.asked = np.concatenate(([0], np.cumsum(asked)))[np.append(start, len(code))]
        self.count = np.bincount(self.row, minlength=len(self.words))
        self.place = np.arange(len(start)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.slot = kind[start] != _LITERAL
        self.token = np.where(self.slot, mix(kind[start]), self.value)

    def windows(self, n: int, bare: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first tokens of the windows of n tokens, their keys).

        Unless `bare`, a window with too few words of its own takes the values in its slots for its key: nothing
        else could tell a short one from others.
        """
        at = np.flatnonzero(self.place + n <= np.repeat(self.count, self.count))
        at = at[self.asked[at + n] > self.asked[at]]
        rich = np.ones(len(at), bool)
        if not bare:
            literals = np.concatenate(([0], np.cumsum(~self.slot)))
            rich = (literals[at + n] - literals[at]) * 5 >= 3 * n
        key = np.where(rich, np.uint64(n), np.uint64(n + (1 << 32)))
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(rich, self.token[at + k], self.value[at + k])
        return at, mix(key)

    def listed(self, at: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
        """The values in the slots of each window, in order, the places of their first words, and those of other words."""
        inner = at[:, None] + np.arange(n)
        out = []
        for x, some in ((signed(self.value), self.slot[inner]), (self.at, self.slot[inner]), (self.at, ~self.slot[inner])):
            ends = pa.array(np.concatenate(([0], np.cumsum(some.sum(1)))).astype(np.int32))
            out.append(pa.ListArray.from_arrays(ends, pa.array(x[inner][some])))
        return tuple(out)


def _own_length(count: np.ndarray, window: int) -> np.ndarray:
    """The other length of windows of an item of so many tokens: all, or what fits before or after any one changed token."""
    return np.where(count < window, count, np.where((count > window) & (count <= 2 * window), (count - 1) // 2, 0))


def _windows(rows: DataFrame, name: str, lengths: tuple[int, ...], whole: bool, wanted: np.ndarray | None) -> DataFrame:
    """(name, n_tokens, length, size, pos, key, slots, slot_at, word_at) of the windows, in words but for `length`.

    `whole`: short texts have windows of their own length besides. With `wanted`, sorted keys, only windows with one
    of them are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches, limit=2 << 20):
            ids, texts = batch.column(name).to_numpy(zero_copy_only=False), Coded(batch.column("text").to_pylist(), codes)
            for opened in (False, True):
                found = Templates(texts, opened)
                own = _own_length(found.count, max(lengths)) if whole else np.zeros(0, np.int64)
                for n in sorted({*lengths, *own.tolist()} - {0}):
                    at, key = found.windows(n, n == max(lengths))
                    if n not in lengths:
                        at, key = (x[own[found.row[at]] == n] for x in (at, key))
                    if wanted is not None and len(at):
                        near = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
                        some = wanted[near] == key if len(wanted) else np.zeros(len(at), bool)
                        at, key = at[some], key[some]
                    row, pos = found.row[at], found.at[at]
                    yield pa.record_batch(
                        [pa.array(ids[row]), pa.array(found.words[row]), pa.array(np.full(len(at), n, np.int32)), pa.array(found.to[at + n - 1] - pos), pa.array(pos), pa.array(signed(key)), *found.listed(at, n)],
                        ["id", "n_tokens", "length", "size", "pos", "key", "slots", "slot_at", "word_at"],
                    )

    schema = "id long, n_tokens long, length int, size long, pos long, key long, slots array<long>, slot_at array<long>, word_at array<long>"
    return rows.select(F.col(name).cast("long"), F.col("text").cast("string")).where(f"{name} is not null").mapInArrow(run, schema).withColumnRenamed("id", name)


def _agreed(met: list[dict]) -> int:
    """The item's tokens under the windows whose slots agree with those of most."""
    pairs = {p for m in met for p in zip(m["item_slot_at"], m["slot_at"], m["item_slots"], m["slots"])}
    both, theirs, own = Counter(p[2:] for p in pairs), Counter(p[2] for p in pairs), Counter(p[3] for p in pairs)
    holds = {(v, d) for (v, d), n in both.items() if v == d or (2 * n > theirs[v] and 2 * n > own[d])}
    met = [m for m in met if holds.issuperset(zip(m["item_slots"], m["slots"]))]
    words = {w for m in met for w in m["item_word_at"]}
    slots = {(at, v, d) for m in met for at, v, d in zip(m["item_slot_at"], m["item_slots"], m["slots"])}
    again = len(slots) - len({(v, d) for _, v, d in slots if v != d})
    if 5 * (len(words) + again) < 3 * max((m["item_length"] for m in met), default=0):
        return 0
    n = end = 0
    for at, to in sorted((m["item_pos"], m["item_pos"] + m["item_size"]) for m in met):
        n += max(0, to - max(at, end))
        end = max(to, end)
    return n


def _best(met: list[dict]) -> int:
    """The most tokens of an item under windows, sorted by diagonal, of one diagonal or of some within half an item."""
    total, most = met[0]["item_tokens"], 0
    lines = [m["diagonal"] for m in met]
    for at in range(len(met)):
        if at and lines[at] == lines[at - 1]:
            continue
        for to in {bisect_right(lines, lines[at]), bisect_right(lines, lines[at] + total // 2)}:
            most = max(most, _agreed(met[at:to]))
            if most == total:
                return most
    return most


def matches(docs: DataFrame, items: DataFrame, window: int = 8, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_matched, n_tokens) of the items of which a document holds at least `share`.

    n_matched counts the item's tokens under matching windows whose slots agree and whose diagonals are at most half
    the item's tokens apart. Items shorter than a window match as a whole; items of at most two windows also by shorter
    ones, if a window's tokens or more match in all. The keys of the items' windows are sent to all tasks to thin out
    the documents' windows if there are at most BROADCAST_WINDOWS of them; otherwise all windows go into the join.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (doc, item), met in groupby(rows, lambda r: (r["doc_id"], r["item_id"])):
            met = list(met)
            n, total = _best(met), met[0]["item_tokens"]
            if n >= max(share * total, min(window, total)):
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (doc, item, n, total)], ["doc_id", "item_id", "n_matched", "n_tokens"])

    known = kept(_windows(items, "item_id", (window,), True, None).distinct(), "items")
    plan = known.agg(F.countDistinct("key"), F.collect_set("length")).first()
    lengths = tuple(sorted(set(plan[1]) | {window}))
    wanted = None
    if plan[0] <= BROADCAST_WINDOWS:
        wanted = np.sort(np.array([r[0] for r in known.select("key").distinct().collect()], np.int64).view(np.uint64))
    theirs = known.select("item_id", "key", F.col("n_tokens").alias("item_tokens"), *(F.col(c).alias(f"item_{c}") for c in ("pos", "size", "length", "slots", "slot_at", "word_at")))
    joined = _windows(docs, "doc_id", lengths, False, wanted).distinct().join(theirs, "key")
    columns = ["doc_id", "item_id", "diagonal", "item_tokens", "item_pos", "item_size", "item_length", "item_slots", "item_slot_at", "item_word_at", "slots", "slot_at"]
    lines = joined.withColumn("diagonal", F.col("pos") - F.col("item_pos")).select(columns).repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "diagonal")
    return lines.mapInArrow(judge, "doc_id long, item_id long, n_matched long, n_tokens long").groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.first("n_tokens").alias("n_tokens"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, share: float = 0.5) -> DataFrame:
    """(doc_id, contaminated, n_items, items) of every row of `docs` (doc_id, text, any others).

    `items` are the ids of the benchmark items (item_id, text) found, ascending. Null and empty texts hold none; items
    without text or id are never found; rows without an id are reported clean. Repeated rows are reported alike; equal
    items are all found. Empty tables of documents or items give no rows, or only clean ones.
    """
    found = matches(docs, items, window, share).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left")
    empty = F.array().cast("array<bigint>")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", empty).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 8, share: float = 0.5) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; rows without an id stay."""
    bad = matches(docs, items, window, share).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
