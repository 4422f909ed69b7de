"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda by score, leftmost first. A candidate that comes up is skipped if its draw, taken
from a keyed hash of (seed, document's id, place of the chunk in it) and its turn, falls below the dropout rate.
Chunks (spaces with the word after them, a line end, or marks that no piece joins to a letter) never share a piece, so
each is segmented on its own. Every occurrence has its own draws, and any rerun gives the same ids. Which turns are
skipped decides the segmentation, so equal chunks of a batch with equal skips are segmented once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import mix, slices

CACHED = 1 << 18  # chunks that a task remembers before it starts anew, of at most 16 characters each in the mean
SPACE = "▁"
LONG, BLOCK, NONE = 22, 8192, (1 << 31) - 1  # at most 3 * (LONG - 1) turns: bits of one number


class _Pairs:
    """Merged symbol and its place in the order of merges for pairs of symbols: an open-addressed table in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, order: np.ndarray):
        bits = max(10, int(len(left)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.merged, self.order = np.append(merged, -1), np.append(order, NONE)
        keys, todo, probe = self._key(left, right), np.arange(len(left)), 0
        while len(todo):
            slot = self._slot(keys[todo], probe)
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[todo[free]]
            mine = self.key[slot] == keys[todo]
            self.at[slot[mine]] = todo[mine]
            todo = todo[~mine]
            probe += 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64) + probe) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged symbol, order) of each pair; order NONE where the pair doesn't merge."""
        keys = self._key(left, right)
        slot = self._slot(keys, 0)
        met = self.key[slot]
        found = np.where(met == keys, self.at[slot], len(self.merged) - 1)
        todo, probe = np.flatnonzero((met != keys) & (met >= 0)), 1
        while len(todo):
            slot = self._slot(keys[todo], probe)
            met = self.key[slot]
            found[todo] = np.where(met == keys[todo], self.at[slot], len(self.merged) - 1)
            todo, probe = todo[(met != keys[todo]) & (met >= 0)], probe + 1
        return self.merged[found], self.order[found]


class Segmenter:
    """Encodes with the merges of a SentencePiece BPE model file and decodes its ids."""

    def __init__(self, path: str, rate: float = 0.1, seed: int = 42):
        import sentencepiece

        if not 0 <= rate < 1:
            raise ValueError("0 <= rate < 1 is needed")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not any(kinds[i])}
        scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        rank = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        self.rank = {p: rank[x] for p, x in scores.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if kinds[i][0]}
        self.unknown = model.unk_id()
        self.text = [
            b"" if odd else bytes([int(model.id_to_piece(i)[3:5], 16)]) if byte else model.id_to_piece(i).replace(SPACE, " ").encode()
            for i, (byte, odd) in enumerate(kinds)
        ]
        self.limit, self.seed = int(rate * 65536), seed
        self._forget()
        # Symbols: pieces by id, then characters of pieces that are none themselves; `other` stands for the rest.
        symbol = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbol.setdefault(c, n + len(symbol))
        self.other = 1 << 30
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.of_char[ord(SPACE)] = self.other
        self.of_char[ord(" ")] = symbol.get(SPACE, self.other)
        splits = [(symbol[p[:k]], symbol[p[k:]], i, self.rank[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = _Pairs(*np.array(splits, np.int32).T)
        # Marks that no piece has after a letter end a chunk of letters.
        joined = {y for p in self.ids for x, y in zip(p, p[1:]) if x.isalpha()}
        marks = re.escape("".join(c for c in ".,;:!?*$%&#|()\"" if c not in joined))
        self.chunk = re.compile(rf"\n| *(?:[^\W\d_]+(?=[{marks}])|[^ \n]+)| +" if marks else r"\n| *[^ \n]+| +")

    def _forget(self) -> None:
        """The chunks known so far by number: their characters as symbols, plain segmentation and its turns."""
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.chars, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.size, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)  # characters, and the first of them
        self.at, self.count, self.turns = (np.zeros(0, np.int64) for _ in range(3))  # first id, ids, turns

    def segment(self, chunk: str, skips: int = 0, key: int | None = None) -> list[int]:
        """Ids of one chunk, by an agenda kept as a heap. Turns whose bits are set in `skips` are skipped, or with `key` those it draws."""
        # A literal U+2581 would decode to a space, so it is spelled in bytes; U+FFFF is in no piece.
        text, rank, n = chunk.replace(SPACE, "\uffff").replace(" ", SPACE), self.rank, len(chunk)
        end = list(range(1, n + 1))  # by the start of a symbol
        start = list(range(n))  # by the end of a symbol, less one
        agenda = [(rank[text[at : at + 2]], at, at + 1, at + 2) for at in range(n - 1) if text[at : at + 2] in rank]
        heapify(agenda)
        turn = 0
        drawn = np.zeros(0, bool)
        while agenda:
            _, at, mid, to = heappop(agenda)
            if end[at] != mid or end[mid] != to:
                continue
            if key is not None and turn == len(drawn):
                drawn = np.append(drawn, self._draw(np.uint64(key), np.arange(turn, 2 * turn + 64)) < self.limit)
            skipped = skips >> turn & 1 if key is None else drawn[turn]
            turn += 1
            if skipped:
                continue
            end[at], end[mid], start[to - 1] = to, -1, at
            for left, middle, right in ((start[at - 1] if at else -1, at, to), (at, to, end[to] if to < n else -1)):
                if left >= 0 and right >= 0 and text[left:right] in rank:
                    heappush(agenda, (rank[text[left:right]], left, middle, right))
        at, ids = 0, []
        while at < n:
            found = self.ids.get(text[at : end[at]])
            ids += [self.byte.get(b, self.unknown) for b in chunk[at : end[at]].encode()] if found is None else [found]
            at = end[at]
        return ids

    @staticmethod
    def _words(key: np.ndarray, four: np.ndarray) -> np.ndarray:
        """The keyed hash of four turns, 16 bits each, from the lowest on."""
        return mix(key + (four.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def _draw(self, key: np.uint64, turn: np.ndarray) -> np.ndarray:
        return self._words(key, turn // 4) >> (turn % 4 * 16).astype(np.uint64) & np.uint64(0xFFFF)

    def _block(self, chars: np.ndarray, sizes: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many a chunk, turns, whether a chunk has characters that are no piece) of chunks of at most LONG symbols.

        All agendas advance together, one candidate each a step. Bits of `skips` name the turns that are skipped.
        """
        n, width = len(sizes), int(sizes.max())
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
        symbol = np.full((n, width + 1), self.other, np.int32)  # the last column is a neighbour that never merges
        symbol[row, place] = chars
        merged, order = np.full((n, width + 1), -1, np.int32), np.full((n, width + 1), NONE, np.int32)
        inner = np.flatnonzero(row[1:] == row[:-1])
        merged[row[inner], place[inner]], order[row[inner], place[inner]] = self.pairs(chars[inner], chars[inner + 1])
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        after[:, width] = width
        after[np.arange(n), sizes - 1] = width
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        before[:, 0] = width
        live, turn, turns = np.arange(n), 0, np.zeros(n, np.int64)
        while True:
            at = order[live].argmin(axis=1)
            some = order[live, at] != NONE
            live, at = live[some], at[some]
            if not len(live):
                break
            keep = (skips[live] >> np.uint64(turn) & np.uint64(1)) == 0
            turn += 1
            turns[live] = turn
            order[live[~keep], at[~keep]] = NONE
            r, a = live[keep], at[keep]
            gone, left = after[r, a], before[r, a]
            right = after[r, gone]
            symbol[r, a] = merged[r, a]
            symbol[r, gone] = -1
            after[r, a], before[r, right], order[r, gone] = right, a, NONE
            merged[r, a], order[r, a] = self.pairs(symbol[r, a], symbol[r, right])
            merged[r, left], order[r, left] = self.pairs(symbol[r, left], symbol[r, a])
            order[r, width] = NONE
        symbol = symbol[:, :width]
        used = (symbol >= 0) & (np.arange(width) < sizes[:, None])
        flat, counts = symbol[used], used.sum(axis=1)
        odd = np.zeros(n, bool)
        odd[np.repeat(np.arange(n), counts)[flat >= len(self.text)]] = True
        return flat, counts, turns, odd

    def _blocks(self, known: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id, ids of a chunk, turns) of known chunks of at most LONG characters."""
        size = self.size[known]
        order = np.argsort(size, kind="stable")
        made, at, count, turns, end = [], np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), 0
        for k in range(0, len(known), BLOCK):
            part = order[k : k + BLOCK]
            n = size[part]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids, counts, turns[part], odd = self._block(self.chars[np.repeat(self.begin[known[part]], n) + inner], n, skips[part])
            at[part] = end + np.cumsum(counts) - counts
            count[part] = counts
            made.append(ids)
            end += len(ids)
            for j in part[odd].tolist():  # characters that are no piece are spelled in bytes
                spelled = np.array(self.segment(self.names[known[j]], int(skips[j])), np.int32)
                at[j], count[j] = end, len(spelled)
                made.append(spelled)
                end += len(spelled)
        return np.concatenate(made) if made else np.zeros(0, np.int32), at, count, turns

    def _learn(self, chunks: list[str]) -> None:
        """Number new chunks and keep the plain segmentation of those of at most LONG characters."""
        first = len(self.names)
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.names += chunks
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chars = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        self.begin = np.concatenate((self.begin, len(self.chars) + np.cumsum(size) - size))
        self.chars, self.size = np.concatenate((self.chars, chars)), np.concatenate((self.size, size))
        short = np.flatnonzero(size <= LONG)
        ids, at, count, turns = self._blocks(first + short, np.zeros(len(short), np.uint64))
        for name, values, shift in (("at", at, len(self.pool)), ("count", count, 0), ("turns", turns, 0)):
            new = np.zeros(len(chunks), np.int64)
            new[short] = values + shift
            setattr(self, name, np.concatenate((getattr(self, name), new)))
        self.pool = np.concatenate((self.pool, ids))

    def _numbers(self, flat: list[str]) -> np.ndarray:
        """The number of each chunk; new ones are learned first."""
        kind = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(kind < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(flat[k] for k in new)))
            kind[new] = [self.number[flat[k]] for k in new]
        return kind

    def _skipped(self, kind: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(turns skipped as bits, whether that changes the plain segmentation) by each occurrence's draws.

        An occurrence goes on drawing beyond the turns of the plain segmentation only after a change.
        """
        plain = self.turns[kind]
        most = np.where(plain > 0, 3 * (self.size[kind] - 1), 0)
        skips, hit = np.zeros(len(kind), np.uint64), np.zeros(len(kind), bool)
        live, turn = np.flatnonzero(most > 0), 0
        while len(live):
            word = self._words(key[live], np.array([turn // 4]))
            held, p, top, bits, met = live, plain[live], most[live], skips[live], hit[live]
            for k in range(4):
                off = ((word >> np.uint64(16 * k) & np.uint64(0xFFFF)) < self.limit) & (top > turn) & (met | (p > turn))
                bits[off] |= np.uint64(1 << turn)
                met |= off & (p > turn)
                turn += 1
            skips[held], hit[held] = bits, met
            live = held[(top > turn) & (met | (p > turn))]
        return skips, hit

    def encode(self, texts: list[str | None], names: list) -> list[np.ndarray]:
        """Ids of whole texts; a text's name keys its draws. Null and empty texts have none.

        Segmentations after a skip are seldom met again, so only plain ones are remembered.
        """
        if len(self.names) > CACHED or len(self.chars) > 16 * CACHED:
            self._forget()
        chunks = [self.chunk.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        del chunks
        kind = self._numbers(flat)
        first = np.concatenate(([0], np.cumsum(counts)))
        key = np.repeat(np.array([xxhash.xxh64_intdigest(str(name), self.seed) for name in names], np.uint64), counts)
        place = np.arange(len(flat)) - np.repeat(first[:-1], counts)
        key = mix(key + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        at, size, pools, end = self.at[kind], self.count[kind], [self.pool], len(self.pool)
        if self.limit:
            skips, hit = self._skipped(kind, key)
            odd = np.flatnonzero(hit)
            if len(odd):
                patterns, pattern = np.unique(skips[odd], return_inverse=True)
                pairs, pair = np.unique(kind[odd] * len(patterns) + pattern, return_inverse=True)
                ids, begin, n, _ = self._blocks(pairs // len(patterns), patterns[pairs % len(patterns)])
                at[odd], size[odd] = end + begin[pair], n[pair]
                pools.append(ids)
                end += len(ids)
        for k in np.flatnonzero(self.size[kind] > LONG).tolist():
            ids = np.array(self.segment(flat[k], 0, int(key[k]) if self.limit else None), np.int32)
            at[k], size[k] = end, len(ids)
            pools.append(ids)
            end += len(ids)
        before = np.concatenate(([0], np.cumsum(size)))
        ids = np.concatenate(pools)[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return [ids[a:b] for a, b in zip(before[first[:-1]].tolist(), before[first[1:]].tolist())]

    def decode(self, ids: list[int]) -> str:
        """The text of ids from `encode`, without the space that encoding puts in front."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_pieces(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 42) -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every row of `docs` (doc_id, text, any others).

    lossless says whether the ids decode to the text again. Null and empty texts have no ids and are lossless as the
    empty text; a null id is a name like any other; repeated rows get equal ids. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = None
        for batch in slices(batches, limit=1 << 20):
            segmenter = segmenter or Segmenter(model, rate, seed)
            texts = batch.column("text").to_pylist()
            ids = segmenter.encode(texts, batch.column("doc_id").to_pylist())
            same = [segmenter.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, lossless boolean")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([segmenter.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
