"""Token ids in Arrow stream files of equal-length sequences, with a manifest for random access by document.

One file is a stream of record batches with two fixed-size-list columns, `input_ids` (uint16, or uint32 for
vocabularies over 65,536) and `attention_mask` (bits). All batches but the last of a file have the same number
of rows, so row r lies in batch r // rows. Documents follow each other in ascending id order, each closed by
the end id; only the last sequence of a file is padded (mask false). The manifest has one row a document:
(doc_id, shard, file, offset, n_tokens), offset counted in tokens of its file.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.store import kept
from attesta.llm.words import slices
from attesta.session import fresh_path

MANIFEST = "doc_id long, shard int, file string, offset long, n_tokens long"
CACHED = 3 << 19  # distinct chunks a task remembers before it starts anew


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Ids of whole texts by a byte-level model of the tokenizers library.

    No pre-token reaches over a space before a non-space, nor from a letter to closing marks. So texts are cut there,
    each distinct chunk is encoded once and remembered, and the ids are those of the whole text. A chunk of letters
    is a single pre-token and goes to the model as it is; any other goes through the whole tokenizer.
    """

    _CUT = re.compile(r"(?= \S)")
    _CLOSING = ".,;:!?*$%&#|)"
    _LETTERS = _byte_letters()

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = np.dtype(np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn_plain(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self.plain))
        for c, e in zip(new, self.whole.encode_batch_fast(new, add_special_tokens=False)):
            self.plain[c] = array(self.code, e.ids).tobytes()

    def _word(self, word: str) -> bytes:
        letters = f" {word}".encode().decode("latin-1").translate(self._LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn_spaced(self, chunks: set[str]) -> None:
        """Learns what may follow a space; chunks that are empty or start with white space are left out."""
        other, known = [], self.spaced
        for c in chunks.difference(known):
            word = c.rstrip(self._CLOSING)
            if word.isalpha():
                found = known.get(word) or known.setdefault(word, self._word(word))
                if word is not c and word != c:
                    if c[len(word) :] not in self.plain:
                        self._learn_plain({c[len(word) :]})
                    known[c] = found + self.plain[c[len(word) :]]
            elif c and not c[0].isspace():
                other.append(c)
        for c, e in zip(other, self.whole.encode_batch_fast([" " + c for c in other], add_special_tokens=False)):
            known[c] = array(self.code, e.ids).tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as bytes. A null text counts as empty."""
        if len(self.plain) + len(self.spaced) > CACHED:
            self.plain.clear()
            self.spaced.clear()
        parts = [(text or "").split(" ") for text in texts]
        self._learn_plain({p[0] for p in parts})
        self._learn_spaced(set().union(*parts))
        out = []
        for text, p in zip(texts, parts):
            try:
                ids = [self.plain[p[0]], *map(self.spaced.__getitem__, p[1:]), self.end]
            except KeyError:  # runs of white space: cut only where a non-space follows
                cut = self._CUT.split(text)
                self._learn_plain(set(cut))
                ids = [*map(self.plain.__getitem__, cut), self.end]
            out.append(b"".join(ids))
        return out


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("attention_mask", pa.list_(pa.bool_(), length))])


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, since tasks know nothing of the session's default one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


class StreamWriter:
    """Fills sequences of `length` ids and writes them in batches of `rows`."""

    def __init__(self, uri: str, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.most = kind, length, rows * length * kind.itemsize
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0])
        self.sink = fs.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.sink, _schema(kind, length))
        self.held = bytearray()

    def add(self, ids: bytes) -> None:
        self.held += ids
        while len(self.held) >= self.most:
            self._batch(bytes(self.held[: self.most]))
            del self.held[: self.most]

    def _batch(self, ids: bytes) -> None:
        real = len(ids) // self.kind.itemsize
        size = -(-real // self.length) * self.length
        flat = np.zeros(size, self.kind)
        flat[:real] = np.frombuffer(ids, self.kind)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(size) < real)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.stream_schema))

    @property
    def stream_schema(self) -> pa.Schema:
        return _schema(self.kind, self.length)

    def close(self) -> None:
        if self.held:
            self._batch(bytes(self.held))
        self.stream.close()
        self.sink.close()


class SequenceFile:
    """Random access to one stream file; a local file is memory-mapped and nothing is copied on opening."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.ids = [b.column(0).flatten().to_numpy() for b in self.batches]
        self.size = len(self.ids[0]) if self.ids else 0
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence, both views of the file."""
        batch, at = self.batches[row // self.rows], row % self.rows
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values

    def tokens(self, offset: int, n: int) -> np.ndarray:
        """n ids from `offset` on; a view unless they lie in several batches."""
        parts = []
        while n > 0:
            batch, at = divmod(offset, self.size)
            parts.append(self.ids[batch][at : at + n])
            offset, n = offset + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def close(self) -> None:
        self.ids, self.batches = [], []
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, rows: int = 64) -> DataFrame:
    """Write the ids of every row of `docs` (doc_id, text, any others); returns the stored manifest.

    Rows are dealt by ranges of doc_id, one file a range, so the files in shard order hold the documents in ascending
    order: null ids first, rows of equal id by text. A null text counts as empty and has the end id only. Every
    attempt of a task writes a file of its own name and the manifest names those of the attempts that counted, so a
    lost executor leaves at most an unnamed file. An empty table writes no file and gives an empty manifest.
    """
    folder = _qualified(docs.sparkSession, fresh_path(docs.sparkSession, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, offset, encoder = TaskContext.get().partitionId(), None, 0, None
        file = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.arrows"
        for batch in slices(batches):
            encoder = encoder or Encoder(tokenizer, end_id)
            writer = writer or StreamWriter(file, encoder.kind, length, rows)
            ids = encoder.many(batch.column("text").to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.kind.itemsize
            for x in ids:
                writer.add(x)
            n = len(ids)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.full(n, shard, np.int32)), pa.array([file] * n), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes)],
                ["doc_id", "shard", "file", "offset", "n_tokens"],
            )
            offset += int(sizes.sum())
        if writer:
            writer.close()

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept(rows_in.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, read back from the files.

    start counts the ids of all documents before it; ids_crc32 is the unsigned crc32 of its ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            found = []
            for file, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))):
                if file != name:
                    if reader:
                        reader.close()
                    name, reader = file, SequenceFile(file)
                found.append(zlib.crc32(reader.tokens(offset, n).astype("<u4").tobytes()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "shard", "offset", "n_tokens")), pa.array(found, pa.int64())], ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    read = manifest.mapInArrow(run, "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long")
    # One row a file: the window below sees as many rows as there are files.
    files = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select("shard", before.alias("base"))
    return read.join(base, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")
