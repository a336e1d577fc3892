"""Token ids in Arrow files of fixed-size lists.

A shard holds the documents of one range of ids, in ascending order, as one run of token ids cut
into sequences of equal length. Its file is in Arrow's random-access format: record batches of
``BATCH_ROWS`` rows with the columns ``tokens`` and ``mask``, both fixed-size lists. The values of a
memory-mapped batch are used in place: sequence i is row i % BATCH_ROWS of batch i // BATCH_ROWS. Only the
last sequence of a shard is padded; the mask is false there. A second file per shard lists its
documents with their first token and length.

Tasks write to names of their own attempt, and the manifest, a stored table with one row per
shard, names the files of the attempts that count, so lost or repeated tasks leave no trace in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import by_partition_order, open_store, text_chunks
from seriesloom.llm.encoding import END_ID, encoder
from seriesloom.storage import new_path, written_table

SEQUENCE_LENGTH = 2048
BATCH_ROWS = 256

_MANIFEST = "shard int, path string, n_docs long, n_sequences long, n_tokens long"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)),
                      ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard: token sequences and the index of its documents."""

    def __init__(self, path: str, dtype: np.dtype, length: int = SEQUENCE_LENGTH):
        self.store, inner = open_store(path)
        self.schema, self.dtype, self.length = _schema(dtype, length), dtype, length
        self.sinks = [self.store.open_output_stream(f"{inner}.{kind}.arrow") for kind in ("tokens", "docs")]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], _INDEX)
        self.waiting: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.n_waiting = self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.waiting.append(ids)
        self.n_docs, self.n_tokens, self.n_waiting = self.n_docs + 1, self.n_tokens + len(ids), self.n_waiting + len(ids)
        if self.n_waiting >= BATCH_ROWS * self.length:
            self._write_batches()
        if len(self.rows) >= 65536:
            self._write_rows()

    def _write_rows(self) -> None:
        if self.rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)]
            self.docs.write_batch(pa.record_batch(columns, schema=_INDEX))
            self.rows = []

    def _write(self, ids: np.ndarray, n_valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n_valid)
        lists = [pa.FixedSizeListArray.from_arrays(v, self.length) for v in (pa.array(ids), mask)]
        self.tokens.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(lists[0])

    def _write_batches(self) -> None:
        ids, size = np.concatenate(self.waiting), BATCH_ROWS * self.length
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            self._write(ids[start:start + size], size)
        self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        if self.n_waiting:
            ids = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[:len(ids)] = ids
            self._write(padded, len(ids))
        self._write_rows()
        for part in (self.tokens, self.docs, *self.sinks):
            part.close()


class ShardReader:
    """Random access to the sequences of a shard, and its documents in order."""

    def __init__(self, path: str):
        self.store, inner = open_store(path)
        self.tokens = pa.ipc.open_file(self._open(f"{inner}.tokens.arrow"))
        self.docs = pa.ipc.open_file(self._open(f"{inner}.docs.arrow"))

    def _open(self, inner: str):
        if self.store.type_name == "local":
            return pa.memory_map(inner)
        return self.store.open_input_file(inner)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of sequence ``i``; the tokens are a view of the file."""
        batch, row = self.tokens.get_batch(i // BATCH_ROWS), i % BATCH_ROWS
        return (batch.column(0)[row].values.to_numpy(zero_copy_only=True),
                batch.column(1)[row].values.to_numpy(zero_copy_only=False))

    def _runs(self) -> Iterator[np.ndarray]:
        for b in range(self.tokens.num_record_batches):
            batch = self.tokens.get_batch(b)
            n_valid = batch.column(1).flatten().true_count
            yield batch.column(0).flatten().to_numpy(zero_copy_only=True)[:n_valid]

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, first token, runs of ids) per document."""
        runs, run, at = self._runs(), np.zeros(0, np.uint16), 0
        for b in range(self.docs.num_record_batches):
            for doc in self.docs.get_batch(b).to_pylist():
                need, parts = doc["n_tokens"], []
                while need:
                    if at == len(run):
                        run, at = next(runs), 0
                    parts.append(run[at:at + need])
                    at += len(parts[-1])
                    need -= len(parts[-1])
                yield doc["doc_id"], doc["start"], parts


def ids_crc32(parts: Iterable[np.ndarray]) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for ids in parts:
        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
    return crc


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID,
                      length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files below ``folder``; returns the manifest.

    Columns: ``shard, path, n_docs, n_sequences, n_tokens``, shards ascending in doc_id. A null or
    empty text gives just the end id; a null doc_id comes first; rows of equal doc_id are ordered by
    a hash of their text; repeated rows stay; other columns are ignored; an empty table
    gives an empty manifest. Only doc_id and text are shuffled, once.
    """
    folder = folder or new_path(docs.sparkSession)
    store, inner = open_store(folder)
    store.create_dir(inner, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, task = encoder(tokenizer), None, TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch, texts in text_chunks(batches):
            writer = writer or ShardWriter(path, words.dtype, length)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                writer.add(doc_id, words.ids(text.decode(), end_id))
        if writer:
            writer.close()
            row = (task.partitionId(), path, writer.n_docs, writer.n_sequences, writer.n_tokens)
            yield pa.record_batch([pa.array([v], t) for v, t in zip(
                row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["shard", "path", "n_docs", "n_sequences", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    return written_table(by_partition_order(rows, "doc_id", "tie").mapInArrow(write, _MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: ``doc_id, start, n_tokens, ids_crc32`` per document.

    ``start`` counts the tokens of all documents before it. One task per shard.
    """
    n_shards = manifest.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for shard in batch.to_pylist():
                rows = []
                for doc_id, start, parts in ShardReader(shard["path"]).documents():
                    rows.append((doc_id, shard["offset"] + start, sum(map(len, parts)), ids_crc32(parts)))
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return shards.repartition(max(1, n_shards), "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")
