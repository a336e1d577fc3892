"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rule: space and U+0009 to U+000D, which is what bytes.split() splits on.
SPACES = " \t\n\x0b\x0c\r"
# Bytes of text that a Python step holds as words at a time, besides one text of any length.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text",
                max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with about ``max_bytes`` of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = done = 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, done + max_bytes)) + 1, len(ends))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()  # the worker lives on, idle or for other operators' tasks


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text",
                max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), each of about ``max_bytes``.

    Texts become Python objects slice by slice, so that a batch is held once.
    """
    for part in text_slices(batches, text, max_bytes):
        yield part, [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(column: str) -> F.Column:
    """The column with A-Z (only) in lower case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and inner path of a URI or plain path in the shared store."""
    return pyarrow.fs.FileSystem.from_uri(path)


def by_partition_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


class WordHashes(dict):
    """64-bit hash per word; unseen words are hashed on first use, the memory is bounded."""

    def __init__(self, seed: int = 0, normal: Callable[[bytes], bytes] | None = None, most: int = 300_000):
        super().__init__()
        self.seed, self.normal, self.most = seed, normal, most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word, self.seed)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of every word of each text, from prefix sums over the bytes of all of them.

    A word's hash is a polynomial of its bytes modulo 2^64, shifted to a common power and scrambled.
    Bytes are taken in blocks of about ``CHUNK_BYTES``, so a long text costs little memory besides its words.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = np.zeros(256, bool)
    space[[ord(c) for c in SPACES]] = True
    edges = np.flatnonzero(np.diff(space[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    base = 0x9E3779B97F4A7C15
    first_words = np.append(np.searchsorted(starts, np.arange(0, len(data), CHUNK_BYTES)), len(starts))
    hashes = np.zeros(len(starts), np.uint64)
    powers = backwards = np.ones(1, np.uint64)
    for first, last in zip(first_words[:-1].tolist(), first_words[1:].tolist()):
        if first == last:
            continue
        low, n = starts[first], ends[last - 1] - starts[first]
        if n > len(powers):
            powers, backwards = (np.cumprod(np.full(n, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[low:low + n]] * powers[:n], out=sums[1:])
        at = starts[first:last] - low
        hashes[first:last] = (sums[ends[first:last] - low] - sums[at]) * backwards[at]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64))
    text_starts = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)
    return np.split(hashes, np.searchsorted(starts, text_starts)) if texts else []


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return mixed(total)
