"""Best-fit packing of token sequences after a dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces of one length are
interchangeable, so the instance that has to be solved is the histogram of lengths: at most
``capacity`` numbers whatever the number of documents. On it, sets of pieces that provably belong
together are fixed first (Martello and Toth): a piece that nothing fits with, pairs that fill a
sequence, and pairs that dominate every other filling of the larger piece. The remainder is packed
best-fit, longest first. The plan maps the k-th piece of a length to a place, and every piece then
finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import text_slices, unused_name
from seriesloom.llm.encoding import END_ID, encoder
from seriesloom.storage import small_batches, written_table

CAPACITY = 4096


class Slots(NamedTuple):
    """Places for ``n * per_bin`` pieces of ``length``, ranks from ``rank``, in sequences from ``first``."""

    length: int
    rank: int
    n: int
    per_bin: int
    first: int
    offset: int


class Planner:
    """Packs a histogram of lengths into sequences, whole groups of equal sequences at a time."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.n_bins = self.n_fixed = 0
        self.slots: list[Slots] = []
        # open groups by free room: (first sequence, number of sequences)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.has_open = np.zeros(capacity + 1, bool)

    def _place(self, length: int, n: int, per_bin: int, first: int, offset: int) -> None:
        self.slots.append(Slots(length, int(self.rank[length]), n, per_bin, first, offset))
        self.rank[length] += n * per_bin
        self.left[length] -= n * per_bin

    def _fix(self, n: int, *lengths: int) -> None:
        """Close ``n`` sequences that hold one piece of each length."""
        offset = 0
        for length in lengths:
            self._place(length, n, 1, self.n_bins, offset)
            offset += length
        self.n_bins += n
        self.n_fixed += n

    def _dominating_partner(self, j: int) -> int | None:
        """The length that is best beside ``j`` whatever else could be; 0 if nothing fits, None if unknown."""
        room = self.capacity - j
        others = self.left[:room + 1].copy()
        if j <= room:
            others[j] -= 1
        fitting = np.flatnonzero(others > 0)
        if not len(fitting):
            return 0
        k = int(fitting[-1])
        if k == room:
            return k
        smallest = np.repeat(fitting[:3], np.minimum(others[fitting[:3]], 3))[:3]
        if len(smallest) < 2 or smallest[:2].sum() > room:
            return k
        if len(smallest) == 3 and smallest.sum() <= room:
            return None
        # at most pairs fit beside j: k dominates if no pair holds more than k
        partner = np.searchsorted(fitting, room - fitting, "right") - 1
        sums = [a + fitting[p] for a, p in zip(fitting, partner)
                if p >= 0 and (fitting[p] != a or others[a] > 1)]
        sums += [a + fitting[p - 1] for a, p in zip(fitting, partner)
                 if p >= 1 and fitting[p] == a and others[a] == 1]
        return k if max(sums, default=0) <= k else None

    def reduce(self) -> None:
        """Fix dominating sets, longest piece first, until a pass fixes nothing."""
        found = True
        while found:
            found = False
            for j in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[j] > 0:
                    k = self._dominating_partner(j)
                    if k is None:
                        break
                    found = True
                    if k == 0:
                        self._fix(int(self.left[j]), j)
                    elif k == j:
                        self._fix(int(self.left[j]) // 2, j, j)
                    else:
                        self._fix(int(min(self.left[j], self.left[k])), j, k)

    def _add_open(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.open[room].append((first, n))
            self.has_open[room] = True

    def best_fit(self) -> None:
        """Pack what is left, longest first, into the fullest sequences that have room."""
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length] > 0:
                rooms = np.flatnonzero(self.has_open[length:])
                n = int(self.left[length])
                if len(rooms):
                    room = length + int(rooms[0])
                    first, bins = self.open[room].pop()
                    self.has_open[room] = bool(self.open[room])
                else:
                    room, first = self.capacity, self.n_bins
                    bins = -(-n // (room // length))
                    self.n_bins += bins
                per_bin = room // length
                offset = self.capacity - room
                full = min(bins, n // per_bin)
                if full:
                    self._place(length, full, per_bin, first, offset)
                    self._add_open(room - per_bin * length, first, full)
                rest = n - full * per_bin
                if full < bins and rest:
                    self._place(length, 1, rest, first + full, offset)
                    self._add_open(room - rest * length, first + full, 1)
                    full += 1
                self._add_open(room, first + full, bins - full)

    def plan(self) -> list[Slots]:
        self.reduce()
        self.best_fit()
        return self.slots


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for the pieces of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in text_slices(batches):
            ids, ends = words.all_ids(batch.column("text"), end_id)
            rows = []
            for doc_id, doc_ids in zip(batch.column("doc_id").to_pylist(), np.split(ids.astype("<u4"), ends[:-1])):
                for piece, start in enumerate(range(0, len(doc_ids), capacity)):
                    part = doc_ids[start:start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with a column ``length`` (1 to ``capacity``).

    No text is shuffled. Only the histogram of lengths, at most ``capacity`` rows, reaches the driver;
    the plan made from it goes to the tasks and is bounded by the capacity as well. Pieces of a
    frequent length are numbered within the stored partitions, so no length is gathered anywhere.
    Columns that are already named so are replaced. An empty table gives an empty result; equal rows get different places.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part, rank, local, of_part, of_length, shift = (
        unused_name(pieces, c) for c in ("part", "rank", "local", "of_part", "of_length", "shift"))
    with small_batches(pieces.sparkSession):
        stored = written_table(pieces.select(*names, F.spark_partition_id().alias(part)))
    sizes = stored.groupBy(F.col(part).alias("of_part"), F.col("length").alias("of_length")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["of_length"]: r["n"] for r in sizes.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}
    slots = Planner(counts, capacity).plan()

    before = Window.partitionBy("of_length").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("of_part").alias(of_part), F.col("of_length").alias(of_length),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    within = Window.partitionBy(part, "length").orderBy(F.monotonically_increasing_id())
    numbered = stored.withColumn(local, F.row_number().over(within) - 1)
    ranked = numbered.join(shifts, (F.col(part) == F.col(of_part)) & (F.col("length") == F.col(of_length)))
    ranked = ranked.select(*names, (F.col(shift) + F.col(local)).alias(rank))
    table = np.array(sorted(slots), np.int64).reshape(-1, len(Slots._fields))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, rank) as one ascending number
        width = int(table[:, 1].max(initial=0)) + int((table[:, 2] * table[:, 3]).max(initial=0)) + 1
        starts = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", rank))
            slot = table[np.searchsorted(starts, length * width + number, "right") - 1]
            nth = number - slot[:, 1]
            sequence = slot[:, 4] + nth // slot[:, 3]
            offset = slot[:, 5] + nth % slot[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text; null text: empty) into sequences.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Every document has
    at least its end id, so none is lost; repeated or null ids do no harm; other columns are ignored.
    """
    return pack_pieces(piece_rows(docs, tokenizer, capacity, end_id), capacity)
