"""Vectors as short codes: a codebook per part, nearest entries found by Orchard's search.

Components become integers, so that every distance, sum and code is exact. A vector is cut into equal parts;
each part position has a codebook that starts from the first vectors and is refined in rounds: every
part goes to its nearest entry, and every entry moves to the mean of its parts.

**Orchard's search.** For every entry the other entries are listed by their distance to it. A part starts
at one entry and walks down that entry's list. An unmarked entry is measured and marked; if it is nearer,
the walk goes on at the top of its list. An entry further from the present one than twice the
present distance ends the walk: by the triangle inequality nothing from there on is as near. (Squared
distances are compared, hence four times.) Equal distances count as nearer at a lower index. The lists are
made anew from each round's entries. All parts of a batch walk at the same time, as arrays.

On Spark a round is one pass over the vectors. Each task sums its parts by entry, the sums of tasks are
combined in groups, and only the new entries (entries x dimensions numbers) come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.enrich import small_side
from seriesloom.storage import written_table

# A component x becomes floor(SCALE * x).
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
# Components of the vectors held as integers at a time.
CHUNK_NUMBERS = 2_000_000

# Entries by part position, each a list of whole numbers of any size.
Codebooks = list[list[list[int]]]


def largest_safe(dimensions: int) -> int:
    """Components up to this size keep four times any squared distance within 64 bits."""
    return math.isqrt(2 ** 60 // dimensions) // 2


def whole_numbers(values: np.ndarray, dimensions: int) -> np.ndarray:
    """floor(SCALE * x): 64-bit numbers, or Python's own if some are too large for those."""
    if not len(values) or np.abs(values).max() < largest_safe(dimensions) / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([math.floor(Fraction(v) * SCALE) for v in values.tolist()], object)


def entry_array(entries: list[list[int]], dimensions: int) -> np.ndarray:
    safe = max((abs(v) for e in entries for v in e), default=0) <= largest_safe(dimensions)
    return np.array(entries, np.int64 if safe else object)


def squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


class NeighbourLists:
    """Entries of a codebook and, for each, the others by distance (lower index first if equal)."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        self.gaps = squared(entries[:, None] - entries[None])
        near = np.argsort(self.gaps, axis=1, kind="stable")
        self.lists = np.stack([row[row != i] for i, row in enumerate(near)]).reshape(n, n - 1)
        self.measured = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, per point."""
        rows, n = len(points), len(self.entries)
        at, best = np.zeros(rows, np.int64), squared(points - self.entries[0])
        marked, place = np.zeros((rows, n), bool), np.zeros(rows, np.int64)
        marked[:, 0] = True
        walking = np.arange(rows if n > 1 else 0)
        self.measured += rows
        while len(walking):
            entry = self.lists[at[walking], place[walking]]
            within = (self.gaps[at[walking], entry] <= 4 * best[walking]).astype(bool)
            walking, entry = walking[within], entry[within]
            place[walking] += 1
            new = ~marked[walking, entry]
            marked[walking, entry] = True
            point, entry = walking[new], entry[new]
            found = squared(points[point] - self.entries[entry])
            self.measured += len(point)
            nearer = ((found < best[point]) | ((found == best[point]) & (entry < at[point]))).astype(bool)
            point, entry = point[nearer], entry[nearer]
            at[point], best[point], place[point] = entry, found[nearer], 0
            walking = walking[place[walking] < n - 1]
        return at, best


def _chunks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, numbers by row and component) of slices of a batch."""
    step = max(1, CHUNK_NUMBERS // dimensions)
    for start in range(0, batch.num_rows, step):
        vectors = batch.column("vector").slice(start, step)
        numbers = whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False), dimensions)
        yield start, start + len(vectors), numbers.reshape(len(vectors), dimensions)


def _searchers(books: Codebooks, dimensions: int) -> list[NeighbourLists]:
    return [NeighbourLists(entry_array(entries, dimensions)) for entries in books]


def _refined(rows: DataFrame, books: Codebooks, dimensions: int) -> Codebooks:
    """One round: the codebooks with every used entry moved to the mean (rounded down) of its parts."""
    width = dimensions // len(books)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, counts, totals = _searchers(books, dimensions), {}, {}
        for batch in batches:
            for _, _, numbers in _chunks(batch, dimensions):
                for p, searcher in enumerate(searchers):
                    points = numbers[:, p * width:(p + 1) * width]
                    at, _ = searcher.nearest(points)
                    for e in np.unique(at).tolist():
                        mine = points[at == e]
                        counts[p, e] = counts.get((p, e), 0) + len(mine)
                        totals[p, e] = [a + b for a, b in zip(totals.get((p, e), [0] * width), mine.sum(axis=0).tolist())]
        if counts:
            keys = list(counts)
            yield pa.record_batch(
                [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
                 pa.array([counts[k] for k in keys], pa.int64()),
                 pa.array([[str(v) for v in totals[k]] for k in keys], pa.list_(pa.string()))],
                names=["part", "entry", "n", "total"])

    def mean(table: pa.Table) -> pa.Table:
        n, total = sum(table.column("n").to_pylist()), [0] * width
        for row in table.column("total").to_pylist():
            total = [a + int(b) for a, b in zip(total, row)]
        return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1],
                         "mean": pa.array([[str(v // n) for v in total]], pa.list_(pa.string()))})

    # One row per task, part and entry; a group holds one row per task.
    partial = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<string>")
    means = partial.groupBy("part", "entry").applyInArrow(mean, "part int, entry int, mean array<string>")
    books = [[list(e) for e in entries] for entries in books]
    for row in means.collect():
        books[row["part"]][row["entry"]] = [int(v) for v in row["mean"]]
    return books


def _coded(rows: DataFrame, books: Codebooks, dimensions: int) -> DataFrame:
    """``vec_id, label, code, error`` (as text) of every vector."""
    width = dimensions // len(books)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, digits = _searchers(books, dimensions), np.array([f"{e:02x}" for e in range(len(books[0]))])
        for batch in batches:
            for start, end, numbers in _chunks(batch, dimensions):
                found = [s.nearest(numbers[:, p * width:(p + 1) * width]) for p, s in enumerate(searchers)]
                codes = ["".join(row) for row in np.stack([digits[at] for at, _ in found], axis=1).tolist()]
                errors = sum(best for _, best in found)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()),
                     pa.array([str(v) for v in errors.tolist()], pa.string())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(code, f"vec_id long, label {kind}, code string, error string")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Vectors that are null or hold null or non-finite components are left out. ``code`` has two hexadecimal digits per
    part, ``error`` is the squared distance to the coded vector, ``label_error`` its sum over
    the label (nulls are one label), both decimal(38, 0) and null beyond 38 digits. The first entries are those of
    the smallest vec_ids; a null id comes last, equal ids are ordered by their vectors. With fewer vectors than
    entries there are as many entries as vectors. The number of dimensions is that of the first vector whose
    length is a multiple of ``parts``. Vectors of another length are returned with a null code and error and
    take part in nothing else. Other columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits number 1 to 256 entries")
    whole = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & whole)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    length = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(*order).select(F.size("vector")).first()
    dimensions = length[0] if length else parts
    fitting = rows.where(F.size("vector") == dimensions)
    first = fitting.orderBy(*order).limit(entries).collect()
    width, books = dimensions // parts, [[] for _ in range(parts)]
    for row in first:
        numbers = whole_numbers(np.array(row["vector"]), dimensions).tolist()
        for p, entries_of_part in enumerate(books):
            entries_of_part.append(numbers[p * width:(p + 1) * width])
    if first:
        for _ in range(rounds):
            books = _refined(fitting, books, dimensions)
        coded = _coded(fitting, books, dimensions)
    else:
        coded = fitting.select("vec_id", "label", F.lit("").alias("code"), F.lit("").alias("error"))
    digest = hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
    others = rows.where(F.size("vector") != dimensions).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"))
    number = F.col("error").try_cast("decimal(38,0)")
    coded = written_table(coded.unionByName(others).select(
        "vec_id", "label", "code", number.alias("error"), (F.col("error").isNotNull() & number.isNull()).alias("beyond")))
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.expr(
        "if(bool_or(beyond), null, try_sum(error))").try_cast("decimal(38,0)").alias("label_error"))
    joined = coded.join(small_side(written_table(sums)), F.col("label").eqNullSafe(F.col("same")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
