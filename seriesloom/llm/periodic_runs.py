"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q, at least MIN_WORDS and MIN_PERIODS * q long, that
cannot be extended to either side with that period. So each of its words occurs in it at least
MIN_PERIODS times.

**Splitting.** A word that occurs more rarely than that in its segment (first the document) belongs to no run
there, so the segment is split at it. Segments too short for a run go. The words of what is left are
counted again within their segments, until nothing changes. Ordinary prose is gone after a few rounds.

**Lag scan.** For sizes m = 1, 2, 4, ... every stretch of m words gets a number (from the numbers of its halves),
and every position its lag: the distance to the next stretch with that number. Inside a run with m / 2 < q <= m the lag
is q at every position from which both stretches fit into the run, as a stretch of a period or more recurs
nowhere else in it; and at its ends the lag is another one. So the longest series of equal lags q are the runs of that
period, without extension or search for smaller periods, and the scan takes
n log n steps for each of the log n sizes, whatever the text. All documents of a batch are scanned at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import text_chunks

MIN_WORDS, MIN_PERIODS = 24, 3

_RUN = "struct<start:long,length:long,period:long>"
RESULT = f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving(words: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segment of each) left after splitting; ``words`` are numbers that no two documents share."""
    at, segment, word = np.arange(len(words)), documents, words
    counts = np.bincount(words) if len(words) else np.zeros(0, np.int64)
    often = counts[words]
    while len(at):
        keep = often >= MIN_PERIODS
        kept, group = at[keep], segment[keep]
        first = np.ones(len(kept), bool)
        first[1:] = (np.diff(kept) != 1) | (np.diff(group) != 0)
        number = np.cumsum(first) - 1
        long_enough = (np.bincount(number) >= MIN_WORDS)[number] if len(kept) else np.zeros(0, bool)
        if len(kept) == len(at) and long_enough.all():
            break
        at, segment = kept[long_enough], number[long_enough]
        word = words[at]
        _, inverse, counts = np.unique(segment * (words.max() + 1) + word, return_inverse=True, return_counts=True)
        often = counts[inverse]
    return at, segment


def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def lag_scan(at: np.ndarray, segment: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the surviving segments, by start and period."""
    runs: list[tuple[int, int, int]] = []
    number, m = _numbered(words[at]), 1
    while len(at):
        # A stretch of m words from here lies in the segment; others get numbers of their own.
        n = len(at)
        fits = np.zeros(n, bool)
        fits[:max(0, n - m + 1)] = segment[:max(0, n - m + 1)] == segment[m - 1:]
        key = np.where(fits, segment * (number.max() + 1) + number, -1)
        order = np.argsort(key, kind="stable")
        again = (key[order][1:] == key[order][:-1]) & (key[order][1:] >= 0)
        lag = np.zeros(n, np.int64)
        lag[order[:-1][again]] = np.diff(order)[again]
        lag[(lag <= m // 2) | (lag > m)] = 0
        # A stretch and its repetition lie in one segment, so equal lags in a row do, too, unless lag is 0.
        edge = np.flatnonzero(np.diff(lag, prepend=-1, append=-1))
        first, last = edge[:-1], edge[1:] - 1
        period = lag[first]
        length = last - first + m + period
        good = (period > 0) & (length >= np.maximum(MIN_WORDS, MIN_PERIODS * period))
        runs += zip(at[first[good]].tolist(), length[good].tolist(), period[good].tolist())
        # Numbers of stretches twice as long, in segments that can hold a run of a period beyond m.
        pair = np.full(n, -1, np.int64)
        pair[:max(0, n - m)] = np.where(segment[:max(0, n - m)] == segment[m:], number[m:], -1)
        number = _numbered(number * (number.max() + 2) + pair + 1)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        sizes = np.diff(np.append(starts, n))
        keep = np.repeat(sizes >= MIN_PERIODS * (m + 1), sizes)
        at, segment, number, m = at[keep], segment[keep], number[keep], 2 * m
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most repetitions; the first by start, then period, of equal ones."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    numbers: list[int] = []
    for words in texts:
        base, known = len(numbers), {}
        numbers += [known.setdefault(w, base + i) for i, w in enumerate(words)]
    starts = np.cumsum([0, *map(len, texts)])
    words = np.array(numbers, np.int64)
    at, segment = surviving(words, np.repeat(np.arange(len(texts)), np.diff(starts)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = lag_scan(at, segment, words)
    owners = np.searchsorted(starts, [r[0] for r in found], "right") - 1
    for (start, length, period), i in zip(found, owners.tolist()):
        out[i].append((start - int(starts[i]), length, period))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change[:-1]).tolist()) if not n]


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` of every row of ``docs`` (doc_id, text).

    ``runs`` are (start, length, period) by start and period, ``strongest`` the one with the largest length / period
    (null without runs), ``collapsed`` the words that no run holds after its first period, joined by one space.
    ``prepare`` may change a document's words before. A null or empty text has no words, no runs and
    an empty ``collapsed``. Rows are independent of each other, so repeated rows and ids and null ids do no harm.
    Other columns are ignored; an empty table gives an empty result.
    """
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            ids = batch.column("doc_id").to_pylist()
            words = [t.split() for t in texts]
            if prepare:
                words = [prepare(i, w) for i, w in zip(ids, words)]
            runs = runs_of(words)
            names = ("start", "length", "period")
            best = [r and dict(zip(names, r)) for r in map(strongest, runs)]
            kept = [b" ".join(kept_words(w, r)).decode() for w, r in zip(words, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([[dict(zip(names, r)) for r in rs] for rs in runs], pa.list_(_RUN_TYPE)),
                 pa.array(best, _RUN_TYPE), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, RESULT)
