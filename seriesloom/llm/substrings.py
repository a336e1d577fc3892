"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Words are removed that lie in a window
whose words also start in a document with a smaller doc_id. A text that is an exact copy of one with a smaller doc_id
loses all its words if it has a window at all, and takes no part in the search; its first document
stands for it. For the others, in three steps:

1. Recurring passages are confirmed. Equal windows share their anchor, the smallest hash of their
   ``ANCHOR``-word runs; about one run in five is an anchor. Anchors of only one document go first;
   the windows left are counted by 64-bit hash, which gives each recurring window its first document.
2. The recurring passages are cut out of their first documents as phrases. Phrases are dealt to shards
   of bounded size, and each shard is compiled into an Aho-Corasick automaton over words. Its patterns are
   runs of ``SEED`` words of the phrases, so chosen that each window of a phrase holds one whole, and
   the rarest in the shard where there is a choice.
3. Every document that holds a recurring passage is streamed through the automata of the shards
   it needs; each pattern found is extended to both sides, word by word, as far as the phrase goes.

Counts are combined before their shuffles; shards wanted by many documents are built several times,
each for a part of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import gram_hashes, text_chunks, word_hashes
from seriesloom.operators.enrich import small_side
from seriesloom.storage import written_table

WINDOW, ANCHOR = 13, 5
# Windows of a long document are dealt in blocks of so many starts.
BLOCK_WORDS = 20_000
# Windows per automaton, and bytes of text that one copy of an automaton reads.
SHARD_WINDOWS = 150_000
SHARD_BYTES = 16_000_000
# Words of a pattern. A window holds seven such runs.
SEED = (WINDOW + 1) // 2
# Letters that spell the numbers of words.
ALPHABET = 32


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window, by its first word."""
    grams = gram_hashes(hashes, ANCHOR)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    smallest = grams[:n].copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        np.minimum(smallest, grams[i:n + i], out=smallest)
    return smallest


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit integers."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([np.zeros(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are listed (not empty)."""
    listed = np.sort(listed)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before, the first place included."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def copied_texts(docs: DataFrame) -> DataFrame:
    """``copied_hash, copied_check, copied_from``: two hashes of each text of several doc_ids, and the smallest of these."""
    hashes = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(
        F.xxhash64("text").alias("copied_hash"), F.xxhash64(F.lit(1), "text").alias("copied_check"))
    found = hashes.agg(F.min(F.col("doc_id").cast("long")).alias("copied_from"), F.max(F.col("doc_id").cast("long")).alias("last"))
    return small_side(written_table(found.where("copied_from < last").drop("last")))


def _with_copies(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """``docs`` with ``copied_from``: null unless the text has copies."""
    same = (F.xxhash64("text") == F.col("copied_hash")) & (F.xxhash64(F.lit(1), "text") == F.col("copied_check"))
    return docs.join(copied, same, "left").drop("copied_hash", "copied_check")


def document_anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, anchors``: the different anchors of each document."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = list(map(window_anchors, word_hashes(texts)))
            anchors = [np.unique(a[_changes(a)]) for a in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(anchors)], names=["doc_id", "anchors"])

    rows = docs.where("doc_id IS NOT NULL").mapInArrow(find, "doc_id long, anchors array<long>")
    return rows.where(F.size("anchors") > 0)


def candidate_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, block, windows`` for the windows whose anchor recurs."""
    anchors = written_table(document_anchors(docs))
    each = anchors.select("doc_id", F.explode("anchors").alias("anchor"))
    again = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    again = again.where("low < high").select(F.col("anchor").alias("again"))
    hot = each.join(again, F.col("anchor") == F.col("again"), "left_semi")
    hot = written_table(hot.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("anchor").alias("hot")))
    rows = docs.join(hot, F.col("doc_id") == F.col("__id")).select("doc_id", "text_hash", "hot", "text")
    schema = "doc_id long, text_hash long, block int, windows array<long>"

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            out: list[tuple] = []
            for i, hashes in enumerate(word_hashes(texts)):
                near = window_anchors(hashes)
                at = _changes(near)
                hot = _among(near[at], batch.column("hot")[i].values.to_numpy().view(np.uint64))
                starts = np.flatnonzero(np.repeat(hot, np.diff(np.append(at, len(near)))))
                if not len(starts):
                    continue
                windows = gram_hashes(hashes, WINDOW)[starts]
                for block in np.unique(starts // BLOCK_WORDS).tolist():
                    out.append((ids[i], keys[i], block, np.unique(windows[starts // BLOCK_WORDS == block])))
            if out:
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), _lists(list(d))],
                    names=["doc_id", "text_hash", "block", "windows"])

    return rows.mapInArrow(find, schema)


def phrases(sources: DataFrame) -> DataFrame:
    """Cut phrases out of ``doc_id, block, windows, text``: runs of the listed windows, one per line."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out, blocks = [], batch.column("block").to_pylist()
            for i, text in enumerate(texts):
                words = text.split()
                first = blocks[i] * BLOCK_WORDS
                part = words[first:first + BLOCK_WORDS + WINDOW - 1]
                listed = batch.column("windows")[i].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(_among(gram_hashes(word_hashes([b" ".join(part)])[0], WINDOW), listed))
                runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
                out.append(b"\n".join(b" ".join(part[r[0]:r[-1] + WINDOW]) for r in runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("block"), pa.array([o.decode() for o in out], pa.string())],
                names=["doc_id", "block", "phrases"])

    return sources.mapInArrow(cut, "doc_id long, block int, phrases string")


class PhraseAutomaton:
    """Aho-Corasick automaton of chosen runs of phrases, over numbered words.

    A word is spelled with as many letters of a small alphabet as its number needs: the automaton searches the
    edges of a node one by one, so nodes must have few. All words are equally long, so a match that ends
    inside a word is told by its place.
    """

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        self.numbers: dict[bytes, int] = {}
        self.phrases: list[tuple[list[int], int]] = []
        self.ready = False

    def add(self, phrase: bytes, source: int) -> None:
        numbers = self.numbers
        self.phrases.append(([numbers.setdefault(w, len(numbers) + 1) for w in phrase.split()], source))

    def _compile(self) -> None:
        """Choose, for each window not yet covered, the run with the fewest occurrences in the shard."""
        runs = [gram_hashes(np.array(p, np.uint64), SEED) for p, _ in self.phrases]
        _, inverse, counts = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        often = np.split(counts[inverse], np.cumsum([len(r) for r in runs])[:-1])
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, (phrase, _) in enumerate(self.phrases):
            # Of the runs in each window that with the fewest uses, the last of equal ones: a sliding minimum.
            size, start = len(often[number]), 0
            rank = often[number] * size + np.arange(size - 1, -1, -1)
            windows = len(phrase) - WINDOW + 1
            least = np.min([rank[k:k + windows] for k in range(WINDOW - SEED + 1)], axis=0)
            chosen = (size - 1 - least % size).tolist()
            while start < windows:
                at = chosen[start]
                places.setdefault(tuple(phrase[at:at + SEED]), []).append((number, at))
                start = at + 1
        self.width = 1
        while ALPHABET ** self.width <= len(self.numbers):
            self.width += 1
        self.spelled = ["".join(chr(n // ALPHABET ** k % ALPHABET + 1) for k in range(self.width))
                        for n in range(len(self.numbers) + 1)]
        for run, found in places.items():
            self.automaton.add_word("".join([self.spelled[n] for n in run]), found)
        self.automaton.make_automaton()
        self.ready = True

    def covered(self, text: bytes, doc_id: int) -> list[tuple[int, int]]:
        """Spans of at least a window of words that are in a phrase of a source smaller than ``doc_id``."""
        if not self.ready:
            self._compile()
        known = self.numbers.get
        words = [known(w, 0) for w in text.split()]
        spans: list[tuple[int, int]] = []
        reached: dict[tuple[int, int], int] = {}
        low = high = 0  # the last stretch covered
        for letter, places in self.automaton.iter("".join([self.spelled[w] for w in words])):
            last, inside = divmod(letter + 1 - self.width, self.width)
            if inside:
                continue
            # All windows that hold this run are covered: the windows beyond it have runs of their own.
            if low <= max(0, last + 1 - WINDOW) and high >= min(len(words), last + 1 - SEED + WINDOW):
                continue
            for number, at in places:
                phrase, source = self.phrases[number]
                start, end = last - SEED + 1, last + 1
                shift = start - at
                if source >= doc_id or reached.get((number, shift), 0) >= end:
                    continue
                # Mostly all of the phrase is there: whole stretches are compared before single words.
                first, stop = max(0, shift), min(len(words), len(phrase) + shift)
                if words[first:start] == phrase[first - shift:start - shift]:
                    start = first
                while start > first and words[start - 1] == phrase[start - 1 - shift]:
                    start -= 1
                if words[end:stop] == phrase[end - shift:stop - shift]:
                    end = stop
                while end < stop and words[end] == phrase[end - shift]:
                    end += 1
                reached[number, shift] = end
                if end - start >= WINDOW:
                    if spans and start <= high and end >= low:
                        low, high = min(low, start), max(high, end)
                        spans[-1] = (low, high)
                    else:
                        low, high = start, end
                        spans.append((low, high))
        return spans


def located(rows: DataFrame) -> DataFrame:
    """Stream documents through automata: ``doc_id, text_hash, starts, ends`` of covered words.

    ``rows`` (shard, copy, kind, doc_id, text_hash, text) hold each shard's phrases (kind 0) before its documents.
    """
    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, PhraseAutomaton()
        for batch, texts in text_chunks(batches):
            out = []
            for row, text in zip(batch.drop_columns(["text"]).to_pylist(), texts):
                if (row["shard"], row["copy"]) != at:
                    at, automaton = (row["shard"], row["copy"]), PhraseAutomaton()
                if row["kind"] == 0:
                    for phrase in text.split(b"\n"):
                        automaton.add(phrase, row["doc_id"])
                elif automaton.phrases:
                    spans = automaton.covered(text, row["doc_id"])
                    if spans:
                        out.append((row["doc_id"], row["text_hash"], [s for s, _ in spans], [e for _, e in spans]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                      names=["doc_id", "text_hash", "starts", "ends"])

    ordered = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return ordered.mapInArrow(stream, "doc_id long, text_hash long, starts array<int>, ends array<int>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, starts, ends``: the repeated words of each document that has any."""
    docs = _keyed(docs)
    candidates = written_table(candidate_windows(docs))
    each = candidates.select("doc_id", "text_hash", "block", F.explode("windows").alias("window"))
    recurring = each.groupBy("window").agg(F.min(F.struct("doc_id", "block")).alias("first"), F.max("doc_id").alias("last"))
    recurring = recurring.where(F.col("first.doc_id") < F.col("last"))
    recurring = written_table(recurring.select("window", F.col("first.doc_id").alias("source"), F.col("first.block").alias("part")))
    n_shards = max(1, -(-recurring.count() // SHARD_WINDOWS))
    shard = F.pmod(F.xxhash64("source", "part"), F.lit(n_shards)).alias("shard")

    listed = recurring.groupBy("source", "part").agg(F.collect_list("window").alias("windows"))
    sources = docs.join(listed, F.col("doc_id") == F.col("source"))
    sources = sources.select("doc_id", F.col("part").alias("block"), "windows", "text")
    found = written_table(phrases(sources).where("phrases <> ''").withColumnsRenamed({"doc_id": "source", "block": "part"}))

    wanted = each.join(recurring.withColumnRenamed("window", "known"), F.col("window") == F.col("known"))
    wanted = written_table(wanted.where(F.col("source") < F.col("doc_id")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), shard).distinct())
    routed = docs.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    routed = written_table(routed.select("shard", "doc_id", "text_hash", "text"))
    copies = routed.groupBy(F.col("shard").alias("__shard")).agg(
        F.ceil(F.sum(F.octet_length("text") + 1) / SHARD_BYTES).cast("int").alias("copies"))
    copies = small_side(written_table(copies))
    documents = routed.join(copies, F.col("shard") == F.col("__shard")).select(
        "shard", F.pmod(F.col("text_hash"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"),
        "doc_id", "text_hash", "text")
    patterns = found.withColumn("shard", shard).join(copies, F.col("shard") == F.col("__shard")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"),
        F.col("source").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.col("phrases").alias("text"))
    spans = located(patterns.unionByName(documents))
    return written_table(spans.groupBy("doc_id", "text_hash").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the words in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def _with_spans(docs: DataFrame, others: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text by their places (c0, c1, ..., if ``others``), then ``doc_id``, ``text``, ``starts``, ``ends``, ``copy``.

    So no name of ``docs`` can clash with a helper's.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if others and c != "text"],
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    copied = copied_texts(rows.select("doc_id", "text"))
    marked = _with_copies(rows, copied).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("copied_from"), F.lit(False)))
    marked = marked.drop("copied_from")
    spans = repeated_spans(marked.where("NOT copy").select("doc_id", "text"))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "starts", "ends")
    same = (F.col("doc_id") == F.col("span_id")) & (F.xxhash64("text") == F.col("span_hash"))
    return marked.join(spans, same, "left").drop("span_id", "span_hash")


def _kept_words(batch: pa.RecordBatch, i: int, words: list[bytes]) -> list[bytes]:
    if batch.column("copy")[i].as_py():
        return [] if len(words) >= WINDOW else words
    starts, ends = batch.column("starts")[i], batch.column("ends")[i]
    if not starts.is_valid:
        return words
    gone = _covered(len(words), starts.values.to_numpy(), ends.values.to_numpy())
    return [w for w, g in zip(words, gone.tolist()) if not g]


def removal_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` (doc_id, text).

    The hash is of the kept words joined by one space. A null text has no words. A row without a
    doc_id keeps all its words and takes none from others. Rows that share a doc_id do not take from each other.
    Other columns are ignored; an empty table gives an empty result.
    """
    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = []
            for i, text in enumerate(texts):
                words = text.split()
                kept = _kept_words(batch, i, words)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(docs, others=False)
    return rows.mapInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``, and ``n_chars`` (if there is one) counted anew.

    A text that loses words becomes its kept words joined by one space; others stay as they are. No row goes.
    """
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = texts[i].split()
                kept = _kept_words(batch, i, words)
                out.append(b" ".join(kept).decode() if len(kept) < len(words) else text)
            columns = {c: batch.column(f"c{i}") for i, c in enumerate(names) if c != "text"}
            columns["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    kept = _with_spans(docs).mapInArrow(keep, docs.schema)
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*names)
