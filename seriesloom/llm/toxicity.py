"""Toxicity by class-conditional Kneser-Ney models of word spelling.

Two models, one per class, give each word a log-likelihood, character by character from the
``ORDER - 1`` characters before. The highest order holds counts of the class, from labelled documents;
what a class has not seen falls back on lower orders that both classes share and that come from
all documents of the corpus (continuation counts). Rare spellings thus cost both classes the same,
and a word's log-likelihood ratio comes from what the labels say about it. A document is
described by ratios normalised by length (mean of all words, highest mean of a few consecutive
words, highest word); a logistic curve turns these into a probability. It is fitted on labelled documents that
the models have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat
from string import punctuation
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import mixed, text_chunks, unused_name
from seriesloom.llm.encoding import release_encoders
from seriesloom.storage import written_table

ORDER = 6
# Bits per character, enough for every code point; a gram is two integers of three characters each.
BITS, HALF = 21, 3
# The lowest order gives every character this probability.
UNIFORM = 1 / 1024
# Ratios are whole multiples of 1 / SCALE, so that their sums are the same in any order.
SCALE = 1 << 20
DISCOUNT = 0.75
# Words in the window whose mean ratio counts.
WINDOW = 8
# Folds of crc32(doc_id as text): 0 is never learned from, 1 fits the curve, the rest the models.
FOLDS, HELD_OUT, CURVE_FOLD = 5, 0, 1
# Most labelled documents learned from (those with the smallest hash).
MAX_LABELLED = 1_000_000
# Most grams of the models that go to every task; with more of them words are scored by joins.
MAX_GRAMS = 8_000_000
# Distinct words a task holds before it passes their counts on.
HELD_WORDS = 400_000
# Distinct words whose counts or ratios a task keeps from slice to slice.
KEPT_WORDS = 200_000
# Distinct words whose grams a task holds at a time.
SPELLED_WORDS = 20_000
# Bytes of text whose words are told apart at a time.
SLICE_BYTES = 4_000_000

_START, _END = "\x02", "\x03"
# Which bytes are white space by str.split().
_BLANK = np.array([chr(b).isspace() and b < 128 for b in range(256)])


def _spelled(word: str) -> str:
    """A word without punctuation around it; a word of punctuation alone stays as it is."""
    core = word.strip(punctuation)
    if core.isalnum():
        return core
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end] or word


def _lowered(text: bytes) -> bytes:
    """The text in lower case; of white space, only ASCII's is left."""
    return text.lower() if text.isascii() else " ".join(text.decode().lower().split()).encode()


def told_apart(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The distinct words, and which of them each word is."""
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def as_spelled(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The distinct words as spelled, and which of them each word is."""
    return told_apart(pa.array(list(map(_spelled, words.to_numpy(zero_copy_only=False))), pa.large_string()))


def written_words(texts: list[bytes]) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Distinct words of the texts, which of them each word in turn is, and the number of words of each text.

    Words are found in the bytes of all texts and told apart by Arrow, so that only distinct ones become Python objects.
    """
    lowered = list(map(_lowered, texts))
    text_ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    data = np.frombuffer(b"".join([t + b" " for t in lowered]), np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - starts))
    letters = pa.py_buffer(data[~blank])
    words, which = told_apart(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), letters))
    return words, which, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def spelled_words(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``written_words`` as spelled."""
    written, which, sizes = written_words(texts)
    words, spelled = as_spelled(written)
    return words.to_numpy(zero_copy_only=False).tolist(), spelled[which], sizes


def spelling_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the grams of all words in turn, and where each word's grams start.

    Each character and the end of the word is an event after the ``ORDER - 1`` characters before it.
    """
    pad = _START * (ORDER - 1)
    text = pad + f"{_END}{pad}".join(words) + _END
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    halves = codes[:len(codes) - HALF + 1]
    for i in range(1, HALF):
        halves = (halves << BITS) | codes[i:len(codes) - HALF + 1 + i]
    # a word's grams end at its own characters, not in its pad
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)) * len(pad), sizes)
    return halves[at], halves[at + HALF], np.cumsum(sizes) - sizes


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams or contexts."""
    return mixed(mixed(high.astype(np.uint64) + np.uint64(1)) + low.astype(np.uint64))


def _gram_column(high: np.ndarray, low: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(high), pa.array(low)], names=["high", "low"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is found, and which of them each key is."""
    which = pa.array(keys).dictionary_encode().indices.to_numpy()
    at = np.zeros(which.max(initial=-1) + 1, np.int64)
    at[which] = np.arange(len(which))
    return at, which


_GRAM = "struct<high: long, low: long>"


def fold_of(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with the columns ``fold`` and ``toxic``; toxic is null where nothing may be learned.

    At most ``most`` labels are used, so their broadcast is bounded. Of several labels of a
    document the highest counts.
    """
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id") != HELD_OUT))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("__id"), "__id").limit(most))
    known = F.broadcast(known.select("__id", F.col("toxic").alias("toxic")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.withColumn("fold", fold_of("doc_id")).join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def spelled_out(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of the counted words (as spelled), ``SPELLED_WORDS`` words at a time."""
    rest = iter(counts["n"])
    while words := list(islice(rest, SPELLED_WORDS)):
        high, low, starts = spelling_grams(words)
        word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(high))))
        at, which = _distinct(_keys(high, low))
        columns = [_gram_column(high[at], low[at])]
        for name in ("n", "toxic", "ordinary"):
            weights = np.fromiter(map(counts[name].get, words, repeat(0)), float, len(words))
            columns.append(pa.array(np.bincount(which, weights[word], len(at)).astype(np.int64)))
        yield pa.record_batch(columns, names=["gram", "n", "toxic", "ordinary"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``gram, n, toxic, ordinary``: occurrences in all documents and in those of each class.

    Tasks count words, spell out each distinct word once and combine before the shuffle.
    """
    def summed(which: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.bincount(which, c, n) for c in times.T]).astype(np.int64)

    def merged(parts: list[tuple[pa.LargeStringArray, np.ndarray]]) -> tuple[pa.LargeStringArray, np.ndarray]:
        words, which = told_apart(pa.concat_arrays([w for w, _ in parts]))
        return words, summed(which, np.concatenate([t for _, t in parts]), len(words))

    def grams(written: pa.LargeStringArray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, which = as_spelled(written)
        words, times = words.to_numpy(zero_copy_only=False), summed(which, times, len(words))
        counts = {"n": Counter(dict(zip(words, times.sum(1).tolist())))}
        for name, column in (("toxic", times[:, 1]), ("ordinary", times[:, 2])):
            counts[name] = Counter(dict(zip(words[column > 0], column[column > 0].tolist())))
        return spelled_out(counts)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # distinct words, and how often each is in texts that are not learned from, in toxic and in ordinary ones
        release_encoders()
        parts: list[tuple[pa.LargeStringArray, np.ndarray]] = []
        for batch, texts in text_chunks(batches, max_bytes=SLICE_BYTES):
            words, which, sizes = written_words(texts)
            kinds = [0 if fold in (None, HELD_OUT, CURVE_FOLD) or toxic is None else 1 if toxic else 2
                     for fold, toxic in zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist())]
            times = np.bincount(which * 3 + np.repeat(np.array(kinds), sizes), minlength=3 * len(words))
            parts.append((words, times.reshape(-1, 3)))
            if sum(len(w) for w, _ in parts) > 2 * KEPT_WORDS:
                parts = [merged(parts)]
                if len(parts[0][0]) > KEPT_WORDS:
                    yield from grams(*parts.pop())
        if parts:
            yield from grams(*merged(parts))

    rows = labelled.mapInArrow(count, f"gram {_GRAM}, n long, toxic long, ordinary long")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "ordinary")])


def _suffix(gram: str, order: int) -> Column:
    """The last ``order`` characters of the gram."""
    high, low = (F.lit((1 << BITS * k) - 1) for k in (max(0, order - HALF), min(order, HALF)))
    return F.struct(F.col(f"{gram}.high").bitwiseAND(high).alias("high"), F.col(f"{gram}.low").bitwiseAND(low).alias("low"))


def _context(gram: str) -> Column:
    """The gram without its last character."""
    return F.struct(F.col(f"{gram}.high").alias("high"), F.shiftright(f"{gram}.low", BITS).alias("low"))


def shared_backoff(counts: DataFrame) -> DataFrame:
    """``suffix, shared``: probability of a gram's last character by the lower orders.

    Kneser-Ney: an order counts in how many different contexts of the next order a gram was seen.
    """
    levels = {ORDER: counts.select(F.col("gram").alias("g"), F.col("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = levels[order + 1].groupBy(_suffix("g", order).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    known = None
    for order in range(1, ORDER):
        level = levels[order]
        totals = level.groupBy(_context("g").alias("ctx")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.withColumn("ctx", _context("g")).join(totals, "ctx")
        if known is None:
            level = level.withColumn("lower", F.lit(UNIFORM))
        else:
            below = known.select(F.col("g").alias("__g"), F.col("p").alias("lower"))
            level = level.join(below, _suffix("g", order - 1) == F.col("__g")).drop("__g")
        known = level.select("g", ((F.col("c") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("lower"))
                                   / F.col("total")).alias("p"))
    return known.select(F.col("g").alias("suffix"), F.col("p").alias("shared"))


class Model(NamedTuple):
    """Log-likelihood ratios of seen grams, and of unseen characters after seen contexts, by ascending key."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray

    def word_ratios(self, words: list[str]) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        high, low, starts = spelling_grams(words)
        keys = _keys(high, low)
        # each distinct gram is looked up once, in ascending order: neighbours are near in memory
        at, which = _distinct(keys)
        order = np.argsort(keys[at])
        at = at[order]

        def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int32)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return keys[place] == wanted, values[place]

        seen, ratio = found(self.grams, self.ratios, keys[at])
        context_seen, context_ratio = found(self.contexts, self.context_ratios, _keys(high[at], low[at] >> BITS))
        each = np.zeros(len(at), np.int64)
        each[order] = np.where(seen, ratio, np.where(context_seen, context_ratio, 0))
        return np.add.reduceat(each[which], starts) / SCALE


def train_models(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both class models as tables of ratios: ``gram, ratio`` (stored) and ``ctx, ratio``; no gram is left out."""
    counts = written_table(gram_counts(labelled))
    seen = counts.where("toxic + ordinary > 0").withColumn("ctx", _context("gram"))
    totals = seen.groupBy("ctx").agg(*[f for c in ("toxic", "ordinary") for f in (
        F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))])

    def left_over(c: str) -> Column:
        """Share of the probability that a class passes down after a context; all of it if unseen."""
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    def probability(c: str) -> Column:
        own = F.when(F.col(f"{c}_total") > 0,
                     F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
        return own + left_over(c) * F.col("shared")

    def ratio(toxic: Column, ordinary: Column) -> Column:
        return F.round(F.log(toxic / ordinary) * SCALE).cast("int").alias("ratio")

    shared = shared_backoff(counts)
    grams = seen.join(totals, "ctx").join(shared, _suffix("gram", ORDER - 1) == F.col("suffix")).select(
        "gram", ratio(probability("toxic"), probability("ordinary")))
    contexts = totals.select("ctx", ratio(left_over("toxic"), left_over("ordinary")))
    return written_table(grams), contexts


def held_model(grams: DataFrame, contexts: DataFrame) -> Model:
    """The tables of ``train_models`` in memory."""
    def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        high, low, value = (table.column(i).to_numpy() for i in range(3))
        key = _keys(high, low)
        order = np.argsort(key)
        return key[order], value[order].astype(np.int32)

    return Model(*ordered(grams.select("gram.high", "gram.low", "ratio").toArrow()),
                 *ordered(contexts.select("ctx.high", "ctx.low", "ratio").toArrow()))


FEATURES = ("mean_ratio", "window_ratio", "word_ratio", "root_ratio")


def _described(ratios: np.ndarray) -> tuple[float, float, float, float]:
    """The features of a document by the ratios of its words."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    width = min(WINDOW, n)
    window = float((sums[width:] - sums[:-width]).max()) / WINDOW
    return sums[-1] / n, window, float(ratios.max()), sums[-1] / n ** 0.5


_FEATURED = "doc_id long, fold long, toxic int, n_words long, " + ", ".join(f"{f} double" for f in FEATURES)


def _featured(batch: pa.RecordBatch, ratios: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.float64()) for c in zip(*map(_described, ratios))]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("fold"), batch.column("toxic"),
         pa.array(list(map(len, ratios)), pa.int64()), *columns],
        names=["doc_id", "fold", "toxic", "n_words", *FEATURES])


def document_features(labelled: DataFrame, grams: DataFrame, contexts: DataFrame,
                      max_grams: int = MAX_GRAMS, held_words: int = HELD_WORDS) -> DataFrame:
    """``doc_id, fold, toxic`` and the length-normalised ratios of every document.

    Up to ``max_grams`` grams go to every task. With more, distinct words meet the grams by joins;
    the ``held_words`` most frequent words go to every task, the others by joins. The ratios are the same.
    """
    labelled = labelled.select("doc_id", "text", F.col("fold").cast("long").alias("fold"), "toxic")
    if grams.count() > max_grams:
        return _features_by_joins(labelled, word_ratios(labelled, grams, contexts), held_words)
    shared = labelled.sparkSession.sparkContext.broadcast(tuple(held_model(grams, contexts)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)  # broadcast as plain arrays: workers may lack this package
        known: dict[str, float] = {}
        for batch, texts in text_chunks(batches, max_bytes=SLICE_BYTES):
            words, which, sizes = spelled_words(texts)
            if len(known) > KEPT_WORDS:
                known.clear()
            new = [w for w in words if w not in known]
            for first in range(0, len(new), SPELLED_WORDS):
                some = new[first:first + SPELLED_WORDS]
                known.update(zip(some, model.word_ratios(some).tolist()))
            ratios = np.fromiter(map(known.__getitem__, words), float, len(words))[which]
            yield _featured(batch, np.split(ratios, np.cumsum(sizes)[:-1]))

    return labelled.mapInArrow(score, _FEATURED)


def word_ratios(labelled: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``word, uses, ratio`` of every distinct word, as spelled (stored).

    A gram seen after no context of the labelled texts has ratio 0; Spark splits frequent grams.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, texts in text_chunks(batches):
            for text in texts:
                counts.update(text.decode().lower().split())
            if len(counts) > HELD_WORDS:
                yield counted(counts)
                counts = Counter()
        if counts:
            yield counted(counts)

    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(map(_spelled, counts)), pa.string()),
                                pa.array(list(counts.values()), pa.int64())], names=["word", "uses"])

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, starts = spelling_grams(batch.column("word").to_pylist())
            repeats = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(high))))
            yield pa.record_batch([batch.column("word").take(pa.array(repeats)), _gram_column(high, low)], names=["word", "gram"])

    words = written_table(labelled.select("text").mapInArrow(count, "word string, uses long")
                          .groupBy("word").agg(F.sum("uses").alias("uses")))
    each = words.select("word").mapInArrow(spell, f"word string, gram {_GRAM}").withColumn("ctx", _context("gram"))
    seen = grams.select(F.col("gram").alias("__gram"), F.col("ratio").alias("seen"))
    heads = contexts.select(F.col("ctx").alias("__ctx"), F.col("ratio").alias("head"))
    # one value per distinct gram first, so that words meet the grams in one join
    values = (each.select("gram", "ctx").distinct().join(heads, F.col("ctx") == F.col("__ctx"))
              .join(seen, F.col("gram") == F.col("__gram"), "left")
              .select(F.col("gram").alias("__gram"), F.coalesce("seen", "head").alias("value")))
    sums = (each.join(values, F.col("gram") == F.col("__gram"), "left").groupBy("word")
            .agg((F.sum(F.coalesce("value", F.lit(0))) / SCALE).alias("ratio")))
    return written_table(words.join(sums, "word"))


def _features_by_joins(labelled: DataFrame, ratios: DataFrame, held_words: int) -> DataFrame:
    """``document_features`` with the ratios of words from a table of any size.

    Documents are stored as ratios of their words with gaps for the rarer words, which are joined and filled in.
    """
    frequent = ratios.orderBy(F.desc("uses"), "word").limit(held_words).select("word", "ratio").toArrow()
    shared = labelled.sparkSession.sparkContext.broadcast(dict(zip(*[c.to_pylist() for c in frequent.columns])))

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch, texts in text_chunks(batches):
            docs = [list(map(_spelled, t.decode().lower().split())) for t in texts]
            known = [[shared.value.get(w) for w in words] for words in docs]
            gaps = [[w for w, ratio in zip(words, row) if ratio is None] for words, row in zip(docs, known)]
            ids = [f"{task.partitionId()}-{task.taskAttemptId()}-{n + i}" for i in range(len(docs))]
            n += len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), batch.column("doc_id"), batch.column("fold"), batch.column("toxic"),
                 pa.array(known, pa.list_(pa.float64())), pa.array(gaps, pa.list_(pa.string()))],
                names=["row", "doc_id", "fold", "toxic", "known", "gaps"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for known, found in zip(batch.column("known").to_pylist(), batch.column("found").to_pylist()):
                row = np.array(known, float)  # a gap is nan
                by_word = {f["word"]: f["ratio"] for f in found or []}
                gaps = iter(batch.column("gaps")[len(rows)].as_py())
                for at in np.flatnonzero(np.isnan(row)):
                    row[at] = by_word[next(gaps)]
                rows.append(row)
            yield _featured(batch, rows)

    rows = written_table(labelled.mapInArrow(
        look_up, "row string, doc_id long, fold long, toxic int, known array<double>, gaps array<string>"))
    wanted = rows.select(F.col("row").alias("__row"), F.explode(F.array_distinct("gaps")).alias("word"))
    found = (wanted.join(ratios.select("word", "ratio"), "word").groupBy("__row")
             .agg(F.collect_list(F.struct("word", "ratio")).alias("found")))
    filled = rows.join(found, F.col("row") == F.col("__row"), "left")
    return filled.select("doc_id", "fold", "toxic", "known", "gaps", "found").mapInArrow(fill, _FEATURED)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                    max_grams: int = MAX_GRAMS, held_words: int = HELD_WORDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the features of every row of ``docs`` (doc_id, text).

    Labels (doc_id, toxic 0 or 1) are learned only from folds other than 0; neither they nor any
    column but the text enter a score. A null or empty text has ratios of 0 and gets the score of
    those. A null doc_id is scored, never learned from, and not held out. Repeated rows are scored alike.
    With no usable labels, or with labels of one class only, every score is the share of toxic labels (0 if none).
    Other columns are ignored; an empty table gives an empty result.
    """
    labelled = labelled_documents(docs, labels, max_labelled)
    features = written_table(document_features(labelled, *train_models(labelled), max_grams, held_words))
    sample = features.where((F.col("fold") == CURVE_FOLD) & F.col("toxic").isNotNull()).select("toxic", *FEATURES)
    sample = sample.orderBy(*FEATURES, "toxic").toArrow()
    y = sample.column("toxic").to_numpy().astype(float)
    if len(set(y)) == 2:
        x = np.column_stack([sample.column(c).to_numpy() for c in FEATURES])
        weights = fit_curve(x, y)
        logit = F.lit(float(weights[-1]))
        for name, weight in zip(FEATURES, weights):
            logit = logit + F.lit(float(weight)) * F.col(name)
        score = 1 / (1 + F.exp(-logit))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    scored = features.withColumn("score", score)
    return scored.select("doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", *FEATURES)


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the documents predicted toxic; columns and other rows are unchanged.

    The decision goes by doc_id: of rows that share one, all go if one is rejected. Rows without
    an id stay.
    """
    scores = toxicity_scores(docs, labels, max_labelled)
    rejected = scores.where((F.col("predicted") == 1) & F.col("doc_id").isNotNull())
    gone = unused_name(docs, "rejected")
    rejected = rejected.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(rejected, F.col("doc_id") == F.col(gone), "left_anti")
