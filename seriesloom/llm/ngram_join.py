"""N-gram Jaccard self-join by universe partition.

A document's set are its distinct five-word shingles (as 64-bit hashes). Two sets of sizes b <= a with a
similarity of at least 0.8 differ in at most H(a) = 2a // 9 elements, and b >= 0.8 a.

**Segments.** For every size band the universe of hashes is cut into segments. Sets that differ in at most H
elements agree in all but H segments. So sets of a band emit one signature per segment that is not
empty, over the first P(size) segments only, where P exceeds H by 40 %: as many as the
larger of two such sets can spare. Sets just above a band emit for that band as well.

**Allocation by cost.** Signatures that more than ``FREQUENT`` sets have in common, and empty segments, yield
nothing. A pair found by no other signature agrees in at least P - H segments that are empty or frequent,
and that holds for both of its sets. Only sets with so many of them, and sets too small for
segments, are searched a second time.

**Second search.** There every element is its own segment. Subsets are chosen by cost: of n elements
the n - ceil(0.8 n) + 1 rarest must contain one that the partner has as well (deletions cannot
remove them all). A set whose rarest elements are its own alone needs no search.

**Exact check.** Candidates are compared element by element. Where many sets share an element, each is
compared with the first; then the sets of buckets that are still in different components are compared
with each other, block by block. So a large group of near copies costs about one comparison per copy, and no link between
components is lost. Exact copies are represented by the one with the smallest id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import WordHashes, gram_hashes, mixed, text_chunks, unused_name
from seriesloom.llm.components import connected_components
from seriesloom.operators.enrich import small_side
from seriesloom.storage import written_table

GRAM = 5
# Buckets up to this size yield all their pairs.
FREQUENT = 8
# Sets up to this size are not cut into segments among themselves.
SMALL = 50
# Segments emitted per difference that must be survived, and growth of the size bands.
SPARE, BAND_GROWTH = 1.4, 1.6
SCHEME_BITS = 6
# Elements of the sets in one block of a large group.
BLOCK_SHINGLES = 50_000


def most_differences(size: int) -> int:
    """Largest symmetric difference of a set with a similar one that is not larger."""
    return 2 * size // 9


@functools.cache
def emitted_segments(size: int) -> int:
    return int(np.ceil(SPARE * (most_differences(5 * size // 4) + 1)))


@functools.cache
def room(size: int) -> int:
    """So many segments must be empty or frequent before a similar set can be missed."""
    return min(emitted_segments(size) - most_differences(5 * size // 4),
               emitted_segments(-(-4 * size // 5)) - most_differences(size))


@functools.cache
def bands() -> list[tuple[int, int]]:
    """(smallest, largest) size of the smaller set per scheme."""
    out, low = [], 4 * (SMALL + 1) // 5 + 1
    while low < 1 << 40:
        high = int(low * BAND_GROWTH)
        out.append((low, high))
        low = high + 1
    return out


@functools.cache
def schemes(size: int) -> tuple[int, ...]:
    return tuple(g for g, (low, high) in enumerate(bands()) if low <= size <= 5 * high // 4)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles; fewer than five words make one shingle, none make none."""
    return np.unique(gram_hashes(hashes, min(GRAM, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def _segments(shingles: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scrambled shingles of the emitted segments, their segments, and the number of segments emitted."""
    n_segments = emitted_segments(bands()[scheme][1])
    emitted = min(emitted_segments(len(shingles)), n_segments)
    spread = mixed(shingles + np.uint64(scheme + 1))
    segment = (spread % np.uint64(n_segments)).astype(np.int64)
    inside = segment < emitted
    return spread[inside], segment[inside], emitted


def empty_segments(shingles: np.ndarray, scheme: int) -> int:
    _, segment, emitted = _segments(shingles, scheme)
    return emitted - int(np.count_nonzero(np.bincount(segment, minlength=emitted)))


def segment_signatures(shingles: np.ndarray, scheme: int) -> np.ndarray:
    """Signatures of the emitted segments that are not empty."""
    spread, segment, emitted = _segments(shingles, scheme)
    total = np.zeros(emitted, np.uint64)
    np.add.at(total, segment, mixed(spread))
    filled = np.flatnonzero(np.bincount(segment, minlength=emitted))
    signature = mixed(total[filled] + filled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (signature << np.uint64(SCHEME_BITS)) | np.uint64(scheme)


def _sets(texts: list[bytes], words: WordHashes) -> list[np.ndarray]:
    return [shingle_set(words.of(t.lower().split())) for t in texts]


def set_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, rooms``: per scheme, how many more segments may be frequent."""
    schema = "doc_id long, text_key string, n_shingles long, rooms array<int>"

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in text_chunks(batches):
            sets = _sets(texts, words)
            rooms = [[room(len(s)) - empty_segments(s, g) for g in schemes(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array(rooms, pa.list_(pa.int32()))], names=["doc_id", "text_key", "n_shingles", "rooms"])

    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return rows.mapInArrow(measure, schema)


def signatures(docs: DataFrame) -> DataFrame:
    """``key, id``: a row per signature. Equal sets that meet in one chunk emit once."""
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in text_chunks(batches):
            seen, keys, ids = set(), [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                if text in seen:
                    continue
                seen.add(text)
                shingles = shingle_set(words.of(text.lower().split()))
                for g in schemes(len(shingles)):
                    keys.append(segment_signatures(shingles, g))
                    ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))],
                                      names=["key", "id"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(emit, "key long, id long")


def bucket_rows(rows: DataFrame) -> DataFrame:
    """``a, b, key`` from ``key, id``: all pairs of buckets with up to ``FREQUENT`` rows (key null).

    A larger bucket yields a row per member: the member, the first id of the bucket, and the key.
    Rows arrive sorted, so a task holds one batch and the end of a bucket at a time.
    """
    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(a, b, key):
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())],
                                   names=["a", "b", "key"])

        def close(keys: np.ndarray, ids: np.ndarray, first: int | None) -> Iterator[pa.RecordBatch]:
            """Whole buckets; the first of them continues one whose first id is ``first``."""
            if not len(keys):
                return
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            heads = ids[starts].copy()
            large = sizes > FREQUENT
            if first is not None:
                heads[0], large[0] = first, True
            member = np.repeat(large, sizes)
            if member.any():
                yield batch_of(ids[member], np.repeat(heads, sizes)[member], keys[member])
            keys, ids = keys[~member], ids[~member]
            for lag in range(1, FREQUENT):
                same = np.flatnonzero((keys[lag:] == keys[:-lag]) & (ids[lag:] != ids[:-lag]))
                if len(same):
                    yield batch_of(ids[same], ids[same + lag], [None] * len(same))

        # first and key of a large bucket that the next batch may continue
        keys, ids, first, open_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            if not len(keys):
                continue
            if first is not None and keys[0] != open_key:
                first = None
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from close(keys[:last], ids[:last], first)
                first = None
            keys, ids = keys[last:], ids[last:]
            if len(keys) > FREQUENT:
                head = first if first is not None else int(ids[0])
                yield from close(keys, ids, head)
                keys, ids, first, open_key = keys[:0], ids[:0], head, int(keys[-1])
        yield from close(keys, ids, first)

    ordered = rows.repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(pair, "a long, b long, key long")


def similar_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are similar, ids replaced by those of their representatives.

    Ids are mapped and sizes compared first; only sets of documents still needed are built and moved.
    """
    known = nodes.select("doc_id", "rep", "n_shingles").where("n_shingles > 0").distinct()

    def side(name: str) -> DataFrame:
        return known.select(F.col("doc_id").alias(name), F.col("rep").alias(f"rep_{name}"),
                            F.col("n_shingles").alias(f"n_{name}"))

    mapped = pairs.join(side("a"), "a").join(side("b"), "b").where(
        "rep_a <> rep_b AND 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    mapped = written_table(mapped.select(F.least("rep_a", "rep_b").alias("a"),
                                         F.greatest("rep_a", "rep_b").alias("b")).distinct())
    needed = mapped.select(F.col("a").alias("__id")).union(mapped.select("b")).distinct()
    texts = written_table(docs.join(small_side(needed), F.col("doc_id") == F.col("__id"), "left_semi"))
    rows = mapped.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts_a in text_chunks(batches, "text_a"):
            alike = []
            texts_b = batch.column("text_b").cast(pa.binary()).to_pylist()
            for i, y in enumerate(_sets([t or b"" for t in texts_b], words)):
                if i == 0 or texts_a[i] != texts_a[i - 1]:
                    x = shingle_set(words.of(texts_a[i].lower().split()))
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    rows = rows.select("a", "b", "text_a", "text_b")
    return written_table(rows.mapInArrow(compare, "a long, b long").distinct())


def document_sets(docs: DataFrame) -> DataFrame:
    """``id, shingles``: the set of every document."""
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in text_chunks(batches):
            sets = [s.view(np.int64) for s in _sets(texts, words)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))],
                names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "id long, shingles array<long>")


def slack(nodes: DataFrame, frequent: DataFrame) -> DataFrame:
    """``id, rep, n_shingles, slack``: signatures that a document shares with each similar one, at least.

    Of the segments in which two similar sets agree, the empty and frequent ones yield nothing;
    ``slack`` is what remains for certain (0 or less: nothing; null: too small for segments).
    """
    scheme = F.col("key").bitwiseAND(F.lit((1 << SCHEME_BITS) - 1)).cast("int")
    counts = frequent.select(F.col("a").alias("__id"), scheme.alias("scheme")).groupBy("__id", "scheme").agg(
        F.count(F.lit(1)).alias("n")).groupBy("__id").agg(F.max("n").alias("n_frequent"))
    rows = nodes.where("n_shingles > 0").join(counts, F.col("doc_id") == F.col("__id"), "left")
    left = F.array_min("rooms") - F.coalesce("n_frequent", F.lit(0))
    return rows.groupBy(F.col("doc_id").alias("id"), "rep").agg(
        F.min("n_shingles").alias("n_shingles"), F.min(left).alias("slack"))


def rare_elements(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``key, id``: for each set of ``ids``, the elements of its rarest part that others have as well."""
    sets = document_sets(docs.join(small_side(ids), F.col("doc_id") == F.col("id"), "left_semi"))
    sets = written_table(sets.withColumn("set", F.monotonically_increasing_id()))
    each = sets.select("set", "id", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    shared = each.join(often.withColumnRenamed("key", "known"), F.col("key") == F.col("known"))
    shared = shared.select("set", "id", "n", "key", "uses")
    by_use = Window.partitionBy("set").orderBy("uses", "key")
    shared = shared.withColumns({"place": F.row_number().over(by_use),
                                 "n_shared": F.count(F.lit(1)).over(Window.partitionBy("set"))})
    # elements of one set only come first in the order
    chosen = F.expr("n - (4 * n + 4) DIV 5 + 1 - (n - n_shared)")
    return written_table(shared.where(F.col("place") <= chosen).select("key", "id"))


def members_apart(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, component, cluster``: members of large buckets whose members are not all linked by now.

    Clusters join the buckets that have members in common.
    """
    members = found.where("key IS NOT NULL").select("key", F.col("a").alias("id"))
    members = members.join(labels.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    buckets = members.groupBy(F.col("key").alias("open")).agg(
        F.min("id").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = written_table(members.join(buckets.select("open", "first"), F.col("key") == F.col("open"))
                          .select("id", "component", "first").distinct())
    clusters = connected_components(apart.select(F.col("id").alias("a"), F.col("first").alias("b")))
    return apart.select("id", "component").distinct().join(clusters.withColumnsRenamed(
        {"id": "__id", "component": "cluster"}), F.col("id") == F.col("__id")).drop("__id")


def links_between_blocks(members: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) within the clusters of ``members`` that join components.

    A cluster is ordered by set size and cut into blocks of about ``BLOCK_SHINGLES`` elements. Each two
    blocks of sizes that can match meet in one task, which compares their sets by an inverted
    index and yields only links that join what is not yet joined: no pair leaves the task otherwise.
    """
    sizes = nodes.groupBy(F.col("doc_id").alias("__id")).agg(F.max("n_shingles").alias("n"))
    in_order = Window.partitionBy("cluster").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = members.join(sizes, F.col("id") == F.col("__id")).drop("__id").withColumn(
        "block", F.floor((F.sum("n").over(in_order) - F.col("n")) / BLOCK_SHINGLES))
    placed = written_table(placed)
    blocks = placed.groupBy(F.col("cluster").alias("of"), F.col("block").alias("other")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"))
    texts = docs.join(small_side(placed), F.col("doc_id") == F.col("id"))
    meets = texts.join(blocks, F.col("cluster") == F.col("of")).where("5 * high >= 4 * n AND 5 * n >= 4 * low")
    rows = meets.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        "id", "component", "text")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group, waiting = WordHashes(), None, []

        def links_of(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if len({component for _, component, _ in rows}) < 2:
                return
            sizes = np.array([len(s) for _, _, s in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            _, token = np.unique(np.concatenate([s for _, _, s in rows]), return_inverse=True)
            order = np.argsort(token, kind="stable")
            postings, starts = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
            label = np.array([component for _, component, _ in rows])
            ends, links = np.cumsum(sizes), []
            for x in range(len(rows)):
                mine = token[ends[x] - sizes[x]:ends[x]]
                met = np.concatenate([postings[starts[t]:starts[t + 1]] for t in mine])
                common = np.bincount(met, minlength=len(rows))
                alike = np.flatnonzero(100 * common >= 80 * (sizes[x] + sizes - common))
                for y in alike[label[alike] != label[x]].tolist():
                    if label[y] != label[x]:
                        links.append((rows[x][0], rows[y][0]))
                        label[label == label[y]] = label[x]
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

        for batch, texts in text_chunks(batches):
            for row, text in zip(batch.drop_columns(["text"]).to_pylist(), texts):
                key = (row["cluster"], row["i"], row["j"])
                if key != group:
                    yield from links_of(waiting)
                    group, waiting = key, []
                waiting.append((row["id"], row["component"], shingle_set(words.of(text.lower().split()))))
        yield from links_of(waiting)

    ordered = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return written_table(ordered.mapInArrow(compare, "a long, b long"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (doc_id, text).

    A document without words (or a null text) has no shingle and is linked with nothing. A row without a
    doc_id is not linked, its component is null. Rows that share a doc_id count as one document
    that has the links of each. Other columns are ignored; an empty table gives an empty result.
    """
    sizes = written_table(set_sizes(docs))
    copies = sizes.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("text_key").alias("same")).agg(
        F.min("doc_id").alias("rep"))
    nodes = sizes.join(copies, F.col("text_key") == F.col("same"), "left")
    nodes = written_table(nodes.select("doc_id", "n_shingles", "rooms",
                                       F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")))
    identified = nodes.where("doc_id IS NOT NULL")
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    rows = bucket_rows(signatures(docs)).groupBy("a", "b", "key").agg(F.count(F.lit(1)).alias("shared"))
    rows = written_table(rows)
    spare = written_table(slack(identified, rows.where("key IS NOT NULL")))

    def limit(name: str) -> DataFrame:
        return spare.select(F.col("id").alias(name), F.coalesce("slack", F.lit(1)).alias(f"least_{name}"))

    pairs = rows.where("key IS NULL").join(limit("a"), "a").join(limit("b"), "b")
    links = similar_pairs(pairs.where("shared >= greatest(least_a, least_b)").select("a", "b"), docs, identified)

    again = spare.where((F.col("n_shingles") <= SMALL) | (F.col("slack") <= 0)).select(F.col("rep").alias("id"))
    elements = rare_elements(docs, written_table(again.distinct()))
    found = written_table(bucket_rows(elements).distinct())
    links = links.union(similar_pairs(found.select("a", "b").distinct(), docs, identified))

    links = links.union(links_between_blocks(members_apart(found, connected_components(links)), docs, identified))

    labels = connected_components(links).withColumnRenamed("id", "__id")
    return nodes.join(labels, F.col("rep") == F.col("__id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest doc_id.

    Rows without a doc_id stay; so do all rows that share the smallest one.
    """
    gone = unused_name(docs, "gone")
    groups = linked_documents(docs).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(groups, F.col("doc_id") == F.col(gone), "left_anti")
