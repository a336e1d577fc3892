"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact verification.

A document leaks an item if some window of it, as long as the item, has a weighted Jaccard
similarity of at least ``SIMILARITY`` with the item; elements are runs of five words, weighted by how often
they occur. A window can only reach the similarity if enough of its runs are runs of the item, in whatever
order, so every window with enough of them is laid and no other. Each window gets a SimHash. Fingerprints
are cut into ``len(BLOCKS)`` blocks; items are indexed under each block's value and under all values one
bit away. Two fingerprints that differ in at most ``RADIUS`` bits agree up to one bit in
some block (nine blocks cannot hold two differences each of 17), so the index yields every fingerprint
within the radius. Candidates are then compared exactly.

At similarity 0.8 fingerprints differ in 10 bits on average (standard deviation 2.9), so the radius keeps 99 % of the
pairs at the very limit and practically all above it. Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.enrich import small_side
from seriesloom.llm.common import unused_name
from seriesloom.storage import written_table

GRAM = 5
SIMILARITY = 0.8
RADIUS = 17
# Widths of the fingerprint's blocks, in bits.
BLOCKS = (7, 7, 7, 7, 7, 7, 7, 7, 8)


def _shingles(df: DataFrame, text: str) -> DataFrame:
    """Add ``n_words`` and ``grams``, the hashes of all runs of five words by first word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")
    df = df.withColumn("__words", words)
    df = df.withColumns({"n_words": F.size("__words"), "__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    grams = F.when(F.col("n_words") < GRAM, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("n_words") - GRAM),
        lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(GRAM)])))
    return df.withColumn("grams", grams).drop("__words", "__hashes")


def simhash(grams: str) -> Column:
    """64-bit SimHash of an array of hashes: per bit, what the majority of them has."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(grams, F.lit(0).cast("long"),
                           lambda n, g: n + F.call_function("shiftright", g, b).bitwiseAND(F.lit(1).cast("long")))
        return F.when(2 * ones > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(
            F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks(fingerprint: str, neighbours: bool) -> Column:
    """Array of (block, value), with all values one bit away if ``neighbours``."""
    out, at = [], 0
    for block, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = [0, *[1 << b for b in range(width)]] if neighbours else [0]
        out += [F.struct(F.lit(block).alias("block"), value.bitwiseXOR(F.lit(f).cast("long")).alias("value"))
                for f in flips]
        at += width
    return F.array(*out)


def shared_weight(a: str, b: str) -> Column:
    """Size of the intersection of two arrays as multisets."""
    def count(array: str, x: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words, grams, fingerprint`` of the items with at least five words."""
    items = _shingles(benchmark.select(F.col("item_id").cast("long"), "text"), "text").drop("text")
    items = items.where(F.col("n_words") >= GRAM)
    return items.withColumn("fingerprint", simhash("grams"))


def _starts(similarity: float) -> Column:
    """First words of all windows that hold enough of the positions ``ats``, whose runs are the item's too.

    The runs that a window of m and an item of n share number at least similarity * (m + n) / (1 + similarity).
    Any ``need`` neighbouring positions that fit into a window give the starts from which it holds all of them.
    """
    n, have = F.col("size") - GRAM + 1, F.col("n_words") - GRAM + 1
    m = F.least(n, have)
    need = F.greatest(F.lit(1), F.ceil(similarity * (m + n) / (1 + similarity) - 1e-9)).cast("int")
    spans = F.transform("ats", lambda at, i: F.when(
        F.get("ats", i + need - 1) - at < m,
        F.sequence(F.greatest(F.lit(0), F.get("ats", i + need - 1) - m + 1), F.least(at, have - m)))
        .otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(spans))


def leaked_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every window of a document that matches an item.

    Columns ``doc_id, text_hash, item_id, start, similarity``: the position counts words. The benchmark is the
    query side; tables made from it are broadcast after their size is measured, else joined by
    shuffle. Documents are exploded into narrow rows that meet the broadcast runs where they are; only
    those with a shared run are joined to their text again. No pair of documents is ever formed.
    """
    items = written_table(benchmark_items(benchmark))
    # items of equal runs share a key
    places = items.select(F.xxhash64("grams").alias("item"), F.explode("grams").alias("gram"), F.col("n_words").alias("size"))
    places = written_table(places.distinct())
    known = small_side(places.select(F.col("gram").alias("known")).distinct())
    source = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = source.withColumn("text_hash", F.xxhash64("text"))

    # the outer form: the plain one adds a filter on the array, which would compute it once more per element
    grams = _shingles(keyed, "text").select("doc_id", "text_hash", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    anchors = grams.join(known, F.col("gram") == F.col("known"), "left_semi")
    shared = (anchors.join(small_side(places), "gram").groupBy("doc_id", "text_hash", "n_words", "item", "size")
              .agg(F.sort_array(F.collect_set("at")).alias("ats")))
    windows = shared.select("doc_id", "text_hash", "size", F.explode(_starts(similarity)).alias("start")).distinct()
    wanted = written_table(windows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("size", "start")).alias("windows")))

    found = wanted.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "windows")
    rows = keyed.join(found, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    rows = _shingles(rows.select("doc_id", "text_hash", "windows", "text"), "text")
    rows = rows.select("doc_id", "text_hash", "grams", F.explode("windows").alias("w"))
    rows = rows.select("doc_id", "text_hash", "w.size", "w.start", F.slice(
        "grams", F.col("w.start") + 1, F.col("w.size") - GRAM + 1).alias("window"))
    prints = written_table(rows.withColumn("fingerprint", simhash("window")))

    index = items.select("item_id", F.col("n_words").alias("size"), F.col("grams").alias("item"),
                         F.col("fingerprint").alias("item_print"), F.inline(_blocks("fingerprint", True)))
    probes = prints.select("*", F.inline(_blocks("fingerprint", False)))
    near = probes.join(small_side(index), ["size", "block", "value"])
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # a pair found by several blocks is compared once: by the first of them
    first = F.array_min(F.transform(F.arrays_zip(
        _blocks("fingerprint", False).alias("a"), _blocks("item_print", False).alias("b")),
        lambda z: F.when(F.bit_count(z["a"]["value"].bitwiseXOR(z["b"]["value"])) <= 1, z["a"]["block"])))
    near = near.where(F.col("block") == first)
    weight = shared_weight("window", "item")
    near = near.withColumn("shared", weight)
    alike = F.col("shared") / (F.size("window") + F.size("item") - F.col("shared"))
    return near.select("doc_id", "text_hash", "item_id", "start", alike.alias("similarity")).where(
        F.col("similarity") >= similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, start``: each leaked item of a document with its best window.

    Null or empty texts leak nothing; items of fewer than five words (null ones, too) are not searched
    for; a null doc_id is reported as null; repeated rows give one result; other columns are ignored;
    an empty table gives an empty result.
    """
    best = leaked_windows(docs, benchmark, similarity).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that leak an item; also repeated rows and null ids are told apart."""
    leak, digest = unused_name(docs, "leak"), unused_name(docs, "digest")
    leaks = leaked_windows(docs, benchmark, similarity).select(
        F.col("doc_id").alias(leak), F.col("text_hash").alias(digest)).distinct()
    same = (F.xxhash64("text") == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(leak))
    return docs.join(written_table(leaks), same, "left_anti")
