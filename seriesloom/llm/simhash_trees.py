"""Near-duplicate groups by SimHash fingerprints, searched with BK-trees.

A fingerprint has a bit for each bit of the shingle hashes: 1 if more than half of them have it set. Documents are
linked when their fingerprints differ in at most ``RADIUS`` bits. Equal fingerprints are counted together first,
so a group of copies of any size is one node from then on.

**Shards.** The 64 bits are cut into RADIUS + 2 blocks. Fingerprints within the radius agree in at least
two blocks, so they meet in a shard of some pair of blocks: fingerprints that agree in these bits. A shard
of more than ``SHARD_NODES`` fingerprints is not searched; the bits that its members do not share yet are
cut into blocks in the same way, and its fingerprints are dealt to finer shards. At most four times, as
then the members have all but eight bits in common. No task ever holds more than SHARD_NODES fingerprints at once, and no
pair is left out.

**Trees.** Each shard becomes a BK-tree: a child hangs at the edge numbered by its Hamming distance to the parent. A
search follows only the edges whose number is within the radius of the distance to the node, as the triangle inequality
allows. All fingerprints of a shard go down its tree together, as arrays. Out come the links that
connect the shard's groups, not all pairs. The trees are built where their shards are: broadcasting them would send what
grows with the corpus through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import text_chunks
from seriesloom.llm.components import connected_components
from seriesloom.storage import written_table

SHINGLE, SEED, RADIUS = 3, 42, 3
# Most fingerprints of one tree, and rounds of finer shards after which no more than 8 bits differ.
SHARD_NODES, ROUNDS = 1000, 4
# Hashes whose bits are counted at a time.
CHUNK_HASHES = 100_000


def fingerprint(words: list[bytes]) -> int:
    """Unsigned fingerprint of a list of words; 0 without words."""
    shingles = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words] if words else []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK_HASHES):
        part = hashes[start:start + CHUNK_HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (as a signed long) of every row."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = np.array([fingerprint(t.lower().split()) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))],
                                             names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, fingerprint long")


def finer_masks(mask: int) -> list[int]:
    """The masks of the shards below: ``mask`` and two of RADIUS + 2 blocks of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(free, RADIUS + 2)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


class BKTree:
    """Tree over different fingerprints; children are keyed by their distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, [{} for _ in values]
        plain = values.tolist()
        for new, value in enumerate(plain[1:], 1):
            at = 0
            while (child := self.children[at].setdefault((value ^ plain[at]).bit_count(), new)) != new:
                at = child

    def pairs_within(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, later nodes within the radius of it)."""
        searches = [(0, np.arange(1, len(self.values)))]
        while searches:
            at, asked = searches.pop()
            distance = np.bitwise_count(self.values[asked] ^ self.values[at]).astype(np.int64)
            near = asked[distance <= radius]
            if len(near):
                yield at, near
            for edge, child in self.children[at].items():
                # Nodes below were added after the child; earlier ones find them in their own searches.
                onward = asked[(np.abs(distance - edge) <= radius) & (asked > child)]
                if len(onward):
                    searches.append((child, onward))


def shard_groups(values: np.ndarray) -> np.ndarray:
    """For each fingerprint the first one it is connected to inside the shard, as indexes."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for at, near in BKTree(values).pairs_within(RADIUS):
        for other in near.tolist():
            a, b = root(at), root(other)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(values))])


def shard_links(shards: DataFrame) -> DataFrame:
    """``a, b``: links that connect the groups of each shard; ``shards`` has a column ``members``."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            a, b = [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                members = np.sort(values[start:end])
                group = shard_groups(members)
                linked = group != np.arange(len(group))
                a.append(members[linked])
                b.append(members[group[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], names=["a", "b"])

    return shards.select("members").mapInArrow(find, "a long, b long")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all groups of the different fingerprints ``nodes`` (fingerprint)."""
    spark = nodes.sparkSession
    masks = F.array(*[F.lit(signed(m)) for m in finer_masks(0)])
    dealt, parts = nodes.select("fingerprint", F.explode(masks).alias("mask")), []
    while dealt is not None:
        dealt = dealt.withColumn("shard", F.col("fingerprint").bitwiseAND(F.col("mask")))
        whole, finer = dealt, None
        if len(parts) < ROUNDS - 1:
            crowded = written_table(dealt.groupBy("mask", "shard").agg(F.count(F.lit(1)).alias("n"))
                                    .where(F.col("n") > SHARD_NODES).select("mask", "shard"))
            masks = [r["mask"] % (1 << 64) for r in crowded.select("mask").distinct().collect()]
            if masks:
                whole = dealt.join(crowded, ["mask", "shard"], "left_anti")
                rows = written_table(dealt.join(crowded, ["mask", "shard"], "left_semi").select("fingerprint", "mask"))
                # Ten rows per mask, at most 10,000 in the last round. Several ways can lead to the same finer shard.
                below = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in finer_masks(m)], "mask long, finer long")
                finer = rows.join(F.broadcast(below), "mask").select("fingerprint", F.col("finer").alias("mask")).distinct()
        members = whole.groupBy("mask", "shard").agg(F.collect_list("fingerprint").alias("members"))
        parts.append(written_table(shard_links(members.where(F.size("members") > 1))))
        dealt = finer
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    return links.distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (doc_id, text).

    ``fingerprint`` has 16 lower-case hexadecimal digits; a text of fewer than three words is one shingle, a null or
    empty one has fingerprint zero and is linked like any other. ``component_id`` is the smallest doc_id
    reachable by links, among rows that repeat an id as well; a null id counts for nothing, but its row links
    others. Other columns are ignored; an empty table gives an empty result.
    """
    prints = written_table(fingerprints(docs))
    nodes = written_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    labels = connected_components(fingerprint_links(nodes))
    grouped = written_table(nodes.join(labels, F.col("fingerprint") == F.col("id")).select("fingerprint", "component", "low"))
    lowest = written_table(grouped.groupBy(F.col("component").alias("same")).agg(F.min("low").alias("lowest")))
    grouped = grouped.join(lowest, F.col("component") == F.col("same")).select(F.col("fingerprint").alias("known"), "lowest")
    alone = nodes.where("n > 1").join(grouped, F.col("fingerprint") == F.col("known"), "left_anti")
    # Only fingerprints of several documents or with links; the others' documents stand for themselves.
    known = written_table(grouped.unionByName(alone.select(F.col("fingerprint").alias("known"), F.col("low").alias("lowest"))))
    joined = prints.join(known, F.col("fingerprint") == F.col("known"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                         F.coalesce("lowest", "doc_id").alias("component_id"))
