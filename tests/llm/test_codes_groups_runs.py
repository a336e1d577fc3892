"""Vector codes, SimHash groups and periodic runs against brute force."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
from compare import connect, differences  # noqa: E402
from llm_data import corpus, frame, lowered, split, words  # noqa: E402
from seriesloom.llm import periodic_runs, simhash_trees, vector_codes  # noqa: E402
from seriesloom.llm.queries import LLM_ORACLE, LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, code string, same int, vector string, beyond int, part int"


# --- vector codes ------------------------------------------------------------------------

def codes_by_hand(rows, parts=8, k=16, rounds=6):
    """(vec_id, code, error, label_error) of every row and the hash of the codebooks, comparing with every entry."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), parts)
    odd, kept = [r for r in kept if len(r[1]) != size], [r for r in kept if len(r[1]) == size]
    w = size // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:k]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(x) // len(mine) for x in zip(*mine)], *books[p][e + 1:]]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = Counter()
    for (_, _, label), e in zip(kept, errors):
        totals[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{a:02x}" for _, a in f), e, totals[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]
    return out + [(i, None, None, totals.get(label), digest) for i, _, label in odd]


def coded(spark, rows, schema=VECTORS):
    table = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], schema).repartition(4)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)
                   for r in vector_codes.vector_codes(table).collect()), key=repr)


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_codes_equal_brute_force(spark, kind):
    rng = random.Random(4)
    draw = (lambda: rng.gauss(0, 1)) if kind == "spread" else (lambda: rng.randrange(-2, 3) / 4096)
    rows = [(i, [draw() for _ in range(16)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.5] * 15, 1), (202, [math.nan] * 16, 1), (203, [math.inf] + [0.0] * 15, 2),
             (None, [0.25] * 16, None), (3, rows[3][1], 1), (3, [0.125] * 16, 2), (204, [1.0] * 7, 2), (205, [], 7)]
    rng.shuffle(rows)
    assert coded(spark, rows) == sorted(codes_by_hand([(i, v and [x if x is None else float(np.float32(x)) for x in v], n)
                                                       for i, v, n in rows]), key=repr)


def test_codes_of_large_numbers_few_vectors_and_none(spark):
    schema = VECTORS.replace("float", "double")
    rows = [(i, [x * 1e7 * (j - 5) + i for j in range(16)], 1) for i, x in enumerate([1.0, 2.5, -3.0, 1e3, 7.0])]
    assert coded(spark, rows, schema) == sorted(codes_by_hand(rows), key=repr)
    huge = [(1, [1e300] * 8, 1), (2, [0.0] * 8, 1), (3, [1.0] * 8, 2)]
    found = coded(spark, huge, schema)
    assert [r[1] for r in found] == ["00" * 8, "01" * 8, "02" * 8] and found[0][2] == 0
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_orchard_search_equals_full_search_with_fewer_distances():
    rng = np.random.default_rng(2)
    for scale, near in ((5, 10), (4000, 300)):
        entries = rng.integers(-scale, scale, (16, 8))
        entries[5], entries[9] = entries[2], entries[0]
        points = entries[rng.integers(0, 16, 3000)] + rng.integers(-near, near, (3000, 8))
        search = vector_codes.NeighbourLists(entries)
        at, best = search.nearest(points)
        full = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
        assert scale == 5 or search.measured < 0.7 * full.size


def test_codes_equal_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert differences(spark, connect(sf), LLM_QUERIES["op11_vector_codes"], LLM_ORACLE["op11_vector_codes"], sf) == []


# --- SimHash groups ------------------------------------------------------------------------

def print_by_hand(text):
    w = lowered(text)
    shingles = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups_by_hand(values):
    """First index of the group of each value, comparing all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def simhash_by_hand(rows):
    prints = [print_by_hand(t) for _, t in rows]
    different = sorted(set(prints))
    group = dict(zip(different, groups_by_hand(different)))
    low = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[group[p]] = min(low.get(group[p], i), i)
    return sorted(((i, f"{p:016x}", low.get(group[p])) for (i, _), p in zip(rows, prints)), key=repr)


def simhash_rows(spark, rows):
    return sorted((tuple(r) for r in simhash_trees.simhash_groups(frame(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("nodes", [simhash_trees.SHARD_NODES, 12])
def test_simhash_groups_equal_all_pairs(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash_trees, "SHARD_NODES", nodes)  # 12: shards of shards
    rows, rng = corpus(6), random.Random(7)
    base = words(rng, 400)
    for k in range(60):  # a chain of near copies
        base[rng.randrange(400)] = f"new{k}"
        rows.append((2000 + k, " ".join(base), "en", "s", 1, 1, 1, "x"))
    rows += [(None, rows[0][1], "en", "s", 1, 1, 1, "x"), (rows[3][0], "a text of its own", "en", "s", 1, 1, 1, "x"),
             (None, "alone here", "en", "s", 1, 1, 1, "x"), (None, "alone here", "en", "s", 1, 1, 1, "x")]
    found = simhash_rows(spark, rows)
    assert found == simhash_by_hand([r[:2] for r in rows])
    assert len({r[2] for r in found}) < len(found) - 40


def test_simhash_of_test_tables_and_of_nothing(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in LLM_QUERIES["op12_simhash_groups"](spark, SF).collect()), key=repr)
    assert found == simhash_by_hand(docs)
    assert simhash_rows(spark, []) == []
    empty = [(5, None, "", "", 1, 1, 1, "x"), (4, " \t", "", "", 1, 1, 1, "x")]
    assert simhash_rows(spark, empty) == [(4, "0" * 16, 4), (5, "0" * 16, 4)]


def test_tree_finds_every_pair_once():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:30]:
        for _ in range(6):
            values.append(values[-1] ^ 1 << rng.randrange(64) if rng.random() < .5 else v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values = sorted(set(values))
    tree = simhash_trees.BKTree(np.array(values, np.uint64))
    found = sorted((a, b) for a, near in tree.pairs_within(3) for b in near.tolist())
    assert found == [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3]


def test_finer_masks_keep_near_pairs_together():
    rng, mask = random.Random(1), 0
    for _ in range(simhash_trees.ROUNDS):
        masks = simhash_trees.finer_masks(mask)
        for _ in range(300):
            wrong = rng.sample([b for b in range(64) if not mask >> b & 1], 3)
            assert any(not any(m >> b & 1 for b in wrong) for m in masks)
        mask = rng.choice(masks)
    assert 64 - mask.bit_count() <= 8


# --- periodic runs -----------------------------------------------------------------------

def runs_by_hand(w):
    """Every lag, every stretch."""
    found, known = {}, {}
    x = np.array([known.setdefault(v, len(known)) for v in w], np.int64)
    for q in range(1, len(w) // 3 + 1):
        edges = np.diff(np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(int))
        for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)  # smaller periods come first
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_report(doc_id, text, change=False):
    w = split(text)
    h = zlib.crc32(str(doc_id).encode())
    if change and h % 10 == 0 and w:
        a, g = (h // 10) % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = runs_by_hand(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    collapsed = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    return len(w), runs, best, collapsed


def test_runs_of_random_words_equal_brute_force():
    rng, texts = random.Random(11), []
    for trial in range(300):
        letters = rng.choice((1, 2, 3, 6, 40))
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.choice((0, 5, 23, 24, 60, 150, 400)))]
        for _ in range(rng.randrange(4)):
            unit = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 16, 17, 40)))]
            at, n = rng.randrange(len(w) + 1), rng.randrange(2 * len(unit), 6 * len(unit) + 30)
            w[at:at] = [unit[i % len(unit)] for i in range(n)]
        texts.append(w)
    found = periodic_runs.runs_of(texts)
    assert found == [runs_by_hand(w) for w in texts]
    assert sum(map(len, found)) > 300


def test_runs_of_rows(spark):
    rng = random.Random(2)
    loop = " ".join(words(rng, 9) * 5)
    texts = [None, "", " \n", "a " * 23, "a " * 24, loop, f"x {loop} y\n{loop}", "a b " * 12 + "c " + "a b " * 30, " ".join(words(rng, 15_000)),
             "é\x1c ü " * 20, " ".join(f"q{i % 2500}" for i in range(15_000)), " ".join(rng.choice("ab") for _ in range(3000))]
    rows = [(i, t, "en", "s", 1, 1, 7, "x") for i, t in enumerate(texts)] + [(None, loop, "", "", 1, 1, 1, "x"), (5, loop, "", "", 1, 1, 1, "x")]
    found = periodic_runs.periodic_runs(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in found), key=repr)
    assert got == sorted(((r[0], *runs_report(*r[:2])) for r in rows), key=repr)
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_runs_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        _, runs, best, collapsed = runs_report(doc_id, text, change=True)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[doc_id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())
    found = {r[0]: tuple(r)[1:] for r in LLM_QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert found == want and sum(v[0] > 0 for v in want.values()) > 5
