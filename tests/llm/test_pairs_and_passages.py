"""Shingle join, substring dedup and decontamination against brute force."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_data import components, corpus, frame, kept_words, split, words  # noqa: E402
from seriesloom.llm import decontamination, ngram_join, substrings  # noqa: E402
from seriesloom.llm.components import connected_components  # noqa: E402
from seriesloom.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(frame(spark, rows)).collect()}
    assert found == components([r[:2] for r in rows])


def test_join_of_sizes_around_the_limits(spark):
    """Sets of every small size with exactly as many differences as the threshold allows, and one more."""
    rows, rng = [], random.Random(5)
    for n in (5, 6, 8, 9, 12, 13, 16, 20, 40, 46, 52, 55, 60, 66, 80, 140, 300):
        base = words(rng, n, f"n{n}x")
        for cut in range(0, max(2, n // 4)):
            rows.append((len(rows), " ".join(base[:n - cut]), "en", "s", 1, 1, 1, "x"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(frame(spark, rows)).collect()}
    assert found == components([r[:2] for r in rows])


def test_segments_never_miss_a_pair_that_neither_set_is_searched_again_for():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(51, 400))
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        gone = int(rng.integers(0, size // 5 + 1))
        fresh = int(rng.integers(0, size // 5 + 1))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, fresh, dtype=np.uint64)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common) or min(len(x), len(y)) <= 50:
            continue
        shared, rooms = 0, []
        for s in (x, y):
            rooms.append(min(ngram_join.room(len(s)) - ngram_join.empty_segments(s, g)
                             for g in ngram_join.schemes(len(s))))
        for g in set(ngram_join.schemes(len(x))) & set(ngram_join.schemes(len(y))):
            shared += len(np.intersect1d(ngram_join.segment_signatures(x, g), ngram_join.segment_signatures(y, g)))
        assert shared >= max(rooms)


def test_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", "s", 1, 1, 1, "x"), (3, "a b c d e f", "en", "s", 1, 1, 1, "x"),
            (2, "A B c d  e f", "en", "s", 1, 1, 1, "x"), (2, "other words", "en", "s", 1, 1, 1, "x"),
            (4, "other words", "en", "s", 1, 1, 1, "x"), (5, None, "en", "s", 1, 1, 1, "x"), (6, "", "en", "s", 1, 1, 1, "x")]
    found = sorted((tuple(r) for r in ngram_join.linked_documents(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 2, None), (3, 2, 2), (2, 2, 2), (2, 1, 2), (4, 1, 2), (5, 0, 5), (6, 0, 6)], key=str)
    kept = ngram_join.one_per_group(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "5", "6", "None"]
    assert kept.columns == frame(spark, rows).columns
    assert ngram_join.linked_documents(frame(spark, [])).collect() == []


def test_join_on_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in LLM_QUERIES["op7_ngram_join"](spark, SF).collect()}
    assert found == components([tuple(r) for r in docs])


def report_of(rows):
    kept, out = kept_words(rows), {}
    for i, text in rows:
        out[i] = (len(split(text)), len(split(text)) - len(kept[i]), hashlib.sha256(b" ".join(kept[i])).hexdigest())
    return out


@pytest.mark.parametrize("limits", [None, (40, 50, 2000)])
def test_removed_words_equal_brute_force(spark, monkeypatch, limits):
    if limits:  # many blocks, shards and copies
        for name, value in zip(("BLOCK_WORDS", "SHARD_WINDOWS", "SHARD_BYTES"), limits):
            monkeypatch.setattr(substrings, name, value)
    rows = corpus(3)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_report(frame(spark, rows)).collect()}
    assert found == report_of([r[:2] for r in rows])
    assert sum(n for _, n, _ in found.values()) > 1000


def test_removed_words_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(None, text, "en", "s", 1, 1, 1, "x"), (5, text, "en", "s", 1, 1, 1, "x"), (5, text, "en", "s", 1, 1, 1, "x"),
            (6, text + " end", "en", "s", 1, 1, 1, "x"), (7, None, "en", "s", 1, 1, 1, "x")]
    found = sorted(((r.doc_id, r.n_removed) for r in substrings.removal_report(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 0), (5, 0), (5, 0), (6, 20), (7, 0)], key=str)
    cut = substrings.without_repeats(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert got == {None: (text, len(text)), 5: (text, len(text)), 6: ("end", 3), 7: (None, None)}
    assert substrings.removal_report(frame(spark, [])).collect() == []


def test_exact_copies_and_names_of_helpers(spark):
    """Copies lose all words if they have a window; columns named like helpers keep their values."""
    long, short = " ".join(f"t{i}" for i in range(15)), " ".join(f"s{i}" for i in range(12))
    names = ["copy", "c0", "c1", "span_id", "span_hash", "copied_from", "starts", "__starts", "__id", "__hash", "last"]
    rows = [(i, t, *[i * 100 + k for k in range(len(names))]) for i, t in enumerate((long, long, short, short, long + " x", long, None, None))]
    schema = "doc_id int, text string, " + ", ".join(f"{n} long" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    cut = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert {i: r.text for i, r in cut.items()} == {0: long, 1: "", 2: short, 3: short, 4: "x", 5: "", 6: None, 7: None}
    assert all(tuple(cut[r[0]])[2:] == r[2:] for r in rows)
    assert substrings.without_repeats(docs).schema == docs.schema


def test_removed_words_on_the_test_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
             for r in LLM_QUERIES["op9_repeated_phrases"](spark, SF).collect()}
    assert found == report_of(docs)


def leaks_of(docs, items):
    from collections import Counter

    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    out = set()
    for i, text in docs:
        g = grams((text or "").lower().split())
        for item, body in items:
            w = (body or "").lower().split()
            if len(w) < 5:
                continue
            mine, n = Counter(grams(w)), len(w) - 4
            for k in range(max(1, len(g) - n + 1)):
                window = Counter(g[k:k + n])
                common = sum((window & mine).values())
                if common and common >= 0.8 * (sum(window.values()) + n - common):
                    out.add((i, item))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, n, "b"))) for k, n in enumerate((5, 6, 12, 30, 30, 45, 60))] + [(50, None), (51, "too short")]
    rows = corpus(4)[:60]
    for k, body in items[:7]:
        w = body.split()
        rows.append((1000 + k, " ".join(words(rng, 9) + w + words(rng, 5)).upper(), "en", "s", 1, 1, 1, "x"))
        w[len(w) // 2] = "edited"
        rows.append((1100 + k, " ".join(words(rng, 9) + w), "en", "s", 1, 1, 1, "x"))
        rows.append((1200 + k, " ".join(body.split()[:-1]), "en", "s", 1, 1, 1, "x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), benchmark).collect()}
    assert found == leaks_of([r[:2] for r in rows], items) and len(found) >= 12
    clean = decontamination.decontaminated(frame(spark, rows), benchmark)
    assert clean.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r[0] for r in rows} - {i for i, _ in found})
    for docs, bench in ((frame(spark, []), benchmark), (frame(spark, rows[:3]), benchmark.limit(0))):
        assert decontamination.contaminated(docs, bench).collect() == []


def test_reordered_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, n, "b"))) for k, n in enumerate((59, 59, 80, 120, 45, 30))] + [(9, " ".join(["x y z"] * 15))]
    rows = [(900, " ".join(["x y z"] * 40), "en", "s", 1, 1, 1, "x")]
    for k, body in items[:6]:
        w = body.split()
        for j, cut in enumerate((len(w) // 2, len(w) // 3, 6)):
            swapped = w[cut:] + w[:cut]
            rows.append((1000 + 10 * k + j, " ".join(words(rng, 70) + swapped + words(rng, 40)), "en", "s", 1, 1, 1, "x"))
            rows.append((2000 + 10 * k + j, " ".join(swapped), "en", "s", 1, 1, 1, "x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), benchmark).collect()}
    assert found == leaks_of([r[:2] for r in rows], items)
    assert {(1000, 0), (1010, 1), (1020, 2), (1030, 3)} <= found


def test_leaks_run_no_python(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = decontamination.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), benchmark)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(k in text for k in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("block", [ngram_join.BLOCK_SHINGLES, 700])
def test_large_group_around_the_threshold(spark, monkeypatch, block):
    """Copies with one to nine edits: some are linked, some only through others, some with nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    base, rows = words(rng, 130), []
    for i in range(90):
        copy = list(base)
        for _ in range(1 + i % 9):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((i * 3, " ".join(copy), "en", "s", 1, 1, 1, "x"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(frame(spark, rows)).collect()}
    assert found == components([r[:2] for r in rows])
    assert 3 < len({c for _, c in found.values()}) < 90
