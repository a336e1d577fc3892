"""Token files and packing: round trips against the tokenizer."""

import math
import random
import sys
import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from llm_data import corpus, frame  # noqa: E402
from seriesloom.llm import common, encoding, packing, token_files  # noqa: E402
from seriesloom.llm.encoding import WordEncoder, default_tokenizer  # noqa: E402
from seriesloom import storage  # noqa: E402

PATH = default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


ENCODER = WordEncoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé ÜßİΣ.,'’s\n\t\x1ć<|>0½#_ſ"), st.characters()), max_size=60))
def test_words_encode_like_whole_texts(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert ENCODER.ids(text).tolist() == whole_ids(text)


def test_memory_for_words_is_bounded(monkeypatch):
    """Few words are kept, those in use among them, and long ones are not; the ids stay the same."""
    monkeypatch.setattr(encoding, "CACHED_WORDS", 40)
    rng, words = random.Random(5), WordEncoder(PATH)
    for i in range(300):
        text = " ".join(["often", "Often,", "x" * 150, "語" * 120, *(f"w{rng.randrange(10 ** 6)}" for _ in range(10))])
        assert words.ids(text).tolist() == whole_ids(text)
        assert len(words) + len(words.older) <= 2 * (40 + 40)
    kept = words.keys() | words.older.keys()
    assert {"often", "Often,"} <= kept and max(map(len, kept)) <= encoding.LONGEST_CACHED


def test_texts_encoded_together_look_up_each_word_once(monkeypatch):
    """Ids as one by one, in slices of few words too; a word that is frequent in the texts costs one look-up."""
    looked_up = []

    class Counted(WordEncoder):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    rng = random.Random(8)
    texts = ["out", None, "", "\n", "Often, OFTEN often ", *(
        " ".join(rng.choice(["often", "é-É", "ÜBER", "über###", "don't", "a_b", "x2", "½", "_", "İΣ", "<|x|>", "\tz\n", "語"])
                 for _ in range(rng.randrange(60))) for _ in range(50)), None, ""]
    found, ends = Counted(PATH).all_ids(pa.array(texts).slice(1))
    assert [i.tolist() for i in np.split(found, ends)] == [whole_ids(t) for t in texts[1:]] + [[]]
    assert looked_up.count("over") == 0 and looked_up.count("often") <= 4 and looked_up.count("don't") == 1
    monkeypatch.setattr(encoding, "LOOKUP_WORDS", 3)
    monkeypatch.setattr(encoding, "CACHED_WORDS", 4)
    words = WordEncoder(PATH)
    again, _ = words.all_ids(pa.array(texts).slice(1))
    assert again.tolist() == found.tolist() and len(words) + len(words.older) <= 2 * (4 + 3 * 3)
    none, ends = words.all_ids(pa.array([], pa.string()))
    assert len(none) == len(ends) == 0


def test_a_batch_of_texts_is_held_once():
    """Slices as before, and no Python copy of the whole batch."""
    texts = ["", None, *(chr(97 + i % 26) * 1_000_000 for i in range(40)), "é", None]
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    tracemalloc.start()
    found, sizes = [], []
    for part, some in common.text_chunks([batch, batch.slice(0, 0)]):
        assert [t or "" for t in part.column("text").to_pylist()] == [t.decode() for t in some]
        found += map(len, some)
        sizes.append(sum(map(len, some)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [len((t or "").encode()) for t in texts[1:]]
    assert sizes == [2_000_000] * 20 + [2]
    assert peak < 20_000_000


def test_token_files_round_trip(spark):
    rows = corpus()
    rows += [(None, "no id", "en", "s", 1, 0, 1, "x"), rows[0]]
    manifest = token_files.write_token_files(frame(spark, rows), PATH, length=64)
    found = token_files.read_token_files(manifest).orderBy("start").collect()
    expected, start = [], 0
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole_ids(row[1])
        expected.append((row[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in found] == expected


def test_sequences_are_views_with_masks(spark):
    manifest = token_files.write_token_files(frame(spark, corpus(), 1).coalesce(1), PATH, length=32).collect()
    for shard in manifest:
        reader = token_files.ShardReader(shard.path)
        valid = 0
        for i in range(shard.n_sequences):
            tokens, mask = reader.sequence(i)
            assert len(tokens) == len(mask) == 32 and not tokens.flags.owndata
            assert mask.all() or i == shard.n_sequences - 1
            valid += mask.sum()
        assert valid == shard.n_tokens


def test_token_files_of_an_empty_table(spark):
    manifest = token_files.write_token_files(frame(spark, []), PATH)
    assert token_files.read_token_files(manifest).collect() == []


def check_packing(pieces, capacity):
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packed_documents(spark):
    rows = corpus() + [(None, None, "en", "s", 1, 0, 1, "x")]
    pieces = packing.pack_documents(frame(spark, rows), PATH, capacity=256).collect()
    check_packing(pieces, 256)
    ids = {r[0]: whole_ids(r[1]) for r in rows}
    for r in pieces:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == 256 * r.piece and len(part) == r.length and crc(part) == r.ids_crc32
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))


def test_texts_reach_the_tasks_in_small_batches(spark):
    """The stage that reads the texts gets few rows at a time, however many a task has; settings are as before then."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([1] * len(batch)), pa.array([len(batch)] * len(batch))], names=["length", "n"])

    before = {key: spark.conf.get(key) for key in storage._BATCH_ROWS}
    pieces = spark.range(0, 1300, 1, 1).mapInArrow(sizes, "length long, n long")
    found = packing.pack_pieces(pieces, 100)
    assert {key: spark.conf.get(key) for key in storage._BATCH_ROWS} == before
    rows = found.collect()
    assert len(rows) == 1300 and check_packing(rows, 100) == 13 and max(r.n for r in rows) <= 500


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_every_piece_once_and_is_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 50, 100))
    low = rng.choice((1, capacity // 5 + 1, capacity // 2))
    counts = {n: rng.randrange(1, 30) for n in range(low, capacity + 1) if rng.random() < 0.5} or {low: 3}
    plan = packing.Planner(counts, capacity)
    fill: dict[int, list] = {}
    placed = {n: set() for n in counts}
    for s in plan.plan():
        for k in range(s.n * s.per_bin):
            placed[s.length].add(s.rank + k)
            fill.setdefault(s.first + k // s.per_bin, []).append((s.offset + k % s.per_bin * s.length, s.length))
    assert {n: len(p) for n, p in placed.items()} == counts
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    least = math.ceil(sum(n * c for n, c in counts.items()) / capacity)
    assert least <= len(fill) <= 11 * max(least, sum(c for n, c in counts.items() if 2 * n > capacity)) / 9 + 4


def optimum(items, capacity):
    best = [len(items)]

    def search(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                search(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        search(i + 1, bins)
        bins.pop()

    search(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_fixed_sets_are_part_of_an_optimum(seed):
    rng = random.Random(100 + seed)
    items = sorted((rng.randrange(3, 21) for _ in range(8)), reverse=True)
    plan = packing.Planner({n: items.count(n) for n in set(items)}, 20)
    plan.reduce()
    left = [n for n in range(20, 0, -1) for _ in range(int(plan.left[n]))]
    assert plan.n_fixed + optimum(left, 20) == optimum(items, 20)
