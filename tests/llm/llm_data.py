"""Small tables with nulls, empties, ties, copies and clashing names, and brute-force forms."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, id long, starts string"


def words(rng: random.Random, n: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{rng.randrange(5000)}" for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Rows: fresh texts, exact and near copies, shared passages, nulls, empties, a long text, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.choice((3, 8, 13, 20, 60, 150)))) for _ in range(60)]
    base = words(rng, 120)
    for _ in range(25):  # more near copies than a bucket lists pairs for
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    small = words(rng, 24)
    for k in range(14):
        texts.append(" ".join(small[:24 - k % 2]) + "\n" * (k % 3))
    passage = " ".join(words(rng, 60))
    texts += [f"{' '.join(words(rng, 30))}\n{passage} {' '.join(words(rng, 10 + i))}" for i in range(6)]
    texts += [None, "", "   \t\n", "one", "One\x0btwo", "é Ü ß\x1cx ’s don't", " ".join(words(rng, 20_000))]
    texts += texts[:5] + texts[60:63]
    rows = [(i, t, "en", "s", len(t or ""), 1, 7, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts: int = 5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> frozenset:
    w = lowered(text)
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def kept_words(rows: list[tuple[int, str | None]]) -> dict[int, list[bytes]]:
    """doc_id -> words left after removing windows that start in a smaller document."""
    first: dict[tuple, int] = {}
    ordered = sorted((i, split(t)) for i, t in rows)
    for i, w in ordered:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    out = {}
    for i, w in ordered:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out
