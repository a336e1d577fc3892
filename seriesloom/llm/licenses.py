"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are turned into words; the hashes of their ``GRAM``-word runs are winnowed (the smallest of
every ``WINDOW`` neighbours is kept) into an inverted index hash -> (template, position). A document is
winnowed alike; each shared fingerprint votes for a template and a diagonal (position in the
document minus position in the template). Around every voted diagonal the template is aligned with
the document inside a band, and a match is reported if enough of the template's words are found in order.

Templates are the query side: a bounded list that goes to every task, its size checked. Documents
are scanned where they are; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import WordHashes, gram_hashes, text_chunks

GRAM, WINDOW = 3, 3
# Half width of the alignment band, and the share of a template's words that must be found.
BAND = 8
MIN_COVERAGE = 0.8
# Most words of all templates together; beyond it the list must be scanned in parts.
MAX_TEMPLATE_WORDS = 2_000_000

# Short statements and opening paragraphs of common licenses.
TEMPLATES = {
    "MIT/statement": "Released under the MIT License.",
    "MIT/notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software",
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                      "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                      "the License, or (at your option) any later version.",
    "BSD/notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:",
    "ISC/notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0/statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0/statement": "Dedicated to the public domain under CC0 1.0.",
}

_CHUNK = re.compile(rb"[^\x20\x09-\x0D]+")
_ENDS = bytes(b for b in range(128) if not chr(b).isalnum())


def normal(word: bytes) -> bytes:
    """A word in lower case without the punctuation around it."""
    return word.lower().strip(_ENDS)


def words_of(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text and their byte spans; chunks of punctuation alone are no words."""
    found = [(normal(m[0]), m.span()) for m in _CHUNK.finditer(text)]
    return [w for w, _ in found if w], [s for w, s in found if w]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the grams that are smallest, rightmost on ties, in some window."""
    if len(grams) <= WINDOW:
        return np.flatnonzero(grams == grams.min())[-1:] if len(grams) else np.zeros(0, np.int64)
    n = len(grams) - WINDOW + 1
    best, at = grams[:n], np.arange(n)
    for i in range(1, WINDOW):
        smaller = grams[i:n + i] <= best
        best, at = np.where(smaller, grams[i:n + i], best), np.where(smaller, np.arange(n) + i, at)
    return np.unique(at)


def banded_alignment(template: list[bytes], words: list[bytes], start: int, band: int) -> tuple[int, int, int]:
    """(template words found, first word, end word) of the best alignment near ``start``.

    A longest common subsequence whose path stays within ``band`` words of the diagonal.
    """
    n = len(template)
    width = 2 * band + 1
    # best (matches, -first, end) by offset from the diagonal
    row = [(0, 0, -1)] * width
    for i in range(n):
        new: list[tuple[int, int, int]] = []
        for d in range(width):
            at = start + i + d - band
            best = row[d + 1] if d + 1 < width else (0, 0, -1)
            if d and new[d - 1] > best:
                best = new[d - 1]
            if 0 <= at < len(words) and words[at] == template[i]:
                matches, first, end = row[d]
                extended = (matches + 1, first if matches else -at, at + 1)
                best = max(best, extended)
            new.append(best)
        row = new
    matches, first, end = max(row)
    return matches, -first, end


class TemplateIndex:
    """Inverted index of winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.words = {name: words_of((text or "").encode())[0] for name, text in templates.items()}
        if sum(map(len, self.words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError("too many templates for one scan; scan them in parts")
        self.hashes = WordHashes(normal=normal)
        self.empty = self.hashes[b""]
        # every gram is indexed: what a document keeps of a template is found wherever it starts
        entries = sorted((gram, name, at) for name, words in self.words.items()
                         for at, gram in enumerate(gram_hashes(self.hashes.of(words), GRAM).tolist()))
        self.grams = np.array([gram for gram, _, _ in entries], np.uint64)
        self.places = [(name, at) for _, name, at in entries]

    def candidates(self, text: bytes) -> dict[str, set[int]]:
        """Diagonals (position in the document minus position in the template) by template."""
        hashes = self.hashes.of(text.split())
        grams = gram_hashes(hashes[hashes != self.empty], GRAM)
        kept = winnow(grams)
        diagonals: dict[str, set[int]] = defaultdict(set)
        low, high = (np.searchsorted(self.grams, grams[kept], side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):
            for name, inside in self.places[low[i]:high[i]]:
                diagonals[name].add(int(kept[i]) - inside)
        return diagonals

    def matches(self, text: bytes, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple]:
        """(template, coverage, matched words, first byte, end byte), in the order of the text.

        Where matches overlap, the one with the higher coverage stays, then the longer one.
        """
        diagonals = self.candidates(text)
        if not diagonals:
            return []
        words, spans = words_of(text)
        out = []
        for name, starts in diagonals.items():
            template, until = self.words[name], -1
            last = None
            for start in sorted(starts):
                if last is not None and start - last <= band // 2:
                    continue  # inside the band of the diagonal just aligned
                last = start
                matched, first, end = banded_alignment(template, words, start, band)
                if matched >= min_coverage * len(template) and first >= until:
                    until = end
                    out.append((name, matched / len(template), matched, spans[first][0], spans[end - 1][1]))
        kept: list[tuple] = []
        for m in sorted(out, key=lambda m: (-m[1], -m[2], m[3], m[0])):
            if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[3])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per template found in a document: ``doc_id, template, coverage, matched_words, start, end``.

    ``start`` and ``end`` are bytes of the UTF-8 text, ``coverage`` the share of the template's words found.
    Documents without a match, with a null or an empty text give no row; repeated rows give
    repeated results; other columns are ignored.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    names = ["doc_id", "template", "coverage", "matched_words", "start", "end"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts)
                    for m in index.matches(text, band, min_coverage)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, template string, coverage double, matched_words long, start long, end long")
