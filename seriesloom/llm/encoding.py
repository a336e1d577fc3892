"""Token ids of whole texts with a public tokenizer file.

A tokenizer of the kind meant here drops white space and never joins across it, so the words of
a text encode independently of each other. Each Python worker therefore keeps the ids of
the words it has seen, and a text becomes a join of look-ups. Words of Latin letters, with or without
ASCII punctuation after them, go straight to the tokenizer's BPE model; every other word goes through
the whole tokenizer. Ids are the same as those of encoding the text at once (tested).
"""

from __future__ import annotations

import functools
import os
import sys
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words of a generation: a worker keeps the ids of up to two, and the older one goes when the newer is full.
CACHED_WORDS = 300_000
# Characters of the longest word whose ids are kept.
LONGEST_CACHED = 100
# Words whose ids are looked up at a time.
LOOKUP_WORDS = 100_000
# Fixed value: id appended to each document.
END_ID = 1


def _byte_letters() -> dict[int, str]:
    """Letters of a byte-level vocabulary: printable bytes are themselves, the rest follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + rest.index(b)) for b in range(256)}


def _is_latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < "ƀ" and "İ" not in word)


class WordEncoder(dict):
    """Ids per word as little-endian bytes of ``dtype``; missing words are encoded on first use.

    The memory is bounded: words used lately are kept, long ones are encoded each time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encoded(self, word: str) -> bytes:
        stem = word.rstrip(punctuation)
        if not _is_latin(stem):
            return self._whole(word)
        lower = stem.lower()
        if lower != word:
            ids = self[lower]
            return ids if len(stem) == len(word) else ids + self[word[len(stem):]]
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(word) <= LONGEST_CACHED:
            self[word] = ids
        return ids

    def _make_room(self) -> None:
        if len(self) > CACHED_WORDS:
            self.older = self.copy()
            self.clear()

    def ids(self, text: str, end_id: int | None = END_ID) -> np.ndarray:
        """Ids of ``text`` followed by ``end_id``."""
        self._make_room()
        found = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if end_id is not None:
            found += np.array([end_id], self.dtype).tobytes()
        return np.frombuffer(found, self.dtype)

    def all_ids(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) in a row, ``end_id`` after each, and where those of each text end.

        Arrow splits the texts and finds the distinct words, and only these become Python objects.
        """
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        parts, sizes = [], [np.zeros(0, np.int64)]
        for first in range(0, len(words.dictionary), LOOKUP_WORDS):
            self._make_room()
            found = list(map(self.__getitem__, words.dictionary.slice(first, LOOKUP_WORDS).to_numpy(zero_copy_only=False)))
            parts.append(b"".join(found))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize)
        spelled, size = np.frombuffer(b"".join(parts), self.dtype), np.concatenate(sizes)
        at = words.indices.to_numpy()
        n = size[at]
        before = np.append(0, np.cumsum(n))
        ids = spelled[np.arange(before[-1]) + np.repeat((np.cumsum(size) - size)[at] - before[:-1], n)]
        ends = before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one per Python worker."""
    return WordEncoder(path)


def release_encoders() -> None:
    """Word ids that earlier tasks left in this Python worker go: other operators' tasks need the memory."""
    module = sys.modules.get("seriesloom.llm.encoding")  # workers may lack this package, and then keep nothing
    if module is not None:
        module.encoder.cache_clear()


def default_tokenizer() -> str:
    """Path of the tokenizer file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
