"""Whole texts to token ids with the tokenizers library, words at a time.

A byte-level vocabulary splits texts into pieces before merging, and a piece never reaches across a space
that a visible character follows. So a text is cut before such spaces, each distinct cut goes through the
library's merges once, and the ids are joined. A cut of letters with punctuation at its end is two pieces;
the library itself splits all others. Texts with other uses of the space, and vocabularies of another
kind, go to the library whole.
"""

from __future__ import annotations

import json
import os
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer words are encoded again each time, so that the cache stays small.
_LONGEST_CACHED = 64
#: Characters that make one piece at the end of a word of letters.
_TAIL = ".,;:!?%$#*&|()[]{}\"-/<>=+~^@_"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 stands for itself, the others
    follow from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes batches of texts; keeps the ids of the first cache_words distinct words."""

    def __init__(self, vocabulary_json: str, cache_words: int = 600_000):
        # A task has one core: threads of the library would only wait for those of other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary_json)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges, self.cut_before = self.library.model, self.library.pre_tokenizer
        self.letters = _byte_letters()
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        made = json.loads(vocabulary_json)
        cutting = made.get("pre_tokenizer") or {}
        self.by_words = (
            made["model"]["type"] == "BPE" and not made.get("normalizer") and cutting.get("type") == "ByteLevel"
            and cutting.get("use_regex", True) and not cutting.get("add_prefix_space")
        )

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            letters = piece.replace(" ", self.letters[0x20])
        else:
            letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a space and a word, which is not empty and does not begin with white space."""
        if word.isalpha():
            return self._piece(" " + word)
        core = word.rstrip(_TAIL)
        if core.isalpha():
            tail = word[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._piece(tail)
            return (self.words.get(core) or self._piece(" " + core)) + self.tails[tail]
        return array("I", [t.id for piece, _ in self.cut_before.pre_tokenize_str(" " + word) for t in self.merges.tokenize(piece)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end; null is empty.

        Arrow cuts the texts and numbers their distinct words, so that Python sees each word once a batch.
        """
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ") if self.by_words else pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        first = parts.offsets.to_numpy()
        flat = parts.values.slice(first[0], first[-1] - first[0])
        first = (first - first[0]).astype(np.int64)
        is_head = np.zeros(len(flat), dtype=bool)
        is_head[first[:-1]] = True
        heads = self._whole(flat.filter(pa.array(is_head)).to_pylist())
        numbered = flat.filter(pa.array(~is_head)).dictionary_encode()
        entries, odd = [], []
        cached, rest = self.words.get, {}
        for at, word in enumerate(numbered.dictionary.to_pylist()):
            ids = cached(word) or self._fresh(word, rest)
            if not ids:
                odd.append(at)
            entries.append(ids)
        entry = np.empty(len(flat), dtype=np.int32)
        entry[is_head] = len(entries) + np.arange(len(texts))
        entry[~is_head] = numbered.indices.to_numpy()
        if odd:  # a space ends these texts or precedes white space: the library gets them whole
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            for at in np.unique(owner[~is_head & np.isin(entry, odd)]).tolist():
                heads[at] = self._whole([texts[at].as_py()])[0]
                entry[first[at] + 1 : first[at + 1]] = len(entries) + len(texts)
        table = [*entries, *heads, b""]
        sizes = np.array([len(x) for x in table], dtype=np.int32) // 4  # a batch has fewer than 2**31 ids
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        blob = np.frombuffer(b"".join(table), dtype="<u4")
        own = sizes[entry]
        ends = np.cumsum(own, dtype=np.int32)
        ids = blob[np.repeat(starts[entry] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        return ids, np.concatenate(([0], ends)).astype(np.int64)[first]

    def _fresh(self, word: str, rest: dict[str, bytes]) -> bytes:
        """The ids of a new word, which is kept; none for what is no word."""
        if not word or word[0].isspace():
            return b""
        ids = self._word(word)
        if len(self.words) < self.cache_words and len(word) <= _LONGEST_CACHED:
            self.words[word] = ids
        else:
            rest[word] = ids
        return ids


def gathered(batches: Iterator[pa.RecordBatch], least_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about least_bytes from smaller ones: the more texts at once, the fewer words are looked up."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoder(vocabulary_json: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary.

    It is kept in a module of its own: functions travel by value, and their globals end with the task.
    """
    kept = sys.modules.setdefault("lamina_worker_state", types.ModuleType("lamina_worker_state")).__dict__
    key = f"encoder {hash(vocabulary_json)}"
    if key not in kept:
        kept[key] = WordEncoder(vocabulary_json)
    return kept[key]


def vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver; executors get it with the task."""
    with open(path, encoding="utf-8") as file:
        return file.read()
