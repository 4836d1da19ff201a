"""Word-cached encoding of whole texts with a public tokenizer file.

Every pre-token of the vocabulary used here lies between two white-space
characters, so the ids of a text are the ids of its white-space separated
chunks, one after another.  Chunks repeat far more often than texts do, so each
Python worker keeps the ids of the chunks it has met, and only asks the tokenizers
library for new ones.  The cache is emptied when it reaches a fixed number of entries or characters;
that changes time, never ids.  A file whose normaliser or pre-tokenizer is not the known one is left to the library,
text by text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .words import HELD

CACHE_ENTRIES, CACHE_CHARACTERS = 1_200_000, 32_000_000
# How a vocabulary file divides texts that can be encoded chunk by chunk.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Characters that the pattern below and the library's own see alike.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]*")
_PLAIN_TEXT = re.compile("[\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]*")
#: Fixed value: the pre-token pattern of the vocabulary, for lower-cased plain characters.
_PLAIN_PRETOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+"
)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: str.split() also splits at these four, which are no white space to the library.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_GAPS = re.compile("[^\\S\x1c-\x1f]+")


def _chunks_of(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [x for x in _GAPS.split(text) if x]
    return text.split()


class _Chunks(dict):
    """Ids by chunk; a new chunk gets an empty bytearray, to be filled, and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> bytes | bytearray:
        if chunk.isascii() and "<" not in chunk:
            # The vocabulary is lower case, and a last stop or comma is a pre-token of its own.
            low = chunk.lower()
            known = self.get(low)
            if known:
                self[chunk] = known
                return known
            if low[-1] in ".," and low[:-1].isalpha():
                stem, stop = self.get(low[:-1]), self.get(low[-1])
                if stem and stop:
                    self[chunk] = ids = bytes(stem) + bytes(stop)
                    return ids
        self[chunk] = ids = bytearray()
        self.new.append(chunk)
        return ids


class WordCachedTokenizer:
    """Encodes texts to uint16 ids; equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        # The library's threads would spin between the many small calls; Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._cap = cache_entries
        ends = [i for w, i in self._tok.get_vocab().items() if w.endswith("</w>")]
        self._ends = np.zeros(1 << 16, bool)
        self._ends[ends] = True
        self._chunks = _Chunks()
        self._characters = 0
        if self._tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        with open(path, encoding="utf-8") as f:
            of = json.load(f)
        self.by_chunks = of["normalizer"] == NORMALIZER and of["pre_tokenizer"] == PRE_TOKENIZER and of["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in of["added_tokens"])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint16).tobytes() for e in found]

    def _encode_plain(self, chunks: list[str]) -> list[bytes]:
        """The same for chunks of plain characters, many to a text.

        The last id of every pre-token marks a word's end, so a chunk's ids end with as
        many marks as it has pre-tokens.
        """
        out: list[bytes] = []
        groups = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
        for group, found in zip(groups, self._tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=np.uint16)
            marks = np.flatnonzero(self._ends[ids]) + 1
            many = np.cumsum([len(x) for x in map(_PLAIN_PRETOKEN.findall, "\n".join(group).lower().split("\n"))])
            if len(marks) != many[-1]:
                out += self._encode(group)
                continue
            raw, at = ids.tobytes(), (2 * marks[many - 1]).tolist()
            out += [raw[a:b] for a, b in zip([0, *at], at)]
        return out

    def _learn(self, new: list[str]) -> None:
        odd: list[str] = []
        plain = new
        self._characters += sum(map(len, new))
        text = " ".join(new)
        if "<|" in text or not _PLAIN_TEXT.fullmatch(text):
            plain = [w for w in new if _PLAIN.fullmatch(w) and "<|" not in w]
            odd = list(set(new).difference(plain))
        chunks = self._chunks
        for words, ids in ((plain, self._encode_plain(plain)), (odd, self._encode(odd))):
            for w, x in zip(words, ids):
                chunks[w][:] = x
            chunks.update(zip(words, ids))  # bytes are smaller than the bytearrays that the group below still holds

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint16 ids of each text; a null text has none."""
        if not self.by_chunks:
            return self._encode([t or "" for t in texts])
        out: list[bytes] = []
        group: list[list[bytes]] = []
        n = 0
        for i, text in enumerate(texts):
            if text:
                group.append(list(map(self._chunks.__getitem__, _chunks_of(text))))
                n += len(group[-1])
            else:
                group.append([])
            if n > 200_000 or i == len(texts) - 1:
                new = self._chunks.new
                if new:
                    self._learn(new)
                    new.clear()
                out += [b"".join(x) for x in group]
                group, n = [], 0
                if len(self._chunks) > self._cap or self._characters > CACHE_CHARACTERS:
                    self._chunks.clear()
                    self._characters = 0
        return out


    def forget(self) -> None:
        """Frees the cache; workers live on after the job that filled it."""
        self._chunks, self._characters = _Chunks(), 0


_OPEN: dict[str, WordCachedTokenizer] = {}


def worker_tokenizer(path: str, cache_entries: int = CACHE_ENTRIES) -> WordCachedTokenizer:
    """One tokenizer per Python worker and vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = WordCachedTokenizer(path, cache_entries)
    _OPEN[path]._cap = cache_entries
    if _OPEN[path].forget not in HELD:
        HELD.append(_OPEN[path].forget)
    return _OPEN[path]
