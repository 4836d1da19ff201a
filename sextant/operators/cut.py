"""Documents cut into passages, their wanted grams counted and the texts that they contain looked for: one pass over each document.

Texts are looked at as UTF-8 bytes, all of a few megabytes at once.  A passage is a number of a document's words, joined by single
spaces; its text is made only where a sought one may be in it, and no text leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .counts import WantedGrams

#: Bytes of text that a task looks at at a time (more, if one document is longer).
_HELD_TEXT = 4_000_000
#: What a byte can be of: a token, its first character, a blank between words, a dot.
_TOKEN, _HEAD, _BLANK, _DOT = 1, 2, 4, 8
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_CLASSES = bytes(_TOKEN | _HEAD if b in _UPPER + _LOWER + b"0123456789" else _TOKEN if b in b"-()" else _TOKEN | _DOT if b in b"." else _BLANK if b in b" \t\n\r\f" else 0 for b in range(256))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
#: Characters beyond ASCII whose lower case has one of a token's characters; the paragraph sign is one itself.
_LOWERED = {"K".encode(): b"k", "İ".encode(): "i̇".encode()}
_SECTION = "§".encode()


def _classes(data: bytes) -> np.ndarray:
    c = np.frombuffer(data.translate(_CLASSES), np.uint8)
    if _SECTION in data:
        c = c.copy()
        for m in re.finditer(_SECTION, data):
            c[m.start() : m.end()] = _TOKEN | _HEAD
    return c


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; the first and the last are false."""
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return at[::2], at[1::2]


def _words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _runs((c & _BLANK) == 0)


def _tokens(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of `functions.text.TOKEN_PATTERN`, without the dots at their ends."""
    start, end = (x.copy() for x in _runs((c & _TOKEN).view(bool)))
    odd = np.flatnonzero((c[start] & _HEAD) == 0)
    for _ in range(4):
        start[odd] += 1
        odd = odd[((c[start[odd]] & _HEAD) == 0) & (start[odd] < end[odd])]
    if len(odd):
        heads = np.append(np.flatnonzero(c & _HEAD), len(c))
        start[odd] = heads[np.searchsorted(heads, start[odd])]
    there = start < end
    start, end = start[there], end[there]
    end -= (c[end - 1] & _DOT) > 0
    odd = np.flatnonzero(c[end - 1] & _DOT)
    if len(odd):
        others = np.flatnonzero((c & (_TOKEN | _DOT)) == _TOKEN)
        end[odd] = others[np.searchsorted(others, end[odd]) - 1] + 1
    return start, end


def _places(data: bytes, start: np.ndarray, end: np.ndarray, of: pa.Array) -> np.ndarray:
    """The place of each span of the data in a list of bytes, -1 where it is none of them."""
    bounds = np.empty(2 * len(start) + 1, np.int32)  # spans and what is between them
    bounds[0:-1:2], bounds[1::2], bounds[-1] = start, end, len(data)
    spans = pa.Array.from_buffers(pa.binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return pc.fill_null(pc.index_in(spans, value_set=of), -1).to_numpy()[::2]


class SoughtTexts:
    """Texts (id, text) by a word, the anchor, that a passage with the text has to have."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        by: dict[bytes, list[tuple[str, bytes]]] = {}
        for i, text, anchor in rows:
            by.setdefault(anchor.encode(), []).append((i, text.encode()))
        self.anchors, self.texts = list(by), list(by.values())
        self.sizes = np.zeros(max(map(len, by), default=0) + 2, bool)
        self.sizes[[len(a) for a in by]] = True

    def within(self, data: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[list[str]]:
        """Ids of the texts in each passage, from the words' bounds and the number of each passage's first word."""
        found: list[list[str]] = [[] for _ in first]
        if not self.anchors:
            return found
        some = np.flatnonzero(self.sizes[np.minimum(end - start, len(self.sizes) - 1)])
        anchor = _places(data, start[some], end[some], pa.array(self.anchors, pa.binary()))
        passage = np.searchsorted(first, some[anchor >= 0], side="right") - 1
        last = np.append(first[1:], len(start)) - 1
        for p, a in np.unique(np.stack([passage, anchor[anchor >= 0]]), axis=1).T.tolist():
            text = b" ".join(data[b:e] for b, e in zip(start[first[p] : last[p] + 1].tolist(), end[first[p] : last[p] + 1].tolist()))
            found[p] += [i for i, sought in self.texts[a] if sought in text]
        return found


def _joined(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts with a line feed before and after each, and where each begins, with the end."""
    lines = pc.binary_join_element_wise(texts, "\n", "")
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    return b"\n" + lines.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes(), at - at[0] + 1


def _passages(dids: list[str], texts: pa.Array, wanted: WantedGrams, vocabulary: pa.Array, sought: SoughtTexts, size: int) -> pa.RecordBatch:
    data, at = _joined(texts)
    c = _classes(data)
    start, end = _words(c)
    of = np.searchsorted(start, at)  # each document's first word
    many = -(-np.diff(of) // size)
    doc = np.repeat(np.arange(len(dids)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = of[doc] + nth * size
    low, begins = data, start
    for upper, lower in _LOWERED.items():
        low = low.replace(upper, lower)
    if low is not data:
        c = _classes(low)
        begins = _words(c)[0]
    low = low.translate(_TO_LOWER)
    token, token_end = _tokens(c)
    sizes = np.diff(np.append(np.searchsorted(token, begins[first]), len(token)))
    bounds, terms, tfs = wanted.count_numbers(_places(low, token, token_end, vocabulary), sizes)
    labels = sought.within(data, start, end, first)
    names = [dids[d] for d in doc.tolist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{d}_{k}" for d, k in zip(names, nth.tolist())], pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int32()),
            pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(tfs, pa.int32())), pa.array(labels, pa.list_(pa.string())),
        ],
        names=["doc_id", "did", "n_tokens", "terms", "tfs", "labels"],
    )


def cut_and_count(documents: DataFrame, size: int, wanted: list[tuple[str, int]], sought: list[tuple[str, str, str]]) -> DataFrame:
    """doc_id, did, n_tokens, terms, tfs, labels of the passages of `size` words of each document (did, text).

    `wanted` are grams with their orders, which terms name by their places; `sought` are texts (id, text, anchor), of which labels has those that the passage
    contains.  Both go to all workers.  Nulls have no passages.
    """
    sent = documents.sparkSession.sparkContext.broadcast((WantedGrams(wanted), SoughtTexts(sought)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, texts = sent.value
        vocabulary = pa.array([t.encode() for t in grams.vocabulary], pa.binary())
        for b in batches:
            before = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))])
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(before, before[at] + _HELD_TEXT, side="right")) - 1)
                part = b.slice(at, end - at)
                yield _passages(part.column("did").to_pylist(), part.column("text"), grams, vocabulary, texts, size)
                at = end

    return documents.select("did", "text").where("text is not null").mapInArrow(cut, "doc_id string, did string, n_tokens int, terms array<int>, tfs array<int>, labels array<string>")
