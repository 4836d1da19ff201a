"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point.  An n-gram's vector binds its letters' vectors, each permuted by
its place, by multiplication; a document's vector bundles those of its n-grams by addition, and a language's prototype
those of all its learning documents.  A document is given the language whose prototype has the largest cosine with it.

Learning counts all labelled rows that are not held out: a task adds up one vector per language, and only these
are shuffled, by language and dimension.  Prediction is one pass without a shuffle; prototypes (one vector per language, see MOST_LANGUAGES) are
broadcast.  All bundles are sums of integers, so results do not depend on partitions.

Letters are what Unicode calls so, in lower case; whatever stands between two words is one space, and a text begins and ends with one.

Defined results: null text and text without a letter are `und` with score 0, and teach nothing, as do rows with null lang; a null doc_id hashes as the
empty text; repeated rows are learnt and predicted each; equal cosines go to the first language in order; where nothing was learnt all is `und`; columns
other than doc_id, text and lang are ignored.  A text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Texts, give_back, slices

DIMENSIONS, ORDER = 1024, 3
UNKNOWN = "und"
#: The part of the documents that is held out: those whose checksum leaves this remainder.
PARTS, HELD_OUT = 4, 2
#: More labels than there are languages are no languages; their prototypes would be too many to broadcast.
MOST_LANGUAGES = 10_000
#: Documents whose vectors are made at a time, and letters whose vectors a worker keeps.
_GROUP, _HELD_LETTERS = 64, 16_384
_POINTS = 0x110000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


@cache
def _letters() -> np.ndarray:
    """Each code point's letter in lower case, 0 if it is none."""
    table = np.zeros(_POINTS, dtype=np.uint32)
    for i in range(_POINTS):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()) if len(c.lower()) == 1 else i
    return table


_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """The vector of each letter; the space between words (0) has one too."""
    if len(_VECTORS) > _HELD_LETTERS:
        _VECTORS.clear()
    rows = []
    for x in letters.tolist():
        if (x, dimensions) not in _VECTORS:
            bits = np.random.Generator(np.random.Philox(key=x)).integers(0, 2, dimensions, dtype=np.int8)
            _VECTORS[x, dimensions] = bits * np.int8(2) - np.int8(1)
        rows.append(_VECTORS[x, dimensions])
    return np.stack(rows)


@dataclass
class Grams:
    """Distinct n-grams of a batch with their vectors, and the text and n-gram of each place in the batch."""

    book: np.ndarray
    text: np.ndarray
    gram: np.ndarray
    letters: np.ndarray

    def bundles(self, groups: np.ndarray, n: int) -> np.ndarray:
        """The sum of the vectors of each group; `groups` has the group of each place."""
        seen = np.zeros(len(self.book) + 1, dtype=bool)
        seen[self.gram] = True
        used = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        counts = np.bincount(groups * len(used) + place[self.gram], minlength=n * len(used)).reshape(n, len(used))
        # Sums of whole numbers: exact in single precision up to 2^24.
        kind = np.float32 if len(self.gram) < 2**24 else np.float64
        return counts.astype(kind) @ self.book[used].astype(kind)

    def of(self, first: int, last: int) -> Grams:
        """Some consecutive texts, numbered from 0."""
        a, b = np.searchsorted(self.text, [first, last])
        return Grams(self.book, self.text[a:b] - first, self.gram[a:b], self.letters[first:last])


def _symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one 0 between words and at both ends, and the text of each."""
    raw = texts.data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        begun = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        sizes = np.diff(begun[texts.offsets])
    except UnicodeDecodeError:  # not UTF-8: what can't be read is no letter
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
        points, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes + 2)
    symbols = np.zeros(len(own), dtype=np.uint32)
    symbols[np.arange(len(points)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = _letters()[points]
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[ends - sizes + 2 * np.arange(len(sizes))] = True
    return symbols[keep], own[keep]


def _numbered(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the number of each key among them; by a table where it is small, else by sorting."""
    if bound > max(1 << 22, 4 * len(key)):
        return np.unique(key, return_inverse=True)
    seen = np.zeros(bound, dtype=bool)
    seen[key] = True
    distinct = np.flatnonzero(seen)
    number = np.empty(bound, dtype=np.int32)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[key]


def grams_of(texts: Texts, dimensions: int, order: int) -> Grams:
    """The n-grams of a batch; a word's have the spaces around it."""
    symbols, own = _symbols(texts)
    seen = np.zeros(_POINTS, dtype=bool)
    seen[symbols] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(_POINTS, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    coded, n = number[symbols], max(len(symbols) - order + 1, 0)
    key = np.zeros(n, dtype=np.int64)
    for j in range(order):
        key = key * len(alphabet) + coded[j : n + j]
    inside = own[:n] == own[order - 1 :] if n else np.zeros(0, dtype=bool)
    key, text = key[inside], own[:n][inside]
    distinct, gram = _numbered(key, len(alphabet) ** order)
    book = np.ones((len(distinct), dimensions), dtype=np.int8)
    if len(distinct):
        vectors, rest = letter_vectors(alphabet, dimensions), distinct
        for place in range(order):  # from the last letter to the first
            rest, letter = np.divmod(rest, len(alphabet))
            book *= np.roll(vectors, place, axis=1)[letter]
    return Grams(book, text, gram, np.bincount(own[symbols > 0], minlength=len(texts)))


@dataclass
class Profiles:
    """Languages in order, and their prototypes at length 1."""

    languages: list[str]
    prototypes: np.ndarray
    order: int

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        """Language and cosine of each text."""
        grams = grams_of(texts, self.prototypes.shape[1], self.order)
        languages, scores = [], []
        for at in range(0, len(texts), _GROUP):
            part = grams.of(at, min(at + _GROUP, len(texts)))
            own = part.bundles(part.text, len(part.letters)).astype(np.float64)
            cosine = own @ self.prototypes.T / np.maximum(np.linalg.norm(own, axis=1), 1e-300)[:, None]
            cosine = np.round(cosine, 6)
            known = (part.letters > 0) & (len(self.languages) > 0)
            best = cosine.argmax(1) if len(self.languages) else np.zeros(len(own), int)
            languages += [self.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            scores.append(np.where(known, np.clip(cosine.max(1), 0, 1) if len(self.languages) else 0, 0))
        return languages, np.concatenate(scores)


def learn(rows: DataFrame, dimensions: int = DIMENSIONS, order: int = ORDER) -> Profiles:
    """Profiles of the languages of labelled rows (text, lang)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            grams = grams_of(Texts.of(batch.column("text")), dimensions, order)
            langs = batch.column("lang").dictionary_encode()
            group = langs.indices.to_numpy()
            for lang, v in zip(langs.dictionary.to_pylist(), grams.bundles(group[grams.text], len(langs.dictionary))):
                sums[lang] = sums.get(lang, 0) + np.round(v).astype(np.int64)
        if sums:
            flat = np.concatenate(list(sums.values()))
            values = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * dimensions, pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), values], names=["lang", "v"])
        give_back()

    if not 1 <= order <= 3:
        raise ValueError("n-grams have 1 to 3 letters, so that one fits a 64-bit number whatever the alphabet")
    usable = rows.where("text is not null and lang is not null").select("text", "lang")
    sums = usable.mapInArrow(bundle, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    got = sums.where("x <> 0").limit(MOST_LANGUAGES * dimensions + 1).toPandas()
    languages = sorted(got["lang"].unique().tolist())
    if len(got) > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} labels are no languages")
    prototypes = np.zeros((len(languages), dimensions))
    prototypes[np.searchsorted(np.array(languages, dtype=object), got["lang"].to_numpy(dtype=object)), got["d"].to_numpy(dtype=int)] = got["x"]
    return Profiles(languages, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1), 1e-300)[:, None], order)


PREDICTED = "doc_id bigint, lang_pred string, score double"


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # MOST_LANGUAGES vectors at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            languages, scores = sent.value.predict(Texts.of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(predict, PREDICTED)


def language_of(docs: DataFrame, dimensions: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the labelled documents that are not held out, predicts all."""
    profiles = learn(docs.where(~held_out(F.col("doc_id").cast("bigint"))), dimensions, order)
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
