"""Word n-grams of documents, counted where the documents are: a row per document with its grams as lists, nothing shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import GRAM_SEPARATOR, TOKEN_PATTERN

_TOKEN = re.compile(TOKEN_PATTERN)


def tokens_of(lowered: str) -> list[str]:
    """As `functions.text.tokenize`, from a text in lower case."""
    return [t.rstrip(".") for t in _TOKEN.findall(lowered)]


def gram_counts(tokens: list[str], max_n: int) -> Counter[str]:
    """How often a document has each gram of orders 1 to max_n."""
    out = Counter(tokens)
    for n in range(2, max_n + 1):
        out.update(map(GRAM_SEPARATOR.join, zip(*(tokens[i:] for i in range(n)))))
    return out


def _lists(rows: list) -> tuple[np.ndarray, list]:
    """Bounds and items of a list per row."""
    return np.cumsum([0, *map(len, rows)]).astype(np.int32), [x for row in rows for x in row]


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _counted(corpus: DataFrame, count, kinds: dict[str, str]) -> DataFrame:
    """doc_id, n_tokens and two lists (their names and kinds), by a function of several documents' tokens that returns the lists of each as one row of lists: bounds, items of either."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                tokens = [tokens_of(t) for t in b.column("text").to_pylist()]
                bounds, *lists = count(tokens)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, _ARROW[kind])) for x, kind in zip(lists, kinds.values())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in tokens], pa.int32()), *lists], names=["doc_id", "n_tokens", *kinds])

    texts = corpus.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(apply, f"doc_id {dict(corpus.dtypes)['doc_id']}, n_tokens int, " + ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items()))


class WantedGrams:
    """Wanted grams (gram, order) by steps: a gram of n tokens is found by the node of its first n - 1 and its last token, for all places of a batch at once."""

    def __init__(self, wanted: list[tuple[str, int]]):
        # Tokens have no separator, so a gram of several is told apart by its parts.
        parts = [(place, [gram] if n == 1 else gram.split(GRAM_SEPARATOR)) for place, (gram, n) in enumerate(wanted)]
        parts = [(place, p) for place, p in parts if len(p) == wanted[place][1]]
        self.size, self.vocabulary = len(wanted), {t: i for i, t in enumerate(dict.fromkeys(t for _, p in parts for t in p))}
        self.wide = max(1, len(self.vocabulary))
        #: By order from 2: keys (node before, token), sorted, a node each; by order from 1: the place of each node's gram, -1 where it is not wanted.
        self.keys: list[np.ndarray] = []
        node = {(t,): i for t, i in self.vocabulary.items()}
        self.places = [np.full(self.wide, -1, np.int64)]
        for n in range(1, max((len(p) for _, p in parts), default=1) + 1):
            if n > 1:
                heads = sorted({(node[tuple(p[: n - 1])] * self.wide + self.vocabulary[p[n - 1]], tuple(p[:n])) for _, p in parts if len(p) >= n})
                self.keys.append(np.array([k for k, _ in heads], np.int64))
                self.places.append(np.full(len(heads), -1, np.int64))
                node = {head: i for i, (_, head) in enumerate(heads)}
            for place, p in parts:
                if len(p) == n:
                    self.places[-1][node[tuple(p)]] = place

    def count(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds, places and counts of the wanted grams of each document."""
        sizes = np.array([len(t) for t in documents], np.int64)
        return self.count_numbers(np.fromiter(map(self.vocabulary.get, chain.from_iterable(documents), repeat(-1)), np.int64, int(sizes.sum())), sizes)

    def count_numbers(self, token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from all documents' tokens by their numbers in the vocabulary, -1 for others, and the number of tokens of each document."""
        total, doc = len(token), np.repeat(np.arange(len(sizes)), sizes)
        begin = np.flatnonzero(token >= 0)
        node, found = token[begin].astype(np.int64), []
        for n, places in enumerate(self.places, 1):
            if n > 1:
                begin, node = begin[begin + n <= total], node[begin + n <= total]
                last, keys = token[begin + n - 1], self.keys[n - 2]
                there = (last >= 0) & (doc[begin + n - 1] == doc[begin])
                begin, key = begin[there], node[there] * self.wide + last[there]
                node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[node] == key
                begin, node = begin[there], node[there]
            place = places[node]
            there = place >= 0
            found.append(doc[begin[there]] * self.size + place[there])
        pairs = np.concatenate(found)
        if len(sizes) * self.size < 1 << 31:
            pairs = pairs.astype(np.int32)  # these are sorted faster
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        tfs = np.diff(np.append(first, len(pairs)))
        pairs = pairs[first].astype(np.int64)
        bounds = np.searchsorted(pairs, np.arange(len(sizes) + 1) * self.size).astype(np.int32)
        return bounds, pairs % max(1, self.size), tfs


def count_wanted(corpus: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """doc_id, n_tokens, terms, tfs: how often each document (doc_id, text) has the wanted grams (gram, order), by their places in that list."""
    sent = corpus.sparkSession.sparkContext.broadcast(WantedGrams(wanted))
    return _counted(corpus, lambda tokens: sent.value.count(tokens), {"terms": "int", "tfs": "int"})


def count_all(corpus: DataFrame, max_n: int) -> DataFrame:
    """doc_id, n_tokens, terms, tfs: all grams of orders 1 to max_n of each document (doc_id, text)."""

    def count(documents: list[list[str]]) -> tuple[np.ndarray, list, list]:
        counts = [gram_counts(t, max_n) for t in documents]
        bounds, terms = _lists(counts)
        return bounds, terms, [tf for c in counts for tf in c.values()]

    return _counted(corpus, count, {"terms": "string", "tfs": "int"})


def add_hashed(corpus: DataFrame, max_n: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, idx, val: all grams of orders 1 to max_n of each document (doc_id, text) by their hashes, as `functions.text.gram_hash`.

    A gram's value is a function of its count and the document's number of tokens; values of grams of one hash are added up.
    """

    def add(documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = [gram_counts(t, max_n) for t in documents]
        doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        tfs = np.fromiter(chain.from_iterable(c.values() for c in counts), np.float64, len(doc))
        hashes = np.fromiter(map(crc32, map(str.encode, chain.from_iterable(counts))), np.int64, len(doc))
        values = value(tfs, np.array([len(t) for t in documents], np.float64)[doc])
        keys = doc << 32 | hashes
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        bounds = np.searchsorted(keys[first], np.arange(len(counts) + 1) << 32).astype(np.int32)
        return bounds, keys[first] & 0xFFFFFFFF, np.add.reduceat(values[order], first) if len(first) else values

    return _counted(corpus, add, {"idx": "bigint", "val": "double"})


def exploded(counted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, term, tf from lists."""
    return counted.select("doc_id", "n_tokens", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", "n_tokens", F.col("x.terms").alias("term"), F.col("x.tfs").cast("bigint").alias("tf"))


def documents_with(lists: DataFrame, n_terms: int) -> DataFrame:
    """term, df: how many of the lists (terms: numbers below n_terms, none twice) have each term, counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(df[there])], names=["term", "df"])

    return lists.select("terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def has_repeats(corpus: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return bool(corpus.groupBy("doc_id").count().where("count > 1").limit(1).count())
