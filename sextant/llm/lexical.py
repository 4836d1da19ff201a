"""Ranked lexical search over document shards of CSR postings with integer impacts.

`build_index` cuts a table of documents into shards of bounded size where its rows are; nothing is shuffled.  A shard
is one row: its terms, the start of each term's postings, and per posting the document's place in the shard
and its impact, a term frequency saturated against the document's length, as an integer.  Impacts need
the number of documents and their mean length, so these are counted before.

`LexicalIndex.search` sends a block of weighted queries to all shards.  A shard scores one query at a time, term by term, into a dense
array of 64-bit sums over its documents, and selects by a partition that keeps every document that ties with the last; a
task merges what its shards select, and only each task's best are shuffled, first to salted groups, then to the query's rank.

Scores are exact integers and ties go by ascending doc_id, so results do not depend on shards.

Defined results: null text and text without a term is no document of the collection (it has no postings); rows that
share a doc_id are documents of their own and may both be ranked; a null doc_id ranks after all others of its score; query rows
that share an id are one query with the terms of all of them; a query without terms, or whose terms no document has, has no rows; empty tables
give none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged
from .words import ALNUM, Texts, give_back, slices

#: Text and documents of a shard: a longer text has a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Terms of the queries that are sent to all tasks at a time, in bytes.
BLOCK_BYTES = 8 << 20
#: Saturation: share of the length norm in percent, and factors that keep everything an integer.
LENGTH_PERCENT, IMPACT_SCALE, TF_SCALE, NORM_SCALE, WEIGHT_SCALE = 25, 1_000_000_000, 1000, 12, 1000
#: Groups that a query's candidates meet in before its rank.
_SALTS = 64


def terms_of(texts: Texts) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of a batch in order, and the first term of each text."""
    low = texts.lowered()
    starts, ends, first = low.runs(ALNUM)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    held = low.data[ALNUM[low.data]]  # terms are the longest runs of these bytes, so they follow one another
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))]).dictionary_encode(), first


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the documents that hold it."""
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer impact of tf occurrences in a document of that many terms."""
    norm = 100 - LENGTH_PERCENT + _div(LENGTH_PERCENT * length, n_docs, n_terms)
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + NORM_SCALE * norm)


def _div(a: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(a * n_docs) div n_terms; by whole numbers of any size where 64 bits do not hold the product."""
    if len(a) and int(a.max()) * n_docs >= 2**63:
        return np.array([int(x) * n_docs // n_terms for x in a], dtype=np.int64)
    return (a * n_docs) // n_terms


_SHARD = "doc_ids binary, null_ids binary, terms array<binary>, starts binary, docs binary, impacts binary"


def _shard(ids: pa.Array, texts: Texts, n_docs: int, n_terms: int) -> pa.RecordBatch:
    coded, first = terms_of(texts)
    lengths = np.diff(first)
    keep = np.flatnonzero(lengths)
    ids, lengths = ids.take(pa.array(keep)), lengths[keep]
    codes = coded.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(codes * len(keep) + np.repeat(np.arange(len(keep)), lengths), return_counts=True)
    doc = key % max(len(keep), 1)
    starts = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * len(keep))
    terms = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.binary()))
    arrays = [ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False), starts.astype("<u4"), doc.astype("<u2"), impacts(tf, lengths[doc], n_docs, n_terms).astype("<u4")]
    columns = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([*columns[:2], terms, *columns[2:]], names=[x.split()[0] for x in _SHARD.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch], most_bytes: int, most_docs: int) -> Iterator[tuple[pa.Array, Texts]]:
    """Ids and texts of as many rows as a shard takes."""
    held: list[pa.RecordBatch] = []
    size = docs = 0
    for batch in slices(batches, "text", most_bytes):
        for at in range(0, batch.num_rows, most_docs):
            part = batch.slice(at, most_docs)
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and (size + n > most_bytes or docs + part.num_rows > most_docs):
                yield _joined(held)
                held, size, docs = [], 0, 0
            held.append(part)
            size, docs = size + n, docs + part.num_rows
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, Texts]:
    ids = pa.concat_arrays([b.column("doc_id") for b in held])
    return ids, Texts.of(pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held]))


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> LexicalIndex:
    """The index of documents (doc_id, text), written to the shared folder."""
    if not 0 < shard_docs <= SHARD_DOCS:
        raise ValueError(f"a shard has 1 to {SHARD_DOCS} documents")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in slices(batches, "text"):
            lengths = np.diff(Texts.of(batch.column("text")).runs(ALNUM)[2])
            n_docs, n_terms = n_docs + int(np.count_nonzero(lengths)), n_terms + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    counted = docs.select("text").mapInArrow(count, "n_docs bigint, n_terms bigint").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(v or 0) for v in counted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _gathered(batches, shard_bytes, shard_docs):
            shard = _shard(ids, texts, n_docs, n_terms)
            if len(shard.column("doc_ids")[0].as_py()):
                yield shard
        give_back()

    return LexicalIndex(staged(docs.mapInArrow(build, _SHARD), "lexical"), n_docs, n_terms)


def query_terms(queries: DataFrame, item: str) -> DataFrame:
    """item, term, repeats: the terms of each query and how often it has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded, first = terms_of(Texts.of(batch.column("text")))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
            key, n = np.unique(rows * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, max(len(coded.dictionary), 1))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), coded.dictionary.cast(pa.binary()).take(pa.array(code)), pa.array(n)], names=["item", "term", "repeats"])

    read = queries.select(F.col(item).cast("bigint").alias("item"), "text")
    return read.mapInArrow(cut, "item bigint, term binary, repeats bigint").groupBy("item", "term").agg(F.sum("repeats").alias("repeats"))


@dataclass
class _Block:
    """Weighted terms of some queries: query i has terms[at[i]:at[i + 1]], numbers in `term`."""

    items: list
    at: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    terms: pa.Array


def best(scores: np.ndarray, ids: np.ndarray, null_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal scores by ascending id, null ids after them."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        last = np.argpartition(-scores[found], k - 1)[k - 1]
        found = found[scores[found] >= scores[found[last]]]  # with all that tie with the k-th
    return found[np.lexsort((ids[found], null_ids[found], -scores[found]))[:k]]


@dataclass
class LexicalIndex:
    """Shards, and the documents and terms of the whole collection."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    def frequencies(self, terms: pa.Array) -> dict[bytes, int]:
        """How many documents hold each of these terms; reads no postings."""
        sent = self.shards.sparkSession.sparkContext.broadcast(terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(sent.value), dtype=np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    place = pc.index_in(sent.value, batch.column("terms")[i].values)
                    known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                    df[known] += np.diff(np.frombuffer(batch.column("starts")[i].as_buffer(), "<u4").astype(np.int64))[place.drop_null().to_numpy()]
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["i", "df"])

        rows = self.shards.select("terms", "starts").mapInArrow(count, "i bigint, df bigint").groupBy("i").agg(F.sum("df").alias("df")).collect()  # one row per term of the block
        got = {terms[r.i].as_py(): r.df for r in rows}
        sent.unpersist()
        return got

    def _block(self, rows: list) -> _Block:
        rows.sort(key=lambda r: (r.item is None, r.item or 0))
        terms = pa.array(sorted({bytes(r.term) for r in rows}), pa.binary())
        df = self.frequencies(terms)
        number = {t: i for i, t in enumerate(terms.to_pylist()) if t in df}
        items, at, term, weights = [], [0], [], []
        for r in rows:
            if not items or items[-1] != r.item:
                items.append(r.item)
                at.append(at[-1])
            if bytes(r.term) in number:
                term.append(number[bytes(r.term)])
                weights.append(r.repeats * weight(self.n_docs, df[bytes(r.term)]))
                at[-1] += 1
        return _Block(items, np.array(at), np.array(term, np.int64), np.array(weights, np.int64), terms)

    def _ranked(self, block: _Block, k: int) -> DataFrame:
        sent = self.shards.sparkSession.sparkContext.broadcast(block)

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b: _Block = sent.value
            # What a task's shards have selected so far, k rows of each query at most.
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in b.items]
            for batch in batches:
                for s in range(batch.num_rows):
                    blob = lambda c, kind: np.frombuffer(batch.column(c)[s].as_buffer(), kind)  # noqa: B023, E731
                    ids, null_ids, starts = blob("doc_ids", "<i8"), blob("null_ids", "?"), blob("starts", "<u4")
                    docs, impact = blob("docs", "<u2"), blob("impacts", "<u4")
                    place = pc.index_in(b.terms, batch.column("terms")[s].values).fill_null(-1).to_numpy()
                    for q in range(len(b.items)):
                        own = slice(b.at[q], b.at[q + 1])
                        here = place[b.term[own]]
                        scores = np.zeros(len(ids), dtype=np.int64)
                        for p, w in zip(here[here >= 0], b.weight[own][here >= 0]):
                            part = slice(starts[p], starts[p + 1])
                            scores[docs[part]] += w * impact[part].astype(np.int64)  # a document once a term
                        got = best(scores, ids, null_ids, k)
                        if len(got):
                            held = tuple(np.concatenate([x, y[got]]) for x, y in zip(top[q], (scores, ids, null_ids)))
                            kept = best(*held, k)
                            top[q] = tuple(x[kept] for x in held)
            n = [len(t[0]) for t in top]
            if sum(n):
                score, ids, null_ids = (np.concatenate(x) for x in zip(*top))
                item = pa.array(b.items, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=null_ids), pa.array(score)], names=["item", "doc_id", "score"])
            give_back()

        return self.shards.mapInArrow(rank, "item bigint, doc_id bigint, score bigint")

    def search(self, queries: DataFrame, k: int = 20, item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """item, rank, doc_id, score: the k best documents of each query (item, text).

        Queries beyond a block are searched a block at a time, each block's hits written before the next is read.
        """
        spark = self.shards.sparkSession
        terms = staged(query_terms(queries, item), "terms")
        size = terms.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
        blocks = -(-size // block_bytes)
        parts = []
        for n in range(blocks):
            # Of about block_bytes: one query's terms are as many as its text has.
            rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).collect()
            if rows:
                hits = self._ranked(self._block(rows), k)
                parts.append(staged(hits, "hits") if blocks > 1 else hits)
        hits = parts[0] if parts else spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
        for part in parts[1:]:
            hits = hits.unionByName(part)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        return hits.select(F.col("item").alias(item), "rank", "doc_id", "score")
