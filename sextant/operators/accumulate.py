"""Scores of documents as sums over the terms that queries and documents share, added up in arrays inside tasks.

The queries' terms are a bounded table that goes to all tasks, by term.  Documents come with their terms as lists, one row each, so
that a task has whole documents, and only its best leave it.  Terms that most entries are of are added up by a product of matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import BestSoFar

#: Scores, and terms of queries in documents, that a task holds at a time.
_HELD_SCORES, _HELD_ENTRIES, _HELD_COMMON = 500_000, 500_000, 2_000_000
#: So many cells of a product of matrices cost what one entry does.
_CELLS_FOR_ENTRY = 300
#: What a document's postings add, by name of the sum: from columns of one number per posting.
Parts = Callable[[dict[str, np.ndarray]], dict[int, np.ndarray]]


@dataclass
class AskedTerms:
    """Term t is asked by query[first[t]:first[t + 1]], with that weight."""

    queries: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, n_terms: int | None = None) -> AskedTerms:
        """From query_id, term, weight; terms are numbers below n_terms if that is given."""
        if not len(rows):
            none = np.zeros(0, int)
            return cls(np.array([], dtype=object), np.array([], dtype=object), np.zeros((n_terms or 0) + 1, int), none, np.zeros(0))
        terms, term = np.unique(rows["term"].to_numpy(), return_inverse=True) if n_terms is None else (np.arange(n_terms), rows["term"].to_numpy())
        queries, query = np.unique(rows["query_id"].to_numpy(dtype=object), return_inverse=True)
        by = np.argsort(term, kind="stable")
        return cls(queries, terms, np.searchsorted(term[by], np.arange(len(terms) + 1)), query[by], rows["weight"].to_numpy(float)[by])

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """A row for each of some terms: its weight in every query, 0 where it is not asked."""
        many = self.first[terms + 1] - self.first[terms]
        row = np.repeat(np.arange(len(terms)), many)
        entry = np.arange(len(row)) + np.repeat(self.first[terms] - (np.cumsum(many) - many), many)
        wide = len(self.queries)
        return np.bincount(row * wide + self.query[entry], self.weight[entry], len(terms) * wide).reshape(len(terms), wide)


def common_terms(term: np.ndarray, n_docs: int, own: AskedTerms) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose entries are so many that a product of matrices costs less, a bounded number, and each term's place among them (-1: none)."""
    entries = np.bincount(term, minlength=len(own.first) - 1) * np.diff(own.first)
    place = np.full(len(entries), -1)
    if not len(term) or not len(own.queries):
        return place[:0], place
    most = min(len(entries), _HELD_COMMON // max(n_docs, len(own.queries)))
    common = np.argpartition(-entries, most - 1)[:most] if most else place[:0]
    common = np.sort(common[entries[common] > n_docs * len(own.queries) / _CELLS_FOR_ENTRY])
    place[common] = np.arange(len(common))
    return common, place


def best_sums(postings: DataFrame, term: str, values: list[str], per_document: list[str], asked: AskedTerms, parts: Parts, limit: int, query_type: str) -> DataFrame:
    """n, query_id, doc_id, score: for every sum n that `parts` makes, the best documents of each query, from every task.

    postings has doc_id, the term, `values` of a posting and `per_document` values; a document without a term of a query is no hit.
    """
    spark = postings.sparkSession
    kind = postings.schema[term].dataType.simpleString()
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(asked.terms.tolist())], f"{term} {kind}, term_ int")
    lists = [F.collect_list(c).alias(c) for c in ["term_", *values]]
    held = postings.join(F.broadcast(numbered), term).groupBy("doc_id", *per_document).agg(*lists)
    return best_of_lists(held, "term_", values, per_document, asked, parts, limit, query_type)


def best_of_lists(held: DataFrame, term: str, values: list[str], per_document: list[str], asked: AskedTerms, parts: Parts, limit: int, query_type: str, without: DataFrame | None = None) -> DataFrame:
    """The same from a row per document, its terms (by number) and their values as lists; pairs (query_id, doc_id) of `without` are no hits."""
    doc_type = dict(held.dtypes)["doc_id"]
    rows = held.select("doc_id", *per_document, term, *values).withColumn("doc_id", F.col("doc_id").cast("string"))
    barring = without is not None
    if barring:
        out = without.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_set(F.col("query_id").cast("string")).alias("without_"))
        rows = rows.join(out, "doc_id", "left")
    sent = held.sparkSession.sparkContext.broadcast(AskedTerms(asked.queries, asked.terms[:0], asked.first, asked.query, asked.weight))

    def scored(part: pa.RecordBatch, own: AskedTerms) -> dict[int, np.ndarray]:
        """A score for each document and query, not a number where they have no term in common."""
        n_docs, wide = part.num_rows, len(own.queries)
        term_, *of = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in [term, *values])
        doc = np.repeat(np.arange(n_docs), pc.list_value_length(part.column(term)).to_numpy(zero_copy_only=False))
        columns = {term: term_} | dict(zip(values, of)) | {c: part.column(c).to_numpy(zero_copy_only=False)[doc] for c in per_document}
        by = {n: np.asarray(v, float) for n, v in parts(columns).items()}
        # Sums of positive parts are positive; others need counting.
        positive = not len(own.weight) or own.weight.min() > 0
        common, place = common_terms(term_, n_docs, own) if positive else (np.zeros(0, int), None)
        out = {n: np.zeros((n_docs, wide)) for n in by}
        if len(common):
            at = place[term_]
            dense = at >= 0
            cell, weights = doc[dense] * len(common) + at[dense], own.dense(common)
            for n, value in by.items():
                out[n] += np.bincount(cell, np.nan_to_num(value[dense]), n_docs * len(common)).reshape(n_docs, -1) @ weights
            term_, doc, by = term_[~dense], doc[~dense], {n: v[~dense] for n, v in by.items()}
        many = own.first[term_ + 1] - own.first[term_]
        begins = np.searchsorted(doc, np.arange(n_docs + 1))
        before = np.concatenate([[0], np.cumsum(many)])  # entries before each posting
        first = 0
        while first < n_docs:
            # As many documents as there is room for.
            end = max(first + 1, int(np.searchsorted(before[begins], before[begins[first]] + _HELD_ENTRIES, side="right")) - 1)
            these = slice(begins[first], begins[end])
            base = own.first[term_[these]] - (before[:-1][these] - before[begins[first]])
            posting = np.repeat(np.arange(begins[end] - begins[first]), many[these])
            entry = np.arange(len(posting)) + base[posting]
            cell, weight = (doc[these] * wide - first * wide)[posting] + own.query[entry], own.weight[entry]
            for n, value in by.items():
                there = ~np.isnan(value[these])
                if there.all():
                    c, w = cell, value[these][posting] * weight
                else:
                    there = there[posting]
                    c, w = cell[there], value[these][posting[there]] * weight[there]
                shown = out[n][first:end]
                shown += np.bincount(c, w, shown.size).reshape(shown.shape)
                none = shown == 0 if positive else np.bincount(c, minlength=shown.size).reshape(shown.shape) == 0
                shown[none] = np.nan
            first = end
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: AskedTerms = sent.value
        place = {q: i for i, q in enumerate(own.queries.tolist())}
        step = max(1, _HELD_SCORES // max(1, len(own.queries)))
        best: dict[int, BestSoFar] = {}

        def given(n: int) -> pa.RecordBatch:
            q, names, scores = best[n].taken()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n, np.int32)), pa.array(own.queries[q], pa.string()), pa.array(names, pa.string()), pa.array(scores)], names=["n", "query_id", "doc_id", "score"])

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                docs = np.array(part.column("doc_id").to_pylist(), dtype=object)
                barred = part.column("without_").to_pylist() if barring else []
                pairs = [(d, place[q]) for d, some in enumerate(barred) for q in some or () if q in place]
                for n, scores in scored(part, own).items():
                    if pairs:
                        scores[tuple(np.array(pairs).T)] = np.nan
                    best.setdefault(n, BestSoFar(len(own.queries), limit)).add(docs, scores)
                    if best[n].full():
                        yield given(n)
        for n in best:
            yield given(n)

    out = rows.mapInArrow(add, "n int, query_id string, doc_id string, score double")
    return out.select("n", F.col("query_id").cast(query_type), F.col("doc_id").cast(doc_type), "score")
