"""Ranks, top-k and fusion.  Scores are rounded before they are compared; ties go by id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6


def best_first(score: str = "score", tie: str = "doc_id") -> list[Column]:
    return [F.round(F.col(score), DIGITS).desc(), F.col(tie).asc()]


def ranked(hits: DataFrame, by: list[Column] | None = None, out: str = "rank") -> DataFrame:
    """Adds the 1-based rank within each query."""
    return hits.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(*(by or best_first()))))


def top_k(hits: DataFrame, k: int | None, by: list[Column] | None = None) -> DataFrame:
    """The k best hits of each query with their rank; all of them if k is None."""
    out = ranked(hits, by)
    return out if k is None else out.where(F.col("rank") <= k)


def rrf(arms: list[DataFrame], k: int = 60, rank_base: int = 1) -> DataFrame:
    """Reciprocal-rank fusion of ranked hits: sum of 1 / (k + rank)."""
    parts = [a.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(k) + F.col("rank") - 1 + rank_base)).alias("part")) for a in arms]
    return _union(parts).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def dbsf(arms: list[DataFrame]) -> DataFrame:
    """Distribution-based fusion: each arm's scores against its mean and three deviations, summed."""
    own = Window.partitionBy("query_id")
    parts = []
    for a in arms:
        s = a.select("query_id", "doc_id", "score", F.avg("score").over(own).alias("m"), F.stddev_samp("score").over(own).alias("d"))
        scaled = F.when(F.col("d") > 0, (F.col("score") - (F.col("m") - 3 * F.col("d"))) / (6 * F.col("d"))).otherwise(F.lit(0.5))
        parts.append(s.select("query_id", "doc_id", scaled.alias("part")))
    return _union(parts).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_by_document(hits: DataFrame, pid2did: DataFrame, limit: int | None = None, strict: bool = True) -> DataFrame:
    """The best passage of each document, in order, re-ranked.

    A passage without a document is an error; unless strict, it is a document of its own.
    """
    joined = hits.join(pid2did.select("doc_id", "did"), "doc_id", "left")
    if not strict:
        joined = joined.withColumn("did", F.when(F.col("did").isNull(), F.struct(F.col("doc_id").alias("pid"), F.lit(None).cast("string").alias("did"))).otherwise(F.struct(F.lit(None).cast("string").alias("pid"), F.col("did").cast("string").alias("did"))))
    else:
        joined = joined.withColumn("did", F.when(F.col("did").isNull(), F.raise_error(F.concat(F.lit("no document for passage "), F.col("doc_id")))).otherwise(F.col("did")))
    first = Window.partitionBy("query_id", "did").orderBy("rank")
    one = joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return top_k(one, limit, [F.col("rank")])


def best_places(names: np.ndarray, scores: np.ndarray, limit: int | None, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and queries of each query's best scores (all if limit is None), ties by name; what is not a number is no hit.

    `bound` has, for each query, the last rounded score that can still be a hit, negated.
    """
    limit = limit or max(1, len(names))
    worse = -np.round(scores, DIGITS)
    worse[np.isnan(worse)] = np.inf
    if bound is not None:
        worse[worse > bound] = np.inf
    if len(names) > limit and (bound is None or np.count_nonzero(worse < np.inf) > limit * scores.shape[1]):
        kth = np.partition(worse, limit - 1, axis=0)[limit - 1]
        d, q = np.nonzero((worse <= kth) & (worse < np.inf))  # the best of each query, with all that tie with the last
    else:
        d, q = np.nonzero(worse < np.inf)
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    by = np.lexsort((place[d], worse[d, q], q))
    d, q = d[by], q[by]
    nth = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return d[nth < limit], q[nth < limit]


class BestSoFar:
    """The best hits of each query over slices of scores that come one after another.

    What is held follows from the number of queries and the limit, not from that of the slices: what is worse than a query's last hit is
    not taken in, and what was taken in is cut back to the limit.
    """

    #: Hits that are held, at most, before they are given out.
    MOST = 400_000

    def __init__(self, n_queries: int, limit: int | None):
        self.limit, self.bound = limit or 1 << 40, np.full(n_queries, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.kept = 0

    def add(self, names: np.ndarray, scores: np.ndarray, first: int = 0) -> None:
        """Scores of documents (rows) and the queries from `first` on (columns)."""
        d, q = best_places(names, scores, min(self.limit, max(1, len(names))), self.bound[first : first + scores.shape[1]])
        if len(d):
            self.parts.append((q + first, names[d], scores[d, q]))
            self.size += len(d)
        if self.size > self.kept + min(max(2 * self.limit * len(self.bound), 20_000), self.MOST):
            self._cut()

    def _cut(self) -> None:
        q, names, scores = (np.concatenate(x) for x in zip(*self.parts))
        worse = -np.round(scores, DIGITS)
        _, place = np.unique(names, return_inverse=True)
        by = np.lexsort((place, worse, q))
        nth = np.arange(len(q)) - np.searchsorted(q[by], q[by], side="left")
        last = by[nth == self.limit - 1]
        self.bound[q[last]] = np.minimum(self.bound[q[last]], worse[last])
        by = by[nth < self.limit]
        self.parts, self.size = [(q[by], names[by], scores[by])], len(by)
        self.kept = self.size

    def full(self) -> bool:
        """Whether more is held than should be; `taken` makes room, and bounds stay."""
        return self.kept > self.MOST

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries by number, names and scores of the best; nothing is held then."""
        if not self.parts:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        self._cut()
        out, self.parts, self.size, self.kept = self.parts[0], [], 0, 0
        return out
