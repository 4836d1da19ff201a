"""Rerank strategies: hits in, hits out, re-scored and re-ordered, none cut off.

Equal scores keep the incoming order, so every strategy orders by score and then by the rank
that hits came with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.encoders import with_retry
from ..sources.staging import staged
from .bm25 import NgramStats
from .ranking import DIGITS, dedupe_by_document, ranked
from .search import MaxSimScorer, Searcher


class RerankStrategy(Protocol):
    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame: ...


def _reordered(hits: DataFrame) -> DataFrame:
    """Hits with a new score and the rank they came with as in_rank."""
    by = [F.round(F.col("score"), DIGITS).desc(), F.col("in_rank").asc()]
    return ranked(hits, by).select("query_id", "doc_id", "score", "rank")


def _rescored(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits by their new scores; those without one have 0."""
    came = hits.select("query_id", "doc_id", F.col("rank").alias("in_rank"))
    joined = came.join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    return _reordered(joined.withColumn("score", F.coalesce("score", F.lit(0.0))))


def _with_text(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs with the text of their passages, empty where the corpus has none."""
    return pairs.join(corpus.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


@dataclass
class PairScorerStrategy:
    """Scores query-passage pairs with a model: `score(queries, texts) -> scores`, in Arrow batches.

    A passage that the corpus lacks, or that has no text, is scored as an empty text.
    """

    corpus: DataFrame
    score: Callable[[list[str], list[str]], list[float]]

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        score = self.score

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                scores = list(score(b["query"].tolist(), b["text"].tolist())) if len(b) else []
                if len(scores) != len(b):
                    raise ValueError(f"{len(b)} pairs, {len(scores)} scores")
                yield b[["query_id", "doc_id"]].assign(score=pd.Series(scores, index=b.index, dtype="float64"))

        pairs = _with_text(hits.select("query_id", "doc_id").join(queries.select("query_id", "query"), "query_id"), self.corpus)
        fields = {f.name: f.dataType.simpleString() for f in pairs.schema}
        schema = f"query_id {fields['query_id']}, doc_id {fields['doc_id']}, score double"
        return _rescored(hits, pairs.select("query_id", "doc_id", "query", "text").mapInPandas(apply, schema))


@dataclass
class ServiceStrategy:
    """Scores a query's whole pool with one call of an injected service, `post(model, query, texts) -> (status, [{index, relevance_score}])`.

    A reply has a score for every text, in any order, by the text's index.  Pools are bounded by the search in front; a
    passage that the corpus lacks is sent as an empty text.
    """

    corpus: DataFrame
    model: str
    post: Callable[[str, str, list[str]], tuple[int, list[dict]]]
    attempts: int = 5

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        model, post, attempts = self.model, self.post, self.attempts

        def ask(pool: pd.DataFrame) -> pd.DataFrame:
            pool = pool.sort_values("rank").reset_index(drop=True)
            reply = with_retry(lambda: post(model, pool["query"][0], pool["text"].tolist()), attempts)
            if sorted(r["index"] for r in reply) != list(range(len(pool))):
                raise ValueError(f"{len(pool)} passages, {len(reply)} scores")
            scores = {r["index"]: float(r["relevance_score"]) for r in reply}
            return pool[["query_id", "doc_id"]].assign(score=[scores[i] for i in range(len(pool))])

        pools = _with_text(hits.select("query_id", "doc_id", "rank").join(queries.select("query_id", "query"), "query_id"), self.corpus)
        kinds = dict(pools.dtypes)
        return _rescored(hits, pools.groupBy("query_id").applyInPandas(ask, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"))


@dataclass
class LexicalStrategy:
    """A deterministic pair scorer: the share of the query's distinct tokens that the passage has."""

    corpus: DataFrame

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        from ..functions.text import tokenize

        q = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("q"))
        pairs = _with_text(hits.select("query_id", "doc_id").join(q, "query_id"), self.corpus)
        share = F.size(F.array_intersect("q", tokenize(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))
        return _rescored(hits, pairs.select("query_id", "doc_id", share.alias("score")))


@dataclass
class LateInteractionStrategy:
    """Local MaxSim over the pool.  Passages without vectors follow those with, in order, with the lowest score of the pool, 0 at most."""

    scorer: MaxSimScorer

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        came = hits.select("query_id", "doc_id", F.col("rank").alias("in_rank"))
        joined = came.join(self.scorer.score(queries, hits), ["query_id", "doc_id"], "left")
        lowest = F.least(F.coalesce(F.min("score").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(0.0))
        by = [F.col("score").isNull().asc(), F.round(F.col("score"), DIGITS).desc(), F.col("in_rank").asc()]
        return ranked(joined.withColumn("lowest", lowest), by).select("query_id", "doc_id", F.coalesce("score", "lowest").alias("score"), "rank")


@dataclass
class FilteredLateInteractionStrategy:
    """MaxSim from an index that may lack passages: those follow, in order, with the score they had."""

    scorer: MaxSimScorer

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        came = hits.select("query_id", "doc_id", F.col("score").alias("old"), F.col("rank").alias("in_rank"))
        joined = came.join(self.scorer.score(queries, hits), ["query_id", "doc_id"], "left")
        by = [F.col("score").isNull().asc(), F.round(F.col("score"), DIGITS).desc(), F.col("in_rank").asc()]
        return ranked(joined, by).select("query_id", "doc_id", F.coalesce("score", "old").alias("score"), "rank")


@dataclass
class NgramBM25Strategy:
    """The order of BM25 over word n-grams instead of the incoming one."""

    stats: NgramStats

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return _rescored(hits, self.stats.score(pool=hits))


@dataclass
class FusedNgramStrategy:
    """The incoming order and the n-gram BM25 order, fused by reciprocal rank."""

    stats: NgramStats
    rrf_k: int = 60

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        second = NgramBM25Strategy(self.stats).rerank(queries, hits).select("query_id", "doc_id", F.col("rank").alias("ngram_rank"))
        both = hits.select("query_id", "doc_id", F.col("rank").alias("in_rank")).join(second, ["query_id", "doc_id"])
        fused = F.lit(1.0) / (F.lit(self.rrf_k) + F.col("in_rank")) + F.lit(1.0) / (F.lit(self.rrf_k) + F.col("ngram_rank"))
        by = [F.round(F.col("score"), 12).desc(), F.col("in_rank").asc()]
        return ranked(both.withColumn("score", fused), by).select("query_id", "doc_id", "score", "rank")


@dataclass
class SiblingExpansionStrategy:
    """Adds the other passages of the hits' documents, scores all, and keeps the best of each document.

    A passage that several hits bring in has the score of the first; hits keep their own.  A hit without a
    document is an error; unless strict, it stays, as a document of its own.
    """

    inner: RerankStrategy
    pid2did: DataFrame
    strict: bool = True

    def expand(self, hits: DataFrame) -> DataFrame:
        of = self.pid2did.select("doc_id", "did")
        around = hits.join(of, "doc_id").join(of.withColumnRenamed("doc_id", "sibling"), "did").where("sibling <> doc_id")
        siblings = around.select("query_id", F.col("sibling").alias("doc_id"), F.col("doc_id").alias("expanded_from"), "score", "rank")
        rows = hits.select("query_id", "doc_id", F.lit(None).cast("string").alias("expanded_from"), "score", "rank").unionByName(siblings)
        own = Window.partitionBy("query_id", "doc_id").orderBy(F.col("expanded_from").isNotNull(), "rank")
        one = rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
        return ranked(one, [F.col("rank"), F.col("expanded_from").isNotNull(), F.col("doc_id")])

    def rerank(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        scored = self.inner.rerank(queries, self.expand(hits))
        return dedupe_by_document(scored, self.pid2did, strict=self.strict).select("query_id", "doc_id", "score", "rank")


@dataclass
class Reranker:
    """A searcher that looks deeper than asked, a strategy, and the cut."""

    retriever: Searcher
    strategy: RerankStrategy
    multiplier: int = 10

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        hits = staged(self.retriever.search(queries, limit * self.multiplier), "pool")  # strategies read them several times
        return self.strategy.rerank(queries, hits).where(F.col("rank") <= limit)
