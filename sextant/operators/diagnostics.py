"""What a corpus and its labels look like: lengths, siblings, and how well features separate gold passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import entities, has_quote, tokenize, word_count
from .bm25 import NgramStats
from .ranking import DIGITS

THRESHOLDS = (128, 256, 512, 1024, 2048)
QUANTILES = (50, 90, 95, 99)


def corpus_stats(corpus: DataFrame, max_seq: int = 512, length: Column | None = None) -> DataFrame:
    """One row of token-length statistics; the length is tokens unless another is given."""
    n = F.col("len")
    rows = corpus.select((F.size(tokenize(F.col("text"))) if length is None else length).cast("bigint").alias("len"))
    out = rows.agg(
        F.count("*").alias("n_docs"), F.sum("len").alias("total"), F.avg("len").alias("mean"), F.max("len").alias("max"),
        F.percentile("len", F.array(*(F.lit(q / 100) for q in QUANTILES))).alias("_q"),
        F.avg((n > max_seq).cast("double")).alias("pct_over_max"),
        *(F.avg((n > t).cast("double")).alias(f"pct_over_{t}") for t in THRESHOLDS),
        F.sum(F.greatest(n - max_seq, F.lit(0))).alias("_cut"),
    )
    out = out.select("*", *(F.floor(F.col("_q")[i]).cast("bigint").alias(f"p{q}") for i, q in enumerate(QUANTILES)))
    return out.withColumn("truncation_loss", F.when(F.col("total") > 0, F.col("_cut") / F.col("total")).otherwise(0.0)).drop("_q", "_cut")


def token_lengths(corpus: DataFrame, make: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """len: each text's length by a tokenizer, special tokens and all; `make()` gives, once a task, a function of texts.

    corpus_stats(token_lengths(...), length=F.col("len")) has the statistics by it.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = make()
        for b in batches:
            yield pd.DataFrame({"len": pd.Series(lengths(b["text"].tolist()) if len(b) else [], dtype="int64")})

    return corpus.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(apply, "len bigint")


def needs_chunking(stats: DataFrame, over: float = 0.10, loss: float = 0.10) -> DataFrame:
    return stats.select(((F.col("pct_over_max") > over) | (F.col("truncation_loss") > loss)).alias("needs_chunking"))


def word_stats(corpus: DataFrame) -> DataFrame:
    """Word counts: mean, median, population deviation, maximum, and the share at the maximum."""
    rows = corpus.select(word_count(F.col("text")).alias("w"))
    by_count = rows.groupBy("w").agg(F.count("*").alias("c"))
    top = by_count.agg(F.max_by("c", "w").alias("at_max"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.median("w").alias("median"), F.stddev_pop("w").alias("std"), F.max("w").alias("max"))
    return stats.join(F.broadcast(top)).select("n", "mean", "median", "std", "max", (F.col("at_max") / F.col("n")).alias("share_at_max"))  # one row each


def did_to_pids(pid2did: DataFrame) -> DataFrame:
    return pid2did.groupBy("did").agg(F.sort_array(F.collect_set("doc_id")).alias("pids"))


def pid_orphans(corpus: DataFrame, pid2did: DataFrame) -> DataFrame:
    return corpus.select("doc_id").join(pid2did, "doc_id", "left_anti")


def siblings_of_gold(qrels: DataFrame, pid2did: DataFrame) -> DataFrame:
    """query_id, doc_id: unlabelled passages of the documents that a query's gold passages are from."""
    of = pid2did.select("doc_id", "did")
    dids = qrels.join(of, "doc_id").select("query_id", "did").distinct()
    return dids.join(of, "did").select("query_id", "doc_id").join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def sibling_stats(qrels: DataFrame, negatives: DataFrame, pid2did: DataFrame) -> DataFrame:
    """One row: documents, multi-passage ones, queries whose gold has siblings, and whose negatives are siblings."""
    sizes = pid2did.groupBy("did").agg(F.count_distinct("doc_id").alias("n"))
    docs = sizes.agg(F.count("*").alias("n_docs"), F.sum((F.col("n") > 1).cast("int")).alias("multi_docs"), F.max("n").alias("max_passages"))
    sib = siblings_of_gold(qrels, pid2did)
    neg = negatives.select("query_id", "doc_id").join(sib, ["query_id", "doc_id"], "left_semi")
    total = qrels.agg(F.count_distinct("query_id").alias("n_queries"))
    with_sib = sib.agg(F.count_distinct("query_id").alias("queries_with_siblings"), F.count("*").alias("siblings"))
    with_neg = neg.agg(F.count_distinct("query_id").alias("queries_with_sibling_negatives"), F.count("*").alias("sibling_negatives"))
    out = docs
    for one in (total, with_sib, with_neg):
        out = out.join(F.broadcast(one))  # one row each
    return out


def sibling_examples(qrels: DataFrame, queries: DataFrame, pid2did: DataFrame, most: int = 5) -> DataFrame:
    """The first queries with siblings, in query order, with sorted gold and sibling ids."""
    sib = siblings_of_gold(qrels, pid2did).groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("siblings"))
    gold = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("gold"))
    return sib.join(gold, "query_id").join(queries.select("query_id", "q_ord"), "query_id").orderBy("q_ord").limit(most)


def pools(qrels: DataFrame, negatives: DataFrame) -> DataFrame:
    """query_id, doc_id, gold for queries with negatives; a passage that is both counts once, as gold."""
    both = qrels.select("query_id", "doc_id", F.lit(1).alias("gold")).unionByName(negatives.select("query_id", "doc_id", F.lit(0).alias("gold")))
    return both.join(negatives.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id", "doc_id").agg(F.max("gold").alias("gold"))


def pool_sizes(qrels: DataFrame, negatives: DataFrame) -> DataFrame:
    """query_id, pool_size: gold and negatives, one that is both counted twice."""
    both = qrels.select("query_id", "doc_id").unionByName(negatives.select("query_id", "doc_id"))
    return both.join(negatives.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("pool_size"))


def gold_ranks(scored: DataFrame, by: list[str]) -> DataFrame:
    """by..., rank, zero: the mean rank of the best gold passage among equal scores (columns doc_id, gold, score)."""
    own = Window.partitionBy(*by)
    s = F.round("score", DIGITS)
    rows = scored.withColumn("s", s).withColumn("best", F.max(F.when(F.col("gold") == 1, F.col("s"))).over(own))
    return rows.groupBy(*by).agg((F.sum((F.col("s") > F.col("best")).cast("int")) + 1 + (F.sum((F.col("s") == F.col("best")).cast("int")) - 1) / 2).alias("rank"), (F.max("best") == 0).alias("zero"))


def entity_overlap(queries: DataFrame, corpus: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, doc_id, entity: entities that a query shares with a passage of its pool."""
    q = queries.select("query_id", F.explode(entities(F.col("query"))).alias("entity"))
    d = corpus.select("doc_id", F.explode(entities(F.col("text"))).alias("entity"))
    return pool.select("query_id", "doc_id").distinct().join(q, "query_id").join(d, ["doc_id", "entity"]).select("query_id", "doc_id", "entity")


def entity_signal(qrels: DataFrame, negatives: DataFrame, queries: DataFrame, corpus: DataFrame, top_ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: how far shared entities, weighted by their rarity in the pool, put gold passages first."""
    pool = pools(qrels, negatives)
    shared = entity_overlap(queries, corpus, pool)
    weight = shared.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("query_id", "entity"))).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    counts = queries.join(pool.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.size(entities(F.col("query"))).alias("n_entities"))
    asked = counts.where("n_entities > 0").select("query_id")
    scored = pool.join(asked, "query_id", "left_semi").join(weight, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rows = gold_ranks(scored, ["query_id"]).join(pool_sizes(qrels, negatives), "query_id")
    head = counts.agg(F.count("*").alias("num_queries"), F.floor(F.median("n_entities")).cast("bigint").alias("median_entities_per_query"))
    body = rows.agg(
        F.count("*").alias("queries_with_entities"), F.floor(F.median("pool_size")).cast("bigint").alias("median_pool_size"), F.avg(F.col("zero").cast("double")).alias("gold_zero_overlap_pct"),
        F.avg(F.col("rank") / F.col("pool_size")).alias("mean_relative_rank"), F.avg(1.0 / F.col("pool_size")).alias("random_top1_pct"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"gold_top_{k}_pct") for k in top_ks),
    )
    return head.join(F.broadcast(body))  # one row each


def ngram_ranks(stats: NgramStats, qrels: DataFrame, negatives: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n, quoted, pool_size, rank, zero for every gram order."""
    pool = pools(qrels, negatives)
    orders = range(1, stats.max_n + 1)
    scored = pool.join(stats.scores(list(orders), pool), ["query_id", "doc_id"], "left")
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.coalesce(f"score_{n}", F.lit(0.0)).alias("score")) for n in orders))
    parts = scored.select("query_id", "doc_id", "gold", F.explode(each).alias("x")).select("query_id", "doc_id", "gold", "x.score", "x.n")
    ranks = gold_ranks(parts, ["query_id", "n"])
    quoted = queries.select("query_id", has_quote(F.col("query")).alias("quoted"))
    return ranks.join(quoted, "query_id").join(pool_sizes(qrels, negatives), "query_id")


def ngram_signal(ranks: DataFrame, top_ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """arm, stratum, num_queries, mean_relative_rank, gold_top_k_pct..., gold_zero_overlap_pct; empty strata have no row."""
    arm = F.when(F.col("n") == 1, F.lit("unigram")).otherwise(F.concat(F.lit("uni+"), F.col("n").cast("string"), F.lit("gram")))
    strata = F.array(F.lit("all"), F.when(F.col("quoted"), F.lit("quoted")).otherwise(F.lit("unquoted")))
    rows = ranks.select("*", arm.alias("arm"), F.explode(strata).alias("stratum"))
    return rows.groupBy("arm", "stratum").agg(
        F.count("*").alias("num_queries"), F.avg(F.col("rank") / F.col("pool_size")).alias("mean_relative_rank"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"gold_top_{k}_pct") for k in top_ks), F.avg(F.col("zero").cast("double")).alias("gold_zero_overlap_pct")
    )


def ngram_arm_deltas(ranks: DataFrame) -> DataFrame:
    """n, mean_relative_rank and its change from the order below."""
    arms = ranks.groupBy("n").agg(F.avg(F.col("rank") / F.col("pool_size")).alias("mean_relative_rank"))
    return arms.withColumn("delta", F.col("mean_relative_rank") - F.lag("mean_relative_rank").over(Window.orderBy("n")))
