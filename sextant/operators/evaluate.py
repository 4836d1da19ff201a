"""Ranking metrics over runs (query_id, doc_id, score[, rank]) and relevance labels (query_id, doc_id, grade).

Means are over the labelled queries: one without hits counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import best_first, ranked

METRICS = ("ndcg@10", "recall@10", "mrr@10", "ndcg@100", "recall@100", "mrr@100")


def build_run(hits: DataFrame, by: str = "score") -> DataFrame:
    """Ranks hits as an evaluator sees them: by score (equal scores by id), or by the rank they have.

    A document that is listed twice counts once, with its last score.
    """
    last = Window.partitionBy("query_id", "doc_id").orderBy(F.col("rank").desc())
    if "rank" in hits.columns:
        hits = hits.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    order = [F.col("rank").asc()] if by == "rank" else best_first()
    return ranked(hits, order).select("query_id", "doc_id", "score", "rank")


def effective_depth(top_k: int, metrics: tuple[str, ...]) -> int:
    return max([top_k, *(int(m.split("@")[1]) for m in metrics)])


def first_queries(qrels: DataFrame, queries: DataFrame, limit: int | None) -> DataFrame:
    """The labelled queries in query order, the first `limit` of them."""
    held = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "q_ord")
    return held if limit is None else held.orderBy("q_ord").limit(limit)


def query_metrics(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = METRICS, gain: str = "linear") -> DataFrame:
    """query_id, metric, value for every labelled query."""
    cutoffs = sorted({int(m.split("@")[1]) for m in metrics})
    g = F.col("grade").cast("double") if gain == "linear" else F.pow(F.lit(2.0), F.col("grade")) - 1
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    ideal = qrels.withColumn("i", F.row_number().over(best)).groupBy("query_id").agg(
        F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0)).alias("n_rel"),
        *(F.sum(F.when(F.col("i") <= k, g / F.log2(F.col("i") + 1)).otherwise(0.0)).alias(f"idcg{k}") for k in cutoffs),
    )
    hits = run.select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"])
    aggs = []
    for k in cutoffs:
        seen = F.col("rank") <= k
        rel = seen & (F.col("grade") >= 1)
        aggs += [
            F.sum(F.when(seen, g / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}"),
            F.sum(F.when(rel, 1).otherwise(0)).alias(f"found{k}"),
            F.max(F.when(rel, 1.0 / F.col("rank")).otherwise(0.0)).alias(f"rr{k}"),
        ]
    nth = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("nth", F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0)).over(nth))
    aggs += [F.sum(F.when((F.col("rank") <= k) & (F.col("grade") >= 1), F.col("nth") / F.col("rank")).otherwise(0.0)).alias(f"ap{k}") for k in cutoffs]
    row = ideal.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")

    def value(metric: str):
        name, k = metric.split("@")
        return {
            "ndcg": lambda: F.when(F.col(f"idcg{k}") > 0, zero(f"dcg{k}") / F.col(f"idcg{k}")).otherwise(0.0),
            "recall": lambda: F.when(F.col("n_rel") > 0, zero(f"found{k}") / F.col("n_rel")).otherwise(0.0),
            "mrr": lambda: zero(f"rr{k}"),
            "map": lambda: F.when(F.col("n_rel") > 0, zero(f"ap{k}") / F.col("n_rel")).otherwise(0.0),
            "precision": lambda: zero(f"found{k}") / int(k),
            "hits": lambda: zero(f"found{k}"),
        }[name]()

    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics))
    return row.select("query_id", F.explode(pairs).alias("x")).select("query_id", "x.metric", "x.value")


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """metric, value, n_queries."""
    return per_query.groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n_queries"))


def running_means(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """The mean so far after each query in query order."""
    so_far = Window.partitionBy("metric").orderBy("q_ord").rowsBetween(Window.unboundedPreceding, 0)
    return per_query.join(queries.select("query_id", "q_ord"), "query_id").select("metric", "q_ord", F.avg("value").over(so_far).alias("value"))


def sibling_qrels(qrels: DataFrame, pid2did: DataFrame, positive: int = 2, sibling: int = 1) -> DataFrame:
    """Labelled passages get `positive`, the other passages of their documents `sibling`."""
    of = pid2did.select("doc_id", "did")
    dids = qrels.join(of, "doc_id").select("query_id", "did").distinct()
    around = dids.join(of, "did").select("query_id", "doc_id", F.lit(0).alias("own"))
    both = around.unionByName(qrels.select("query_id", "doc_id", F.lit(1).alias("own")))
    return both.groupBy("query_id", "doc_id").agg(F.when(F.max("own") == 1, F.lit(positive)).otherwise(F.lit(sibling)).alias("grade"))


def _documents(passages: DataFrame, pid2did: DataFrame, strict: bool, what: str) -> DataFrame:
    """Passages with their did; one without a document is an error, or has none where not strict."""
    joined = passages.join(pid2did.select("doc_id", "did"), "doc_id", "left")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit(f"no document for {what} "), F.col("doc_id").cast("string")))
    return joined.withColumn("did", F.when(F.col("did").isNull(), missing).otherwise(F.col("did")))


def doc_level_rows(run: DataFrame, qrels: DataFrame, pid2did: DataFrame, strict: bool = True) -> DataFrame:
    """query_id, outcome (exact, sibling_only, miss) and the share of hits from a right document.

    A hit or labelled passage without a document is an error; unless strict, such a hit is from no right document, and such a
    label is reached by its own passage alone.
    """
    labelled = _documents(qrels, pid2did, strict, "labelled passage")
    dids = labelled.where("did is not null").select("query_id", "did").distinct().withColumn("same", F.lit(1))
    gold = qrels.select("query_id", "doc_id").distinct().withColumn("gold", F.lit(1))
    asked = labelled.groupBy("query_id").agg(F.count("did").alias("mapped"))  # looked at below, so that labels are checked without hits too
    hits = _documents(run.join(asked, "query_id", "left_semi"), pid2did, strict, "passage").join(dids, ["query_id", "did"], "left").join(gold, ["query_id", "doc_id"], "left")
    per = hits.groupBy("query_id").agg(F.max("gold").alias("gold"), F.max("same").alias("same"), (F.sum(F.coalesce("same", F.lit(0))) / F.count("*")).alias("precision"))
    outcome = F.when(F.col("gold") == 1, "exact").when(F.col("same") == 1, "sibling_only").otherwise("miss")
    return asked.join(per, "query_id", "left").select("query_id", outcome.alias("outcome"), F.when(F.col("mapped") >= 0, F.coalesce("precision", F.lit(0.0))).alias("precision"))


def doc_level_diagnosis(run: DataFrame, qrels: DataFrame, pid2did: DataFrame, strict: bool = True) -> DataFrame:
    """One row: shares of exact, sibling-only and missed queries, and the mean document precision."""
    share = lambda o: F.avg((F.col("outcome") == o).cast("double"))
    return doc_level_rows(run, qrels, pid2did, strict).agg(
        F.count("*").alias("n_queries"), share("exact").alias("exact_pct"), share("sibling_only").alias("sibling_only_pct"), share("miss").alias("miss_pct"), F.avg("precision").alias("mean_doc_precision")
    )


def queries_by_outcome(rows: DataFrame) -> DataFrame:
    """outcome, n, query_ids: the queries of each outcome of `doc_level_rows`, in order."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("query_id")).alias("query_ids"))
