"""The retrieval queries: name to function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diagnostics as D
from ..operators import evaluate as E
from ..operators import rag
from ..operators import significance as S
from ..operators.ann import HyperplaneIndex
from ..operators.bm25 import NgramStats, SparseEncoder, query_grams
from ..operators.cells import CellIndex
from ..operators.late import LateIndex, LateSearcher
from ..operators.postings import PostingsIndex
from ..operators.ranking import dedupe_by_document, top_k
from ..operators.rerank import FilteredLateInteractionStrategy, FusedNgramStrategy, LateInteractionStrategy, LexicalStrategy, NgramBM25Strategy, Reranker, SiblingExpansionStrategy
from ..operators.search import Bm25Searcher, DenseSearcher, HybridRerankSearcher, HybridSearcher, MaxSimScorer, MaxSimSearcher, SparseSearcher, UniqueDocSearcher, missing_query_vectors
from ..sources import ingest, store
from ..sources.passages import PassageSource
from ..sources.staging import staged
from .roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six digits: all of them, or those named."""
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(n, 6) for n in names})


def hits(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank")))


# ---- sources and the store


@query
def ingest_corpus(r: Roles) -> DataFrame:
    return ingest.corpus_of(r.training_rows())


@query
def ingest_queries(r: Roles) -> DataFrame:
    return ingest.queries_of(r.training_rows())


@query
def ingest_qrels(r: Roles) -> DataFrame:
    return ingest.qrels_of(r.training_rows())


@query
def ingest_negatives(r: Roles) -> DataFrame:
    return ingest.negatives_of(r.training_rows())


@query
def pid2did_scan(r: Roles) -> DataFrame:
    path = r.scratch("pid2did")
    r.pid2did().write.option("sep", "\t").option("compression", "gzip").csv(path)
    return ingest.read_pid2did(r.spark, path, r.qrels().select("doc_id"))


@query
def passage_scan(r: Roles) -> DataFrame:
    """Passages written as tab-separated lines, and read in parts by the passage source."""
    path = r.scratch("passages-tsv")
    r.passages().select(F.concat_ws("\t", "doc_id", "did", F.translate("text", "\t\r\n", "   "))).write.text(path)
    r.spark.dataSource.register(PassageSource)
    got = r.spark.read.format("passages").options(path=path, columns="doc_id,did,text", mode="failfast").load()
    return got.select("doc_id", "did", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def sample_pair(r: Roles) -> DataFrame:
    return ingest.sample_pair(r.qrels())


@query
def embed_cache_roundtrip(r: Roles) -> DataFrame:
    cache = store.EmbeddingCache(r.spark, r.scratch("cache"))
    v = r.vectors()
    cache.save("org/model", "dense", v.select(F.col("doc_id").alias("item_id"), F.xxhash64("doc_id").alias("text_hash"), "vec"))
    got = cache.load("org/model", "dense")
    return got.select("item_id", F.size("vec").alias("size"), F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"))


@query
def embed_cache_fill(r: Roles) -> DataFrame:
    cache = store.EmbeddingCache(r.spark, r.scratch("cache"))
    items = r.table("benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    lengths = lambda rows: rows.select("item_id", F.array(F.char_length("text").cast("float")).alias("vec"))
    cache.save("m", "dense", items.where("item_id % 2 = 0").select("item_id", F.xxhash64("text").alias("text_hash"), F.array(F.lit(-1.0).cast("float")).alias("vec")))
    return cache.fill("m", "dense", items, lengths).select("item_id", F.element_at("vec", 1).cast("double").alias("value"))


@query
def upsert_skip_existing(r: Roles) -> DataFrame:
    docs = r.table("documents").select(F.col("doc_id").alias("id"), "lang")
    return store.new_points(docs, docs.where("lang = 'en'"))


@query
def upsert_latest(r: Roles) -> DataFrame:
    e = r.table("events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("version"), "event_id", "event_type")
    return store.latest(e).select("id", "event_id", "event_type")


@query
def backfill_slot(r: Roles) -> DataFrame:
    points = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("double").alias("spent"))
    spent = r.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("spent"))
    return store.backfilled(points, "spent", spent).withColumns({"balance": F.round("balance", 2), "spent": F.round("spent", 2)})


@query
def points_count(r: Roles) -> DataFrame:
    return r.passages().agg(F.count("*").alias("n"))


@query
def warmup_missing(r: Roles) -> DataFrame:
    turns = r.table("conversations").where("role = 'user'").select(F.col("text").alias("query"), "turn")
    return missing_query_vectors(turns, turns.where("turn = 0").select("query").distinct())


# ---- text


@query
def tokenize(r: Roles) -> DataFrame:
    return r.documents().select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query
def ngrams(r: Roles) -> DataFrame:
    tokens = r.documents().select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.array_join(T.ngrams(F.col("tokens"), 2), " ").alias("grams"))


@query
def term_freq(r: Roles) -> DataFrame:
    grams = r.documents().select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("gram"))
    return grams.groupBy("doc_id", "gram").agg(F.count("*").alias("tf"))


@query
def ngram_df(r: Roles) -> DataFrame:
    return r.stats().df


@query
def ngram_idf(r: Roles) -> DataFrame:
    return rounded(r.stats().idf_table().select("gram", "n", "df", "idf"))


@query
def quoted_flag(r: Roles) -> DataFrame:
    return r.documents().select("doc_id", T.has_quote(F.col("text")).alias("quoted"))


@query
def entities(r: Roles) -> DataFrame:
    return r.cited_parts().select("doc_id", F.explode(T.entities(F.col("text"))).alias("entity"))


@query
def word_counts(r: Roles) -> DataFrame:
    return r.documents().select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def sparse_encode_docs(r: Roles) -> DataFrame:
    """Hashed vectors: how many indices a passage has, and what their values, of all grams of a hash, add up to and reach."""
    enc = SparseEncoder().fit(r.passages())
    return rounded(enc.encode_documents(r.passages()).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("val").alias("total"), F.max("val").alias("largest")))


@query
def sparse_encode_query(r: Roles) -> DataFrame:
    return query_grams(r.queries(), 2).select("query_id", "gram", F.lit(1.0).alias("val"))


# ---- search


@query
def bm25_unigram(r: Roles) -> DataFrame:
    return hits(r.stats().best([1], 10))


@query
def bm25_bigram(r: Roles) -> DataFrame:
    return hits(r.stats().best([2], 10))


def _dense(r: Roles, distance: str) -> DataFrame:
    return hits(DenseSearcher(r.vectors(), distance=distance).search(r.query_vectors(), 10))


@query
def dense_topk(r: Roles) -> DataFrame:
    return _dense(r, "cosine")


@query
def dense_topk_dot(r: Roles) -> DataFrame:
    return _dense(r, "dot")


@query
def dense_topk_l2(r: Roles) -> DataFrame:
    return _dense(r, "euclid")


@query
def dense_topk_l1(r: Roles) -> DataFrame:
    return _dense(r, "manhattan")


def sparse_search(r: Roles, with_idf: bool, limit: int) -> DataFrame:
    """Grams stand for their hashes, so that no collision comes between this and its SQL."""
    stats = r.stats()
    if stats.held is not None:
        return stats.best_saturated(limit, with_idf)
    _, postings = SparseEncoder.of_stats(stats)
    encoded = stats.wanted.select("query_id", F.col("gram").alias("idx"), F.lit(1.0).alias("val"))
    return SparseSearcher(postings.withColumnRenamed("gram", "idx"), stats.n_docs, with_idf=with_idf).search_encoded(encoded, limit)


@query
def sparse_topk(r: Roles) -> DataFrame:
    return hits(sparse_search(r, True, 10))


def _hybrid(r: Roles, fusion: str) -> DataFrame:
    stats = r.stats()
    return hits(HybridSearcher([Bm25Searcher(stats, 1), Bm25Searcher(stats, 2)], fusion).search(r.queries(), 10))


@query
def hybrid_rrf(r: Roles) -> DataFrame:
    return _hybrid(r, "rrf")


@query
def hybrid_dbsf(r: Roles) -> DataFrame:
    return _hybrid(r, "dbsf")


def _arms(r: Roles) -> list[DenseSearcher]:
    mv = r.multivectors()
    return [DenseSearcher(mv, vector=c, query_vector=c) for c in ("head", "tail")]


@query
def hybrid_rerank_maxsim(r: Roles) -> DataFrame:
    s = HybridRerankSearcher(_arms(r), MaxSimScorer(r.multivectors()))
    return hits(s.search(r.query_multivectors(), 10))


@query
def maxsim_topk(r: Roles) -> DataFrame:
    return hits(MaxSimSearcher(r.multivectors()).search(r.query_multivectors(), 10))


@query
def maxsim_candidates(r: Roles) -> DataFrame:
    docs = r.multivectors()
    return hits(LateSearcher(LateIndex.build(docs), docs).search(r.query_multivectors(), 10))


@query
def ann_lsh(r: Roles) -> DataFrame:
    return hits(HyperplaneIndex(r.vectors(), 64).search(r.query_vectors(), 10))


@query
def stored_index_topk(r: Roles) -> DataFrame:
    """Queries that the stored index was not built for."""
    return hits(PostingsIndex.of_corpus(r.passages()).search(r.queries(), 10))


@query
def ann_cells(r: Roles) -> DataFrame:
    return hits(CellIndex.build(r.vectors()).search(r.query_vectors(), 10))


@query
def dedupe_by_doc(r: Roles) -> DataFrame:
    return hits(dedupe_by_document(Bm25Searcher(r.stats(), 1).search(r.queries(), 50), r.pid2did(), 10))


@query
def unique_doc_topk(r: Roles) -> DataFrame:
    return hits(UniqueDocSearcher(Bm25Searcher(r.stats(), 2), r.pid2did()).search(r.queries(), 10))


# ---- rerank


def _reranked(r: Roles, strategy, stats: NgramStats | None = None) -> DataFrame:
    return hits(Reranker(Bm25Searcher(stats or r.stats(), 1), strategy).search(r.queries(), 10))


@query
def rerank_pairwise(r: Roles) -> DataFrame:
    return _reranked(r, LexicalStrategy(r.passages()))


@query
def rerank_maxsim(r: Roles) -> DataFrame:
    return hits(Reranker(_arms(r)[0], LateInteractionStrategy(MaxSimScorer(r.multivectors()))).search(r.query_multivectors(), 10))


@query
def rerank_filtered_maxsim(r: Roles) -> DataFrame:
    indexed = MaxSimScorer(r.multivectors().where("head[0] > 0.1875"))  # few documents have vectors, so most of the best hits follow as they were
    return hits(Reranker(_arms(r)[0], FilteredLateInteractionStrategy(indexed)).search(r.query_multivectors(), 10))


@query
def rerank_ngram_bm25(r: Roles) -> DataFrame:
    stats = r.stats()
    return _reranked(r, NgramBM25Strategy(stats), stats)


@query
def rerank_fused_ngram(r: Roles) -> DataFrame:
    stats = r.stats()
    return _reranked(r, FusedNgramStrategy(stats), stats)


@query
def rerank_sibling_expansion(r: Roles) -> DataFrame:
    stats = r.stats()
    return _reranked(r, SiblingExpansionStrategy(NgramBM25Strategy(stats), r.pid2did()), stats)


# ---- evaluation


def run_of(r: Roles, name: str) -> DataFrame:
    """Runs to compare: BM25 over words, over words and pairs, and frequencies without idf."""
    if name == "tf":
        return sparse_search(r, False, 100)
    return Bm25Searcher(r.stats(), 1 if name == "words" else 2).search(r.queries(), 100)


def _per_query(r: Roles, metrics: tuple[str, ...] = E.METRICS, name: str = "words") -> DataFrame:
    return E.query_metrics(E.build_run(run_of(r, name)), r.qrels(), metrics)


@query
def build_run(r: Roles) -> DataFrame:
    return hits(E.build_run(dedupe_by_document(Bm25Searcher(r.stats(), 1).search(r.queries(), 50), r.pid2did())))


@query
def eval_binary(r: Roles) -> DataFrame:
    return rounded(E.mean_metrics(_per_query(r)))


def _metric(name: str, metric: str) -> None:
    def one(r: Roles) -> DataFrame:
        return rounded(_per_query(r, (metric,), "tf").select("query_id", "value"))

    one.__name__ = name
    query(one)


for _name in ("ndcg", "recall", "mrr"):
    for _k in (10, 100):
        _metric(f"{_name}_at_{_k}", f"{_name}@{_k}")
for _name in ("map", "precision", "hits"):
    _metric(f"{_name}_at_10", f"{_name}@10")


@query
def running_metric(r: Roles) -> DataFrame:
    return rounded(E.running_means(_per_query(r, ("ndcg@10", "mrr@10"), "tf"), r.queries()))


@query
def sibling_qrels(r: Roles) -> DataFrame:
    return E.sibling_qrels(r.qrels(), r.pid2did())


@query
def eval_graded(r: Roles) -> DataFrame:
    return rounded(E.mean_metrics(E.query_metrics(E.build_run(run_of(r, "words")), E.sibling_qrels(r.qrels(), r.pid2did()))))


@query
def doc_level_diagnosis(r: Roles) -> DataFrame:
    return rounded(E.doc_level_diagnosis(Bm25Searcher(r.stats(), 1).search(r.queries(), 10), r.qrels(), r.pid2did()))


# ---- comparison


def _metrics_of(r: Roles, *names: str) -> DataFrame:
    """run, query_id, metric, value; written, as every comparison reads it several times."""
    out = None
    for n in names:
        one = _per_query(r, name=n).withColumn("run", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return staged(out, "metrics")


def _pairs(r: Roles) -> DataFrame:
    return S.paired(_metrics_of(r, "tf", "words"), "tf", "words")


@query
def pairwise_stats(r: Roles) -> DataFrame:
    """Ties are what wins and losses leave of 1, as they are shown."""
    return rounded(rounded(S.pair_summary(_pairs(r))).withColumn("tie", 1 - F.col("win") - F.col("loss")))


@query
def bootstrap_ci(r: Roles) -> DataFrame:
    return rounded(S.bootstrap_ci(_pairs(r)))


@query
def permutation_p(r: Roles) -> DataFrame:
    return rounded(S.permutation_p(_pairs(r)))


@query
def wilcoxon_z(r: Roles) -> DataFrame:
    return rounded(S.wilcoxon(_pairs(r)))


@query
def compare_all_pairs(r: Roles) -> DataFrame:
    return rounded(S.compare_all_pairs(_metrics_of(r, "tf", "words", "pairs")))


@query
def fisher_p(r: Roles) -> DataFrame:
    return rounded(S.fisher_p(_metrics_of(r, "tf", "words", "pairs")))


# ---- diagnostics


@query
def corpus_stats(r: Roles) -> DataFrame:
    return rounded(D.corpus_stats(r.documents()))


@query
def needs_chunking(r: Roles) -> DataFrame:
    return D.needs_chunking(D.corpus_stats(r.documents()))


@query
def word_stats(r: Roles) -> DataFrame:
    return rounded(D.word_stats(r.documents()))


@query
def did_to_pids(r: Roles) -> DataFrame:
    return D.did_to_pids(r.pid2did()).select("did", F.array_join("pids", ",").alias("pids"))


@query
def pid_did_orphans(r: Roles) -> DataFrame:
    known = r.table("documents").where("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("did"))
    return D.pid_orphans(r.passages(), r.pid2did().join(known, "did", "left_semi"))


@query
def sibling_pairs(r: Roles) -> DataFrame:
    return D.siblings_of_gold(r.qrels(), r.pid2did())


@query
def sibling_stats(r: Roles) -> DataFrame:
    return D.sibling_stats(r.qrels(), r.negatives(), r.pid2did())


@query
def sibling_examples(r: Roles) -> DataFrame:
    out = D.sibling_examples(r.qrels(), r.queries(), r.pid2did())
    return out.select("query_id", "q_ord", F.array_join("gold", ",").alias("gold"), F.array_join("siblings", ",").alias("siblings"))


@query
def sibling_example(r: Roles) -> DataFrame:
    sizes = r.pid2did().groupBy("did").agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("did", F.struct(F.col("n"), F.col("did"))).alias("did"), F.max("n").alias("n"))


@query
def entity_overlap(r: Roles) -> DataFrame:
    pool = D.pools(r.cited_qrels(), r.cited_negatives())
    return D.entity_overlap(r.cited_suppliers(), r.cited_parts(), pool)


@query
def entity_signal(r: Roles) -> DataFrame:
    return rounded(D.entity_signal(r.cited_qrels(), r.cited_negatives(), r.cited_suppliers(), r.cited_parts()))


def _ranks(r: Roles) -> DataFrame:
    stats = r.stats()
    return D.ngram_ranks(stats, r.qrels(), r.negatives(), r.queries())


@query
def ngram_signal(r: Roles) -> DataFrame:
    return rounded(D.ngram_signal(_ranks(r)))


@query
def ngram_arm_deltas(r: Roles) -> DataFrame:
    return rounded(D.ngram_arm_deltas(_ranks(r)))


@query
def rag_prompt(r: Roles) -> DataFrame:
    asked = rag.prompts(r.queries(), Bm25Searcher(r.stats(), 2).search(r.queries(), rag.TOP_K), r.passages())
    return asked.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.char_length("prompt").cast("bigint").alias("chars"), F.array_join("retrieved", ",").alias("retrieved"))
