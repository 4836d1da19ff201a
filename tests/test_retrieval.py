"""BM25, search, fusion and rerank strategies against hand-checked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions.vectors import cosine
from sextant.operators import search
from sextant.operators.ann import HyperplaneIndex
from sextant.operators.bm25 import NgramStats, SparseEncoder, gram_total
from sextant.operators.ranking import dbsf, dedupe_by_document, rrf, top_k
from sextant.operators.rerank import FilteredLateInteractionStrategy, FusedNgramStrategy, LexicalStrategy, NgramBM25Strategy, PairScorerStrategy, Reranker, ServiceStrategy, SiblingExpansionStrategy
from sextant.operators.search import Bm25Searcher, DenseSearcher, HybridRerankSearcher, HybridSearcher, MaxSimScorer, MaxSimSearcher, SparseSearcher, UniqueDocSearcher

CORPUS = [("d1", "the court held that the statute is void"), ("d2", "the statute is void for vagueness"), ("d3", "a contract requires consideration"), ("d4", "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id string, text string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q", "the statute is void", 0)], "query_id string, query string, q_ord long")


@pytest.fixture(scope="module")
def stats(corpus, queries):
    return NgramStats.build(corpus, queries)


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def order(df):
    return [r.doc_id for r in df.orderBy("query_id", "rank").collect()]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank int")


def test_bm25(stats):
    assert (stats.n_docs, stats.mean_tokens, stats.avgdl(2)) == (4, 4.5, 8.0)
    assert scores(stats.score(1)) == {"d1": 2.332495, "d2": 2.410947}
    assert scores(stats.score(2)) == {"d1": 3.756799, "d2": 4.151470}
    assert {round(r.idf, 6) for r in stats.idf_table().collect()} == {0.693147}


def test_default_idf_and_negative_length(spark, corpus):
    q = spark.createDataFrame([("q", "unseen words")], "query_id string, query string")
    assert {round(r.idf, 6) for r in NgramStats.build(corpus, q).idf_table().collect()} == {round(math.log(1 + 4.5 / 0.5), 6)}
    assert spark.range(1).select(gram_total(F.lit(0), 2)).first()[0] == -1


def test_sparse_encoder(corpus, queries):
    enc = SparseEncoder(1).fit(corpus)
    with pytest.raises(ValueError):
        SparseEncoder().encode_grams(corpus)
    rows = {(r.doc_id, r.gram): r.val for r in enc.encode_grams(corpus).collect()}
    norm = 1.5 * (0.25 + 0.75 * 8 / 4)  # the mean 4.5 is rounded to the even 4
    assert round(rows["d1", "the"], 9) == round(2 * 2.5 / (2 + norm), 9)
    got = SparseSearcher(enc.encode_documents(corpus), 4, enc).search(queries, 10)
    assert order(got) == ["d2", "d1"]


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid", "manhattan"])
def test_dense(spark, distance):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 5)).astype(np.float32)
    docs = spark.createDataFrame([(f"{i:02}", m[i].tolist()) for i in range(60)], "doc_id string, vec array<float>").repartition(4)
    q = spark.createDataFrame([(str(i), m[i].tolist()) for i in (3, 7)], "query_id string, vec array<float>")
    got = DenseSearcher(docs, distance=distance).search(q, 5)
    m = m.astype(np.float64)
    for i in (3, 7):
        s = {"cosine": m @ m[i] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[i]), "dot": m @ m[i], "euclid": -np.linalg.norm(m - m[i], axis=1), "manhattan": -np.abs(m - m[i]).sum(1)}[distance]
        want = [f"{j:02}" for j in np.lexsort((np.arange(60), -np.round(s, 6)))[:5]]
        assert [r.doc_id for r in got.where(F.col("query_id") == str(i)).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        DenseSearcher(docs, distance="hamming")


def test_ann_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    m = (centres[np.arange(900) % 30] + 0.3 * rng.standard_normal((900, 32))).astype(np.float32)
    docs = spark.createDataFrame([(str(i), m[i].tolist()) for i in range(900)], "doc_id string, vec array<float>")
    q = docs.where("cast(doc_id as int) % 100 = 0").withColumnRenamed("doc_id", "query_id")
    found = {(r.query_id, r.doc_id) for r in HyperplaneIndex(docs, 32).search(q, 10).collect()}
    exact = {(r.query_id, r.doc_id) for r in DenseSearcher(docs).search(q, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_fusion(spark):
    a = hits(spark, [("q", "x", 9.0, 1), ("q", "y", 5.0, 2)])
    b = hits(spark, [("q", "y", 0.3, 1), ("q", "z", 0.1, 2)])
    assert scores(rrf([a, b], 60, 1)) == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6), "z": round(1 / 62, 6)}
    again = rrf([a.withColumn("score", F.col("score") * 7 + 1), b], 60, 1)  # ranks are all that counts
    assert scores(again) == scores(rrf([a, b], 60, 1))
    assert set(scores(dbsf([a, b]))) == {"x", "y", "z"}


def test_hybrid_guards(stats):
    with pytest.raises(ValueError):
        HybridSearcher([Bm25Searcher(stats)])
    with pytest.raises(ValueError):
        HybridSearcher([Bm25Searcher(stats)] * 2, "sum")
    with pytest.raises(ValueError):
        HybridRerankSearcher([], None)


def test_dedupe(spark):
    h = hits(spark, [("q", "p1", 3.0, 1), ("q", "p2", 2.0, 2), ("q", "p3", 1.0, 3)])
    of = spark.createDataFrame([("p1", "d1"), ("p2", "d1"), ("p3", "d2")], "doc_id string, did string")
    once = dedupe_by_document(h, of, 2)
    assert order(once) == ["p1", "p3"]
    assert order(dedupe_by_document(once.select("query_id", "doc_id", "score", "rank"), of, 2)) == ["p1", "p3"]
    with pytest.raises(Exception, match="no document for passage p3"):
        dedupe_by_document(h, of.where("doc_id <> 'p3'"), strict=True).collect()


def test_fused_ngram(spark, stats, monkeypatch):
    h = hits(spark, [("q", d, 1.0 - i / 10, i + 1) for i, d in enumerate("abcd")])
    ng = {"a": 0.0, "b": 5.0, "c": 0.0, "d": 7.0}
    rows = spark.createDataFrame([("q", d, s) for d, s in ng.items()], "query_id string, doc_id string, score double")
    monkeypatch.setattr(NgramStats, "score", lambda self, order=None, pool=None: rows)
    got = FusedNgramStrategy(stats).rerank(None, h)
    assert order(got) == ["a", "b", "d", "c"]
    assert {r.doc_id: round(r.score, 8) for r in got.collect()} == {"a": 0.03226646, "b": 0.03225806, "d": 0.03201844, "c": 0.03149802}


def test_strategies_keep_all_hits(spark, stats, corpus, queries):
    h = hits(spark, [("q", "d4", 4.0, 1), ("q", "d3", 3.0, 2), ("q", "d2", 2.0, 3), ("q", "d1", 1.0, 4)])
    assert order(NgramBM25Strategy(stats).rerank(queries, h)) == ["d2", "d1", "d4", "d3"]  # no evidence: incoming order
    assert order(LexicalStrategy(corpus).rerank(queries, h)) == ["d2", "d1", "d4", "d3"]
    length = PairScorerStrategy(corpus, lambda q, t: [float(len(x)) for x in t])
    assert order(length.rerank(queries, h)) == ["d1", "d3", "d2", "d4"]
    with pytest.raises(Exception, match="4 pairs, 0 scores"):
        PairScorerStrategy(corpus.coalesce(1), lambda q, t: []).rerank(queries, h.coalesce(1)).collect()
    assert order(Reranker(Bm25Searcher(stats, 1), NgramBM25Strategy(stats)).search(queries, 1)) == ["d2"]


def test_filtered_maxsim_appends_the_rest(spark):
    docs = spark.createDataFrame([("a", [[1.0, 0.0]]), ("c", [[0.0, 1.0]])], "doc_id string, vecs array<array<float>>")
    q = spark.createDataFrame([("q", [[0.0, 1.0]])], "query_id string, vecs array<array<float>>")
    h = hits(spark, [("q", "a", 9.0, 1), ("q", "b", 8.0, 2), ("q", "c", 7.0, 3)])
    got = FilteredLateInteractionStrategy(MaxSimScorer(docs)).rerank(q, h)
    assert [(r.doc_id, r.score) for r in got.orderBy("rank").collect()] == [("c", 1.0), ("a", 0.0), ("b", 8.0)]


def test_sibling_expansion(spark, stats, corpus, queries):
    of = spark.createDataFrame([("d1", "A"), ("d2", "A"), ("d3", "B"), ("d4", "B")], "doc_id string, did string")
    h = hits(spark, [("q", "d1", 2.0, 1), ("q", "d3", 1.0, 2)])
    strategy = SiblingExpansionStrategy(NgramBM25Strategy(stats), of)
    assert {(r.doc_id, r.expanded_from, r.score) for r in strategy.expand(h).collect()} == {("d1", None, 2.0), ("d2", "d1", 2.0), ("d3", None, 1.0), ("d4", "d3", 1.0)}
    assert order(strategy.rerank(queries, h)) == ["d2", "d3"]
    assert order(UniqueDocSearcher(Bm25Searcher(stats, 2), of).search(queries, 3)) == ["d2"]


@pytest.mark.parametrize("sf,most", [("sf0.01", 0.17), ("sf0.1", 0.05)])
def test_ann_recall_on_the_table(spark, sf, most):
    """Its own table: vectors without clusters, the hard case."""
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("cast(vec_id as string) doc_id", "embedding vec", "vec_id").cache()
    q = v.where("vec_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    index = HyperplaneIndex(v, 64)
    exact = {(r.query_id, r.doc_id) for r in DenseSearcher(v).search(q, 10).collect()}
    found = {(r.query_id, r.doc_id) for r in index.search(q, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    assert index.candidates(q).count() <= most * v.count() * q.count()


def test_vectors_of_zeros(spark):
    rows = [(f"z{i:02}", [0.0, 0.0]) for i in range(30)] + [("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("n", None)]
    docs = spark.createDataFrame(rows, "doc_id string, vec array<float>").coalesce(1)
    got = DenseSearcher(docs).search(spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vec array<float>"), 3)
    assert [r.doc_id for r in got.where("query_id = 'q'").orderBy("rank").collect()] == ["a", "b", "z00"]
    assert {r.score for r in got.where("query_id = 'z'").collect()} == {0.0}
    assert docs.select(cosine(F.col("vec"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).where("s = 0").count() == 30


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((70, 4, 3)).round(2)
    docs = spark.createDataFrame([(f"{i:02}", m[i].tolist(), m[i, 0].tolist()) for i in range(70)], "doc_id string, vecs array<array<float>>, vec array<float>").repartition(3)
    q = docs.where("doc_id < '20'").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.doc_id, r.rank, round(r.score, 5)) for r in df.collect())
    searchers = [DenseSearcher(docs), DenseSearcher(docs, distance="manhattan"), MaxSimSearcher(docs)]
    whole = [rows(s.search(q, 4)) for s in searchers]
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "CELL_QUERIES", 8)
    monkeypatch.setattr(search, "_HELD_SCORES", 60)
    assert [rows(s.search(q, 4)) for s in searchers] == whole
    pairs = q.select("query_id").crossJoin(docs.select("doc_id"))
    assert whole[2] == rows(top_k(MaxSimScorer(docs).score(q, pairs), 4))


def test_payload_of_hits(spark):
    h = hits(spark, [("q", "1", 3.0, 1), ("q", "2", 2.0, 2), ("q", "9", 1.0, 3)])
    points = spark.createDataFrame([(1, "text one", "p1", 5), (2, None, None, 6)], "id long, text string, doc_id string, year int")
    got = {r["rank"]: r for r in search.with_payload(h, points, "id").collect()}
    assert [(got[i].doc_id, got[i].text) for i in (1, 2, 3)] == [("p1", "text one"), ("2", ""), ("9", "")]
    assert got[1].payload.year == 5 and got[3].payload is None


def test_hits_without_a_document(spark, stats, queries):
    of = spark.createDataFrame([("p2", "B")], "doc_id string, did string")
    h = hits(spark, [("q", "p1", 3.0, 1), ("q", "p2", 2.0, 2)])
    with pytest.raises(Exception, match="no document for passage p1"):
        dedupe_by_document(h, of, 5).collect()
    assert order(dedupe_by_document(h, of, 5, strict=False)) == ["p1", "p2"]
    strategy = SiblingExpansionStrategy(NgramBM25Strategy(stats), of, strict=False)
    assert order(strategy.rerank(queries, h)) == ["p1", "p2"]
    with pytest.raises(Exception, match="no document for passage p1"):
        SiblingExpansionStrategy(NgramBM25Strategy(stats), of).rerank(queries, h).collect()


def test_service_strategy(spark, corpus, queries):
    h = hits(spark, [("q", "d1", 4.0, 1), ("q", "d3", 3.0, 2), ("q", "gone", 2.0, 3)])
    post = lambda model, query, texts: (200, [{"index": i, "relevance_score": len(texts[i]) + len(query) / 100} for i in reversed(range(len(texts)))])
    assert [(r.doc_id, r.score) for r in ServiceStrategy(corpus, "m", post).rerank(queries, h).orderBy("rank").collect()] == [("d1", 39.19), ("d3", 33.19), ("gone", 0.19)]
    with pytest.raises(Exception, match="3 passages, 1 scores"):
        ServiceStrategy(corpus, "m", lambda m, q, t: (200, [{"index": 0, "relevance_score": 1.0}])).rerank(queries, h).collect()


def test_sparse_postings_in_one_pass(spark, corpus, queries):
    wanted = queries.selectExpr("query_id", "explode(split(query, ' ')) gram")
    enc, postings, n = SparseEncoder(1).fit_postings(corpus, wanted)
    whole = {(r.doc_id, r.gram): r.val for r in enc.encode_grams(corpus).collect()}
    asked = {r.gram for r in wanted.collect()}
    assert n == 4 and enc.mean_tokens == 4.5 and {(r.doc_id, r.gram): r.val for r in postings.collect()} == {k: v for k, v in whole.items() if k[1] in asked}


def test_counted_where_documents_are(spark, monkeypatch):
    """Lists per document: no join of grams, no rows of query and document; as with joins and groups, and as plain sums in small pieces."""
    texts = [(f"d{i}", " ".join(f"w{j % 7}." if j % 3 else f"W{i % 5}" for j in range(i))) for i in range(40)] + [("empty", ""), ("null", None), ("odd", "(w1) w1... §w2 Kw3")]
    corpus = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([("a", "w1 w2 w1 w3"), ("b", "w3 w4 kw3"), ("c", "none such"), ("d", None)], "query_id string, query string")
    lists = NgramStats.build(corpus, asked)
    assert lists.held is not None
    plan = lists.held._jdf.queryExecution().executedPlan().toString() + lists._best_in_tasks([1, 2], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr("sextant.operators.accumulate._HELD_ENTRIES", 7)
    seen = lambda df: sorted((r.n, r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    few, gold = seen(lists.best([1, 2], 5)), lists.best([1], 3).select("query_id", "doc_id")
    without = seen(lists.best([1], 5, without=gold))
    rows = lambda df: sorted((r.doc_id, r.gram, r.n, r.tf, r.n_tokens) for r in df.collect())
    counted, saturated = rows(lists.postings), [(r.query_id, r.doc_id, round(r.score, 9)) for r in lists.best_saturated(4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr("sextant.operators.bm25.BROADCAST_GRAMS", 0)
    joins = NgramStats.build(corpus, asked)
    assert joins.held is None and counted == rows(joins.postings) and few == seen(joins.best([1, 2], 5)) and without == seen(joins.best([1], 5, without=gold))
    postings = SparseEncoder.of_stats(joins)[1].withColumnRenamed("gram", "idx")
    old = SparseSearcher(postings, joins.n_docs).search_encoded(joins.wanted.selectExpr("query_id", "gram idx", "1.0D val"), 4)
    assert saturated == [(r.query_id, r.doc_id, round(r.score, 9)) for r in old.orderBy("query_id", "rank").collect()]
    monkeypatch.undo()
    twice = NgramStats.build(corpus.unionByName(corpus.where("doc_id = 'd20'")), asked)
    assert twice.held is None  # documents of one id are added up
    assert {r.tf for r in twice.postings.where("doc_id = 'd20' and gram = 'w1'").collect()} == {2 * t for d, g, _, t, _ in counted if (d, g) == ("d20", "w1")}


def test_all_grams_are_counted_without_a_shuffle(corpus):
    enc = SparseEncoder().fit(corpus)
    encoded = enc.encode_grams(corpus)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    twice = enc.encode_grams(corpus.unionByName(corpus.where("doc_id = 'd2'")))
    assert twice.count() == encoded.count()  # documents of one id are added up
    assert scores(twice.where("gram = 'the_statute'").withColumnRenamed("val", "score"))["d2"] > scores(encoded.where("gram = 'the_statute'").withColumnRenamed("val", "score"))["d2"]


def test_documents_are_hashed_without_a_shuffle(spark, corpus):
    """Grams of one hash (plumless, buckeroo) are one index with both values; the same from documents as from grouped rows."""
    texts = corpus.unionByName(spark.createDataFrame([("odd", "Plumless buckeroo buckeroo §2"), ("none", None)], "doc_id string, text string"))
    enc = SparseEncoder().fit(texts)
    encoded = enc.encode_documents(texts)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: {(r.doc_id, r.idx): round(r.val, 9) for r in df.collect()}
    grams = enc.encode_grams(texts)
    got = rows(encoded)
    assert got == rows(grams.groupBy("doc_id", F.crc32(F.encode("gram", "UTF-8")).alias("idx")).agg(F.sum("val").alias("val")))
    odd = {r.gram: r.val for r in grams.where("doc_id = 'odd'").collect()}
    assert got["odd", 1306201125] == round(odd["plumless"] + odd["buckeroo"], 9) and len([d for d, _ in got if d == "odd"]) == len(odd) - 2  # and both words before buckeroo
    twice = rows(enc.encode_documents(texts.unionByName(texts.where("doc_id = 'd2'"))))
    assert twice.keys() == got.keys() and all((v > got[k]) == (k[0] == "d2") for k, v in twice.items())
    with pytest.raises(ValueError):
        SparseEncoder().encode_documents(texts)


def test_sparse_encode_docs_is_by_hash(spark, tmp_path):
    """The registered query goes through hashes, as does its SQL: two words of one hash are one index."""
    import duckdb

    from sextant.plans.oracle import ORACLE
    from sextant.plans.queries import QUERIES

    spark.createDataFrame([(1, "plumless buckeroo buckeroo"), (2, "plumless plumless §2 b"), (3, ""), (4, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["sparse_encode_docs"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert [(d, n) for d, n, _, _ in got] == [("1_0", 2), ("2_0", 6)]  # plumless and buckeroo, alone and before buckeroo
    assert got == sorted(duck.execute(ORACLE["sparse_encode_docs"]).fetchall())


def test_a_task_holds_few_hits_of_each_query():
    """What is held does not grow with the documents (8,000 of each slice's hits were kept before), and it is what sorting all gives."""
    from sextant.operators.ranking import BestSoFar, best_places

    rng = np.random.default_rng(5)
    names, scores = np.array([f"d{i:05d}" for i in rng.permutation(20_000)], dtype=object), np.round(rng.random((20_000, 40)), 3)  # many ties
    scores[rng.random(scores.shape) < 0.2] = np.nan
    best, most = BestSoFar(40, 20), 0
    for at in range(0, len(names), 100):
        for first in (0, 25):
            best.add(names[at : at + 100], scores[at : at + 100, first : first + (25 if not first else 15)], first)
            most = max(most, best.size)
    q, d, s = best.taken()
    at, of = best_places(names, scores, 20)
    assert sorted(zip(q, d, s)) == sorted(zip(of, names[at], scores[at, of])) and most <= 25_000


def test_more_queries_than_a_block_are_searched_alike(spark, monkeypatch):
    """Groups that meet groups give what one block gives, by every operator that searches in blocks."""
    from sextant.operators import search
    from sextant.operators.late import LateIndex

    rng = np.random.default_rng(6)
    rows = [(str(i), v.tolist(), m.tolist()) for i, (v, m) in enumerate(zip(rng.standard_normal((300, 16)), rng.standard_normal((300, 3, 16))))]
    docs = spark.createDataFrame(rows, "doc_id string, vec array<float>, vecs array<array<float>>")
    asked = docs.where("cast(doc_id as int) < 40").withColumnRenamed("doc_id", "query_id")
    index = LateIndex.build(docs, cells=30)
    ways = (lambda: HyperplaneIndex(docs, 16).search(asked, 5), lambda: DenseSearcher(docs).search(asked, 5), lambda: search.MaxSimSearcher(docs).search(asked, 5), lambda: index.candidates(asked, 5), lambda: index.estimates(asked))
    found = lambda: [sorted(tuple(r[:2]) for r in way().collect()) for way in ways]
    before = found()
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "CELL_QUERIES", 15)
    monkeypatch.setattr(search, "CELL_BYTES", 1000)
    assert found() == before and all(before)


def test_late_candidates_make_no_rows_of_vectors_and_documents(spark):
    """Rows that are shuffled for candidates are hits of tasks: there was one for each query, vector and document."""
    from sextant.operators.late import LateIndex

    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(str(i), rng.standard_normal((4, 16)).tolist()) for i in range(200)], "doc_id string, vecs array<array<float>>")
    asked = docs.where("cast(doc_id as int) < 5").withColumnRenamed("doc_id", "query_id")
    plan = LateIndex.build(docs).candidates(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_a_pool_is_searched_once(spark, corpus, queries):
    """What strategies read several times is written: the postings were scored again for each of these reads."""
    more = queries.unionByName(spark.createDataFrame([("r", "a contract", 1)], queries.schema))
    stats = NgramStats.build(corpus, more)
    of = corpus.select("doc_id", F.col("doc_id").alias("did"))
    for strategy in (LexicalStrategy(corpus), NgramBM25Strategy(stats), FusedNgramStrategy(stats), SiblingExpansionStrategy(NgramBM25Strategy(stats), of)):
        got = Reranker(Bm25Searcher(stats, 1), strategy).search(more, 3)
        assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.query_id, r.doc_id) for r in got.where("rank = 1").collect()} >= {("r", "d3")}


def test_wanted_grams_of_many_documents_at_once():
    """Against counting each document's grams one by one; grams do not reach from a document into the next."""
    from sextant.operators.counts import WantedGrams

    rng = np.random.default_rng(4)
    for _ in range(60):
        docs = [rng.choice(list("abcde"), rng.choice([0, 1, 2, 3, 20])).tolist() for _ in range(rng.integers(0, 6))]
        wanted = sorted({("_".join(rng.choice(list("abcx"), n)), int(n)) for n in rng.integers(1, 4, rng.integers(0, 12))})
        bounds, terms, tfs = WantedGrams(wanted).count(docs)
        for i, d in enumerate(docs):
            expected = {p: sum("_".join(d[j : j + n]) == g for j in range(len(d) - n + 1)) for p, (g, n) in enumerate(wanted)}
            assert dict(zip(terms[bounds[i] : bounds[i + 1]].tolist(), tfs[bounds[i] : bounds[i + 1]].tolist())) == {p: tf for p, tf in expected.items() if tf}


def test_passages_are_cut_at_ascii_blanks_alone(spark, tmp_path):
    from sextant.plans.roles import Roles

    texts = [None, "", " \t\n\r\f ", " a\tb\nc\rd\fe ", "a b c\x0bd \x1ce", "😀 " * 351, "x  " * 700, "y " * 701]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one 😀 😀 two"), (2, "b c d"), (3, "y y y"), (4, "x x"), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = Roles(spark, str(tmp_path))
    expected = []
    for i, t in enumerate(texts):
        w = [x for x in __import__("re").findall(r"[^ \t\n\r\f]+", t or "")]
        expected += [(f"{i}_{c // 350}", str(i), " ".join(w[c : c + 350])) for c in range(0, len(w), 350)]
    assert sorted(tuple(x) for x in r.passages().collect()) == sorted(expected)
    gold = {(x.query_id, x.doc_id) for x in r.qrels().collect()}
    assert gold == {(str(q), d) for q, text in ((2, "b c d"), (3, "y y y"), (4, "x x")) for d, _, p in expected if text in p} and len(gold) >= 5
