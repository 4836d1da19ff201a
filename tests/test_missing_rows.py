"""Rows that one side lacks: passages without text, document or vectors, and texts that are null."""

import pytest

from sextant.operators import evaluate as E
from sextant.operators import rag
from sextant.operators.bm25 import NgramStats, SparseEncoder
from sextant.operators.rerank import LateInteractionStrategy, LexicalStrategy, PairScorerStrategy
from sextant.operators.search import MaxSimScorer

RUN = "query_id string, doc_id string, score double, rank int"


@pytest.fixture(scope="module")
def of(spark):
    return spark.createDataFrame([("g", "d1"), ("s", "d1")], "doc_id string, did string")


def test_unmapped_hits_and_labels(spark, of):
    gold = spark.createDataFrame([("q", "g", 1), ("r", "u", 1)], "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([("q", "x", 3.0, 1), ("q", "s", 2.0, 2), ("r", "u", 1.0, 1), ("other", "y", 1.0, 1)], RUN)
    with pytest.raises(Exception, match="no document for"):
        E.doc_level_rows(run, gold, of).collect()
    with pytest.raises(Exception, match="no document for labelled passage u"):
        E.doc_level_rows(run.limit(0), gold, of).collect()
    rows = E.doc_level_rows(run, gold, of, strict=False)
    assert {r.query_id: (r.outcome, r.precision) for r in rows.collect()} == {"q": ("sibling_only", 0.5), "r": ("exact", 0.0)}
    assert {r.outcome: r.query_ids for r in E.queries_by_outcome(rows).collect()} == {"sibling_only": ["q"], "exact": ["r"]}
    mapped = of.unionByName(spark.createDataFrame([("x", "d2"), ("u", "d3")], of.schema))
    assert E.doc_level_diagnosis(run, gold, mapped).first().mean_doc_precision == 0.75


def test_null_texts_are_documents(spark):
    corpus = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "two")], "query_id string, query string")
    stats = NgramStats.build(corpus, asked)
    assert stats.n_docs == 3 and stats.mean_tokens == pytest.approx(2 / 3)
    assert SparseEncoder().fit(corpus).mean_tokens == pytest.approx(2 / 3)
    assert [r.doc_id for r in stats.best([1, 2], 5).collect()] == ["a", "a"]


def test_passages_without_text(spark):
    corpus = spark.createDataFrame([("a", "good"), ("b", None)], "doc_id string, text string")
    hits = spark.createDataFrame([("q", "missing", 9.0, 1), ("q", "b", 8.0, 2), ("q", "a", 7.0, 3)], RUN)
    asked = spark.createDataFrame([("q", "good")], "query_id string, query string")
    logits = PairScorerStrategy(corpus, lambda q, t: [-1.0 if x else -5.0 for x in t]).rerank(asked, hits).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in logits] == [("a", -1.0), ("missing", -5.0), ("b", -5.0)]
    assert [r.doc_id for r in LexicalStrategy(corpus).rerank(asked, hits).orderBy("rank").collect()] == ["a", "missing", "b"]
    row = rag.prompts(asked, hits, corpus).first()
    assert row.retrieved == ["missing", "b", "a"] and "[doc_id: missing]\n\n\n[doc_id: b]\n\n\n[doc_id: a]\ngood" in row.prompt


def test_passages_without_vectors(spark):
    docs = spark.createDataFrame([("a", [[-1.0, 0.0]]), ("b", [[-0.5, 0.0]])], "doc_id string, vecs array<array<float>>")
    asked = spark.createDataFrame([("q", [[1.0, 0.0]])], "query_id string, vecs array<array<float>>")
    hits = spark.createDataFrame([("q", "none", 9.0, 1), ("q", "a", 8.0, 2), ("q", "b", 7.0, 3)], RUN)
    got = LateInteractionStrategy(MaxSimScorer(docs)).rerank(asked, hits).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [("b", -0.5), ("a", -1.0), ("none", -1.0)]
