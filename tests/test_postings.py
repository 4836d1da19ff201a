"""The stored index against exhaustive search, on queries that it was not built for."""

import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import postings
from sextant.operators.bm25 import NgramStats, SparseEncoder
from sextant.operators.postings import PostingsIndex
from sextant.operators.search import SparseSearcher

SF = "/root/testdata/sf0.01"


def listed(hits):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in hits.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text").cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    built = PostingsIndex.of_corpus(corpus)
    return PostingsIndex.open(spark, built.path)


@pytest.fixture(scope="module")
def queries(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    odd = spark.createDataFrame([("none", "zzzz qqqq"), ("empty", ""), ("null", None), ("common", "the of the")], "query_id string, query string")
    return items.unionByName(odd)


@pytest.mark.parametrize("limit", [3, 10, 2000])
def test_as_exhaustive_search(corpus, index, queries, limit):
    want = NgramStats.build(corpus, queries).best([2], limit)
    got = index.search(queries, limit)
    assert listed(got) == listed(want)
    assert not got.where("query_id in ('none', 'empty', 'null')").count()


def test_fewer_postings(index, queries):
    """Passages of these documents are the queries, so the best hit stands out; the tenth is like a hundred others."""
    asked = queries.where("query_id <> 'common'")
    assert index.scored_share(asked, 10) < 0.6 and index.scored_share(asked, 1) < 0.25


def test_only_folders_of_the_terms(spark, index, queries):
    weighted = index.weighted(spark.createDataFrame([("q", "the", 1.0)], "query_id string, term string, weight double"))
    plan = index.bounds(weighted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters" in plan and not re.search(r"ReadSchema: struct<[^>]*docs", plan)


def test_sparse_slots(corpus, queries):
    """An index of given terms: saturated frequencies by hash, as the sparse encoder makes them."""
    enc = SparseEncoder(1).fit(corpus)
    encoded = enc.encode_documents(corpus)
    n = corpus.count()
    stored = PostingsIndex.build(encoded.select("doc_id", F.col("idx").alias("term"), "val"), n)
    asked = enc.encode_queries(queries)
    for with_idf in (True, False):
        want = SparseSearcher(encoded, n, enc, with_idf).search(queries, 10)
        got = stored.search_terms(asked.select("query_id", F.col("idx").alias("term"), F.col("val").alias("weight")), 10, with_idf)
        assert listed(got) == listed(want)
    with pytest.raises(ValueError, match="searched by terms"):
        stored.search(queries)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(postings, "FILE_BLOCKS", 5)
    asked = spark.createDataFrame([("q", "same words")], "query_id string, query string")
    schema = "doc_id string, text string"
    none = PostingsIndex.of_corpus(spark.createDataFrame([], schema))
    assert none.search(asked).count() == 0
    ties = spark.createDataFrame([(f"{i:03}", "same words") for i in range(100)] + [("null", None), ("empty", "")], schema)
    got = PostingsIndex.of_corpus(ties).search(asked, 7)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [f"{i:03}" for i in range(7)]


def test_no_posting_is_shuffled(spark, corpus, queries, index, monkeypatch):
    """Segments are written where they are made; searches by arrays and by bounds agree."""
    got = listed(index.search(queries, 10))
    monkeypatch.setattr(postings, "BROADCAST_GRAMS", 0)
    assert got == listed(index.search(queries, 10))
    monkeypatch.setattr(postings, "SEGMENT_TOKENS", 20_000)
    monkeypatch.setattr(postings, "staged", None)  # nothing is written besides the index
    built = PostingsIndex.of_corpus(corpus)
    files = spark.read.parquet(f"{built.path}/blocks").withColumn("f", F.input_file_name())
    owners = files.groupBy("grp").agg(F.count_distinct(F.regexp_extract("f", r"part-(\d+)", 1)).alias("tasks"))
    assert files.select("f").distinct().count() > 3 * postings.BUCKETS and owners.agg(F.max("tasks")).first()[0] == 1
    assert owners.count() >= corpus.where("text rlike '[a-z]'").count() // postings.GROUP_DOCS
    monkeypatch.undo()
    assert got == listed(built.search(queries, 10))
    twice = PostingsIndex.of_corpus(corpus.limit(50).unionByName(corpus.limit(1)))
    asked = queries.limit(5)
    assert listed(twice.search(asked, 10)) == listed(NgramStats.build(corpus.limit(50).unionByName(corpus.limit(1)), asked).best([2], 10))
