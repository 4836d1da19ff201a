"""Late interaction over an index of centres against exhaustive MaxSim."""

import numpy as np
import pytest

from sextant.operators.late import LateIndex, LateSearcher
from sextant.operators.search import MaxSimSearcher
from sextant.plans.roles import Roles

SCHEMA = "doc_id string, vecs array<array<float>>"


def pairs(hits):
    return {(r.query_id, r.doc_id) for r in hits.collect()}


def test_embeddings(spark):
    """Vectors without clusters, eight to a document: the hardest case."""
    roles = Roles(spark, "/root/testdata/sf0.1")
    docs = roles.multivectors().cache()
    asked = docs.where("m % 10 = 0").withColumnRenamed("doc_id", "query_id")
    index = LateIndex.build(docs)
    exact = pairs(MaxSimSearcher(docs).search(asked, 10))
    got = LateSearcher(LateIndex.open(spark, index.path), docs).search(asked, 10)
    share = index.candidates(asked, 10).count() / (docs.count() * asked.count())
    assert len(pairs(got) & exact) / len(exact) >= 0.9
    assert share <= 0.36  # documents that are scored: ninety of 250, ninety of any number


def test_clusters(spark):
    rng = np.random.default_rng(3)
    topics = rng.standard_normal((20, 4, 16))
    rows = [(str(i), (topics[i % 20] + 0.2 * rng.standard_normal((4, 16))).tolist()) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = docs.where("cast(doc_id as int) < 10").withColumnRenamed("doc_id", "query_id")
    index = LateIndex.build(docs)
    exact = pairs(MaxSimSearcher(docs).search(asked, 10))
    assert len(pairs(LateSearcher(index, docs, probed=0.02, oversample=2).search(asked, 10)) & exact) / len(exact) >= 0.9
    assert index.estimates(asked, probed=0.02).count() <= 0.3 * 400 * 10  # most documents are in none of the lists


def test_edges(spark):
    docs = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 1.0]]), ("b", []), ("c", None), ("d", [[0.0, 0.0], [0.0, 3.0]])], SCHEMA)
    asked = spark.createDataFrame([("q", [[0.0, 1.0], [0.0, 0.0]]), ("none", []), ("null", None)], "query_id string, vecs array<array<float>>")
    got = LateSearcher(LateIndex.build(docs), docs, probed=1.0).search(asked, 5).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [("q", "d", 3.0), ("q", "a", 1.0)]
    empty = LateIndex.build(docs.limit(0))
    assert LateSearcher(empty, docs).search(asked, 5).count() == 0 and LateIndex.open(spark, empty.path).centres.shape[0] == 0
    assert pytest.approx(1.0) == np.linalg.norm(LateIndex.build(docs).centres, axis=1).max()


def test_the_depth_of_candidates_is_measured(spark):
    """Where estimates say little (one centre alone), nine candidates for a hit are not enough; the depth follows from sampled queries."""
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(str(i), rng.standard_normal((2, 16)).tolist()) for i in range(400)], SCHEMA)
    asked = docs.where("cast(doc_id as int) < 12").withColumnRenamed("doc_id", "query_id")
    index = LateIndex.build(docs, cells=1)
    exact = pairs(MaxSimSearcher(docs).search(asked, 5))
    assert len(pairs(LateSearcher(index, docs, oversample=9).search(asked, 5)) & exact) / len(exact) < 0.9
    assert len(pairs(LateSearcher(index, docs).search(asked, 5)) & exact) / len(exact) >= 0.9
