"""The cell index against exact search: recall, how much it reads, folders that it opens, and edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import cells
from sextant.operators.cells import CellIndex
from sextant.operators.search import DenseSearcher

SF = "/root/testdata"


def vectors(spark, m):
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m.astype(np.float32))], "doc_id string, vec array<float>").repartition(3)


def pairs(hits):
    return {(r.query_id, r.doc_id) for r in hits.collect()}


def recall_of(index, docs, q, **how):
    got, exact = pairs(index.search(q, 10, **how)), pairs(DenseSearcher(docs).search(q, 10))
    return len(got & exact) / len(exact)


def test_embeddings(spark):
    """These vectors have no clusters: the hardest case.  A larger table is read in a smaller part."""
    reads = []
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"{SF}/{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vec"))
        q = docs.where("cast(doc_id as int) % 20 = 0").withColumnRenamed("doc_id", "query_id")
        index = CellIndex.build(docs)
        assert index.cells.n.sum() == docs.count()
        assert recall_of(index, docs, q) >= 0.9
        assert 0 < index.reads < 0.25
        reads.append(index.reads)
    assert reads[1] < 0.8 * reads[0]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    docs = vectors(spark, centres[np.arange(1200) % 40] + 0.3 * rng.standard_normal((1200, 32)))
    return docs, CellIndex.build(docs, shelves=12)


def test_clusters_are_read_in_small_part(spark, clustered, monkeypatch):
    docs, index = clustered
    q = docs.where("cast(doc_id as int) % 100 = 0").withColumnRenamed("doc_id", "query_id")
    assert recall_of(index, docs, q) >= 0.9 and index.reads < 0.05
    assert recall_of(index, docs, q, recall=0.98) >= 0.97 and index.reads < 0.1
    again = CellIndex.open(spark, index.path)
    listed = lambda hits: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in hits.collect())
    whole = listed(again.search(q))
    monkeypatch.setattr(cells, "QUERY_BLOCK", 3)  # block by block
    assert listed(again.search(q)) == whole


def test_other_folders_are_not_opened(spark, clustered):
    docs, index = clustered
    one = docs.where("doc_id = '100'").select(F.col("doc_id").alias("query_id"), "vec")
    chosen = index._choose(one, 10, 0.92).toArrow()
    wanted = np.flatnonzero(np.unpackbits(np.frombuffer(chosen["read"][0].as_buffer(), np.uint8), count=len(index.shelf)))
    rows = index.vectors(wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and re.search(r"PartitionFilters: \[[^\]]*shelf", plan)
    files = {r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    every = spark.read.parquet(f"{index.path}/vectors").select(F.input_file_name().alias("f")).distinct().count()
    assert len(files) <= every / 3


def test_more_is_read_where_the_estimate_fails(clustered):
    """Low scores in the cells that were read send the search on, high ones end it."""
    own = clustered[1].cells
    q = own.centres[:5]
    read = own.chosen(q, 10, 0.9)
    assert read.any(axis=1).all() and not read.all()
    more = own.chosen(q, 10, 0.9, read, np.full((5, 10), -1.0))
    assert more.any(axis=1).all() and not (more & read).any()
    assert not own.chosen(q, 10, 0.9, read, np.full((5, 10), 0.9999)).any()


def test_one_vector_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "FILE_ROWS", 50)
    rng = np.random.default_rng(1)
    m = rng.standard_normal((600, 8))
    m[::3] = m[0]
    docs = vectors(spark, m)
    index = CellIndex.build(docs)
    assert index.cells.n.sum() == 600 and index.cells.n.max() >= 200
    got = index.search(vectors(spark, m[:1]).withColumnRenamed("doc_id", "query_id"), 250).collect()
    assert {r.doc_id for r in got if r.score > 0.999999} == {str(i) for i in range(0, 600, 3)}


def test_edges(spark):
    schema = "doc_id string, vec array<float>"
    none = CellIndex.build(spark.createDataFrame([], schema))
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "query_id string, vec array<float>")
    assert none.search(asked).count() == 0
    few = CellIndex.build(spark.createDataFrame([("x", [1.0, 0.0]), ("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", None), ("w", [0.0, -2.0])], schema))
    got = few.search(asked, 10).collect()
    assert [(r.query_id, r.doc_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank)] == [("a", "x", 1.0), ("a", "x", 1.0), ("a", "w", 0.0)]
    assert few.search(asked.limit(0)).count() == 0
