"""Candidates for late interaction: token vectors by nearest centre, and MaxSim on what these bring up.

Centres are fitted on a bounded sample of all documents' vectors (`SAMPLE_ROWS` of the cell index); a document is indexed by the centres of its
vectors, each once with its greatest length, a few dozen bytes.  A query's vector looks at its best centres; a document's
estimate is the sum, over the query's vectors, of the best centre that brought it up.  The best estimates are scored exactly.

Estimates are made in arrays, by the blocks of the exact search, and a task keeps the best of each query: no row is made of a query, its
vector and a document.

Documents without vectors are not indexed; a vector of zeros has no centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import place, staged
from .cells import MOST_CELLS, SAMPLE_ROWS, _nearest_centre, fit_centres
from .ranking import top_k
from .search import MaxSimScorer, MaxSimSearcher, _firsts, _flat, _nearest, _unit, needed_oversample

#: Vectors of a centre while these are few, and the share of all centres that a query's vector looks at.
LIST_ROWS, PROBED = 2, 0.3


@dataclass
class LateIndex:
    """Documents (doc_id, cells, sizes) and centres in a folder; documents keep their vectors elsewhere."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    @classmethod
    def build(cls, docs: DataFrame, vecs: str = "vecs", path: str | None = None, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> LateIndex:
        """Indexes the vectors of documents (doc_id, vecs)."""
        spark = docs.sparkSession
        path = path or place(spark, "late")
        tokens = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(vecs).alias("vec")).where(F.exists("vec", lambda v: v != 0))
        total = tokens.count()
        sample = tokens.orderBy(F.xxhash64("doc_id", "vec"), "doc_id").limit(sample_rows).select("vec").toArrow()["vec"].combine_chunks()
        centres = fit_centres(_unit(_flat(sample)), max(1, min(cells or math.ceil(total / LIST_ROWS), MOST_CELLS)), seed) if total else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast(centres)  # MOST_CELLS centres at most

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _flat(b.column("vec"))
                    size = np.linalg.norm(v, axis=1)
                    cell, _ = _nearest_centre(v / size[:, None], sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("doc_id"), pa.array(size)], names=["cell", "doc_id", "size"])

        held = tokens.mapInArrow(deal, "cell int, doc_id string, size double").repartition("doc_id").groupBy("doc_id", "cell").agg(F.max("size").alias("size"))
        held = held.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cell", "size"))).alias("x")).select("doc_id", F.col("x.cell").alias("cells"), F.col("x.size").alias("sizes"))
        held.write.parquet(f"{path}/documents")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return cls(spark, path, centres)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LateIndex:
        rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").toArrow()
        return cls(spark, path, _flat(rows["centre"].combine_chunks()) if rows.num_rows else np.zeros((0, 1)))

    def estimates(self, queries: DataFrame, vecs: str = "vecs", probed: float = PROBED, limit: int | None = None) -> DataFrame:
        """query_id, doc_id, score: an estimate for every document that a query (query_id, vecs) brings up, or the best of each query."""
        probes = max(1, math.ceil(len(self.centres) * probed))
        sent = self.spark.sparkContext.broadcast(self.centres)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each vector with the score of the last centre it looks at in front."""
            for whole in batches:
                for at in range(0, whole.num_rows, 8):
                    b = whole.slice(at, 8)
                    v = _flat(b.column("vec").flatten())
                    last = np.concatenate([np.partition(-(part @ sent.value.T), probes - 1, axis=1)[:, probes - 1] for part in np.split(v, range(64, len(v), 64))])
                    of = np.concatenate([-last[:, None], v], axis=1)
                    inner = pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * of.shape[1], pa.array(of.ravel()))
                    bounds = np.append(_firsts(b.column("vec")), len(of)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.ListArray.from_arrays(bounds, inner)], names=["query_id", "vec"])

        def estimate(docs: pa.Array, asked: pa.Array) -> np.ndarray:
            """A score for each document (its [cell, size] pairs) and query; not a number where no vector brings the document up."""
            d, q = _flat(docs.flatten()), _flat(asked.flatten())
            cells, at = np.unique(d[:, 0].astype(int), return_inverse=True)
            near = q[:, 1:] @ sent.value[cells].T
            near[near < q[:, :1] - 1e-9] = -np.inf
            # What a document has of several centres counts once per vector of the query, by the best of them.
            best = np.maximum.reduceat(near[:, at] * d[:, 1], _firsts(docs), axis=1)
            out = np.add.reduceat(np.where(best > -np.inf, best, 0.0), _firsts(asked), axis=0).T
            out[np.maximum.reduceat(best, _firsts(asked), axis=0).T == -np.inf] = np.nan
            return out

        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.filter(vecs, lambda v: v.isNotNull()).alias("vec")).where("size(vec) > 0")
        if not len(self.centres):
            return self.spark.createDataFrame([], "query_id string, doc_id string, score double")
        looked = staged(asked.mapInArrow(look, "query_id string, vec array<array<double>>"), "looked")
        held = self.spark.read.schema("doc_id string, cells array<int>, sizes array<double>").parquet(f"{self.path}/documents")
        held = held.select("doc_id", F.zip_with("cells", "sizes", lambda c, s: F.array(c.cast("double"), s)).alias("vec"))
        return _nearest(held, looked, estimate, limit).drop("rank")

    def candidates(self, queries: DataFrame, limit: int = 10, vecs: str = "vecs", probed: float = PROBED, oversample: int = 9) -> DataFrame:
        """query_id, doc_id of the best estimates: `oversample` times the hits that are asked for."""
        return self.estimates(queries, vecs, probed, limit * oversample).select("query_id", "doc_id")


@dataclass
class LateSearcher:
    """MaxSim over the candidates of an index; how many, unless given, is measured on a sample of the queries, whose hits are searched exactly."""

    index: LateIndex
    docs: DataFrame
    vecs: str = "vecs"
    probed: float = PROBED
    oversample: int | None = None

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        asked, held = queries.withColumn("query_id", F.col("query_id").cast("string")), self.docs.withColumn("doc_id", F.col("doc_id").cast("string"))
        times = self.oversample
        if times is None:
            near = lambda some, pool: top_k(self.index.estimates(some, self.vecs, self.probed, pool), pool)
            times = needed_oversample(asked, lambda some: MaxSimSearcher(held, self.vecs).search(some, limit), near, limit, held.count())
        pool = staged(self.index.candidates(asked, limit, self.vecs, self.probed, times), "candidates")
        return top_k(MaxSimScorer(held, self.vecs).score(asked, pool), limit)
