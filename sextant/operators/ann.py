"""Approximate neighbours by sketches: the signs of a vector against random hyperplanes, compared in place of vectors.

Two sketches differ in a share of their bits that is the angle between their vectors over pi, give or take
1 / (2 sqrt(bits)).  Every vector is indexed by its sketch, a few dozen bytes; a search ranks all sketches, in the blocks
of the exact search, keeps `oversample` times the hits that are asked for, and scores only those by their vectors.  Unless it is
given, that number is measured on a sample of the queries, whose hits are searched exactly: near vectors lie closer in larger tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.staging import staged
from .ranking import top_k
from .search import DenseSearcher, _nearest, needed_oversample


def _signs(sketches: pa.Array) -> np.ndarray:
    """Sketches (list<int64>) as rows of 1 and -1."""
    words = sketches.flatten().to_numpy(zero_copy_only=False).reshape(len(sketches), -1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


@dataclass
class HyperplaneIndex:
    vectors: DataFrame  # doc_id, vec
    size: int
    bits: int = 512
    oversample: int | None = None
    seed: int = 7

    def sketches(self, rows: DataFrame, key: str) -> DataFrame:
        """key, vec: the signs of each vector, 64 to a number."""
        planes = np.random.default_rng(self.seed).standard_normal((self.bits, self.size))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                m = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                words = np.packbits(m @ planes.T > 0, axis=1).view(np.int64)
                bounds = np.arange(len(m) + 1, dtype=np.int32) * words.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(bounds), pa.array(words.ravel()))], names=[key, "vec"])

        return rows.select(F.col(key).cast("string").alias(key), "vec").where("vec is not null").mapInArrow(sign, f"{key} string, vec array<bigint>")

    @cached_property
    def held(self) -> DataFrame:
        """The sketches of all vectors, written once."""
        return staged(self.sketches(self.vectors, "doc_id"), "sketches")

    def _near(self, queries: DataFrame, pool: int) -> DataFrame:
        return _nearest(self.held, self.sketches(queries, "query_id"), lambda d, q: (_signs(d) @ _signs(q).T).astype(np.float64), pool)

    def candidates(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """query_id, doc_id of the nearest sketches of each query."""
        times = self.oversample or needed_oversample(queries, lambda some: DenseSearcher(self.vectors).search(some, limit), self._near, limit, self.held.count())
        return self._near(queries, limit * times).select("query_id", "doc_id")

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vec").alias("_q"))
        d = self.vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("vec").alias("_d"))
        met = self.candidates(queries, limit).join(q, "query_id").join(d, "doc_id")
        return top_k(met.select("query_id", "doc_id", cosine(F.col("_q"), F.col("_d")).alias("score")), limit)
