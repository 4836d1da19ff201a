"""Approximate neighbours by cells: vectors near one of many centres are stored together, and a search reads the cells that can hold hits.

Centres come from a bounded sample (`SAMPLE_ROWS`, the rows of smallest hashes); every vector is then given to its nearest centre
and written, by shelf (a group of near centres, one folder each) and sorted by cell.  A search by cosine decides per query which cells to
read.  Within a cell a vector is its share of the centre and a rest in no particular direction, so the number of vectors of a cell
that score more than s is a normal tail with known mean and deviation; the score of the last hit is estimated as that which
`limit` vectors of all cells are expected to exceed, and the best cells are read until `recall` of the hits is expected in them.  When
they are read, the last hit is known; where more than the rest of the hits is still expected elsewhere, further cells are read.

Cells of one shelf are found by their folder, cells in it by the statistics of its files.  Vectors of zeros are not indexed
(they score 0 with everything); null vectors neither.
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
from .ranking import best_places, top_k
from .search import _flat, _unit

#: Vectors that centres are fitted on, and centres, at most.
SAMPLE_ROWS, MOST_CELLS = 262_144, 65_536
#: Vectors of a cell, while there are fewer than MOST_CELLS cells.
CELL_ROWS = 3
#: Vectors of a file, and of a shelf of small cells.
FILE_ROWS = 1_000_000
#: Queries that go to all workers at once; more are searched a block at a time.
QUERY_BLOCK = 2048
#: Centres that are fitted at once; more are split into groups first.
_FITTED = 1024
_ROUNDS = 8
#: Numbers of a matrix that is made at a time.
_HELD = 4_000_000


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, and their cosine."""
    step = max(1, _HELD // len(centres))
    nearest, cosine = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ centres.T
        nearest[at : at + step] = near.argmax(1)
        cosine[at : at + step] = near.max(1)
    return nearest, cosine


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Unit centres of unit vectors; a centre without vectors stays where it was."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(_ROUNDS):
        nearest, _ = _nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres[moved] = _unit(sums[moved])
    return centres


def fit_centres(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centres, or fewer where there are fewer different vectors."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if k >= len(x):
        return x
    if k <= _FITTED:
        return _lloyd(x, k, rng)
    groups = _lloyd(x, math.isqrt(k), rng)
    nearest, _ = _nearest_centre(x, groups)
    parts = [x[nearest == g] for g in range(len(groups))]
    return np.concatenate([fit_centres(p, max(1, round(k * len(p) / len(x))), seed) for p in parts if len(p)])


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z (a published rational approximation, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(z >= 0, upper, 1 - upper)


@dataclass
class Cells:
    """Centres; per cell the number of its vectors and mean and deviation of their cosine with the centre; and the
    deviation of the cosine of two rests."""

    centres: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    spread: float

    def _law(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.clip(queries @ self.centres.T, -1, 1)
        rest = np.sqrt(np.maximum((1 - self.mean**2) * (1 - b * b), 0)) * self.spread
        return self.mean * b, np.sqrt((self.dev * b) ** 2 + rest**2) + 1e-6

    def expected(self, queries: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Vectors of each cell that are expected to score more than `above` (one per query)."""
        mean, dev = self._law(queries)
        return self.n * _tail((above[:, None] - mean) / dev)

    def last_score(self, queries: np.ndarray, limit: int, read: np.ndarray | None = None, found: np.ndarray | None = None) -> np.ndarray:
        """The score that `limit` vectors are expected to exceed; of cells that were read, by the scores that were found there."""
        mean, dev = self._law(queries)
        n = self.n if read is None else np.where(read, 0, self.n)
        low, high = np.full(len(queries), -1.0), np.full(len(queries), 1.0)
        for _ in range(24):
            middle = (low + high) / 2
            above = (n * _tail((middle[:, None] - mean) / dev)).sum(1)
            if found is not None:
                above += (found > middle[:, None]).sum(1)
            low, high = np.where(above > limit, middle, low), np.where(above > limit, high, middle)
        return low

    def chosen(self, queries: np.ndarray, limit: int, recall: float, read: np.ndarray | None = None, found: np.ndarray | None = None) -> np.ndarray:
        """Cells (queries x cells) to read so that under (1 - recall) * limit hits are expected elsewhere.

        After some were read, which further ones, by the best scores found (queries x limit, -1 where there are fewer).
        """
        left = self.expected(queries, self.last_score(queries, limit, read, found))
        if read is not None:
            left = np.where(read, 0, left)
        order = np.argsort(-left / np.maximum(self.n, 1), axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(left, order, 1), axis=1)
        before = np.concatenate([np.zeros((len(queries), 1)), upto[:, :-1]], axis=1)
        out = np.zeros(left.shape, dtype=bool)
        np.put_along_axis(out, order, upto[:, -1:] - before > (1 - recall) * limit, 1)
        return out & (self.n > 0)


def measured(x: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> float:
    """The deviation of the cosine of a vector's rest and a rest of another cell, over pairs of a sample."""
    x = x[rng.permutation(len(x))[:20_000]]
    nearest, _ = _nearest_centre(x, centres)
    q, y = rng.integers(0, len(x), (2, 20_000))
    c = centres[nearest[y]]
    a, b, s = (x[y] * c).sum(1), (x[q] * c).sum(1), (x[q] * x[y]).sum(1)
    size = np.sqrt(np.maximum((1 - a * a) * (1 - b * b), 0))
    usable = (size > 1e-3) & (nearest[q] != nearest[y])
    if usable.sum() < 100:
        return 1 / math.sqrt(x.shape[1])
    return float(np.sqrt(np.mean(((s - a * b)[usable] / size[usable]) ** 2)))


_META = "cell int, shelf int, centre array<double>, n bigint, mean double, dev double, spread double"


@dataclass
class CellIndex:
    """Vectors (cell, shelf, doc_id, vec) by cell, in a folder; `reads` has the share of vectors that the last search compared."""

    spark: SparkSession
    path: str
    cells: Cells
    shelf: np.ndarray
    reads: float = 0.0

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, shelves: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> CellIndex:
        """Indexes all vectors (doc_id, vec); the number of cells follows from their number unless given."""
        spark = vectors.sparkSession
        path = path or place(spark, "cells")
        rows = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "vec").where(F.exists("vec", lambda v: v != 0))
        total = rows.count()
        k = max(1, min(cells or math.ceil(total / CELL_ROWS), MOST_CELLS))
        sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("vec").toArrow()["vec"].combine_chunks()
        x = _unit(_flat(sample)) if len(sample) else np.zeros((0, 1))
        centres = fit_centres(x, k, seed) if len(x) else np.zeros((0, 1))
        spread = measured(x, centres, np.random.default_rng(seed)) if len(x) else 1.0
        n_shelves = max(1, min(len(centres), shelves or max(8, -(-total // FILE_ROWS))))
        shelf = _nearest_centre(centres, _lloyd(centres, n_shelves, np.random.default_rng(seed)))[0] if len(centres) else np.zeros(0, int)
        sent = spark.sparkContext.broadcast((centres, shelf))  # MOST_CELLS centres at most

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, shelf = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = _unit(_flat(b.column("vec")))
                cell, near = _nearest_centre(v, centres)
                unit = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(shelf[cell], pa.int32()), b.column("doc_id"), unit, pa.array(near)], names=["cell", "shelf", "doc_id", "vec", "near"])

        dealt = staged(rows.mapInArrow(deal, "cell int, shelf int, doc_id string, vec array<float>, near double"), "dealt")
        counted = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.avg("near").alias("mean"), F.coalesce(F.stddev_pop("near"), F.lit(0.0)).alias("dev")).collect()}  # one row per cell
        # A shelf with many vectors, equal ones perhaps, is written by several tasks.
        files = np.bincount(shelf, weights=[counted[c].n if c in counted else 0 for c in range(len(shelf))], minlength=1) // FILE_ROWS + 1 if len(shelf) else [1]
        parts = F.element_at(F.array(*(F.lit(int(f)) for f in files)), F.col("shelf") + 1)
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).repartition("shelf", "part").sortWithinPartitions("shelf", "cell", "doc_id")
        dealt.select("cell", "doc_id", "vec", "shelf").write.partitionBy("shelf").parquet(f"{path}/vectors")
        meta = [(c, int(shelf[c]), centres[c].tolist(), counted[c].n if c in counted else 0, counted[c].mean if c in counted else 0.0, counted[c].dev if c in counted else 0.0, spread) for c in range(len(centres))]
        spark.createDataFrame(meta, _META).coalesce(1).write.parquet(f"{path}/cells")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        rows = spark.read.schema(_META).parquet(f"{path}/cells").orderBy("cell").toArrow()
        centres = _flat(rows["centre"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))
        got = {c: rows[c].to_numpy() for c in ("shelf", "n", "mean", "dev", "spread")}
        return cls(spark, path, Cells(centres, got["n"], got["mean"], got["dev"], float(got["spread"][0]) if rows.num_rows else 1.0), got["shelf"])

    def vectors(self, cells: np.ndarray) -> DataFrame:
        """The vectors of some cells; folders of other shelves are not opened."""
        rows = self.spark.read.schema("cell int, doc_id string, vec array<float>, shelf int").parquet(f"{self.path}/vectors")
        rows = rows.where(F.col("shelf").isin(np.unique(self.shelf[cells]).tolist()))
        return rows.where(F.col("cell").isin(cells.tolist())) if len(cells) <= 1000 else rows

    def _choose(self, asked: DataFrame, limit: int, recall: float) -> DataFrame:
        """query_id, vec, read: the cells to read, a bit each; `asked` may have those read before, and the scores found there."""
        sent = self.spark.sparkContext.broadcast(self.cells)
        again = "found" in asked.columns

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells: Cells = sent.value
            step, k = max(1, _HELD // len(cells.n)), len(cells.n)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    read = found = None
                    if again:
                        read = np.stack([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x in b.column("read")]).astype(bool)
                        scores = [sorted(x or [], reverse=True)[:limit] for x in b.column("found").to_pylist()]
                        found = np.array([x + [-1.0] * (limit - len(x)) for x in scores])
                    chosen = np.packbits(cells.chosen(_unit(_flat(b.column("vec"))), limit, recall, read, found), axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec"), pa.array([row.tobytes() for row in chosen], pa.binary())], names=["query_id", "vec", "read"])

        return asked.mapInArrow(choose, "query_id string, vec array<float>, read binary")

    def _hits(self, chosen: pa.Table, limit: int) -> DataFrame:
        """query_id, doc_id, score, rank: the best of the cells that each query (query_id, vec, read) reads."""
        ids, queries = np.array(chosen["query_id"].to_pylist(), dtype=object), _unit(_flat(chosen["vec"].combine_chunks()))
        packed = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in chosen["read"]])
        sent = self.spark.sparkContext.broadcast((ids, queries, packed))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, packed = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                cell, vecs, names = b.column("cell").to_numpy(), _flat(b.column("vec")), np.array(b.column("doc_id").to_pylist(), dtype=object)
                hits = []
                for own in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                    asked = np.flatnonzero(packed[:, cell[own[0]] >> 3] >> (7 - (cell[own[0]] & 7)) & 1)
                    for at in range(0, len(own) if len(asked) else 0, 2048):
                        part = own[at : at + 2048]
                        scores = vecs[part] @ queries[asked].T
                        d, q = best_places(names[part], scores, limit)
                        hits.append((asked[q], part[d], scores[d, q]))
                if hits:
                    q, d, s = (np.concatenate(x) for x in zip(*hits))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.string()), pa.array(names[d], pa.string()), pa.array(s)], names=["query_id", "doc_id", "score"])

        cells = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(packed, axis=0), count=len(self.shelf)))
        return top_k(self.vectors(cells).mapInArrow(score, "query_id string, doc_id string, score double"), limit)

    def _compared(self, chosen: pa.Table) -> int:
        """Query-vector pairs of the cells that were chosen."""
        return sum(int(self.cells.n[np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(self.shelf)))].sum()) for x in chosen["read"])

    def _block(self, asked: DataFrame, limit: int, recall: float) -> tuple[DataFrame | None, int]:
        """Hits of a block of queries, and the pairs that were compared."""
        first = self._choose(asked, limit, recall).toArrow()
        if not first.num_rows:
            return None, 0
        hits = staged(self._hits(first, limit), "hits")
        read = self.spark.createDataFrame(first)
        more = self._choose(read.join(hits.groupBy("query_id").agg(F.collect_list("score").alias("found")), "query_id", "left"), limit, recall).toArrow()
        if pairs := self._compared(more):
            hits = top_k(hits.drop("rank").unionByName(self._hits(more, limit).drop("rank")), limit)
        return hits, pairs + self._compared(first)

    def search(self, queries: DataFrame, limit: int = 10, recall: float = 0.91) -> DataFrame:
        """query_id, doc_id, score, rank of the nearest vectors of each query (query_id, vec) by cosine."""
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vec").where(F.exists("vec", lambda v: v != 0))
        total = asked.count()
        blocks = -(-total // QUERY_BLOCK)
        out, compared = None, 0
        for n in range(blocks if len(self.cells.centres) else 0):
            # Blocks by hash: some are larger than QUERY_BLOCK by the scatter of a hash.
            hits, pairs = self._block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n), limit, recall)
            if hits is not None:
                hits, compared = (staged(hits, "hits") if blocks > 1 else hits), compared + pairs
                out = hits if out is None else out.unionByName(hits)
        self.reads = compared / max(total * int(self.cells.n.sum()), 1)
        return out if out is not None else self.spark.createDataFrame([], "query_id string, doc_id string, score double, rank int")
