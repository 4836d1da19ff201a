"""A stored inverted index that any query can be searched in, with score bounds per block.

Documents are dealt into small groups.  A row of the index is a block: the documents of one group that hold one term, with
what the term adds to their scores and the largest such value.  Blocks are stored by the hash of their term (a folder each) and sorted by term.

A corpus is indexed in segments: a task has whole groups, makes their blocks itself, and writes its own files, so that no posting is shuffled.

A search whose terms can be sent to all workers shuffles the postings of these terms alone, once, and adds them up in arrays over the queries.  With more
terms, bounds are read first: the sum of a query's bounds in a group is more than any document there can score.  The
groups of the highest bounds are scored, which gives a score that the last hit has at least, and of the others only those whose bound reaches it.
So hits and scores are those of an exhaustive search either way; queries are a table of any size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import place, staged
from .accumulate import AskedTerms, best_sums
from .bm25 import BROADCAST_GRAMS, gram_total, idf, query_grams
from .counts import count_all, count_wanted, exploded, has_repeats
from .ranking import DIGITS, top_k

#: Documents of a group, folders of terms, blocks of a file, and groups of a query that are scored first.
GROUP_DOCS, BUCKETS, FILE_BLOCKS, FIRST_GROUPS = 4, 8, 2_000_000, 12
#: Tokens of a segment, and documents whose blocks are made at a time.
SEGMENT_TOKENS, _HELD_DOCS = 2_000_000, 64 * GROUP_DOCS


@dataclass(frozen=True)
class IndexParameters:
    n_docs: int
    groups: int
    max_n: int | None = None
    k1: float | None = None
    b: float | None = None


@dataclass
class PostingsIndex:
    """Blocks (bucket, term, grp, n, top, docs, vals) in a folder."""

    spark: SparkSession
    path: str
    of: IndexParameters

    @classmethod
    def build(cls, postings: DataFrame, n_docs: int, path: str | None = None, **of) -> PostingsIndex:
        """Indexes postings (doc_id, term, val), one row per document and term, val not below 0."""
        spark = postings.sparkSession
        path = path or place(spark, "index")
        groups = max(1, -(-n_docs // GROUP_DOCS))
        rows = postings.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("term").cast("string").alias("term"), F.col("val").cast("double").alias("val"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(groups)).alias("grp"))
        blocks = rows.groupBy("term", "grp").agg(F.count("*").alias("n"), F.max("val").alias("top"), F.array_sort(F.collect_list(F.struct("doc_id", "val"))).alias("x"))
        blocks = blocks.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", "grp", "n", "top", F.transform("x", lambda x: x["doc_id"]).alias("docs"), F.transform("x", lambda x: x["val"]).alias("vals"))
        blocks = staged(blocks, "blocks")
        # A folder with a frequent term is written by several tasks, groups of documents apart.
        sizes = {r.bucket: r["count"] for r in blocks.groupBy("bucket").count().collect()}  # BUCKETS rows
        files = F.element_at(F.array(*(F.lit(sizes.get(b, 0) // FILE_BLOCKS + 1) for b in range(BUCKETS))), F.col("bucket") + 1)
        blocks.repartition(F.col("bucket"), F.pmod("grp", files)).sortWithinPartitions("bucket", "term", "grp").write.partitionBy("bucket").parquet(f"{path}/blocks")
        return cls._kept(spark, path, IndexParameters(n_docs, groups, **of))

    @classmethod
    def _kept(cls, spark: SparkSession, path: str, parameters: IndexParameters) -> PostingsIndex:
        spark.createDataFrame([(json.dumps(asdict(parameters)),)], "of string").coalesce(1).write.parquet(f"{path}/parameters")
        return cls(spark, path, parameters)

    @classmethod
    def of_corpus(cls, corpus: DataFrame, max_n: int = 2, k1: float = 1.5, b: float = 0.75, path: str | None = None) -> PostingsIndex:
        """BM25 over the word n-grams of a corpus (doc_id, text); null text is empty."""
        n_docs, mean = count_wanted(corpus, []).agg(F.count("*"), F.avg("n_tokens")).first()
        average = max_n * float(mean or 0.0) - max_n * (max_n - 1) / 2
        if has_repeats(corpus):
            # Documents of one id are added up before they are indexed.
            grams = exploded(count_all(corpus, max_n)).groupBy("doc_id", "n_tokens", "term").agg(F.sum("tf").alias("tf"))
            norm = k1 * (1 - b + b * gram_total(F.col("n_tokens"), max_n) / average)
            return cls.build(grams.select("doc_id", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("val")), n_docs, path, max_n=max_n, k1=k1, b=b)
        spark = corpus.sparkSession
        path = path or place(spark, "index")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = TaskContext.get().partitionId() << 40
            for whole in batches:
                for at in range(0, whole.num_rows, _HELD_DOCS):
                    part = whole.slice(at, _HELD_DOCS)
                    sizes, n_tokens = np.diff(np.array(part.column("terms").offsets)), part.column("n_tokens").to_numpy()
                    coded = part.column("terms").flatten().dictionary_encode()
                    doc, code, tf = np.repeat(np.arange(part.num_rows), sizes), coded.indices.to_numpy(), part.column("tfs").flatten().to_numpy()
                    if not len(doc):
                        continue
                    norm = k1 * (1 - b + b * (max_n * n_tokens[doc] - max_n * (max_n - 1) / 2) / average)
                    by = np.lexsort((doc, doc // GROUP_DOCS, code))
                    doc, code, val = doc[by], code[by], (tf * (k1 + 1) / (tf + norm))[by]
                    begins = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(doc // GROUP_DOCS) != 0)) + 1])
                    bounds = pa.array(np.append(begins, len(doc)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            coded.dictionary.take(pa.array(code[begins])), pa.array(own + doc[begins] // GROUP_DOCS), pa.array(np.diff(np.append(begins, len(doc)))), pa.array(np.maximum.reduceat(val, begins)),
                            pa.ListArray.from_arrays(bounds, part.column("doc_id").take(pa.array(doc))), pa.ListArray.from_arrays(bounds, pa.array(val)),
                        ],
                        names=["term", "grp", "n", "top", "docs", "vals"],
                    )
                    own += _HELD_DOCS // GROUP_DOCS

        tokens = int(n_docs * float(mean or 0.0))
        segments = max(-(-tokens // SEGMENT_TOKENS), min(spark.sparkContext.defaultParallelism, 1 + tokens // 50_000))
        texts = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), "text").repartition(segments, "doc_id")
        made = count_all(texts, max_n).mapInArrow(blocks, "term string, grp bigint, n bigint, top double, docs array<string>, vals array<double>")
        made = made.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).sortWithinPartitions("bucket", "term", "grp")
        made.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
        return cls._kept(spark, path, IndexParameters(n_docs, -(-n_docs // GROUP_DOCS), max_n, k1, b))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PostingsIndex:
        return cls(spark, path, IndexParameters(**json.loads(spark.read.parquet(f"{path}/parameters").first()[0])))

    def _read(self, name: str, schema: str, terms: DataFrame) -> DataFrame:
        """A table of the index; only the folders of these terms where they are few."""
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        some = [r[0] for r in terms.select("term").distinct().limit(2 * BUCKETS + 1).collect()]
        if len(some) > 2 * BUCKETS:
            return rows
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in some], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(some))

    def weighted(self, asked: DataFrame, with_idf: bool = True) -> DataFrame:
        """query_id, term, weight of asked terms (query_id, term, weight) that the index has, times their idf."""
        asked = asked.select("query_id", F.col("term").cast("string").alias("term"), "weight")
        held = self._read("blocks", "term string, n bigint", asked)
        terms = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.col("weight") * (idf(F.lit(float(self.of.n_docs)), F.col("df")) if with_idf else F.lit(1.0))
        return asked.join(terms, "term").groupBy("query_id", "term").agg(F.sum(weight).alias("weight"))

    def bounds(self, weighted: DataFrame) -> DataFrame:
        """query_id, grp, bound, nth: what no document of a group scores more than, best groups first.  Weights are not below 0."""
        blocks = self._read("blocks", "term string, grp bigint, top double", weighted)
        found = blocks.join(weighted, "term").groupBy("query_id", "grp").agg(F.sum(F.col("top") * F.col("weight")).alias("bound"))
        return found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "grp")))

    def scored(self, weighted: DataFrame, groups: DataFrame) -> DataFrame:
        """query_id, doc_id, score of the documents of some groups (query_id, grp)."""
        blocks = self._read("blocks", "term string, grp bigint, docs array<string>, vals array<double>", weighted)
        wanted = groups.select("query_id", "grp").join(weighted, "query_id")
        rows = blocks.join(wanted, ["term", "grp"]).select("query_id", "weight", F.explode(F.arrays_zip("docs", "vals")).alias("x"))
        return rows.groupBy("query_id", F.col("x.docs").alias("doc_id")).agg(F.sum(F.col("x.vals") * F.col("weight")).alias("score"))

    def _candidates(self, weighted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """First hits, and the groups (query_id, grp) that may hold more."""
        bounds = staged(self.bounds(weighted), "bounds")
        first = staged(top_k(self.scored(weighted, bounds.where(F.col("nth") <= FIRST_GROUPS)), limit), "first")
        last = first.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("score")).alias("last"))
        # Scores are ranked by their rounded values, and sums in another order differ in their last digits.
        reach = F.coalesce(F.col("last"), F.lit(0.0)) - 2 * 10.0**-DIGITS
        rest = bounds.where(F.col("nth") > FIRST_GROUPS).join(last, "query_id", "left").where(F.col("bound") >= reach)
        return first, rest.select("query_id", "grp")

    def search_terms(self, asked: DataFrame, limit: int = 10, with_idf: bool = True) -> DataFrame:
        """query_id, doc_id, score, rank for terms (query_id, term, weight), weights not below 0."""
        weighted = staged(self.weighted(asked, with_idf), "weighted")
        some = weighted.limit(BROADCAST_GRAMS + 1).toPandas()
        if len(some) <= BROADCAST_GRAMS:
            blocks = self._read("blocks", "term string, docs array<string>, vals array<double>", weighted).join(F.broadcast(weighted.select("term").distinct()), "term", "left_semi")
            rows = blocks.select("term", F.explode(F.arrays_zip("docs", "vals")).alias("x")).select(F.col("x.docs").alias("doc_id"), "term", F.col("x.vals").alias("val"))
            return top_k(best_sums(rows, "term", ["val"], [], AskedTerms.of(some), lambda x: {0: x["val"]}, limit, dict(weighted.dtypes)["query_id"]).drop("n"), limit)
        first, rest = self._candidates(weighted, limit)
        return top_k(first.drop("rank").unionByName(top_k(self.scored(weighted, rest), limit).drop("rank")), limit)

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank of queries (query_id, query) in the index of a corpus."""
        if self.of.max_n is None:
            raise ValueError("an index of given terms is searched by terms")
        asked = query_grams(queries, self.of.max_n).select("query_id", F.col("gram").alias("term"), F.lit(1.0).alias("weight"))
        return self.search_terms(asked, limit)

    def scored_share(self, queries: DataFrame, limit: int = 10) -> float:
        """The share of the queries' postings that a search scores."""
        asked = query_grams(queries, self.of.max_n).select("query_id", F.col("gram").alias("term"), F.lit(1.0).alias("weight"))
        weighted = staged(self.weighted(asked), "weighted")
        _, rest = self._candidates(weighted, limit)
        first = self.bounds(weighted).where(F.col("nth") <= FIRST_GROUPS).select("query_id", "grp")
        blocks = self._read("blocks", "term string, grp bigint, n bigint", weighted).join(weighted, "term")
        scored = blocks.join(first.unionByName(rest), ["query_id", "grp"], "left_semi").agg(F.sum("n")).first()[0] or 0
        return scored / (blocks.agg(F.sum("n")).first()[0] or 1)
