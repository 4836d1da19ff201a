"""Corpus, queries, labels, vectors and so on, derived from whole tables.

What several parts of a plan read (counted passages with their labels, statistics, negatives) is written once per query, so that the
documents are read and cut once; passages' texts are written where a plan needs the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..operators.bm25 import AskedGrams, NgramStats
from ..operators.counts import has_repeats
from ..operators.cut import cut_and_count
from ..sources.staging import place, spread, staged

PASSAGE_WORDS = 350
N_NEGATIVES = 20
#: Labelled queries up to this number are broadcast when their passages are looked for.
BROADCAST_QUERIES = 20_000
#: Queries without an inner word that are held against all passages at a time.
SHORT_QUERIES = 500


def _words(text: str) -> list[str]:
    """Runs of other characters than space, tab, line feed, return and form feed."""
    for blank in "\t\n\r\f":
        text = text.replace(blank, " ")
    return list(filter(None, text.split(" ")))


def _containing(passages: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id of passages (doc_id, text) that contain a query (query_id, query, anchor: one of its words), of a bounded number."""
    by: dict[str, list[tuple[str, str]]] = {}
    for row in asked.collect():
        by.setdefault(row.anchor, []).append((row.query_id, row.query))
    sent = passages.sparkSession.sparkContext.broadcast((frozenset(by), by))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, by = sent.value
        for b in batches:
            rows = [(i, d) for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for word in anchors.intersection(text.split(" ")) for i, query in by[word] if query in text]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else ([], []))], names=["query_id", "doc_id"])

    return passages.mapInArrow(look, "query_id string, doc_id string")


class Roles:
    """Lazily made tables over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text"))

    def scratch(self, name: str) -> str:
        """A new place in the folder that all executors share."""
        return place(self.spark, name)

    def _texts(self) -> DataFrame:
        return self.documents().select(F.col("doc_id").cast("string").alias("did"), "text").where("text is not null")

    @cached_property
    def _passages(self) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    rows = [(f"{i}_{c // PASSAGE_WORDS}", i, " ".join(w[c : c + PASSAGE_WORDS])) for i, w in zip(b.column("did").to_pylist(), map(_words, b.column("text").to_pylist())) for c in range(0, len(w), PASSAGE_WORDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else ([], [], []))], names=["doc_id", "did", "text"])

        return staged(self._texts().mapInArrow(cut, "doc_id string, did string, text string"), "passages")

    def passages(self) -> DataFrame:
        """doc_id, did, text: documents in windows of 350 words."""
        return self._passages

    @cached_property
    def _asked(self) -> AskedGrams:
        return AskedGrams.of(self.queries())

    @cached_property
    def _counted(self) -> DataFrame | None:
        """doc_id, did, n_tokens, terms, tfs, labels of all passages, from one pass over the documents; None where there are too many query grams for it."""
        if self._asked.grams is None:
            return None
        sought = [(r.query_id, r.query, r.anchor) for r in self._anchored.collect()] if self._few_labelled else []
        return staged(cut_and_count(self._texts(), PASSAGE_WORDS, self._asked.grams, sought), "counted")

    def pid2did(self) -> DataFrame:
        """doc_id, did of all passages; their texts are not written for it."""
        return (self.passages() if self._counted is None else self._counted).select("doc_id", "did")

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("item_id").alias("q_ord"), normalised(F.col("text")).alias("query"))

    def qrels(self) -> DataFrame:
        """Passages that contain a query word for word: query_id, doc_id, grade."""
        return self._qrels

    @cached_property
    def _labelled(self) -> DataFrame:
        """query_id, query, anchor: the longest inner word, which a passage with the query has to have."""
        q = self.queries().select("query_id", "query", F.split("query", " ").alias("w"))
        inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
        anchor = F.array_max(F.transform(inner, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
        return staged(q.select("query_id", "query", anchor.alias("anchor")), "labelled-queries")

    @property
    def _anchored(self) -> DataFrame:
        return self._labelled.where("anchor is not null")

    @cached_property
    def _few_labelled(self) -> bool:
        return self._anchored.count() <= BROADCAST_QUERIES

    @cached_property
    def _qrels(self) -> DataFrame:
        """A passage has to have the query's longest inner word, so only those are looked at, where passages are cut and counted.

        Queries of one or two words have none; they are held against all passages, a bounded number at a time.
        """
        q, long = self._labelled, self._anchored
        if self._few_labelled and self._counted is not None:
            found = self._counted.select(F.explode("labels").alias("query_id"), "doc_id")
        elif self._few_labelled:
            found = _containing(self.passages().select("doc_id", "text"), long)
        else:
            words = self.passages().select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("anchor"))
            found = words.join(long, "anchor").where(F.contains("text", "query")).select("query_id", "doc_id")
        block: list[tuple[str, str]] = []

        def held_against(block: list[tuple[str, str]]) -> DataFrame:
            asked = F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("query")) for i, t in block))
            return self.passages().select("doc_id", F.explode(F.filter(asked, lambda x: F.contains(F.col("text"), x["query"]))).alias("x")).select("x.query_id", "doc_id")

        for row in q.where("anchor is null and query is not null").toLocalIterator():
            block.append((row.query_id, row.query))
            if len(block) == SHORT_QUERIES:
                found, block = found.unionByName(held_against(block)), []
        if block:
            found = found.unionByName(held_against(block))
        return staged(found.distinct().withColumn("grade", F.lit(1)), "labels")

    @cached_property
    def _stats(self) -> NgramStats:
        if self._counted is None or has_repeats(self._counted):
            return NgramStats.build(self.passages(), self.queries())
        return NgramStats.of_held(self._counted, self._asked)

    def stats(self) -> NgramStats:
        return self._stats

    @cached_property
    def _negatives(self) -> DataFrame:
        gold = self.qrels()
        best = self.stats().best([1], N_NEGATIVES, without=gold)
        return staged(best.join(gold.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id"), "negatives")

    def negatives(self) -> DataFrame:
        """The 20 best unigram BM25 passages of each labelled query that are not its gold."""
        return self._negatives

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vec"))

    def query_vectors(self) -> DataFrame:
        """The stated query set: every vector whose id is divisible by 100."""
        return self.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vec"))

    def multivectors(self) -> DataFrame:
        """doc_id, vecs, head, tail: eight vectors to a document."""
        g = self.table("embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("m")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
        vecs = F.transform("e", lambda x: x["embedding"])
        return g.select("m", F.col("m").cast("string").alias("doc_id"), vecs.alias("vecs")).withColumn("head", F.element_at("vecs", 1)).withColumn("tail", F.element_at("vecs", -1))

    def query_multivectors(self) -> DataFrame:
        return self.multivectors().where("m % 100 = 0").withColumnRenamed("doc_id", "query_id")

    def training_rows(self) -> DataFrame:
        """Nested rows: a conversation's first user turn asks, assistant turns are gold, other turns are negatives."""
        passage = F.struct(F.md5(F.col("text").cast("binary")).alias("docid"), "text")
        turns = self.table("conversations").select("conv_id", "turn", "role", "text", passage.alias("p"))
        keep = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "p")))), lambda x: x["p"])
        rows = turns.groupBy(F.col("conv_id").alias("row_id")).agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("query"), keep(F.col("role") == "assistant").alias("positive_passages"), keep(F.col("role") != "assistant").alias("negative_passages"))
        return rows.where("query is not null").withColumn("query_id", F.md5(F.col("query").cast("binary")))

    def cited_parts(self) -> DataFrame:
        """doc_id, text with statute and reporter cites, one per part."""
        p = self.table("part")
        text = F.concat(F.lit("See "), F.col("p_size").cast("string"), F.lit(" U.S.C. § "), (F.col("p_partkey") % 97).cast("string"), F.lit(" and "), (F.col("p_partkey") % 89).cast("string"), F.lit(" F.2d "), (F.col("p_partkey") % 13).cast("string"), F.lit("; Doe v. Roe § "), (F.col("p_partkey") % 7).cast("string"))
        return p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("k"), text.alias("text"))

    def cited_suppliers(self) -> DataFrame:
        """query_id, query with cites, one per supplier; every fifth has none."""
        s = self.table("supplier")
        cites = F.concat(F.lit("Is "), (F.col("s_suppkey") % 89).cast("string"), F.lit(" F.2d "), (F.col("s_suppkey") % 13).cast("string"), F.lit(" good law under § "), (F.col("s_suppkey") % 7).cast("string"))
        return s.select(F.col("s_suppkey").cast("string").alias("query_id"), F.col("s_suppkey").alias("q_ord"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("what is this")).otherwise(cites).alias("query"))

    def cited_qrels(self) -> DataFrame:
        k = self.table("part").select(F.col("p_partkey").alias("q_ord"))
        return self.cited_suppliers().join(k, "q_ord").select("query_id", F.col("q_ord").cast("string").alias("doc_id"), F.lit(1).alias("grade"))

    def cited_negatives(self) -> DataFrame:
        k = self.table("part").select(F.col("p_partkey").alias("k"))
        near = self.cited_suppliers().select("query_id", F.explode(F.sequence(F.col("q_ord") + 1, F.col("q_ord") + N_NEGATIVES)).alias("k"))
        return near.join(k, "k").select("query_id", F.col("k").cast("string").alias("doc_id"))

