"""Nested training rows to corpus, queries, labels and negatives; passage-to-document maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PASSAGES = "array<struct<docid:string,text:string>>"
ROWS = f"row_id bigint, query_id string, query string, positive_passages {_PASSAGES}, negative_passages {_PASSAGES}"


def read_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines of training rows; malformed ones are dropped; the first `limit` by row_id."""
    rows = spark.read.schema(ROWS).option("mode", "DROPMALFORMED").json(path).where("query_id is not null")
    return rows if limit is None else rows.orderBy("row_id").limit(limit)


def corpus_of(rows: DataFrame) -> DataFrame:
    """doc_id, text: the first text of each id, gold passages before negatives within a row."""
    both = F.concat(F.coalesce("positive_passages", F.array().cast(_PASSAGES)), F.coalesce("negative_passages", F.array().cast(_PASSAGES)))
    long = rows.select("row_id", F.posexplode(both).alias("pos", "p"))
    return long.groupBy(F.col("p.docid").alias("doc_id")).agg(F.min_by("p.text", F.struct("row_id", "pos")).alias("text"))


def last_rows(rows: DataFrame) -> DataFrame:
    """The last row of each query id, in the order of first appearance as q_ord."""
    own = Window.partitionBy("query_id")
    marked = rows.withColumn("q_ord", F.min("row_id").over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.col("row_id").desc())))
    return marked.where("_n = 1").drop("_n")


def queries_of(rows: DataFrame) -> DataFrame:
    return last_rows(rows).select("query_id", "query", "q_ord")


def qrels_of(rows: DataFrame) -> DataFrame:
    long = last_rows(rows).select("query_id", F.explode("positive_passages").alias("p"))
    return long.select("query_id", F.col("p.docid").alias("doc_id")).distinct().withColumn("grade", F.lit(1))


def negatives_of(rows: DataFrame) -> DataFrame:
    long = last_rows(rows).select("query_id", F.explode("negative_passages").alias("p"))
    return long.select("query_id", F.col("p.docid").alias("doc_id")).distinct()


def read_pid2did(spark: SparkSession, path: str, pids: DataFrame | None = None) -> DataFrame:
    """doc_id, did from a tab-separated file without header (.gz too), only for the passages given."""
    got = spark.read.schema("doc_id string, did string").option("sep", "\t").csv(path)
    return got if pids is None else got.join(pids.select("doc_id").distinct(), "doc_id", "left_semi")


def sample_pair(qrels: DataFrame, seed: int = 42) -> DataFrame:
    """One labelled pair, the same on every run: the smallest hash of seed and ids."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id"), F.col("doc_id")).cast("binary"))
    return qrels.select("query_id", "doc_id", key.alias("k")).orderBy("k").limit(1).select("query_id", "doc_id")
