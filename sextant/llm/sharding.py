"""Sharding by jump consistent hashing of a stable key.

A key's shard follows from the key and the number of shards alone; one more shard takes
its fraction of the keys and moves no others.  Slots, gapless from 0 within a shard, go by a hash of the whole row
and are given in two steps: rows are counted per shard and range of hashes, and each range numbers its own.

Defined results: a null key hashes as a value of its own; repeated rows are numbered by their count and get slots one
after another; null text has size 1 and checksum 0; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged
from .words import mix

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key, by the published jump consistent hash."""
    key = keys.astype(np.uint64)
    shard = np.full(len(key), -1, dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = np.floor((shard[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """Adds shard, grown_shard and place, a hash of the row's key, checksum and size, to rows of them."""

    @F.pandas_udf("shard int, grown_shard int, place bigint")
    def place(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for k, crc, size in parts:
            key = mix(k.to_numpy(dtype=np.int64).view(np.uint64))
            row = mix(key + crc.to_numpy(dtype=np.uint64) * _SPREAD + size.to_numpy(dtype=np.uint64))
            yield pd.DataFrame({"shard": jump_hash(key.copy(), shards).astype(np.int32), "grown_shard": jump_hash(key.copy(), shards + 1).astype(np.int32), "place": row.view(np.int64)})

    key = F.coalesce("doc_id", F.lit(NULL_KEY).cast("bigint"))  # pandas would make floats of nulls
    return rows.withColumn("p", place(key, "text_crc32", "size")).select(*rows.columns, "p.*")


#: What a null key hashes as, and a factor that sets a row's checksum apart from its key.
NULL_KEY, _SPREAD = -(2**63), np.uint64(2654435761)
#: Copies of one row that are written out at a time.
_COPIES = 10_000


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document."""
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
    )
    # Equal rows become one with their number before anything is dealt out.
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = staged(_placed(rows, shards), "sharded")
    share = (F.col("place").cast("double") + 2.0**63) / 2.0**64
    buckets = max(4, -(-rows.count() // (bucket_rows * shards)))
    rows = rows.withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("first", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(before, ["shard", "bucket"]).withColumn("first", F.col("first") + F.col("before"))
    parts = first.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES))))
    copies = F.sequence(F.col("c") * _COPIES, F.least((F.col("c") + 1) * _COPIES, F.col("copies")) - 1)
    return parts.withColumn("i", F.explode(copies)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("i")).cast("bigint").alias("slot"), "grown_shard")
