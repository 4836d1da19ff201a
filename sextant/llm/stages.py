"""Tables, checkpoints and numbering that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import shared_dir, staged

__all__ = ["BATCH_BYTES", "prefixed_offsets", "shared_dir", "staged", "table"]

#: Most bytes of rows that go to a Python worker at a time, so that long texts don't add up.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers touch the path."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefixed_offsets(counts: DataFrame, key: str, n: str, out: str) -> DataFrame:
    """Adds to a small table of counts the sum of `n` over all smaller keys.

    The table has one row per bucket, not per row of data.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))
