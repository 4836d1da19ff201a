"""Tables that are written once and read by every use, and scans spread over the cores there are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    In local mode one machine is all there is, so a temporary folder does where the setting is missing;
    on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='sextant-')}"
    return _OWN[context.applicationId]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends there, and lost executors cost their tasks only."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores (one small file, say) dealt over the cores; larger scans as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
