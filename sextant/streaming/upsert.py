"""A stream of points into a store: each micro-batch is one upsert of the last version of each key.

A late batch with an older version than the store has changes nothing, and a batch that is run again neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import PointStore, latest


def upsert_stream(points: DataFrame, store: PointStore, checkpoint: str, key: str = "id", version: str = "version") -> StreamingQuery:
    """Runs through what is there and stops; started again, it goes on where it stopped."""
    store.ensure(points.schema, key=key)

    def apply(batch: DataFrame, _: int) -> None:
        store.upload(latest(batch, key, version), key, skip_existing=False, version=version)

    return points.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
