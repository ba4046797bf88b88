"""The stream that keeps a file table current: each micro-batch of mutations adds a delta to the table.

The delta has the rows of the files that the batch names; the table is merged on reading, and written anew now and then
(sources/cache.py). The pointer says which batch was the last, so one that is replayed after a failure does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.cache import load, read_pointer, write_delta
from lodestone.streaming.journal import apply_batch


def apply_version(spark: SparkSession, root: str, batch: DataFrame, batch_id: int) -> bool:
    """Applies a batch to the table at root; False if it was applied before."""
    now = read_pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"no table at {root}")
    if now["batch_id"] >= batch_id:
        return False
    write_delta(apply_batch(load(spark, root), batch, touched=True), root, "file_id", batch_id)
    return True


def tail(mutations: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follows a stream of mutations; with once, takes what is there and stops."""
    spark = mutations.sparkSession
    writer = mutations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: apply_version(spark, root, batch, batch_id)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
