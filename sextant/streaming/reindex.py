"""Incremental reindexing of a stream of rows: only contents that the index does not hold are encoded. Goes beyond the batch reindex."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.versions import distinct_work
from sextant.runtime import names_in


def reindex_stream(stream: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch of (row, content_hash, text, ...) to folder/rows and vectors of new hashes to folder/vectors.

    Batches are written under their number, so a batch that runs again after a failure replaces itself.
    """
    vectors, rows = os.path.join(folder, "vectors"), os.path.join(folder, "rows")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        work = distinct_work(batch).select("content_hash", "text")
        before = [os.path.join(vectors, p) for p in names_in(spark, vectors) if p.startswith("batch=") and int(p[6:]) < number]
        if before:
            work = work.join(spark.read.parquet(*before).select("content_hash"), "content_hash", "left_anti")
        encode(work).select("content_hash", "embedding").write.mode("overwrite").parquet(os.path.join(vectors, f"batch={number}"))
        batch.write.mode("overwrite").parquet(os.path.join(rows, f"batch={number}"))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window, late ones accepted up to the watermark; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), key, "n", "value")
