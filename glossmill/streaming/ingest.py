"""Streams: messages into an archive with its index, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inverted_index import postings
from ..operators.mail import fresh_messages, message_vectors, nearest_centroid, network_edges


def deduplicated(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of messages, each (sender, time, digest) once within the watermark."""
    return messages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sender", "at", "digest"])


def ingest_messages(messages: DataFrame, centres: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch of messages with its category, its postings and its network edges under ``path``.

    Batches are written by number, so a batch that runs again after a failure replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = fresh_messages(batch).persist()
        try:
            found = nearest_centroid(message_vectors(rows), centres)
            placed = rows.join(found.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("category", F.coalesce("category", F.lit("Miscellaneous")))
            placed.write.mode("overwrite").parquet(f"{path}/messages/batch={number}")
            postings(rows, "id", "text", "email").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
            network_edges(rows).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        finally:
            rows.unpersist()

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time_col: str, key_col: str, width: str = "10 minutes", delay: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(start, key, n) of tumbling or sliding windows, for streams (with a watermark) and tables alike."""
    rows = events.withWatermark(time_col, delay) if events.isStreaming else events
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return rows.groupBy(span.alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")
