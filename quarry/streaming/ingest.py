"""Documents as they arrive: chunked, deduplicated by chunk id, appended. An extension; batch ingest gives the same chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.chunking import chunk


def chunks_of(stream: DataFrame, strategy: str = "fixed", size: int = 512, overlap: int = 64, *, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Chunks of a stream of documents(id, text, ...). Content-addressed ids make repeats equal; with an event time they are dropped within the watermark."""
    rows = chunk(stream, strategy, size, overlap)
    return rows if event_time is None else rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["chunk_id"])


def append(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, all that is available, exactly once by the checkpoint."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
