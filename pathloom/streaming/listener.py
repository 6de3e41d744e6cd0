"""Change feeds: batches of new edges keep derived tables current (an extension; statements themselves are not streams).

A feed is a streaming DataFrame of edges ``(_src, _dst, _rank, _time)``. Degrees in event-time windows use Spark's own
watermarks and state; the full-text listener appends the words of new texts to an inverted index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.sources.fulltext import inverted_index


def windowed_degrees(feed: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Edges that leave each vertex in each event-time window: ``(window_start, _vid, degree)``.

    Edges later than ``late`` are dropped with their state; Spark aggregates partially before it shuffles.
    """
    timed = feed.withWatermark("_time", late)
    frame = F.window("_time", window, slide) if slide else F.window("_time", window)
    return timed.groupBy(frame, F.col("_src").alias("_vid")).agg(F.count("*").alias("degree")).select(F.col("window.start").alias("window_start"), "_vid", "degree")


def distinct_edges(feed: DataFrame, late: str = "2 hours") -> DataFrame:
    """Edges of a feed, each key once within the watermark."""
    return feed.withWatermark("_time", late).dropDuplicatesWithinWatermark(["_src", "_dst", "_rank"])


def fulltext_listener(feed: DataFrame, key: str, text: str, path: str, checkpoint: str):
    """Append the inverted index of each batch of new texts to ``path``; exactly once, by the checkpoint and file sink."""
    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        inverted_index(batch, key, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
