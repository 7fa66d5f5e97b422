"""A stream of queries against the index of a reference: stateless, each batch joined with the static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.blocking import Index, query_candidates


def link_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, top_k: int = 5) -> StreamingQuery:
    """Gives ``sink`` the best candidates of every micro-batch. Top-k by query needs the whole batch, hence foreachBatch."""
    return queries.writeStream.foreachBatch(lambda batch, n: sink(query_candidates(index, batch, top_k), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; works on streams (watermark ``late``) and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
