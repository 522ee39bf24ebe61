"""Incremental ingestion: passages arrive as a stream and facts are upserted once each, however often a batch is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom import schemas
from graphloom.operators.tables import Catalog, pending_passages


def ingest_stream(passages: DataFrame, catalog: Catalog, extract: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that extracts facts from each batch of passages and upserts them by key.

    ``extract`` turns a batch of (sample_id, source_text_id, text) into routed tables. Passages whose facts are stored are skipped, and
    upserts keep the first row of a key, so a batch that runs again after a failure changes nothing.
    """
    key = schemas.KEYS[catalog.mode]["triplets"]

    def write(batch: DataFrame, _: int) -> None:
        todo = pending_passages(batch, catalog.read("initial_triplets"))
        for name, rows in extract(todo).items():
            # The order within a batch is that of the passages and of the facts in each.
            ordered = rows.withColumn("_order", F.struct("sample_id", "source_text_id", "seq")).drop("seq") if "seq" in rows.columns else rows
            catalog.upsert(name, ordered, key if name != "filtered_triplets" else [*key, "source_text_id"], "_order" if "seq" in rows.columns else None)

    writer = passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time, with a watermark; an addition of ours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
