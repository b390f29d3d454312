"""Incremental evidence: a stream of texts becomes a versioned table keyed by stable ids, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.evidence import records
from lodestone.sources import versions


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Evidence of a stream with columns source, text and at, by source: its text with the last ``at`` is in force, and a null text deletes it.

    A batch is the version of its number, so one that is played again writes what it wrote. All that is there, then stop.
    """

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("source").agg(F.max_by(F.struct("text", "at"), "at").alias("x")).select("source", "x.text")
        new = records(last.where("text is not null"), "stream", [F.col("source")], F.col("source"), F.col("text"))
        versions.write(new.select("source", "evidence_id", "title", "text", "content_hash"), table, "source", last.where("text is null"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) for each window; later ones than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
