"""Append-only ingestion by Structured Streaming, and the checks that a restart needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from sparkvec.sources.store import VectorStore


def ingest(stream: DataFrame, store: VectorStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of stream (embedding, ord) to store. The manifest keeps the last batch taken, so a batch
    delivered again after a failure changes nothing."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: store.append(rows, batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(log: DataFrame, stored: DataFrame, watermark: int) -> DataFrame:
    """Entries of log (lsn, vec_id, ...) from watermark on whose ids aren't stored, each id once, by its first entry."""
    fresh = log.where(F.col("lsn") >= watermark).join(stored.select("vec_id"), "vec_id", "left_anti")
    first = fresh.groupBy("vec_id").agg(F.min("lsn").alias("lsn"))
    return fresh.join(first, ["vec_id", "lsn"], "left_semi")


def gaps(ids: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(vec_id, next_id) where an id doesn't follow the one before. Neighbours are sought within spans of ids; the ends
    of spans, a row each, are compared after."""
    inside = Window.partitionBy("span").orderBy("vec_id")
    spans = ids.select("vec_id", F.floor(F.col("vec_id") / span).alias("span"))
    near = spans.select("vec_id", F.lead("vec_id").over(inside).alias("next_id")).where("next_id is not null")
    ends = spans.groupBy("span").agg(F.max("vec_id").alias("vec_id"), F.min("vec_id").alias("first"))
    across = ends.select("vec_id", F.lead("first").over(Window.orderBy("span")).alias("next_id")).where("next_id is not null")
    return near.unionByName(across).where("next_id - vec_id <> 1")


def verify(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: how many vectors are expected, missing and different."""
    e = expected.select("vec_id", F.col("embedding").alias("want"))
    both = e.join(stored.select("vec_id", "embedding"), "vec_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum(F.col("embedding").isNull().cast("long")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum((F.col("embedding") != F.col("want")).cast("long")), F.lit(0)).alias("mismatched"),
    )


def unindexed(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """Ids that are stored but not in the index."""
    return stored.select("vec_id").join(indexed.select("vec_id"), "vec_id", "left_anti")
