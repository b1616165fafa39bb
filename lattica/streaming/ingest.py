"""Continuous ingest: new papers are chunked and appended, content already stored is skipped."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import chunking, incremental


def chunk_stream(papers: DataFrame, store: str, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that writes the new chunks of a stream of papers (seq, paper_id, full_text) under `store`.

    Each batch writes its own directory, named by its id and replaced on a retry, so a batch run again after
    a failure changes nothing; chunks whose hash the paper has in an earlier batch are skipped.
    """
    spark = papers.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        text = batch.where("full_text IS NOT NULL").select("seq", "paper_id", "full_text")
        made = chunking.chunks(text).join(text.select("seq", "paper_id"), "seq").dropDuplicates(["paper_id", "chunk_hash"])
        earlier = stored(spark, store)
        new = incremental.diff(made, earlier.where(F.col("batch") < number))[0] if earlier is not None else made
        new.withColumn("extraction_status", F.lit("pending")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    # Beside the store and named by it, so that a later process goes on where this one stopped.
    where = checkpoint or f"{store.rstrip('/')}-checkpoint-{md5(store.encode(), usedforsecurity=False).hexdigest()[:12]}"
    return papers.writeStream.foreachBatch(write).option("checkpointLocation", where).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The chunks written so far, None before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(store)
    except AnalysisException:
        return None


def activity(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Counts per window and event type of a stream (or table) of events, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
