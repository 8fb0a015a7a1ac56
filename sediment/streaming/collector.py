"""Continuous collection: observations that arrive as files are committed batch by batch, and late data is told apart.

Each micro-batch commits one observation of each source in it. ``foreachBatch`` may run a batch again after a failure; a
snapshot's number comes from the batch's, and commits of a number that is there already change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.archive import Archive

INTERVAL = "3 hours"


def drops(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Files of observed rows as a stream; ``schema`` has ``source_key`` and ``captured_at`` besides the rows' fields."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def collect(stream: DataFrame, archive: Archive, keys: dict[str, Sequence[str]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Commit every source's rows of each batch; a source that fails is on record as failed and holds up no other."""
    order = {s: k for k, s in enumerate(sorted(keys))}

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for r in batch.groupBy("source_key").agg(F.max("captured_at").alias("at")).collect():
                key, snapshot = r["source_key"], number * max(1, len(order)) + order.get(r["source_key"], 0) + 1
                if key not in order:
                    continue
                try:
                    archive.commit(key, snapshot, r["at"], batch.where(F.col("source_key") == key).drop("source_key", "captured_at"), list(keys[key]))
                except Exception as e:  # a difficult table, also one that only fails when Spark computes it
                    archive.fail(key, snapshot, r["at"], f"{type(e).__name__}: {e}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def closed_windows(stream: DataFrame, at: str, window: str, lateness: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of event-time windows, given out once the watermark has passed them; later rows no longer count."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n"))


def late_rows(rows: DataFrame, counts: DataFrame, at: str, window: str, by: Sequence[str] = ()) -> DataFrame:
    """Per window, rows that are there now beyond those counted when it closed: the arrivals into a closed window."""
    now = rows.groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("now"))
    return now.join(counts.withColumnRenamed("n", "then"), ["window", *by], "left").withColumn("late", F.col("now") - F.coalesce("then", F.lit(0))).where("late > 0")
