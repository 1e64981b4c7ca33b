"""Continuous ingest of evidence lines into a keyed state (an addition of this library).

A file stream of JSON lines (source_fp, k, layer, sha256, written_at) is upserted batch by batch: a later row
of a key evicts earlier ones, also under other sources. Each batch writes a new version of the state and
then names it, so a failed batch leaves the last version in place and is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fragmill.operators.state import upsert

SCHEMA = "source_fp string, k int, layer int, sha256 string, written_at timestamp"


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was named last; without one, no rows."""
    try:
        version = spark.read.text(f"{folder}/current").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        version = None
    if version is None:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/v{version[0]}")


def ingest(spark: SparkSession, incoming: str, folder: str, checkpoint: str):
    """Starts the stream; it ends when all files that are there have been taken."""

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        merged = upsert(load_state(s, folder), df.where("source_fp is not null and k is not null and layer is not null"), ["k", "layer"])
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")
        s.createDataFrame([(str(number),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")

    rows = spark.readStream.schema(SCHEMA).json(incoming)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, size: str, late: str, key: str) -> DataFrame:
    """Counts per key and event-time window with a watermark; the same plan over a table or a stream."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
