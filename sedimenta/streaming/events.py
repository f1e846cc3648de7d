"""Windows, sessions, idempotent intake and latest states over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.session import checkpoint_dir


def stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """The files of a folder whose names match, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str, by: list[str], length: str, late: str, value: str) -> DataFrame:
    """(start, `by`, n, total) of tumbling windows; events later than `late` behind the newest one are dropped by the watermark of a stream."""
    w = F.window(F.col(at), length)
    return events.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """(`by`, start, end, n): runs of events with no gap longer than `gap`, as leases that are renewed."""
    w = F.session_window(F.col(at), gap)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, at: str, key: list[str], late: str) -> DataFrame:
    """Each key once: repeated deliveries within the watermark are dropped with bounded state."""
    marked = events.withWatermark(at, late)
    return marked.dropDuplicatesWithinWatermark(key) if events.isStreaming else marked.dropDuplicates(key)


def drain(result: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there, and return its rows from a table in the checkpoint folder."""
    spark, run = result.sparkSession, uuid.uuid4().hex
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{run}"
    if mode == "append":
        query = result.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/rows")
        query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/rows")
