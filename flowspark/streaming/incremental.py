"""Packets that arrive file by file, added to a stored index and to running flow totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def committed_batches(spark: SparkSession, progress: str) -> int:
    """How many batches a query with this checkpoint has finished."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=-1) + 1


def append_new_packets(spark: SparkSession, folder: str, schema: StructType, index: str, progress: str, files_per_batch: int = 100) -> int:
    """Add the Parquet files of ``folder`` that earlier calls have not seen to the index; returns the number of batches.

    Progress is kept in ``progress``, so a call that was stopped is taken up where it ended. Batches
    are counted there too, as a query remembers its latest ones only.
    """
    before = committed_batches(spark, progress)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = stream.writeStream.format("parquet").option("path", index).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return committed_batches(spark, progress) - before


def windowed_totals(packets: DataFrame, lateness: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Packets and bytes by time window and transport for a stream (or a table) of packets; later ones than ``lateness`` are left out of a stream."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    grouped = timed.groupBy(F.window("ts", window), "protocol").agg(F.count("*").alias("packet_count"), F.sum("original_length").alias("total_bytes"))
    return grouped.select(F.unix_micros("window.start").alias("window_us"), "protocol", "packet_count", "total_bytes")
