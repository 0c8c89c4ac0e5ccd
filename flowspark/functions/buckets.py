"""Fixed histogram buckets, as inclusive ranges; the last of each has no upper bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower bounds and labels of the four histograms.
CAPTURE_SIZE = [0, 64, 128, 256, 512, 1024, 1400, 1551, 2500, 5001, 9001, 16001, 25001]
FLOW_SIZE = [0, 64, 128, 256, 512, 1024, 1400, 1551, 2500, 5001]
FLOW_PACKETS = [1, 2, 3, 6, 11, 26, 51, 101, 251, 501, 1001, 5001]
INTER_ARRIVAL = [0, 10, 100, 1000, 10000, 100000, 500000, 1000000, 8000000]
INTER_ARRIVAL_LABELS = ["0-9 us", "10-99 us", "100-999 us", "1-9.9 ms", "10-99 ms", "100-499 ms", "500-999 ms", "1-8 s", "8 s+"]


def labels(bounds: list[int]) -> list[str]:
    """``lo-hi``, ``n`` where both are equal, ``lo+`` for the last."""
    spans = [(lo, hi - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [str(lo) if lo == hi else f"{lo}-{hi}" for lo, hi in spans] + [f"{bounds[-1]}+"]


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of the bucket that holds ``value``, from 0; null below the first."""
    found = F.lit(None).cast("int")
    for i, low in enumerate(bounds):
        found = F.when(value >= low, F.lit(i)).otherwise(found)
    return found


def bucket_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """One row per bucket, so that empty ones can be filled with zero."""
    return spark.createDataFrame(list(enumerate(names)), "bucket int, bucket_label string")
