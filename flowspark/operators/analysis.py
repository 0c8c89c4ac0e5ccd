"""Time analysis of every flow at once; filter on flow_index for one flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import FLOW_SIZE, INTER_ARRIVAL, INTER_ARRIVAL_LABELS, bucket_of, bucket_table, labels
from ..functions.scan import with_running

BURST_GAP_US = 1_000
IDLE_GAP_US = 100_000
PREVIEW_PACKETS = 20
MIN_WINDOW_US, MAX_WINDOW_US, MAX_WINDOWS = 10_000, 1_000_000, 99


#: A flow's packets by time; packets of one time by number.
IN_TIME = ["ts_us", "packet_index"]


def with_gaps(owned: DataFrame) -> DataFrame:
    """Adds the time since the flow's packet before, in either direction; a flow may span many tasks."""
    return with_running(owned, "flow_index", IN_TIME, previous={"_was": F.col("ts_us")}).withColumn("gap_us", F.col("ts_us") - F.col("_was")).drop("_was")


def per_second(amount: Column, duration_us: Column) -> Column:
    return F.when(duration_us > 0, F.round(amount * 1_000_000.0 / duration_us, 6)).otherwise(F.lit(0.0))


def inter_arrival(owned: DataFrame) -> DataFrame:
    """Number, sum, mean and largest of each flow's gaps."""
    gaps = with_gaps(owned.select("flow_index", *IN_TIME)).groupBy("flow_index").agg(F.count("gap_us").alias("gap_count"), F.coalesce(F.sum("gap_us"), F.lit(0)).alias("gap_sum_us"), F.coalesce(F.max("gap_us"), F.lit(0)).alias("largest_gap_us"))
    return gaps.withColumn("mean_gap_us", F.when(F.col("gap_count") > 0, F.round(F.col("gap_sum_us") / F.col("gap_count"), 6)).otherwise(0.0))


def rates(flows: DataFrame) -> DataFrame:
    duration = F.col("last_ts_us") - F.col("first_ts_us")
    return flows.select("flow_index", duration.alias("duration_us"), per_second(F.col("packet_count"), duration).alias("packets_per_second"), per_second(F.col("total_bytes"), duration).alias("bytes_per_second"))


def bursts(owned: DataFrame) -> DataFrame:
    """Runs of two packets or more with gaps below 1 ms: how many, most packets, most bytes."""
    starts = F.when(F.col("gap_us") < BURST_GAP_US, 0).otherwise(1)
    runs = with_running(with_gaps(owned.select("flow_index", *IN_TIME, "original_length")), "flow_index", IN_TIME, sums={"_before": starts}).withColumn("_run", F.col("_before") + starts)
    runs = runs.groupBy("flow_index", "_run").agg(F.count("*").alias("n"), F.sum("original_length").alias("bytes"))
    burst = lambda c: F.when(F.col("n") >= 2, F.col(c))
    found = runs.groupBy("flow_index").agg(F.count(burst("n")).alias("burst_count"), F.coalesce(F.max(burst("n")), F.lit(0)).alias("max_burst_packets"), F.coalesce(F.max(burst("bytes")), F.lit(0)).alias("max_burst_bytes"))
    return found


def idle_gaps(owned: DataFrame) -> DataFrame:
    idle = F.when(F.col("gap_us") >= IDLE_GAP_US, F.col("gap_us"))
    return with_gaps(owned.select("flow_index", *IN_TIME)).groupBy("flow_index").agg(F.count(idle).alias("idle_gap_count"), F.coalesce(F.max(idle), F.lit(0)).alias("largest_idle_gap_us"))


def three_way(rows: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """Counts by bucket over all flows' packets: both directions, A to B, B to A."""
    one = lambda d: F.count(F.when(F.col("direction") == d, 1))
    found = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("all_count"), one("A->B").alias("a_to_b_count"), one("B->A").alias("b_to_a_count")).where("bucket is not null")
    table = bucket_table(rows.sparkSession, names)
    return table.join(found, "bucket", "left").na.fill(0)


def inter_arrival_histogram(owned: DataFrame) -> DataFrame:
    return three_way(with_gaps(owned.select("flow_index", *IN_TIME, "direction")).where("gap_us is not null"), bucket_of(F.col("gap_us"), INTER_ARRIVAL), INTER_ARRIVAL_LABELS)


def size_histogram(owned: DataFrame) -> DataFrame:
    return three_way(owned, bucket_of(F.col("original_length"), FLOW_SIZE), labels(FLOW_SIZE))


def rate_graph(owned: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets and bytes of each flow in equal windows from its first packet, empty windows included.

    The window is a hundredth of the duration, within 10 ms and 1 s, and wide enough for 100 windows at most. Flows with
    fewer than three windows that hold packets have no graph.
    """
    duration = F.col("last_ts_us") - F.col("first_ts_us")
    width = F.greatest(F.least(F.greatest(F.expr("(last_ts_us - first_ts_us) div 100"), F.lit(MIN_WINDOW_US)), F.lit(MAX_WINDOW_US)), F.ceil(duration / MAX_WINDOWS))
    sized = flows.select("flow_index", "first_ts_us", duration.alias("duration_us"), width.cast("long").alias("window_us"))
    counted = owned.select("flow_index", "ts_us", "original_length").join(sized, "flow_index").withColumn("window", F.expr("(ts_us - first_ts_us) div window_us"))
    counted = counted.groupBy("flow_index", "window").agg(F.count("*").alias("packet_count"), F.sum("original_length").alias("byte_count"))
    shown = counted.groupBy("flow_index").agg(F.count("*").alias("_n")).where("_n >= 3").select("flow_index")
    grid = sized.join(shown, "flow_index").select("flow_index", "window_us", F.explode(F.expr("sequence(0L, duration_us div window_us)")).alias("window"))
    return grid.join(counted, ["flow_index", "window"], "left").na.fill(0, ["packet_count", "byte_count"])


def preview(owned: DataFrame, packets: int = PREVIEW_PACKETS) -> DataFrame:
    """The first packets of each flow in time, with the gap before each."""
    shown = ["flow_index", *IN_TIME, "direction", "captured_length", "original_length"]
    ranked = with_running(with_gaps(owned.select(shown)), "flow_index", IN_TIME, sums={"_before": F.lit(1)}).withColumn("number", (F.col("_before") + 1).cast("int")).where(F.col("number") <= packets)
    return ranked.select("flow_index", "number", "packet_index", "direction", F.coalesce("gap_us", F.lit(0)).alias("delta_us"), "captured_length", "original_length")


def verdict(a: Column, b: Column) -> Column:
    """Balanced if the larger is twice the smaller at most."""
    return F.when(F.greatest(a, b) <= 2 * F.least(a, b), "Balanced").when(a > b, "Mostly A->B").otherwise("Mostly B->A")


def ratio_text(a: Column, b: Column) -> Column:
    """``x : 1`` or ``1 : x`` with one decimal unless whole; ``n : 0`` where one side is empty."""
    scaled = F.round(F.greatest(a, b) / F.least(a, b), 1)
    text = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(scaled.cast("decimal(20,1)").cast("string"))
    both = F.when(a >= b, F.concat(text, F.lit(" : 1"))).otherwise(F.concat(F.lit("1 : "), text))
    return F.when((a == 0) | (b == 0), F.concat(a.cast("string"), F.lit(" : "), b.cast("string"))).otherwise(both)


def directions(flows: DataFrame) -> DataFrame:
    pa, pb, ba, bb = (F.col(c) for c in ("packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a"))
    return flows.select("flow_index", ratio_text(pa, pb).alias("packet_ratio"), ratio_text(ba, bb).alias("byte_ratio"), verdict(pa, pb).alias("packet_verdict"), verdict(ba, bb).alias("data_verdict"))


def control_counts(owned: DataFrame) -> DataFrame:
    has = lambda bit: F.count(F.when(F.col("tcp_flags").bitwiseAND(bit) != 0, 1))
    return owned.where("protocol = 6").groupBy("flow_index").agg(has(2).alias("syn_count"), has(1).alias("fin_count"), has(4).alias("rst_count"))


def size_limits(owned: DataFrame) -> DataFrame:
    one = lambda f, d: F.coalesce(f(F.when(F.col("direction") == d, F.col("original_length"))), F.lit(0))
    return owned.groupBy("flow_index").agg(
        F.min("original_length").alias("min_length"), F.max("original_length").alias("max_length"), F.max("captured_length").alias("max_captured"),
        one(F.min, "A->B").alias("min_a_to_b"), one(F.max, "A->B").alias("max_a_to_b"), one(F.min, "B->A").alias("min_b_to_a"), one(F.max, "B->A").alias("max_b_to_a"),
    )
