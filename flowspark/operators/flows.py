"""Packets grouped into canonical bidirectional flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.text import endpoint_text, path_text, protocol_text

KEY = ["family", "ep_lo", "ep_hi", "protocol", "path"]
MAX_LAYERS = 32


def normalize_path(packets: DataFrame, ignore_vlan_and_mpls: bool = False, ignore_gtpu_teid: bool = False) -> DataFrame:
    """The path as it identifies a flow: without VLAN 0, on request without VLAN and MPLS or GTP-U's TEID; null if empty or too deep."""
    path = F.filter("path", lambda x: x != "VLAN(vid=0)")
    if ignore_vlan_and_mpls:
        path = F.filter(path, lambda x: ~x.rlike("^(VLAN|MPLS)\\b"))
    if ignore_gtpu_teid:
        path = F.transform(path, lambda x: F.when(x.startswith("GTP-U("), "GTP-U").otherwise(x))
    return packets.withColumn("path", F.when((F.size(path) > 0) & (F.size(path) <= MAX_LAYERS), path))


def with_key(packets: DataFrame) -> DataFrame:
    """Adds the flow key: the lesser and the greater endpoint (address, port), in unsigned byte order, and source as an endpoint."""
    source = F.struct(F.col("src_addr").alias("addr"), F.col("src_port").alias("port"))
    target = F.struct(F.col("dst_addr").alias("addr"), F.col("dst_port").alias("port"))
    return normalize_path(packets).withColumns({"ep_src": source, "ep_lo": F.least(source, target), "ep_hi": F.greatest(source, target)})


def flows_of(packets: DataFrame) -> DataFrame:
    """One row per flow with totals and per-direction counts; bytes are original lengths.

    The first packet's source is endpoint A. Counts are kept for the lesser and the greater
    endpoint and named A and B afterwards, so one aggregation with partial sums on the map side
    does it, whatever share of the packets one flow has. Each hint field has its first known value
    in packet order.
    """
    keyed = with_key(packets)
    from_lo = F.col("ep_src") == F.col("ep_lo")
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    total = lambda x, value: F.sum(F.when(x, F.col(value)).otherwise(0)).cast("long")
    grouped = keyed.groupBy(*KEY).agg(
        F.min_by("ep_src", "packet_index").alias("first_src"),
        F.count("*").alias("packet_count"),
        F.sum("original_length").alias("total_bytes"),
        F.sum("captured_length").alias("captured_bytes"),
        count(from_lo).alias("_n_lo"),
        total(from_lo, "original_length").alias("_bytes_lo"),
        total(from_lo, "captured_length").alias("_captured_lo"),
        count(F.col("is_ip_fragmented")).alias("fragmented_packet_count"),
        F.min_by("hint", F.when(F.col("hint").isNotNull(), F.col("packet_index"))).alias("protocol_hint"),
        F.min_by("service", F.when(F.col("service").isNotNull(), F.col("packet_index"))).alias("service_hint"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("packet_index"))).alias(c) for c in ("tls_version", "quic_version") if c in packets.columns],
        F.min("ts_us").alias("first_ts_us"),
        F.max("ts_us").alias("last_ts_us"),
        F.min_by("ts_us", "packet_index").alias("first_packet_ts_us"),
        F.max_by("ts_us", "packet_index").alias("last_packet_ts_us"),
        F.min("packet_index").alias("first_packet_index"),
        F.max("packet_index").alias("last_packet_index"),
    )
    lo_first = F.col("first_src") == F.col("ep_lo")
    side = lambda a, b: F.when(lo_first, F.col(a)).otherwise(F.col(b))
    split = lambda name, whole: {f"{name}_a_to_b": F.when(lo_first, F.col(f"_{short[name]}_lo")).otherwise(F.col(whole) - F.col(f"_{short[name]}_lo")), f"{name}_b_to_a": F.when(lo_first, F.col(whole) - F.col(f"_{short[name]}_lo")).otherwise(F.col(f"_{short[name]}_lo"))}
    short = {"packets": "n", "bytes": "bytes", "captured": "captured"}
    named = grouped.withColumns({"ep_a": side("ep_lo", "ep_hi"), "ep_b": side("ep_hi", "ep_lo"), **split("packets", "packet_count"), **split("bytes", "total_bytes"), **split("captured", "captured_bytes")})
    return named.drop("_n_lo", "_bytes_lo", "_captured_lo").withColumns(
        {
            "protocol_text": protocol_text(F.col("protocol")),
            "endpoint_a": endpoint_text(F.col("ep_a.addr"), F.col("ep_a.port")),
            "endpoint_b": endpoint_text(F.col("ep_b.addr"), F.col("ep_b.port")),
            "protocol_path": F.coalesce(path_text(F.col("path")), F.lit("")),
            "has_fragmented_packets": F.col("fragmented_packet_count") > 0,
        }
    )



def canonical_order() -> list:
    """Bytes and packets, most first, then the key."""
    return [F.desc("total_bytes"), F.desc("packet_count"), "family", "ep_lo", "ep_hi", "protocol", "protocol_path"]


def numbered(df: DataFrame, order: list, name: str = "flow_index", first: int = 1) -> DataFrame:
    """Adds the row's number in ``order`` over the whole table.

    Rows are sorted in ranges, not in one task: each range numbers its own rows, and the counts of
    the ranges before are added.
    """
    ranged = stored(df, "unnumbered").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered").withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + F.col("_in") + first).drop("_range", "_at", "_in", "_before")


def list_flows(packets: DataFrame) -> DataFrame:
    """All flows in canonical order (bytes, packets, family, key) with their one-based number."""
    return numbered(flows_of(packets), canonical_order())


def flow_key() -> Column:
    """128 bits that stand for a flow's key, for windows over packets before flows are numbered."""
    return F.struct(F.xxhash64(*KEY).alias("k1"), F.xxhash64(F.lit(1), *KEY).alias("k2"))


def by_key(packets: DataFrame, directed: bool = True) -> DataFrame:
    """Packets with their flow's key as flow_index and, if ``directed``, their direction by the source of the flow's first packet."""
    keyed = with_key(packets).withColumn("flow_index", flow_key())
    if not directed:
        return keyed
    first = keyed.groupBy("flow_index").agg(F.min_by("ep_src", "packet_index").alias("_first"))
    return keyed.join(first, "flow_index").withColumn("direction", F.when(F.col("ep_src") == F.col("_first"), "A->B").otherwise("B->A")).drop("_first")


def with_numbers(found: DataFrame, flows: DataFrame) -> DataFrame:
    """Results by flow key with the flows' numbers in place of the keys."""
    numbers = flows.select(flow_key().alias("_key"), F.col("flow_index").alias("_number"))
    joined = found.join(numbers, found["flow_index"] == numbers["_key"])
    return joined.select(F.col("_number").alias("flow_index"), *[c for c in found.columns if c != "flow_index"])


def with_flow(packets: DataFrame, flows: DataFrame, *columns: str) -> DataFrame:
    """Packets with their flow's columns and direction (``A->B`` or ``B->A``)."""
    own = flows.select(*[F.col(c).alias(f"_own_{c}") for c in KEY], "first_src", *columns)
    # The path is part of the key, null or not: else each packet would meet all flows of its endpoints.
    same = [F.col("path").eqNullSafe(F.col("_own_path")), *[F.col(c) == F.col(f"_own_{c}") for c in KEY[:-1]]]
    joined = with_key(packets).join(own, same).drop(*[f"_own_{c}" for c in KEY])
    return joined.withColumn("direction", F.when(F.col("ep_src") == F.col("first_src"), "A->B").otherwise("B->A"))


def without_flow(packets: DataFrame, owned: DataFrame) -> DataFrame:
    """Packets whose index no flow owns."""
    return packets.join(owned.select("packet_index"), "packet_index", "left_anti")


def effective_hint(flows: DataFrame, guess_port_443: bool = False) -> DataFrame:
    """Adds the hint to show: the detected one, else on request what port 443 suggests."""
    on_443 = (F.col("ep_a.port") == 443) | (F.col("ep_b.port") == 443)
    guess = F.when(on_443 & (F.col("protocol") == 6), "possible_tls").when(on_443 & (F.col("protocol") == 17), "possible_quic")
    return flows.withColumn("effective_hint", F.coalesce("protocol_hint", guess) if guess_port_443 else F.col("protocol_hint"))
