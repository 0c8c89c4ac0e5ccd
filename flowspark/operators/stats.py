"""Capture-wide statistics. Every report has all its rows, with zeros where nothing was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import CAPTURE_SIZE, FLOW_PACKETS, bucket_of, bucket_table, labels
from ..functions.text import layer_kind, path_text

# Rows of the hint report, in order, and the hints that each gathers.
HINT_ROWS = [
    ("HTTP", ["http"]), ("TLS", ["tls"]), ("Possible TLS", ["possible_tls"]), ("DNS", ["dns"]), ("QUIC", ["quic"]), ("Possible QUIC", ["possible_quic"]),
    ("SSH", ["ssh"]), ("STUN", ["stun"]), ("BitTorrent", ["bittorrent"]), ("Mail protocols", ["smtp", "pop3", "imap"]), ("DHCP", ["dhcp"]), ("mDNS", ["mdns"]), ("Unknown", []),
]


def percent(part: Column, total: Column) -> Column:
    return F.when((total > 0) & (part > 0), F.lit(100.0) * part / total).otherwise(F.lit(0.0))


def filled(found: DataFrame, names: DataFrame, on: str, measures: list[str]) -> DataFrame:
    return names.join(found, on, "left").select(*names.columns, *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures])


MEASURES = ["flow_count", "packet_count", "captured_bytes", "original_bytes"]


def measured(flows: DataFrame, group: Column, name: str) -> DataFrame:
    return flows.groupBy(group.alias(name)).agg(
        F.count("*").alias("flow_count"), F.sum("packet_count").alias("packet_count"), F.sum("captured_bytes").alias("captured_bytes"), F.sum("total_bytes").alias("original_bytes")
    )


def capture_totals(packets: DataFrame, flows: DataFrame) -> DataFrame:
    seen = packets.agg(F.count("*").alias("packet_count"), F.coalesce(F.sum("original_length"), F.lit(0)).alias("total_bytes"))
    return seen.crossJoin(F.broadcast(flows.agg(F.count("*").alias("flow_count")))).select("packet_count", "flow_count", "total_bytes")


def transport_summary(flows: DataFrame) -> DataFrame:
    rows = flows.sparkSession.createDataFrame([("TCP",), ("UDP",), ("SCTP",), ("Other",)], "transport string")
    group = F.when(F.col("protocol_text").isin("TCP", "UDP", "SCTP"), F.col("protocol_text")).otherwise("Other")
    return filled(measured(flows, group, "transport"), rows, "transport", MEASURES)


def family_summary(flows: DataFrame) -> DataFrame:
    rows = flows.sparkSession.createDataFrame([("IPv4",), ("IPv6",)], "family string")
    return filled(measured(flows, F.col("family"), "family"), rows, "family", MEASURES)


def hint_summary(flows: DataFrame) -> DataFrame:
    """Flows with an ``effective_hint`` gathered in the 13 rows of the hint report, with shares of all flows, packets and bytes."""
    rows = flows.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(HINT_ROWS)], "row_index int, hint_row string")
    group = F.lit("Unknown")
    for name, hints in HINT_ROWS:
        if hints:
            group = F.when(F.col("effective_hint").isin(hints), F.lit(name)).otherwise(group)
    found = filled(measured(flows, group, "hint_row"), rows, "hint_row", MEASURES)
    sums = found.agg(*[F.sum(m).alias(f"_all_{m}") for m in MEASURES])
    shares = [F.round(percent(F.col(m), F.col(f"_all_{m}")), 6).alias(f"{m.split('_')[0]}_percent") for m in ("flow_count", "packet_count", "original_bytes")]
    return found.crossJoin(F.broadcast(sums)).select("row_index", "hint_row", *MEASURES, *shares)


def packet_size_histogram(packets: DataFrame) -> DataFrame:
    found = packets.groupBy(bucket_of(F.col("captured_length"), CAPTURE_SIZE).alias("bucket")).agg(F.count("*").alias("packet_count"), F.sum("captured_length").alias("captured_bytes"), F.max("captured_length").alias("max_length"))
    return filled(found, bucket_table(packets.sparkSession, labels(CAPTURE_SIZE)), "bucket", ["packet_count", "captured_bytes", "max_length"])


def flow_packet_histogram(flows: DataFrame) -> DataFrame:
    some = flows.where("packet_count > 0")
    found = some.groupBy(bucket_of(F.col("packet_count"), FLOW_PACKETS).alias("bucket")).agg(F.count("*").alias("flow_count"), F.sum("total_bytes").alias("original_bytes"))
    return filled(found, bucket_table(flows.sparkSession, labels(FLOW_PACKETS)), "bucket", ["flow_count", "original_bytes"])


def top_endpoints(flows: DataFrame, limit: int = 5) -> DataFrame:
    """Endpoints by bytes, packets and key; a flow counts in full for both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("ep_a").alias("ep"), F.col("endpoint_a").alias("endpoint")), F.struct(F.col("ep_b").alias("ep"), F.col("endpoint_b").alias("endpoint"))))
    each = flows.select("family", ends.alias("_e"), "packet_count", "total_bytes").select("family", "_e.*", "packet_count", "total_bytes")
    found = each.groupBy("family", "ep", "endpoint").agg(F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"))
    return found.orderBy(F.desc("total_bytes"), F.desc("packet_count"), "family", "ep").limit(limit).select("endpoint", "packet_count", "total_bytes")


def top_ports(flows: DataFrame, limit: int = 5) -> DataFrame:
    """Ports by bytes, packets and number; a flow counts for both its ports, port 0 is left out."""
    each = flows.select(F.explode(F.array("ep_a.port", "ep_b.port")).alias("port"), "packet_count", "total_bytes").where("port <> 0")
    found = each.groupBy("port").agg(F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"))
    return found.orderBy(F.desc("total_bytes"), F.desc("packet_count"), "port").limit(limit)


def path_tree(flows: DataFrame, kinds_only: bool = False) -> DataFrame:
    """One row per prefix of the flows' paths, with or without identifiers: depth, flows, packets, bytes, share of packets, and whether a flow ends there."""
    path = F.transform("path", layer_kind) if kinds_only else F.col("path")
    each = flows.where(F.size("path") > 0).select(path.alias("path"), "packet_count", "total_bytes").withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("path"))))
    each = each.select(path_text(F.slice("path", F.lit(1), F.col("depth"))).alias("node"), "depth", "packet_count", "total_bytes", (F.col("depth") == F.size("path")).alias("_end"))
    found = each.groupBy("node", "depth").agg(F.count("*").alias("flow_count"), F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("original_bytes"), F.max("_end").alias("is_terminal"))
    whole = flows.agg(F.sum("packet_count").alias("_all"))
    return found.crossJoin(F.broadcast(whole)).withColumn("packet_percent", F.round(percent(F.col("packet_count"), F.col("_all")), 6)).drop("_all")


def terminal_paths(flows: DataFrame) -> DataFrame:
    return flows.where("protocol_path <> ''").groupBy("protocol_path").agg(F.count("*").alias("flow_count"), F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("original_bytes"))


def node_members(flows: DataFrame, node: str) -> DataFrame:
    """Numbers of the flows whose path starts with the node's."""
    return flows.where((F.col("protocol_path") == node) | F.col("protocol_path").startswith(f"{node} -> ")).select("flow_index")


def unrecognized_statistics(packets: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return packets.agg(F.count("*").alias("packet_count"), zero("captured_length"), zero("original_length"))


def storage_summary(flows: DataFrame) -> DataFrame:
    depth = F.coalesce(F.size("path"), F.lit(0))
    paths = flows.where(F.col("protocol_path") != "").select("protocol_path", depth.alias("depth")).distinct()
    found = paths.agg(F.count("*").alias("unique_paths"), F.coalesce(F.sum("depth"), F.lit(0)).alias("layer_total"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))
    sums = flows.agg(F.count("*").alias("flow_count"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packet_count"), F.coalesce(F.sum("fragmented_packet_count"), F.lit(0)).alias("fragmented_packets"))
    return sums.crossJoin(F.broadcast(found))


def recognition(flows: DataFrame) -> DataFrame:
    """Flows and named flows for each detected hint."""
    return flows.where("protocol_hint is not null").groupBy("protocol_hint").agg(F.count("*").alias("flow_count"), F.count("service_hint").alias("with_service"))


def version_recognition(flows: DataFrame) -> DataFrame:
    """One row for QUIC and TLS each: detected flows, with and without a server name, and by version."""
    rows = flows.sparkSession.createDataFrame([("quic", "v1"), ("quic", "draft29"), ("quic", "v2"), ("quic", "unknown"), ("tls", "tls12"), ("tls", "tls13"), ("tls", "unknown")], "hint string, version string")
    version = F.coalesce(F.when(F.col("protocol_hint") == "quic", F.col("quic_version")).otherwise(F.col("tls_version")), F.lit("unknown"))
    found = flows.where(F.col("protocol_hint").isin("quic", "tls")).groupBy(F.col("protocol_hint").alias("hint"), version.alias("version"))
    found = found.agg(F.count("*").alias("flow_count"), F.count("service_hint").alias("with_sni"), (F.count("*") - F.count("service_hint")).alias("without_sni"))
    return rows.join(found, ["hint", "version"], "left").na.fill(0)


# Names of the versions of TLS and QUIC.
VERSION_TEXTS = {"tls12": "TLS 1.2", "tls13": "TLS 1.3", "v1": "QUIC v1", "draft29": "QUIC draft-29", "v2": "QUIC v2"}
NO_PANEL = "No protocol-specific metadata available"


def protocol_panel(flows: DataFrame, controls: DataFrame) -> DataFrame:
    """What is to be told of each flow's protocol: version and service of TLS and QUIC, control packets of TCP, or that there is nothing.

    ``controls`` has the flows' SYN, FIN and RST counts by flow_index.
    """
    hint = F.col("protocol_hint")
    version = F.when(hint == "tls", F.col("tls_version")).when(hint == "quic", F.col("quic_version"))
    text = F.lit("unknown")
    for value, name in VERSION_TEXTS.items():
        text = F.when(version == value, name).otherwise(text)
    told = hint.isin("tls", "quic")
    joined = flows.join(controls, "flow_index", "left")
    tcp = F.col("protocol") == 6
    counts = [F.when(tcp, F.coalesce(c, F.lit(0))).alias(c) for c in ("syn_count", "fin_count", "rst_count")]
    nothing = ~F.coalesce(told, F.lit(False)) & ~tcp
    return joined.select("flow_index", F.when(told, text).alias("version_text"), F.when(told, F.col("service_hint")).alias("service_text"), *counts, F.when(nothing, NO_PANEL).alias("fallback_text"))
