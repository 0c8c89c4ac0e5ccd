"""Report rows and texts of flows, and what a capture's index remembers of its source."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field, csv_path, file_name, tree_percent_text
from ..sources.pcap import NG_MAGIC, PCAP_MAGIC, Source
from .flows import numbered

# Columns of the report of all flows and of a sampled export's manifest.
FLOW_COLUMNS = "flow_id family transport protocol protocol_hint src_ip src_port dst_ip dst_port packet_count captured_bytes original_bytes first_timestamp last_timestamp duration_us protocol_path".split()
EXPORT_COLUMNS = "exported_packet_count exported_captured_bytes exported_original_bytes".split()
MANIFEST_COLUMNS = [*FLOW_COLUMNS[:1], "file_name", *FLOW_COLUMNS[1:-1], *EXPORT_COLUMNS, FLOW_COLUMNS[-1]]
EDGE_BYTES = 64 * 1024


def seconds_text(column: str) -> Column:
    """Seconds with six decimals."""
    return F.concat(F.expr(f"{column} div 1000000").cast("string"), F.lit("."), F.lpad((F.col(column) % 1_000_000).cast("string"), 6, "0"))


def flow_report(rows: DataFrame) -> DataFrame:
    """The 16 report columns of flows with their texts (``query.flow_rows``); what is unknown is called so."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    first, last = F.col("first_packet_ts_us"), F.col("last_packet_ts_us")
    values = [
        F.col("flow_index"), F.col("family"), known("protocol_text"), known("effective_hint"), known("service_hint"), F.col("address_a"), F.col("ep_a.port"), F.col("address_b"), F.col("ep_b.port"),
        F.col("packet_count"), F.col("captured_bytes"), F.col("total_bytes"), seconds_text("first_packet_ts_us"),
        seconds_text("last_packet_ts_us"), F.greatest(last - first, F.lit(0)), csv_path(F.col("protocol_path")),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, FLOW_COLUMNS, strict=True)])


def manifest(rows: DataFrame, exported: DataFrame) -> DataFrame:
    """The 20 manifest columns of flows of which packets were exported (rows of packets with flow_index)."""
    sums = exported.groupBy(F.col("flow_index").alias("flow_id")).agg(
        F.count("*").alias("exported_packet_count"), F.sum("captured_length").alias("exported_captured_bytes"), F.sum("original_length").alias("exported_original_bytes")
    )
    report = flow_report(rows)
    address = lambda c: F.regexp_replace(c, "[^A-Za-z0-9.-]", "_")
    name = F.concat(
        F.lpad(F.col("flow_id").cast("string"), 6, "0"), F.lit("_"), file_name(F.col("protocol")), F.lit("_"), file_name(F.col("protocol_hint")), F.lit("_"), file_name(F.col("transport")), F.lit("_"),
        address(F.col("src_ip")), F.lit("_"), F.col("src_port").cast("string"), F.lit("-"), address(F.col("dst_ip")), F.lit("_"), F.col("dst_port").cast("string"), F.lit(".pcap"),
    )
    return report.join(sums, "flow_id").withColumn("file_name", name).select(*MANIFEST_COLUMNS)


def csv_lines(rows: DataFrame, name: str = "line") -> DataFrame:
    """One CSV line for each row, without a header."""
    return rows.select(F.array_join(F.array(*[csv_field(F.col(c).cast("string")) for c in rows.columns]), ",").alias(name))


def tree_text(tree: DataFrame) -> DataFrame:
    """(position, line): the rows of ``stats.path_tree`` depth first, siblings by packets, flows (most first) and text; two blanks a level.

    A node's place follows from its own and its ancestors' keys, joined by depth; a tree has at most
    one row for each prefix of each path, however many flows there are.
    """
    layers = F.split("node", " -> ")
    own = tree.select("node", "depth", "flow_count", "packet_count", "packet_percent", layers.alias("layers"))
    keys = own.select(F.col("node").alias("prefix"), F.struct((-F.col("packet_count")).alias("p"), (-F.col("flow_count")).alias("f"), F.col("node").alias("n")).alias("key"), F.col("depth").alias("level"))
    each = own.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("layers")))).withColumn("prefix", F.array_join(F.slice("layers", F.lit(1), F.col("level")), " -> "))
    joined = each.join(keys.drop("level"), "prefix")
    placed = joined.groupBy("node", "depth", "flow_count", "packet_count", "packet_percent", "layers").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "key"))), lambda x: x["key"]).alias("order"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at("layers", -1), F.lit("  flows: "), F.col("flow_count").cast("string"), F.lit(", packets: "), F.col("packet_count").cast("string"), F.lit(" ("), tree_percent_text(F.col("packet_percent")), F.lit(")"))
    return numbered(placed.select("order", line.alias("line")), ["order"], "position").select("position", "line")


def byte_texts(data: Column) -> dict[str, Column]:
    """A byte string as continuous hexadecimal, blank-separated hexadecimal, base64, a C list of 16 a line and an escaped string."""
    # One pass over the digits for each text: picking each byte by its place would walk the text anew every time.
    digits = F.hex(data)
    each = F.regexp_replace(digits, "..", "0x$0, ")
    return {
        "hex": digits,
        "hex_spaced": F.regexp_replace(digits, "..(?=.)", "$0 "),
        "base64": F.regexp_replace(F.base64(data), "[\\r\\n]", ""),
        "c_list": F.rtrim(F.regexp_replace(each, "(.{94}), ", "$1\n"), F.lit(", \n")),
        "escaped": F.regexp_replace(digits, "..", r"\\x$0"),
    }


def describe_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, format, size and a digest of the first and last 64 KiB of each capture under ``path``; only these are read."""
    formats = {PCAP_MAGIC: "pcap", NG_MAGIC: "pcapng"}

    def describe(batches):
        source = Source()
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = source.read(path, 0, min(size, EDGE_BYTES))
                tail = source.read(path, max(0, size - EDGE_BYTES), min(size, EDGE_BYTES))
                rows.append((path, formats.get(head[:4], "unknown"), size, hashlib.sha256(head + tail).hexdigest()))
            source.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64(), pa.string())], names=["path", "format", "size", "edges"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(describe, "path string, format string, size long, edges string")


def changed_sources(known: DataFrame, now: DataFrame) -> DataFrame:
    """Sources that are missing, new or not what they were when the index was made: path and what is wrong."""
    a, b = known.alias("a"), now.alias("b")
    wrong = F.when(F.col("b.size").isNull(), "missing").when(F.col("a.size").isNull(), "new").when(F.col("a.format") != F.col("b.format"), "format").when(F.col("a.size") != F.col("b.size"), "size").when(F.col("a.edges") != F.col("b.edges"), "content")
    return a.join(b, "path", "full").select("path", wrong.alias("wrong")).where("wrong is not null")
