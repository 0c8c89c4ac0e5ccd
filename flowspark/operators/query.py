"""Text filter, selection, sort, limit and sampling over flows and their packets."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import BLOCK, with_running
from ..functions.text import address_text, ascii_lower, hint_text
from .flows import numbered

FILTER_FIELDS = ["family", "protocol_text", "hint_text", "service_text", "address_a", "address_b", "endpoint_a", "endpoint_b", "port_a", "port_b"]


def flow_rows(flows: DataFrame) -> DataFrame:
    """Flows with the text columns that filters and reports use."""
    return flows.withColumns(
        {
            "hint_text": hint_text(F.col("effective_hint")),
            "service_text": F.coalesce("service_hint", F.lit("")),
            "address_a": address_text(F.col("ep_a.addr")),
            "address_b": address_text(F.col("ep_b.addr")),
            "port_a": F.col("ep_a.port").cast("string"),
            "port_b": F.col("ep_b.port").cast("string"),
        }
    )


def matches(needle: str, with_fragments: bool = False) -> Column:
    """Any text field holds the needle, whatever the case of A-Z; an empty needle matches all."""
    low = needle.translate({c: c + 32 for c in range(65, 91)})
    found = F.lit(not low)
    for field in FILTER_FIELDS:
        found = found | F.contains(ascii_lower(F.col(field)), F.lit(low))
    if with_fragments:
        found = found | (F.lit("frag".startswith(low)) & F.col("has_fragmented_packets")) | F.contains(F.col("fragmented_packet_count").cast("string"), F.lit(low))
    return found


def parse_numbers(text: str) -> list[int]:
    """Sorted distinct numbers of a list such as ``1-3,8``; ValueError for anything else."""
    found: set[int] = set()
    for part in text.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not lo.isdigit() or (dash and not hi.isdigit()):
            raise ValueError(f"not a flow number or range: {part!r}")
        first, last = int(lo), int(hi or lo)
        if first < 1 or last < first:
            raise ValueError(f"not a range: {part!r}")
        found.update(range(first, last + 1))
    return sorted(found)


SORT_KEYS = {
    "index": ["flow_index"],
    "packets": ["packet_count"],
    "bytes": ["total_bytes"],
    "protocol": ["protocol_text"],
    "service": ["service_text"],
    "source": ["family", "ep_a"],
    "destination": ["family", "ep_b"],
    "fragments": ["fragmented_packet_count"],
    "family": ["family"],
    "hint": ["hint_text"],
    "port_a": ["ep_a.port", "ep_a.addr"],
    "port_b": ["ep_b.port", "ep_b.addr"],
}


@dataclasses.dataclass(frozen=True)
class FlowQuery:
    """Selection by number, then text filter, sort (ties by flow number, ascending) and limit."""

    numbers: tuple[int, ...] = ()
    text: str = ""
    sort: str = "index"
    descending: bool = False
    limit: int | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        if self.limit is not None and self.limit < 1:
            raise ValueError("a limit is at least 1")
        if self.sort not in SORT_KEYS:
            raise ValueError(f"no such sort key: {self.sort}")
        if self.numbers:
            if min(self.numbers) < 1 or max(self.numbers) > rows.count():
                raise ValueError("no such flow number")
            rows = rows.where(F.col("flow_index").isin(list(self.numbers)))
        if self.text:
            rows = rows.where(matches(self.text))
        keys = [ascii_lower(F.col(k)) if k.endswith("_text") else F.col(k) for k in SORT_KEYS[self.sort]]
        rows = rows.orderBy(*[k.desc() if self.descending else k.asc() for k in keys], "flow_index")
        return rows.limit(self.limit) if self.limit else rows


def display_filter(rows: DataFrame) -> DataFrame:
    """A packet filter text for TCP, UDP and SCTP flows; empty for others."""
    name = F.lower("protocol_text")
    ip = F.when(F.col("family") == "IPv4", "ip").otherwise("ipv6")
    port = F.greatest("ep_a.port", "ep_b.port").cast("string")
    text = F.concat(ip, F.lit(".addr == "), "address_a", F.lit(" && "), ip, F.lit(".addr == "), "address_b", F.lit(" && "), name, F.lit(".port == "), port)
    return rows.select("flow_index", F.when(F.col("protocol_text").isin("TCP", "UDP", "SCTP"), text).otherwise("").alias("display_filter"))


@dataclasses.dataclass(frozen=True)
class Retention:
    """Which packets of each group stay: the first so many packets or original bytes (the packet that crosses the mark included), or all; then the last, and every k-th after the base."""

    first_packets: int | None = None
    first_bytes: int | None = None
    last: bool = False
    every: int | None = None

    def __post_init__(self):
        if any(x is not None and x < 1 for x in (self.first_packets, self.first_bytes, self.every)):
            raise ValueError("counts are at least 1")
        if self.first_packets and self.first_bytes:
            raise ValueError("one base only")

    def apply(self, packets: DataFrame, group: str | None = "flow_index") -> DataFrame:
        if not group:
            return self.of_capture(packets)
        sums = {"_earlier": F.lit(1)} | ({"_before": F.col("original_length")} if self.first_bytes else {})
        ranked = with_running(packets, group, ["packet_index"], sums=sums).withColumn("number", (F.col("_earlier") + 1).cast("int"))
        if not (self.first_packets or self.first_bytes):
            return ranked.drop("_earlier", BLOCK)
        base = F.col("number") <= self.first_packets if self.first_packets else F.col("_before") < self.first_bytes
        keep = base
        if self.last or self.every:
            # The base comes first, so its packets are counted with all of a group's by one aggregation.
            counts = ranked.groupBy(group).agg(F.count("*").alias("_n"), F.sum(base.cast("long")).alias("_n_base"))
            ranked = ranked.join(counts, group)
        if self.last:
            keep = keep | (F.col("number") == F.col("_n"))
        if self.every:
            keep = keep | ((F.col("number") > F.col("_n_base")) & ((F.col("number") - F.col("_n_base")) % self.every == 0))
        return ranked.where(keep).drop("_before", "_earlier", "_n", "_n_base", BLOCK)

    def of_capture(self, packets: DataFrame) -> DataFrame:
        """The same over all packets as one group, numbered by ranges of packet numbers, never in one task."""
        ranked = numbered(packets, ["packet_index"], "number")
        if not (self.first_packets or self.first_bytes):
            return ranked
        limit = self.first_packets
        if self.first_bytes:
            # The base ends in the first range whose running total reaches the mark; only that range is looked at packet by packet.
            span = 10_000
            sums = ranked.groupBy(F.expr(f"number div {span}").alias("at")).agg(F.sum("original_length").alias("n"))
            running = with_running(sums.withColumn("all", F.lit(0)), "all", ["at"], sums={"before": F.col("n")})
            last = running.where(F.col("before") < self.first_bytes).orderBy(F.desc("at")).first()
            if last is None:
                return ranked
            inside = ranked.where(F.expr(f"number div {span}") == last["at"]).select("number", "original_length").orderBy("number").collect()
            before, limit = last["before"], 0
            for row in inside:
                if before >= self.first_bytes:
                    break
                before, limit = before + row["original_length"], row["number"]
        keep = F.col("number") <= limit
        if self.last or self.every:
            n = ranked.count()
            if self.last:
                keep = keep | (F.col("number") == n)
            if self.every:
                keep = keep | ((F.col("number") > limit) & ((F.col("number") - F.lit(min(limit, n))) % self.every == 0))
        return ranked.where(keep)


def packets_page(owned: DataFrame, flow_index: int, offset: int, limit: int) -> DataFrame:
    """Packets ``offset`` .. ``offset + limit`` of one flow in packet order."""
    return owned.where(F.col("flow_index") == flow_index).orderBy("packet_index").offset(offset).limit(limit)


def hints_within_budget(owned: DataFrame, attempts: int = 10) -> DataFrame:
    """The first known hint among each flow's first ``attempts`` packets with a payload, fragments left out."""
    tried = owned.where("payload_length > 0 and not is_ip_fragmented")
    ranked = tried.withColumn("_at", F.row_number().over(Window.partitionBy("flow_index").orderBy("packet_index"))).where(F.col("_at") <= attempts)
    known = F.when(F.col("hint").isNotNull(), F.col("packet_index"))
    return ranked.groupBy("flow_index").agg(F.count("*").alias("attempts"), F.min_by("hint", known).alias("hint"))
