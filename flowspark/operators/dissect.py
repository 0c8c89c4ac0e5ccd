"""Headers and hints of raw packets: addresses, ports, path, payload, service names and versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layers


def dissect(raw: DataFrame) -> DataFrame:
    """Packet rows of ``read_captures`` with addresses, ports, path, flags, payload, hint, service and reason.

    reason is null for packets that belong to a flow and says what was missing for the others.
    Layers are walked by ``layers.Machine``, 48 at most, and the addresses inside the last count;
    an overlay in a UDP payload counts only if it holds a whole TCP, UDP or SCTP header, else the
    outer UDP flow stands. ICMP, IGMP and ARP add no layer, nor does the transport of a fragment;
    an IGMP group is the destination. Packets without bytes are left out. hint, service and versions
    come from the payload (``hints``): service is the Host of a request, the name that a DNS message
    asks for, or a ClientHello's server name.
    """
    packets = raw
    if "original_length" not in packets.columns:
        packets = packets.withColumn("original_length", F.octet_length("bytes").cast("long"))
    names = packets.columns

    def walked(batches):
        for batch in batches:
            # Not a filter before: it would compute the bytes of derived frames twice.
            batch = batch.filter(batch.column(names.index("bytes")).is_valid())
            own = {c: batch.column(i) for i, c in enumerate(names)}
            found = layers.walk_layers(own["bytes"], own["data_link_type"], own["original_length"])
            yield pa.RecordBatch.from_arrays([*own.values(), *found.values()], names=[*own, *found])

    taken = {c.split()[0] for c in layers.SCHEMA.split(", ")} & set(names)
    if taken:
        raise ValueError(f"columns that dissection makes are there already: {sorted(taken)}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields), layers.SCHEMA])
    return packets.mapInArrow(walked, schema)


def recognized(packets: DataFrame) -> DataFrame:
    return packets.where("reason is null")


def unrecognized(packets: DataFrame) -> DataFrame:
    return packets.where("reason is not null").select("packet_index", "captured_length", "original_length", "ts_us", "reason")
