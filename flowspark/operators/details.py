"""All header fields of packets, layer by layer, as nested rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import layers

# The fields of each header, as (name, first bit, bits, form); forms are numbers, hexadecimal, addresses and flags.
FIELDS = {
    "EthernetII": [("target", 0, 48, "mac"), ("source", 48, 48, "mac"), ("type", 96, 16, "hex")],
    "IEEE 802.3": [("target", 0, 48, "mac"), ("source", 48, 48, "mac"), ("length", 96, 16, "number")],
    "LinuxSll": [("packet_type", 0, 16, "number"), ("hardware_type", 16, 16, "number"), ("address_length", 32, 16, "number"), ("type", 112, 16, "hex")],
    "LinuxSll2": [("type", 0, 16, "hex"), ("interface", 32, 32, "number"), ("hardware_type", 64, 16, "number"), ("packet_type", 80, 8, "number")],
    "VLAN": [("priority", 0, 3, "number"), ("drop_eligible", 3, 1, "number"), ("vid", 4, 12, "number"), ("type", 16, 16, "hex")],
    "LLC/SNAP": [("dsap", 0, 8, "hex"), ("ssap", 8, 8, "hex"), ("control", 16, 8, "hex"), ("organization", 24, 24, "hex"), ("type", 48, 16, "hex")],
    "PBB": [("priority", 0, 3, "number"), ("isid", 8, 24, "number"), ("target", 32, 48, "mac"), ("source", 80, 48, "mac")],
    "PPPoE": [("version", 0, 4, "number"), ("type", 4, 4, "number"), ("code", 8, 8, "number"), ("session", 16, 16, "number"), ("length", 32, 16, "number")],
    "PPP": [("protocol", 0, 16, "hex")],
    "MPLS": [("label", 0, 20, "number"), ("traffic_class", 20, 3, "number"), ("bottom", 23, 1, "number"), ("ttl", 24, 8, "number")],
    "IPv4": [("version", 0, 4, "number"), ("header_words", 4, 4, "number"), ("dscp", 8, 6, "number"), ("ecn", 14, 2, "number"), ("total_length", 16, 16, "number"), ("identification", 32, 16, "number"), ("dont_fragment", 49, 1, "number"), ("more_fragments", 50, 1, "number"), ("fragment_offset", 51, 13, "number"), ("ttl", 64, 8, "number"), ("protocol", 72, 8, "number"), ("checksum", 80, 16, "hex"), ("source", 96, 32, "ipv4"), ("target", 128, 32, "ipv4")],
    "IPv6": [("version", 0, 4, "number"), ("traffic_class", 4, 8, "number"), ("flow_label", 12, 20, "number"), ("payload_length", 32, 16, "number"), ("next_header", 48, 8, "number"), ("hop_limit", 56, 8, "number"), ("source", 64, 128, "ipv6"), ("target", 192, 128, "ipv6")],
    "AH": [("next_header", 0, 8, "number"), ("length_words", 8, 8, "number"), ("spi", 32, 32, "hex"), ("sequence", 64, 32, "number")],
    "ESP": [("spi", 0, 32, "hex"), ("sequence", 32, 32, "number")],
    "GRE": [("checksum_present", 0, 1, "number"), ("key_present", 2, 1, "number"), ("sequence_present", 3, 1, "number"), ("version", 13, 3, "number"), ("protocol", 16, 16, "hex")],
    "UDP": [("source_port", 0, 16, "number"), ("target_port", 16, 16, "number"), ("length", 32, 16, "number"), ("checksum", 48, 16, "hex")],
    "TCP": [("source_port", 0, 16, "number"), ("target_port", 16, 16, "number"), ("sequence", 32, 32, "number"), ("acknowledgement", 64, 32, "number"), ("header_words", 96, 4, "number"), ("flags", 104, 8, "flags"), ("window", 112, 16, "number"), ("checksum", 128, 16, "hex"), ("urgent", 144, 16, "number")],
    "SCTP": [("source_port", 0, 16, "number"), ("target_port", 16, 16, "number"), ("verification_tag", 32, 32, "hex"), ("checksum", 64, 32, "hex")],
    "VXLAN": [("flags", 0, 8, "hex"), ("vni", 32, 24, "number")],
    "Geneve": [("version", 0, 2, "number"), ("option_words", 2, 6, "number"), ("protocol", 16, 16, "hex"), ("vni", 32, 24, "number")],
    "GTP-U": [("version", 0, 3, "number"), ("flags", 0, 8, "hex"), ("message", 8, 8, "number"), ("length", 16, 16, "number"), ("teid", 32, 32, "hex")],
}
FLAGS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]
FLAG_TEXTS = pa.array(["|".join(n for i, n in enumerate(FLAGS) if x >> i & 1) for x in range(256)])
BYTE_TEXTS = pa.array([str(x) for x in range(256)])
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
SCHEMA = "layers array<struct<name:string,offset:int,fields:map<string,string>>>"


def digit_texts(head: str, nibbles: np.ndarray, every: int = 0) -> pa.Array:
    """Rows of hexadecimal digits as texts after ``head``, with a colon after ``every`` so many."""
    rows, n = nibbles.shape
    digits = DIGITS[nibbles]
    if every:
        groups = np.full((rows, n // every, every + 1), ord(":"), np.uint8)
        groups[:, :, :every] = digits.reshape(rows, n // every, every)
        digits = groups.reshape(rows, -1)[:, :-1]
    chars = np.concatenate([np.broadcast_to(np.frombuffer(head.encode(), np.uint8), (rows, len(head))), digits], axis=1)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer((np.arange(rows + 1) * chars.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(chars))])


def field_texts(data: np.ndarray, at: np.ndarray, first: int, bits: int, form: str) -> pa.Array:
    """A field's values as texts, for headers that begin at ``at`` and whose bytes up to the field's end are in ``data``."""
    low, high = first // 8, -(-(first + bits) // 8)
    own = data[at[:, None] + np.arange(low, high)]
    if form in ("mac", "ipv6"):
        return digit_texts("", np.stack([own >> 4, own & 15], axis=2).reshape(len(own), -1), 2 if form == "mac" else 4)
    if form == "ipv4":
        return pc.binary_join_element_wise(*[BYTE_TEXTS.take(pa.array(own[:, k])) for k in range(4)], ".")
    value = np.zeros(len(own), np.int64)
    for k in range(high - low):
        value = value << 8 | own[:, k]
    value = value >> (8 * high - first - bits) & ((1 << bits) - 1)
    if form == "flags":
        return FLAG_TEXTS.take(pa.array(value))
    if form == "hex":
        return digit_texts("0x", value[:, None] >> 4 * np.arange(-(-bits // 4))[::-1] & 15)
    return pa.array(value).cast(pa.string())


def layer_fields(data: np.ndarray, kinds: np.ndarray, kind_names: list[str], starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The header fields of each layer as a map of texts, without those whose bytes were not captured.

    Every field is read for all headers of its kind at once; the texts are then put in the layers' order.
    """
    rows, fields, names, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [pa.array([], pa.string())]
    for k, kind in enumerate(kind_names):
        own = np.flatnonzero(kinds == k)
        for name, first, bits, form in FIELDS.get(kind, []):
            held = own[starts[own] + -(-(first + bits) // 8) <= ends[own]]
            if not len(held):
                continue
            rows.append(held)
            fields.append(np.full(len(held), len(names)))
            names.append(name)
            texts.append(field_texts(data, starts[held], first, bits, form))
    rows, fields = np.concatenate(rows), np.concatenate(fields)
    # Fields were read in the order that a header has them, so a stable sort by layer keeps it.
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(kinds)))]).astype(np.int32)
    keys = pa.array(names, pa.string()).take(pa.array(fields[order]))
    return pa.MapArray.from_arrays(pa.array(offsets), keys, pa.concat_arrays(texts).take(pa.array(order)))


def layer_rows(packets: pa.Array, links: pa.Array) -> pa.Array:
    """The layers of packets given as bytes (none null) and link types, as rows of ``SCHEMA``."""
    machine = layers.machine_over(packets, links)
    offsets, numbers, places = machine.in_order()
    names = list(machine.texts)
    kinds = [n.partition("(")[0] for n in names]
    different = {k: n for n, k in enumerate(dict.fromkeys(kinds))}
    packet = np.repeat(np.arange(len(packets)), np.diff(offsets))
    begins = machine.begin[packet]
    ends = begins + pc.binary_length(packets).to_numpy(zero_copy_only=False)[packet]
    fields = layer_fields(machine.data, np.array([different[k] for k in kinds], np.int64)[numbers], list(different), places, ends)
    texts = pa.array(names, pa.string()).take(pa.array(numbers))
    each = pa.StructArray.from_arrays([texts, pa.array(places - begins, pa.int32()), fields], ["name", "offset", "fields"])
    return pa.ListArray.from_arrays(pa.array(offsets), each)


def packet_details(packets: DataFrame) -> DataFrame:
    """packet_index and the layers of packets (packet_index, bytes, data_link_type), each with its name, offset and header fields.

    Meant for the packets that somebody looks at; packets without bytes are left out. Layers are those
    that were recognized before a packet ended, also where it belongs to no flow.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(packets.sparkSession.createDataFrame([], SCHEMA).schema[0].dataType)
    own = packets.select("packet_index", "bytes", "data_link_type")

    def read(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), layer_rows(batch.column(1), batch.column(2)).cast(kind)], names=["packet_index", "layers"])

    return own.mapInArrow(read, f"packet_index {dict(own.dtypes)['packet_index']}, {SCHEMA}")
