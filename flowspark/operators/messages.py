"""Application messages: HTTP messages and TLS records of reassembled streams, DNS messages, and QUIC Initials."""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.scan import BLOCK, with_running
from .flows import flow_key, with_key
from .hints import hello_name
from .streams import HTTP_METHODS, client_hello, number_bytes, page_host

# Bounds of reconstruction, names of TLS record types, handshake messages and alerts, DNS types and bounds, QUIC salts and labels by version.
MAX_STREAM, MAX_HELLO = 2 << 20, 16 << 10
RECORD_TYPES = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData"}
HANDSHAKES = {0: "HelloRequest", 1: "ClientHello", 2: "ServerHello", 4: "NewSessionTicket", 8: "EncryptedExtensions", 11: "Certificate", 12: "ServerKeyExchange", 13: "CertificateRequest", 14: "ServerHelloDone", 15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished"}
DNS_MAX_QUESTIONS, DNS_MAX_RECORDS, DNS_MAX_SECTION, DNS_MAX_HOPS, DNS_MAX_LABELS, DNS_MAX_NAME = 128, 512, 256, 32, 128, 255
QUIC_SALTS = {
    1: bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"),
    0x6B3343CF: bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9"),
    0xFF00001D: bytes.fromhex("afbfec289993d24c9e9786f19c6111e04390a899"),
}
QUIC_LABELS = {1: "quic", 0x6B3343CF: "quicv2", 0xFF00001D: "quic"}


# Streams ---------------------------------------------------------------------------------------------


class Stream:
    """One direction's payload in packet order, up to a bound, and which packets its bytes came from."""

    def __init__(self, limit: int = MAX_STREAM):
        self.data, self.ends, self.packets, self.limit = bytearray(), [], [], limit

    def add(self, packet: int, payload: bytes) -> None:
        payload = payload[: self.limit - len(self.data)]
        if payload:
            self.data += payload
            self.ends.append(len(self.data))
            self.packets.append(packet)

    def packets_of(self, begin: int, end: int) -> tuple[int, int]:
        from bisect import bisect_right

        return self.packets[bisect_right(self.ends, begin)], self.packets[bisect_right(self.ends, max(begin, end - 1))]


def line_at(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The line that begins at an offset, without CR LF or LF, and where the next begins; None where no line ends."""
    end = data.find(b"\n", at)
    if end < 0:
        return None, len(data)
    return data[at : end - 1 if end > at and data[end - 1] == 13 else end], end + 1


def header_size(data: bytes, at: int) -> int | None:
    ends = [(found, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (found := data.find(mark, at)) >= 0]
    return min(ends)[0] + min(ends)[1] - at if ends else None


def header_value(headers: bytes, name: bytes) -> bytes | None:
    for line in headers.split(b"\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return None


def chunked_size(data: bytes, at: int) -> int | None:
    """Bytes of a whole chunked body, its trailer included; None if it is cut or damaged."""
    begin = at
    while at < len(data):
        line, at = line_at(data, at)
        size = re.fullmatch(rb"[0-9a-fA-F]+", line.partition(b";")[0].strip()) if line is not None else None
        if not size:
            return None
        size = int(size[0], 16)
        if not size:
            while True:
                line, at = line_at(data, at)
                if line is None:
                    return None
                if not line:
                    return at - begin
        if size > len(data) - at:
            return None
        at += size
        if data[at : at + 2] == b"\r\n":
            at += 2
        elif data[at : at + 1] == b"\n":
            at += 1
        else:
            return None
    return None


def http_items(data: bytes):
    """(kind, label, start, header bytes, body bytes) of each message; what cannot be read on is one partial item."""
    at = 0
    methods = tuple(f"{m} ".encode() for m in HTTP_METHODS)
    while at < len(data):
        size = header_size(data, at)
        line = line_at(data, at)[0] if size is not None else None
        words = line.decode("latin-1").split(" ") if line else []
        if line and line.startswith(methods) and len(words) >= 2 and words[1]:
            kind, label = "request", f"HTTP {words[0]} {words[1]}"
        elif line and re.match(rb"HTTP/1\.[^ ]* [0-9]{3}(?: |$)", line):
            kind, label = "response", " ".join(["HTTP", *words[1:]]).rstrip()
        else:
            yield "partial", "HTTP Payload (partial)", at, 0, len(data) - at
            return
        headers, body = bytes(data[at : at + size]), at + size
        coding, length = header_value(headers, b"transfer-encoding"), header_value(headers, b"content-length")
        if coding is not None and b"chunked" in [x.strip().lower() for x in coding.split(b",")]:
            n = chunked_size(data, body) or 0
        else:
            n = int(length) if length is not None and re.fullmatch(rb"[0-9]{1,18}", length) and int(length) <= len(data) - body else 0
        yield kind, label, at, size, n
        at = body + n


@udtf(returnType="flow_index long, direction string, item int, kind string, label string, first_packet long, last_packet long, header_bytes long, body_bytes long")
class HttpMessages:
    """Cuts each direction's payloads, which come in packet order, into messages by Content-Length and chunk framing."""

    def __init__(self):
        self.stream, self.key = Stream(), None

    def eval(self, row):
        self.key = row["flow_index"], row["direction"]
        self.stream.add(row["packet_index"], bytes(row["payload"]))

    def terminate(self):
        data = bytes(self.stream.data)
        for n, (kind, label, at, header, body) in enumerate(http_items(data)):
            yield (*self.key, n, kind, label, *self.stream.packets_of(at, at + header + body), header, body)


def record_items(data: bytes):
    """(record type, version, length, messages, alert, complete) of each TLS record, and where it begins; handshake messages are named with the record in which they end.

    Messages may span records: bytes of handshake records are strung together until another type of
    record, after which they may be encrypted and are not read.
    """
    at, pending, opened = 0, b"", True
    while at < len(data):
        if len(data) - at < 5:
            yield at, None, None, None, [], None, False
            return
        kind, version, size = data[at], int.from_bytes(data[at + 1 : at + 3], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
        if kind not in RECORD_TYPES or version >> 8 != 3 or not size or size > 18432:
            yield at, None, None, None, [], None, False
            return
        body = data[at + 5 : at + 5 + size]
        messages, alert = [], None
        if kind == 22 and opened:
            pending += body
            while len(pending) >= 4 and len(pending) >= 4 + int.from_bytes(pending[1:4], "big"):
                length = int.from_bytes(pending[1:4], "big")
                body_of = pending[4 : 4 + length]
                messages.append((HANDSHAKES.get(pending[0], "unknown"), length, hello_name(body_of) if pending[0] == 1 else None, first_certificate(body_of) if pending[0] == 11 else None))
                pending = pending[4 + length :]
        elif kind == 20:
            opened = False
        elif kind == 21 and size == 2 and len(body) == 2:
            alert = int(body[1])
        yield at, RECORD_TYPES[kind], version, size, messages, alert, len(body) == size
        at += 5 + size


@udtf(returnType="flow_index long, direction string, item int, type string, version int, length int, first_packet long, last_packet long, handshakes array<struct<name:string,length:int,server_name:string,certificate:struct<subject:string,issuer:string,valid_from:string,valid_to:string,dns_names:array<string>>>>, alert int, complete boolean")
class TlsRecords:
    """Reads each direction's payloads, which come in packet order, as TLS records; what is no record ends a direction with a row without type."""

    def __init__(self):
        self.stream, self.key = Stream(), None

    def eval(self, row):
        self.key = row["flow_index"], row["direction"]
        self.stream.add(row["packet_index"], bytes(row["payload"]))

    def terminate(self):
        data = bytes(self.stream.data)
        for n, (at, kind, version, size, messages, alert, complete) in enumerate(record_items(data)):
            end = min(len(data), at + 5 + size) if size is not None else len(data)
            yield (*self.key, n, kind, version, size, *self.stream.packets_of(at, end), [{"name": a, "length": b, "server_name": c, "certificate": d} for a, b, c, d in messages], alert, complete)


def by_direction(function, segments: DataFrame) -> DataFrame:
    """A table function over segments (flow_index, direction, packet_index, payload), one direction at a time in packet order."""
    own = segments.select("flow_index", "direction", "packet_index", F.col("payload").cast("binary").alias("payload")).where("payload is not null")
    return function(own.asTable().partitionBy("flow_index", "direction").orderBy("packet_index"))


def http_messages(segments: DataFrame) -> DataFrame:
    """The HTTP messages of each flow's directions, of 2 MiB a direction at most: kind, label, packets, header and body bytes.

    A message whose body is not there whole is its header; what follows and is no message is one partial item.
    """
    return by_direction(HttpMessages, segments)


def tls_records(segments: DataFrame) -> DataFrame:
    """The TLS records of each flow's directions, of 2 MiB a direction at most, with the handshake messages that end in each."""
    return by_direction(TlsRecords, segments)


# Certificates ------------------------------------------------------------------------------------------

COMMON_NAME, ALTERNATIVE_NAMES = b"\x55\x04\x03", b"\x55\x1d\x11"


def elements(data: bytes):
    """(tag, value) of the DER elements in a row; stops where one does not fit."""
    at = 0
    while at + 2 <= len(data):
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not n or n > 4 or at + n > len(data):
                return
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return
        yield tag, data[at : at + size]
        at += size


def common_name(name: bytes) -> str:
    for _, group in elements(name):
        for _, pair in elements(group):
            parts = list(elements(pair))
            if len(parts) == 2 and parts[0] == (6, COMMON_NAME):
                return parts[1][1].decode("latin-1")
    return ""


def certificate_summary(data: bytes) -> dict | None:
    """Common names of subject and issuer, validity as written, and DNS names of a DER certificate; None for what is none."""
    outer = next(elements(data), None)
    body = next(elements(outer[1]), None) if outer and outer[0] == 0x30 else None
    if not body or body[0] != 0x30:
        return None
    parts = list(elements(body[1]))
    parts = parts[1:] if parts and parts[0][0] == 0xA0 else parts  # the version
    if len(parts) < 5:
        return None
    times = [v.decode("latin-1") for _, v in elements(parts[3][1])]
    names = []
    for wrapped in (v for tag, v in parts[5:] if tag == 0xA3):
        for _, extension in (e for _, v in elements(wrapped) for e in elements(v)):
            fields = list(elements(extension))
            if fields and fields[0] == (6, ALTERNATIVE_NAMES) and fields[-1][0] == 4:
                names += [v.decode("latin-1") for _, held in elements(fields[-1][1]) for tag, v in elements(held) if tag == 0x82]
    return {"subject": common_name(parts[4][1]), "issuer": common_name(parts[2][1]), "valid_from": times[0] if len(times) == 2 else "", "valid_to": times[1] if len(times) == 2 else "", "dns_names": names}


def first_certificate(message: bytes) -> dict | None:
    """The first certificate of a Certificate message's list."""
    if len(message) < 6:
        return None
    size = int.from_bytes(message[3:6], "big")
    return certificate_summary(message[6 : 6 + size]) if 6 + size <= len(message) else None


# ICMP --------------------------------------------------------------------------------------------------

# Kinds of ICMP and ICMPv6 messages by type.
ICMP_KINDS = {0: "echo reply", 3: "destination unreachable", 5: "redirect", 8: "echo request", 11: "time exceeded", 12: "parameter problem"}
ICMPV6_KINDS = {1: "destination unreachable", 3: "time exceeded", 4: "parameter problem", 128: "echo request", 129: "echo reply", 137: "redirect"}


def icmp_messages(packets: DataFrame) -> DataFrame:
    """The ICMP messages among dissected packets: kind, type, code, identifier and sequence of echoes, next MTU, gateway, pointer and quoted bytes."""
    size, byte = F.octet_length("control"), lambda at, n=1: F.when(F.octet_length("control") >= at + n, F.conv(F.hex(F.substring("control", at + 1, n)), 16, 10).cast("long"))
    own = packets.where("protocol in (1, 58) and control is not null")
    kind = F.lit("unknown")
    for protocol, kinds in ((1, ICMP_KINDS), (58, ICMPV6_KINDS)):
        for code, name in kinds.items():
            kind = F.when((F.col("protocol") == protocol) & (byte(0) == code), name).otherwise(kind)
    own = own.withColumn("kind", kind)
    of = lambda name, value: F.when(F.col("kind") == name, value)
    echo = F.col("kind").isin("echo request", "echo reply")
    quoting = F.col("kind").isin("destination unreachable", "time exceeded", "redirect", "parameter problem")
    return own.select(
        "packet_index", "kind", byte(0).cast("int").alias("type"), byte(1).cast("int").alias("code"), F.when(echo, byte(4, 2)).cast("int").alias("identifier"), F.when(echo, byte(6, 2)).cast("int").alias("sequence"),
        of("destination unreachable", F.when((F.col("protocol") == 1) & (byte(1) == 4), byte(6, 2))).cast("int").alias("next_mtu"), of("redirect", F.when(F.col("protocol") == 1, F.hex(F.substring("control", 5, 4)))).alias("gateway"),
        of("parameter problem", byte(4)).cast("int").alias("pointer"), F.when(quoting, F.greatest(size - 8, F.lit(0))).cast("long").alias("quoted_bytes"), F.when(size >= 8, "complete").otherwise("truncated").alias("status"),
    )


# Items -------------------------------------------------------------------------------------------------


def stream_items(messages: DataFrame, records: DataFrame) -> DataFrame:
    """HTTP messages and TLS records as items of their flows: flow_index, first_packet, direction, item, label."""
    http = messages.select("flow_index", "first_packet", "direction", "item", "label")
    label = F.concat(F.lit("TLS "), F.coalesce("type", F.lit("Payload (partial)")), F.when(F.size("handshakes") > 0, F.concat(F.lit(": "), F.array_join("handshakes.name", ", "))).otherwise(""))
    return http.unionByName(records.select("flow_index", "first_packet", "direction", "item", label.alias("label")))


def items_page(items: DataFrame, flow_index: int, after: tuple | None = None, limit: int = 15) -> tuple[list, tuple | None]:
    """The next ``limit`` items of a flow and where to go on, or None at the end. One item more is looked at, none is counted.

    ``after`` is the place of the last item of the page before: (first_packet, direction, item).
    """
    order = ["first_packet", "direction", "item"]
    own = items.where(F.col("flow_index") == flow_index)
    if after is not None:
        own = own.where(F.struct(*order) > F.struct(*[F.lit(v).cast(dict(items.dtypes)[c]).alias(c) for c, v in zip(order, after, strict=True)]))
    found = own.orderBy(*order).limit(limit + 1).collect()
    return found[:limit], tuple(found[limit - 1][c] for c in order) if len(found) > limit else None


def paged(items: DataFrame, size: int) -> DataFrame:
    """Items with the page of their flow that they are on, and whether another follows; for all flows at once."""
    order = ["first_packet", "direction", "item"]
    placed = with_running(items, "flow_index", order, sums={"_place": F.lit(1)}).drop(BLOCK)
    whole = items.groupBy("flow_index").agg(F.count("*").alias("_total"))
    page = F.expr(f"_place div {size}")
    return placed.join(whole, "flow_index").withColumns({"page": page, "more": (page + 1) * size < F.col("_total")}).drop("_place", "_total")


# DNS ---------------------------------------------------------------------------------------------------


class Cut(Exception):
    pass


class Wrong(Exception):
    pass


def dns_name(message: bytes, at: int, limit: int) -> tuple[str, int]:
    """A name and where what follows it begins; pointers may go anywhere, 32 times and to no place twice."""
    labels, after, targets = [], None, set()
    if at >= min(limit, len(message)):
        raise Wrong
    while True:
        if at >= (len(message) if after else min(limit, len(message))):
            raise Cut
        size = message[at]
        if not size:
            return ".".join(labels) or ".", after or at + 1
        if size >= 0xC0:
            if at + 1 >= (len(message) if after else min(limit, len(message))):
                raise Cut
            target = (size & 0x3F) << 8 | message[at + 1]
            if len(targets) >= DNS_MAX_HOPS or target >= len(message) or target in targets:
                raise Wrong
            targets.add(target)
            after, at = after or at + 2, target
            continue
        if size > 63 or len(labels) >= DNS_MAX_LABELS:
            raise Wrong
        if at + 1 + size > (len(message) if after else min(limit, len(message))):
            raise Cut
        labels.append(message[at + 1 : at + 1 + size].decode("latin-1"))
        if sum(map(len, labels)) + len(labels) - 1 > DNS_MAX_NAME:
            raise Wrong
        at += 1 + size


def dns_value(message: bytes, at: int, kind: int, size: int) -> str:
    """A record's data as text: addresses, names, strings; else hexadecimal."""
    end = at + size
    if end > len(message):
        raise Cut
    data = message[at:end]
    if kind == 1:
        if size != 4:
            raise Wrong
        return ".".join(map(str, data))
    if kind == 28:
        if size != 16:
            raise Wrong
        return ":".join(f"{data[i]:02x}{data[i + 1]:02x}" for i in range(0, 16, 2))
    if kind in (2, 5, 12):
        return dns_name(message, at, end)[0]
    if kind == 15:
        if size < 3:
            raise Cut
        return f"{int.from_bytes(data[:2], 'big')} {dns_name(message, at + 2, end)[0]}"
    if kind == 33:
        if size < 7:
            raise Cut
        return " ".join([*(str(int.from_bytes(data[i : i + 2], "big")) for i in (0, 2, 4)), dns_name(message, at + 6, end)[0]])
    if kind == 16:
        found, i = [], 0
        while i < size:
            if i + 1 + data[i] > size:
                raise Cut
            found.append(data[i + 1 : i + 1 + data[i]].decode("latin-1"))
            i += 1 + data[i]
        return "".join(found)
    return data.hex()


DNS_RECORD = "struct<name:string,type:int,class:int,ttl:long,value:string>"
DNS_SCHEMA = f"dns struct<id:int,is_response:boolean,opcode:int,rcode:int,status:string,questions:array<struct<name:string,type:int,class:int>>,answers:array<{DNS_RECORD}>,authorities:array<{DNS_RECORD}>,additionals:array<{DNS_RECORD}>>"


def dns_message(message: bytes) -> dict:
    """A message as far as it can be read; status is complete, truncated, malformed or not_enough_header."""
    found: dict = {"id": None, "is_response": None, "opcode": None, "rcode": None, "status": "not_enough_header", "questions": [], "answers": [], "authorities": [], "additionals": []}
    if len(message) < 12:
        return found
    number = lambda at, size=2: int.from_bytes(message[at : at + size], "big")
    flags, counts = number(2), [number(at) for at in (4, 6, 8, 10)]
    found |= {"id": number(0), "is_response": bool(flags & 0x8000), "opcode": flags >> 11 & 15, "rcode": flags & 15, "status": "complete"}
    at = 12
    try:
        if counts[0] > DNS_MAX_QUESTIONS or sum(counts[1:]) > DNS_MAX_RECORDS:
            raise Wrong
        for _ in range(counts[0]):
            name, at = dns_name(message, at, len(message))
            if at + 4 > len(message):
                raise Cut
            found["questions"].append({"name": name, "type": number(at), "class": number(at + 2)})
            at += 4
        for section, count in zip(("answers", "authorities", "additionals"), counts[1:], strict=True):
            if count > DNS_MAX_SECTION:
                raise Wrong
            for _ in range(count):
                name, at = dns_name(message, at, len(message))
                if at + 10 > len(message):
                    raise Cut
                kind, size = number(at), number(at + 8)
                record = {"name": name, "type": kind, "class": number(at + 2), "ttl": number(at + 4, 4), "value": None}
                found[section].append(record)
                record["value"] = dns_value(message, at + 10, kind, size)
                at += 10 + size
    except Cut:
        found["status"] = "truncated"
    except Wrong:
        found["status"] = "malformed"
    return found


def dns_messages(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``dns``: the message in each packet's payload as nested rows, names with their pointers followed. Null payloads have none."""
    names = packets.columns
    kind = arrow_type(packets.sparkSession, DNS_SCHEMA)

    def read(batches):
        for batch in batches:
            data = batch.column(names.index(payload)).to_pylist()
            found = pa.array([None if x is None else dns_message(bytes(x)) for x in data], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, "dns"])

    return packets.mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields), DNS_SCHEMA]))


def arrow_type(spark: SparkSession, field: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], field).schema[0].dataType)


# QUIC --------------------------------------------------------------------------------------------------


def expand(secret: bytes, label: str, size: int) -> bytes:
    """HKDF-Expand-Label of TLS 1.3 with SHA-256, for up to 32 bytes."""
    name = b"tls13 " + label.encode()
    info = size.to_bytes(2, "big") + bytes([len(name)]) + name + b"\0"
    return hmac.new(secret, info + b"\1", hashlib.sha256).digest()[:size]


def initial_keys(version: int, connection: bytes, server: bool = False) -> tuple[bytes, bytes, bytes]:
    """Key, IV and header-protection key of the client's (or server's) Initials, from the connection id that the client chose."""
    secret = expand(hmac.new(QUIC_SALTS[version], connection, hashlib.sha256).digest(), "server in" if server else "client in", 32)
    return tuple(expand(secret, f"{QUIC_LABELS[version]} {part}", size) for part, size in (("key", 16), ("iv", 12), ("hp", 16)))


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer and where it ends; Cut beyond the data."""
    if at >= len(data) or at + (1 << (data[at] >> 6)) > len(data):
        raise Cut
    size = 1 << (data[at] >> 6)
    return int.from_bytes(data[at : at + size], "big") & ((1 << 8 * size - 2) - 1), at + size


def initials_in(datagram: bytes):
    """(version, connection id, begin, packet-number offset, end) of the Initials in a datagram, which other long-header packets may follow."""
    at = 0
    while at + 7 <= len(datagram) and datagram[at] & 0xC0 == 0xC0:
        version = int.from_bytes(datagram[at + 1 : at + 5], "big")
        if version not in QUIC_SALTS:
            return
        kind = datagram[at] >> 4 & 3
        initial, retry = (1, 0) if version == 0x6B3343CF else (0, 3)
        place = at + 5
        try:
            size = datagram[place]
            connection = datagram[place + 1 : place + 1 + size]
            place += 1 + size
            place += 1 + datagram[place]
            if kind == retry:
                return
            if kind == initial:
                size, place = varint(datagram, place)
                place += size
            size, place = varint(datagram, place)
        except (Cut, IndexError):
            return
        if place + size > len(datagram) or size < 20:
            return
        if kind == initial:
            yield version, connection, at, place, place + size
        at = place + size


def crypto_frames(plain: bytes) -> list[tuple[int, bytes]] | None:
    """(offset, data) of the CRYPTO frames of an Initial; None if another frame than padding, ping or acknowledgement is found."""
    at, found = 0, []
    try:
        while at < len(plain):
            kind = plain[at]
            at += 1
            if kind in (0, 1):
                continue
            if kind in (2, 3):
                for _ in range(2):
                    _, at = varint(plain, at)
                ranges, at = varint(plain, at)
                for _ in range(1 + 2 * ranges + 3 * (kind == 3)):
                    _, at = varint(plain, at)
            elif kind == 6:
                offset, at = varint(plain, at)
                size, at = varint(plain, at)
                if at + size > len(plain):
                    raise Cut
                found.append((offset, plain[at : at + size]))
                at += size
            else:
                return None
    except Cut:
        return None
    return found


def joined_frames(frames: list[tuple[int, bytes]]) -> bytes:
    """The bytes from offset 0 on that frames in any order, repeated or overlapping, give without a gap."""
    data = b""
    for offset, piece in sorted(frames, key=lambda x: x[0]):
        if offset > len(data):
            break
        data += piece[len(data) - offset :]
    return data


INITIAL_SCHEMA = "version long, connection binary, header binary, first int, rest binary, key binary, iv binary, hp binary, sample binary"


def quic_initials(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """The client Initials of UDP payloads, decrypted: the packets' other columns, version, connection, packet_number and plain (null where the tag does not fit).

    Keys come from the connection id by HKDF in batches; the header's mask is AES of a sample and the
    payload AES-GCM, both by Spark's own functions.
    """
    names = [c for c in packets.columns if c != payload]
    kept = packets.select(*names, F.col(payload).cast("binary").alias("_payload"))

    def split(batches):
        for batch in batches:
            rows, found = [], []
            for i, data in enumerate(batch.column(len(names)).to_pylist()):
                for version, connection, begin, number, end in initials_in(data or b""):
                    key, iv, hp = initial_keys(version, connection)
                    rows.append(i)
                    found.append((version, connection, data[begin:number], data[begin], data[number:end], key, iv, hp, data[number + 4 : number + 20]))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5)
            columns = zip(*found, strict=True) if found else [[] for _ in kinds]
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*names, *[c.split()[0] for c in INITIAL_SCHEMA.split(", ")]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields if f.name != payload), INITIAL_SCHEMA])
    cut = kept.mapInArrow(split, schema)
    digits = lambda column, at, size: F.conv(F.hex(F.substring(column, at, size)), 16, 10).cast("long")
    # One block of AES; Spark pads, so only the first block counts.
    cut = cut.withColumn("mask", F.substring(F.aes_encrypt("sample", "hp", F.lit("ECB"), F.lit("PKCS")), 1, 5))
    cut = cut.withColumn("first", F.col("first").bitwiseXOR(digits(F.col("mask"), 1, 1).bitwiseAND(15).cast("int")))
    cut = cut.withColumn("size", F.col("first").bitwiseAND(3) + 1)
    part = lambda column, at, size: F.conv(F.hex(F.substring(column, F.lit(at), size)), 16, 10).cast("long")
    cut = cut.withColumn("packet_number", part(F.col("rest"), 1, F.col("size")).bitwiseXOR(part(F.col("mask"), 2, F.col("size"))))
    raw = lambda value, size: F.unhex(F.lpad(F.hex(value), size, "0"))
    header = F.concat(F.unhex(F.lpad(F.hex(F.col("first")), 2, "0")), F.expr("substring(header, 2)"), F.unhex(F.lpad(F.hex("packet_number"), F.col("size") * 2, F.lit("0"))))
    nonce = F.concat(F.substring("iv", 1, 8), raw(digits(F.col("iv"), 9, 4).bitwiseXOR(F.col("packet_number")), 8))
    sealed = F.concat(nonce, F.expr("substring(rest, size + 1)"))
    plain = F.try_aes_decrypt(sealed, F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), header)
    return cut.select(*names, "version", "connection", "packet_number", plain.alias("plain"))


def quic_server_names(packets: DataFrame, group: list[str], payload: str = "payload") -> DataFrame:
    """The server name that each connection's Initials carry: CRYPTO frames of all its packets, in any order, joined by their offsets.

    ``group`` names the columns that a flow's packets share. A connection without a readable name has a row with null.
    """
    opened = quic_initials(packets.select(*group, payload), payload).where("plain is not null")
    names = [*group, "version", "connection"]
    own = opened.select(*names, "plain")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def frames(batches):
        for batch in batches:
            rows, found = [], []
            for i, plain in enumerate(batch.column(len(names)).to_pylist()):
                for offset, data in crypto_frames(plain) or []:
                    if offset < MAX_HELLO:
                        rows.append(i)
                        found.append((offset, data))
            columns = zip(*found, strict=True) if found else ([], [])
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary()), strict=True)]], names=[*names, "offset", "data"])

    def read(batches):
        for batch in batches:
            found = []
            for pieces in batch.column(len(names)).to_pylist():
                data = joined_frames([(x["offset"], x["data"]) for x in pieces])
                size = int.from_bytes(data[1:4], "big")
                found.append(hello_name(data[4 : 4 + size]) if data[:1] == b"\1" and len(data) >= 4 + size else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.string())], names=[*names, "server_name"])

    # The longest frame at each offset, of which a connection has ``MAX_HELLO`` at most, however often its packets were sent.
    pieces = own.mapInArrow(frames, f"{schema}, offset long, data binary").groupBy(*names, "offset").agg(F.max_by("data", F.octet_length("data")).alias("data"))
    crypto = pieces.groupBy(*names).agg(F.collect_list(F.struct("offset", "data")).alias("pieces"))
    return crypto.mapInArrow(read, f"{schema}, server_name string")


def with_quic_names(packets: DataFrame) -> DataFrame:
    """Dissected packets whose QUIC connections have their server's name as service, as far as their Initials tell it.

    Initials of a flow are put together from all its packets; only the UDP payloads of QUIC flows are read again.
    """
    keyed = with_key(packets).withColumn("_flow", flow_key())
    names = quic_server_names(keyed.where("hint = 'quic'").select("_flow", "payload"), ["_flow"])
    known = names.where("server_name is not null").groupBy("_flow").agg(F.min("server_name").alias("_name"))
    joined = keyed.join(known, "_flow", "left")
    return joined.withColumn("service", F.when(F.col("hint") == "quic", F.coalesce("service", "_name")).otherwise(F.col("service"))).select(packets.columns)


def quic_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The datagrams of ``quic_datagrams`` as frames, one client address for each page."""
    made = quic_datagrams(spark, folder).withColumn("packet_index", F.monotonically_increasing_id())
    hexed = lambda digits: F.unhex(F.lit(digits))
    size = F.octet_length("payload")
    udp = F.concat(hexed("c35001bb"), number_bytes(size + 8, 2), hexed("0000"), F.col("payload"))
    ip = F.concat(hexed("4500"), number_bytes(size + 28, 2), hexed("0001000040110000"), number_bytes(F.lit(0x0A000000) + F.col("flow_index"), 4), hexed("c0a80001"), udp)
    length = (size + 42).cast("long")
    return made.select("packet_index", F.col("packet_index").alias("ts_us"), length.alias("captured_length"), length.alias("original_length"), F.lit(1).alias("data_link_type"), F.concat(hexed("02" * 12 + "0800"), ip).alias("bytes"))


def quic_datagrams(spark: SparkSession, folder: str) -> DataFrame:
    """Protected Initials for each page: a ClientHello in two CRYPTO frames of two packets, the later one first, one of them sent twice.

    Of every seventh page the first frame is missing, so that its name cannot be read.
    """
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("page_id is not null")
    made = pages.select("page_id", client_hello(page_host()).alias("hello"))
    version = F.expr("case page_id % 3 when 0 then 1L when 1 then 1798521807L else 4278190109L end")
    connection = F.unhex(F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 16))
    frame = lambda at, data: F.concat(F.unhex(F.lit("06")), number_bytes(F.lit(0x4000 + at), 2), number_bytes(F.lit(0x4000) + F.octet_length(data), 2), data)
    head, tail = F.expr("substring(hello, 1, 30)"), F.expr("substring(hello, 31)")
    late = F.struct(F.lit(1).alias("number"), F.concat(F.unhex(F.lit("01")), frame(30, tail)).alias("plain"))
    early = F.struct(F.lit(2).alias("number"), F.concat(frame(0, head), F.unhex(F.lit("00" * 20))).alias("plain"))
    sent = F.when(F.col("page_id") % 7 == 3, F.array(late, late)).otherwise(F.array(late, early, late))
    each = made.select(F.col("page_id").alias("flow_index"), version.alias("version"), connection.alias("connection"), F.explode(sent).alias("s")).select("*", "s.*").drop("s")

    def derive(batches):
        for batch in batches:
            keys = [initial_keys(v, bytes(c)) for v, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*keys, strict=True) if keys else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.binary()) for c in columns]], names=[*batch.schema.names, "key", "iv", "hp"])

    keyed = each.mapInArrow(derive, "flow_index long, version long, connection binary, number int, plain binary, key binary, iv binary, hp binary")
    size = F.octet_length("plain") + 2 + 16
    kind = F.when(F.col("version") == 0x6B3343CF, 0xD1).otherwise(0xC1)  # packet numbers of two bytes
    header = F.concat(number_bytes(F.col("version"), 4), F.unhex(F.lit("08")), F.col("connection"), F.unhex(F.lit("0000")), number_bytes(F.lit(0x4000) + size, 2))
    number = number_bytes(F.col("number"), 2)
    nonce = F.concat(F.substring("iv", 1, 8), number_bytes(F.conv(F.hex(F.substring("iv", 9, 4)), 16, 10).cast("long").bitwiseXOR(F.col("number").cast("long")), 4))
    keyed = keyed.withColumns({"head": header, "kind": kind})
    sealed = F.aes_encrypt("plain", "key", F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat(number_bytes(F.col("kind"), 1), F.col("head"), number))
    # Spark puts the nonce before what it seals.
    keyed = keyed.withColumn("sealed", sealed).withColumn("sealed", F.expr("substring(sealed, 13)"))
    keyed = keyed.withColumn("mask", F.substring(F.aes_encrypt(F.substring("sealed", 3, 16), "hp", F.lit("ECB"), F.lit("PKCS")), 1, 5))
    bits = lambda at, n: F.conv(F.hex(F.substring("mask", at, n)), 16, 10).cast("long")
    first = number_bytes(F.col("kind").cast("long").bitwiseXOR(bits(1, 1).bitwiseAND(15)), 1)
    hidden = number_bytes(F.col("number").cast("long").bitwiseXOR(bits(2, 2)), 2)
    return keyed.select("flow_index", F.concat(first, "head", hidden, "sealed").alias("payload"))
