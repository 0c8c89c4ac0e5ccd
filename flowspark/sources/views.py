"""Packet tables derived from ordinary tables, for tests and benchmarks without captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ipv4(number: Column) -> Column:
    """Four address bytes of an unsigned 32-bit number."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def by_type(values: dict, otherwise=None) -> Column:
    found = F.lit(otherwise)
    for key, value in values.items():
        found = F.when(F.col("event_type") == key, F.lit(value)).otherwise(found)
    return found


def packets_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """One packet per event: a client chosen by user talks with a server chosen by event type."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events = events.withColumns(
        {
            "packet_index": F.col("event_id"),
            "ts_us": F.expr("unix_micros(cast(ts as timestamp)) div 1000000"),
            "captured_length": F.floor(F.col("value") * 20).cast("long"),
            "protocol": by_type({"view": 17, "signup": 17}, 6),
            "client": F.lit(167772160) + F.col("user_id") % 32,
            "client_port": (F.lit(40000) + F.col("user_id") % 32).cast("int"),
            "server": by_type({"click": 3232235521, "view": 3232235522, "purchase": 3232235523, "signup": 3232235524, "error": 3232235525}).cast("long"),
            "server_port": by_type({"click": 80, "view": 443, "purchase": 443, "signup": 53, "error": 22}).cast("int"),
            "vid": F.col("user_id") % 4,
            "out": F.col("event_id") % 3 != 0,
        }
    )
    event = F.col("event_id")
    flags = F.when(F.col("protocol") != 6, 0).when(event % 7 == 0, 2).when(event % 11 == 0, 17).when(event % 13 == 0, 4).otherwise(16)
    hint = F.when((F.col("event_type") == "click") & (event % 5 == 0), "http").when((F.col("event_type") == "error") & (event % 4 == 0), "ssh")
    hint = hint.when((F.col("event_type") == "signup") & (event % 2 == 0), "dns").otherwise(F.lit(None))
    side = lambda a, b: F.when(F.col("out"), F.col(a)).otherwise(F.col(b))
    layers = F.array(F.lit("EthernetII"), F.concat(F.lit("VLAN(vid="), F.col("vid").cast("string"), F.lit(")")), F.lit("IPv4"), F.when(F.col("protocol") == 6, "TCP").otherwise("UDP"))
    return events.select(
        "packet_index",
        "ts_us",
        "captured_length",
        (F.col("captured_length") + F.when(event % 10 == 0, 40).otherwise(0)).alias("original_length"),
        F.greatest(F.col("captured_length") - 54, F.lit(0)).alias("payload_length"),
        flags.cast("int").alias("tcp_flags"),
        (event % 97 == 0).alias("is_ip_fragmented"),
        F.lit("IPv4").alias("family"),
        ipv4(side("client", "server")).alias("src_addr"),
        side("client_port", "server_port").alias("src_port"),
        ipv4(side("server", "client")).alias("dst_addr"),
        side("server_port", "client_port").alias("dst_port"),
        F.col("protocol").cast("int").alias("protocol"),
        layers.alias("path"),
        hint.alias("hint"),
        F.when(hint.isNotNull(), F.concat(F.lit("host-"), (event % 3).cast("string"))).alias("service"),
    )


def packets_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A larger packet table with many flows: supplier talks to part, on UDP without a VLAN. Its packet_index is unique but not dense."""
    item = spark.read.parquet(f"{folder}/lineitem.parquet")
    return item.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("packet_index"),
        F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000000").alias("ts_us"),
        F.floor(F.col("l_quantity") * 30).cast("long").alias("captured_length"),
        F.floor(F.col("l_quantity") * 30).cast("long").alias("original_length"),
        F.lit(0).cast("long").alias("payload_length"),
        F.lit(0).alias("tcp_flags"),
        F.lit(False).alias("is_ip_fragmented"),
        F.lit("IPv4").alias("family"),
        ipv4(F.col("l_suppkey")).alias("src_addr"),
        F.lit(5000).alias("src_port"),
        ipv4(F.col("l_partkey") % 500).alias("dst_addr"),
        F.lit(6000).alias("dst_port"),
        F.lit(17).alias("protocol"),
        F.array(F.lit("EthernetII"), F.lit("IPv4"), F.lit("UDP")).alias("path"),
        F.lit(None).cast("string").alias("hint"),
        F.lit(None).cast("string").alias("service"),
    )


def be(value: Column, size: int) -> Column:
    """Big-endian bytes of a number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def frames_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """The packets of ``packets_from_events`` as Ethernet frames, with payloads that their hints tell of, for queries over bytes.

    Every 50th frame is one that belongs to no flow: too short, of an unknown EtherType, a PPPoE
    discovery or a cut ARP. Servers on UDP 443 speak QUIC, on TCP 443 TLS.
    """
    packets = packets_from_events(spark, folder)
    index, tcp = F.col("packet_index"), F.col("protocol") == 6
    host = F.concat(F.lit("host-"), (index % 3).cast("string"))
    raw = lambda text: text.cast("binary")
    hexed = lambda digits: F.unhex(F.lit(digits))
    request = F.concat(F.lit("GET /a HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    question = F.concat(be(index % 65536, 2), hexed("01000001000000000000"), hexed("06"), raw(host), hexed("07"), raw(F.lit("example")), hexed("00"), hexed("00010001"))
    quic = F.concat(hexed("c0"), F.when(index % 4 == 0, hexed("00000001")).when(index % 4 == 1, hexed("ff00001d")).when(index % 4 == 2, hexed("6b3343cf")).otherwise(hexed("0a0a0a0a")), hexed("00" * 20))
    name = F.concat(hexed("0000000b0009000006"), raw(host))
    hello = F.concat(hexed("0303"), hexed("11" * 32), hexed("00"), hexed("00021301"), hexed("0100"), hexed("0013"), hexed("00170000"), name)
    tls = F.when(index % 3 == 1, F.concat(hexed("1603010042"), hexed("0100003e"), hello)).otherwise(hexed("1703030010" + "22" * 16))
    payload = (
        F.when(F.col("hint") == "http", raw(request)).when(F.col("hint") == "ssh", raw(F.lit("SSH-2.0-x\r\n"))).when(F.col("hint") == "dns", question)
        .when((F.col("protocol") == 17) & F.array_contains(F.array("src_port", "dst_port"), 443), quic)
        .when(F.array_contains(F.array("src_port", "dst_port"), 443), tls)
        .otherwise(hexed("99" * 8))
    )
    segment = F.when(tcp, F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), be(index, 4), hexed("00000000"), hexed("50"), be(F.col("tcp_flags"), 1), hexed("ffff00000000"), payload))
    segment = segment.otherwise(F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), be(F.octet_length(payload) + 8, 2), hexed("0000"), payload))
    fragment = F.when(F.col("is_ip_fragmented"), hexed("2000")).otherwise(hexed("0000"))
    ip = F.concat(hexed("4500"), be(F.octet_length(segment) + 20, 2), hexed("0001"), fragment, hexed("40"), be(F.col("protocol"), 1), hexed("0000"), F.col("src_addr"), F.col("dst_addr"), segment)
    vid = F.regexp_extract(F.col("path")[1], "vid=([0-9]+)", 1).cast("long")
    mac = hexed("02" * 12)
    odd = F.when(index % 200 == 0, hexed("0202")).when(index % 200 == 50, F.concat(mac, hexed("88cc"), hexed("00" * 30))).when(index % 200 == 100, F.concat(mac, hexed("8863"), hexed("110900000000"))).otherwise(F.concat(mac, hexed("0806"), hexed("00010800060400")))
    frame = F.when(index % 50 == 0, odd).otherwise(F.concat(mac, hexed("8100"), be(vid, 2), hexed("0800"), ip))
    made = packets.select("packet_index", "ts_us", frame.alias("bytes"))
    length = F.octet_length("bytes").cast("long")
    return made.select("packet_index", "ts_us", length.alias("captured_length"), (length + index % 5).alias("original_length"), F.lit(1).alias("data_link_type"), "bytes")


def layered_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The packets of ``packets_from_events`` in frames of many layers, one kind for each remainder of packet_index by 40.

    Kinds 0 to 26 belong to flows, of which 17 and 18 look like overlays and are none; the others are
    cut or hold nothing that a flow could be made of. Fragments, ports and addresses are those of the packets.
    """
    packets = packets_from_events(spark, folder)
    index = F.col("packet_index")
    kind = index % 40
    number = index % 1000 + 16
    hexed = lambda digits: F.unhex(F.lit(digits))
    rest, mac = F.concat, hexed("02" * 12)
    ether = lambda code, body: rest(mac, hexed(code), body)
    ports = rest(be(F.col("src_port"), 2), be(F.col("dst_port"), 2))
    own, addresses = be(F.col("protocol"), 1), rest(F.col("src_addr"), F.col("dst_addr"))
    # Sizes are told along with the bodies, so that no body is made twice for its length.
    size = F.when(F.col("protocol") == 6, 28).otherwise(16)
    v4 = lambda protocol, body, length, between=addresses: rest(hexed("4500"), be(length + 20, 2), hexed("0001000040"), protocol, hexed("0000"), between, body)
    outer = lambda code, body, length: v4(hexed(code), body, length, hexed("0a0000010a000002"))
    over_udp = lambda port, body, length: outer("11", rest(be(F.lit(0x2710 << 16 | port), 4), be(length + 8, 2), hexed("0000"), body), length + 8)
    v6 = lambda code, body, length: rest(hexed("60000000"), be(length, 2), code, hexed("40" + "20" + "00" * 11), F.col("src_addr"), hexed("20" + "00" * 11), F.col("dst_addr"), body)
    label = lambda value, bottom: be(F.shiftleft(value.cast("long"), 12) + (256 if bottom else 0), 4)
    tcp = rest(ports, be(index, 4), hexed("0000000050"), be(F.col("tcp_flags"), 1), hexed("ffff00000000"), hexed("99" * 8))
    udp = rest(ports, hexed("00100000"), hexed("99" * 8))
    packets = packets.withColumn("transport", F.when(F.col("protocol") == 6, tcp).otherwise(udp))
    transport, inner, framed = F.col("transport"), F.col("inner"), F.col("framed")
    packets = packets.withColumn("inner", v4(own, transport, size)).withColumn("framed", ether("0800", inner))
    nested, whole, frame = inner, size + 20, size + 34
    for level in range(6):
        nested = outer("04", nested, whole + 20 * level)
    kinds = {
        0: ether("0800", inner),
        1: ether("8100", rest(be(index % 4000, 2), hexed("88a80007"), hexed("0800"), inner)),
        2: ether("8847", rest(label(number, False), label(F.lit(7), True), inner)),
        3: ether("8847", rest(label(number, True), hexed("00000000"), framed)),
        4: ether("8864", rest(hexed("11000001"), be(whole + 2, 2), hexed("0021"), inner)),
        5: ether("88e7", rest(hexed("00"), be(number, 3), framed)),
        6: rest(mac, be(whole + 8, 2), hexed("aaaa03000000" + "0800"), inner),
        7: rest(hexed("00" * 14), hexed("0800"), inner),
        8: rest(hexed("0800"), hexed("00" * 18), inner),
        9: ether("0800", outer("2f", rest(hexed("00000800"), inner), whole + 4)),
        10: ether("0800", outer("2f", rest(hexed("30000800"), be(number, 4), hexed("00000001"), inner), whole + 12)),
        11: ether("0800", outer("2f", rest(hexed("20016400"), be(frame, 2), be(number % 256, 1), hexed("00"), framed), frame + 8)),
        12: ether("0800", nested),
        13: ether("0800", outer("29", v6(own, transport, size), size + 40)),
        14: ether("0800", over_udp(4789, rest(hexed("08000000"), be(number, 3), hexed("00"), framed), frame + 8)),
        15: ether("0800", over_udp(6081, rest(hexed("02006558"), be(number, 3), hexed("00" * 9), framed), frame + 16)),
        16: ether("0800", over_udp(2152, rest(hexed("34ff"), be(whole + 16, 2), be(number, 4), hexed("00000085" + "01000085" + "02000000000000" + "00"), inner), whole + 24)),
        17: ether("0800", over_udp(2152, rest(hexed("30ff0000"), be(number, 4), inner), whole + 8)),
        18: ether("0800", over_udp(4789, rest(hexed("08000000"), be(number, 3), hexed("00"), ether("0800", outer("01", hexed("08000000"), F.lit(4)))), F.lit(46))),
        19: ether("86dd", v6(hexed("00"), rest(hexed("3c00" + "00" * 6), own, hexed("00" * 7), transport), size + 16)),
        20: ether("86dd", v6(hexed("2c"), rest(own, hexed("00000100000001"), transport), size + 8)),
        21: ether("0800", v4(hexed("33"), rest(own, hexed("040000"), be(number, 4), hexed("00" * 16), transport), size + 24)),
        22: ether("0800", v4(hexed("32"), rest(be(number, 4), hexed("00000001"), hexed("99" * 16)), F.lit(24))),
        23: ether("0800", v4(hexed("84"), rest(ports, hexed("00" * 8), hexed("99" * 8)), F.lit(20))),
        24: ether("0800", v4(hexed("01"), hexed("0800000000010002"), F.lit(8))),
        25: ether("0800", v4(hexed("02"), hexed("16000000e0010203"), F.lit(8))),
        26: ether("0806", rest(hexed("0001080006040001"), hexed("02" * 6), F.col("src_addr"), hexed("00" * 6), F.col("dst_addr"))),
        27: ether("88e5", hexed("0000" + "11" * 40)),
        28: ether("8847", rest(label(number, True), mac, hexed("0010"), hexed("42420300" * 4))),
        29: ether("0800", v4(hexed("06"), hexed("0102030405"), F.lit(5))),
        30: ether("8847", rest(label(number, True), v4(hexed("06"), hexed("0102030405"), F.lit(5)))),
        31: rest(mac, hexed("81000001" * 60), hexed("0800"), inner),
        32: ether("8847", rest(label(number, True), hexed("4500"))),
        33: ether("0800", hexed("4500")),
        34: ether("0800", v4(hexed("63"), hexed("99" * 8), F.lit(8))),
        35: ether("0800", outer("2f", hexed("00010800" + "99" * 30), F.lit(34))),
        36: ether("8847", rest(label(number, True), hexed("00000000"), mac, hexed("88cc"), hexed("99" * 8))),
        37: ether("8864", hexed("110000010004c0210101")),
        38: rest(mac, hexed("0020" + "424203"), hexed("99" * 20)),
        39: ether("86dd", hexed("60000000")),
    }
    link = F.when(kind == 7, 113).when(kind == 8, 276).otherwise(1)
    found = F.when(kind == 0, kinds.pop(0))
    for k, frame in kinds.items():
        found = found.when(kind == k, frame)
    made = packets.select("packet_index", "ts_us", link.alias("data_link_type"), found.alias("bytes"))
    length = F.octet_length("bytes").cast("long")
    return made.select("packet_index", "ts_us", length.alias("captured_length"), length.alias("original_length"), "data_link_type", "bytes")


def icmp_frames(spark: SparkSession, folder: str) -> DataFrame:
    """An ICMP message for each event, of six kinds in turn, the last one cut."""
    packets = packets_from_events(spark, folder)
    index = F.col("packet_index")
    kind = index % 6
    hexed = lambda digits: F.unhex(F.lit(digits))
    quote = hexed("45" + "00" * 27)
    message = F.when(kind == 0, F.concat(hexed("08000000"), be(index % 65536, 2), be(index % 100, 2), hexed("61" * 8))).when(kind == 1, F.concat(hexed("030400000000"), be(index % 1500, 2), quote)).when(kind == 2, F.concat(hexed("0b00000000000000"), quote))
    message = message.when(kind == 3, F.concat(hexed("05010000"), F.col("dst_addr"), quote)).when(kind == 4, F.concat(hexed("0c000000"), be(index % 40, 1), hexed("000000"), quote)).otherwise(hexed("00000000"))
    size = F.when(kind == 0, 16).when(kind == 5, 4).otherwise(36)
    ip = F.concat(hexed("02" * 12 + "08004500"), be(size + 20, 2), hexed("0001000040010000"), F.col("src_addr"), F.col("dst_addr"), message)
    length = (size + 34).cast("long")
    return packets.select("packet_index", "ts_us", length.alias("captured_length"), length.alias("original_length"), F.lit(1).alias("data_link_type"), ip.alias("bytes"))
