"""Captures written byte by byte, read and dissected."""

import struct

import pytest

from flowspark.operators import dissect, flows, stats
from flowspark.sources import pcap
from flowspark.sources.views import packets_from_events
from flowspark.streaming.incremental import append_new_packets, windowed_totals


def ether(kind, rest, tags=()):
    out = b"\1" * 12
    for vid in tags:
        out += struct.pack(">HH", 0x8100, vid)
    return out + struct.pack(">H", kind) + rest


def ipv4(protocol, rest, src="10.0.0.1", dst="10.0.0.2", fragment=0):
    address = lambda x: bytes(map(int, x.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(rest), 1, fragment, 64, protocol, 0) + address(src) + address(dst) + rest


def ipv6(protocol, rest):
    return struct.pack(">IHBB", 6 << 28, len(rest), protocol, 64) + b"\x20" + b"\0" * 14 + b"\1" + b"\x20" + b"\0" * 14 + b"\2" + rest


def tcp(source, target, payload=b"", flags=0x18):
    return struct.pack(">HHIIBBHHH", source, target, 1, 2, 0x50, flags, 100, 0, 0) + payload


def udp(source, target, payload=b""):
    return struct.pack(">HHHH", source, target, 8 + len(payload), 0) + payload


PACKETS = [
    ether(0x0800, ipv4(6, tcp(4000, 80, b"GET /a HTTP/1.1\r\nHost: h.example\r\n\r\n"))),
    ether(0x0800, ipv4(6, tcp(80, 4000, b"HTTP/1.1 200 OK\r\n\r\n"), "10.0.0.2", "10.0.0.1"), tags=(0,)),
    ether(0x0800, ipv4(17, udp(5000, 53, struct.pack(">HHHHHH", 7, 0x100, 1, 0, 0, 0) + b"\1a\0\0\1\0\1")), tags=(10, 20)),
    ether(0x86DD, ipv6(0, b"\x11\0" + b"\0" * 6 + udp(443, 6000, b"\xc0\0\0\0\1" + b"x" * 20))),
    ether(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + b"\1" * 6 + bytes([10, 0, 0, 9]) + b"\0" * 6 + bytes([10, 0, 0, 8])),
    ether(0x8847, struct.pack(">I", 77 << 12 | 0x100) + ipv4(1, b"\x08\0\0\0")),
    ether(0x0800, ipv4(6, tcp(4000, 80), fragment=0x2000)),
    ether(0x0800, ipv4(6, b"\1\2\3")),
    ether(0x88CC, b"lldp"),
    b"short",
]


@pytest.fixture
def capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes([(1_000_000 * i + 7, len(p) + (i == 0) * 5, p) for i, p in enumerate(PACKETS)]))
    return dissect.dissect(pcap.read_captures(spark, str(tmp_path / "a.pcap")))


def test_layers_and_hints(capture):
    found = capture.orderBy("packet_index").collect()
    paths = [" -> ".join(r.path) for r in found[:6]]
    assert paths == [
        "EthernetII -> IPv4 -> TCP", "EthernetII -> VLAN(vid=0) -> IPv4 -> TCP", "EthernetII -> VLAN(vid=10) -> VLAN(vid=20) -> IPv4 -> UDP", "EthernetII -> IPv6 -> UDP",
        "EthernetII", "EthernetII -> MPLS(label=77) -> IPv4",
    ]
    assert [r.hint for r in found[:6]] == ["http", "http", "dns", "quic", None, None]
    assert (found[0].service, found[0].src_port, found[0].tcp_flags, found[0].payload_length, found[0].original_length) == ("h.example", 4000, 0x18, 36, len(PACKETS[0]) + 5)
    assert (found[6].is_ip_fragmented, found[6].src_port) == (True, 0)
    assert [r.reason for r in found[6:]] == [None, "TCP header truncated", "Unsupported or malformed packet", "Link-layer header truncated"]


def test_flows_of_a_capture(capture):
    listed = flows.flows_of(dissect.recognized(capture))
    found = {(r.protocol_text, r.endpoint_a): r.packet_count for r in listed.collect()}
    assert found == {("TCP", "10.0.0.1:4000"): 2, ("UDP", "10.0.0.1:5000"): 1, ("UDP", "[2000:0000:0000:0000:0000:0000:0000:0001]:443"): 1, ("ARP", "10.0.0.9:0"): 1, ("ICMP", "10.0.0.1:0"): 1, ("TCP", "10.0.0.1:0"): 1}
    assert stats.unrecognized_statistics(dissect.unrecognized(capture)).first().packet_count == 3


def test_tunnels(spark):
    inner = ipv4(6, tcp(1, 2), "192.168.0.1", "192.168.0.2")
    frame = ether(0x0800, inner)
    wrapped = [
        (ipv4(17, udp(9, 4789, b"\x08\0\0\0" + (100 << 8).to_bytes(4, "big") + frame)), "EthernetII -> IPv4 -> UDP -> VXLAN(vni=100) -> EthernetII -> IPv4 -> TCP"),
        (ipv4(17, udp(9, 6081, b"\x01\0\x65\x58" + (7 << 8).to_bytes(4, "big") + b"\0" * 4 + frame)), "EthernetII -> IPv4 -> UDP -> Geneve(vni=7) -> EthernetII -> IPv4 -> TCP"),
        (ipv4(17, udp(9, 2152, b"\x30\xff" + struct.pack(">HI", len(inner), 0x1234) + inner)), "EthernetII -> IPv4 -> UDP -> GTP-U(teid=0x00001234) -> IPv4 -> TCP"),
        (ipv4(47, struct.pack(">HHI", 0x2000, 0x0800, 0xAB) + inner), "EthernetII -> IPv4 -> GRE(key=0x000000ab) -> IPv4 -> TCP"),
        (ipv4(4, inner), "EthernetII -> IPv4 -> IPv4 -> TCP"),
        (ipv4(17, udp(9, 4789, b"\0" * 8)), "EthernetII -> IPv4 -> UDP"),
    ]
    rows = [(i, bytes(ether(0x0800, w)), 1) for i, (w, _) in enumerate(wrapped)]
    found = dissect.dissect(spark.createDataFrame(rows, "packet_index long, bytes binary, data_link_type int")).orderBy("packet_index").collect()
    assert [" -> ".join(r.path) for r in found] == [p for _, p in wrapped]
    assert {(bytes(r.src_addr), r.src_port, r.reason) for r in found[:-1]} == {(bytes([192, 168, 0, 1]), 1, None)}


def test_further_layers_and_reasons(spark):
    inner = ipv4(6, tcp(1, 2))
    labels = lambda n: b"".join(struct.pack(">I", i << 12 | (0x100 if i == n else 0)) for i in range(1, n + 1))
    cases = [
        (b"\1" * 12 + struct.pack(">H", 8 + len(inner)) + b"\xaa\xaa\3\0\0\0\x08\0" + inner, "IEEE 802.3 -> LLC/SNAP -> IPv4 -> TCP", None),
        (ether(0x8864, b"\x11\0\0\1\0\x20\0\x21" + inner), "EthernetII -> PPPoE -> PPP -> IPv4 -> TCP", None),
        (ether(0x88E7, b"\0\0\1\2" + b"\1" * 12 + b"\x08\0" + inner), "EthernetII -> PBB(isid=0x000102) -> EthernetII -> IPv4 -> TCP", None),
        (ether(0x8847, labels(16) + inner), "EthernetII -> " + "".join(f"MPLS(label={i}) -> " for i in range(1, 17)) + "IPv4 -> TCP", None),
        (ether(0x8847, labels(1) + b"\0" * 4 + ether(0x0800, inner)), "EthernetII -> MPLS(label=1) -> MPLS PW -> EthernetII -> IPv4 -> TCP", None),
        (ether(0x0800, ipv4(51, b"\6\4\0\0" + b"\0\0\0\7" + b"\0" * 16 + tcp(1, 2))), "EthernetII -> IPv4 -> AH(spi=0x00000007) -> TCP", None),
        (ether(0x0800, ipv4(50, b"\0\0\0\x09rest")), "EthernetII -> IPv4 -> ESP(spi=0x00000009)", None),
        (ether(0x0800, ipv4(4, ipv4(47, struct.pack(">HH", 0, 0x0800) + inner))), "EthernetII -> IPv4 -> IPv4 -> GRE -> IPv4 -> TCP", None),
        (ether(0x0800, ipv4(2, b"\x16\0\0\0\xe0\1\2\3")), "EthernetII -> IPv4", None),
        (ether(0x0800, ipv4(6, tcp(1, 2), fragment=0x2000)), "EthernetII -> IPv4", None),
        (ether(0x86DD, ipv6(0, b"\x3c\0" + b"\0" * 6 + (b"\x3c\0" + b"\0" * 6) * 6 + b"\x11\0" + b"\0" * 6 + udp(1, 2))), "EthernetII -> IPv6 -> UDP", None),
        (b"\1" * 12 + b"\0\x20\x42\x42\3" + b"x" * 20, None, "Non-SNAP LLC frame"),
        (b"\1" * 12 + b"\0\x20\xaa\xaa\3\0\0\0\x88\xcc", None, "Unknown SNAP PID"),
        (b"\1" * 12 + b"\0\x20\xaa", None, "LLC header truncated"),
        (ether(0x8863, b"\x11\x09" + b"\0" * 10), None, "PPPoE Discovery PADI"),
        (ether(0x8864, b"\x11\0\0\1\0\4\xc0\x21"), None, "PPP LCP control packet"),
        (ether(0x88E5, b"\0\0" + b"\1" * 40), None, "MACsec protected payload not decrypted"),
        (ether(0x88E5, b"\x20\0" + b"\1" * 6), None, "MACsec SCI truncated"),
        (ether(0x8847, labels(2)[:6]), None, "MPLS label header truncated"),
        (ether(0x8847, struct.pack(">I", 1 << 12) * 20), None, "MPLS bottom-of-stack not found"),
        (ether(0x0800, ipv4(2, b"")), None, "Missing IGMP payload"),
        (ether(0x0800, ipv4(17, b"\0\1\0")), None, "UDP header truncated"),
        (ether(0x0806, b"\0\1\x08\0\6\4"), None, "ARP header truncated"),
    ]
    rows = [(i, bytes(c[0]), 1) for i, c in enumerate(cases)]
    found = dissect.dissect(spark.createDataFrame(rows, "packet_index long, bytes binary, data_link_type int")).orderBy("packet_index").collect()
    for r, (_, path, reason) in zip(found, cases, strict=True):
        assert (None if reason else " -> ".join(r.path), r.reason) == (path, reason), r.packet_index
    assert bytes(found[8].dst_addr) == bytes([224, 1, 2, 3]) and (found[0].sequence, found[0].acknowledgement) == (1, 2)


def test_cut_capture_keeps_what_was_read(spark, tmp_path):
    whole = pcap.pcap_bytes([(1, 60, PACKETS[0]), (2, 60, PACKETS[1])])
    (tmp_path / "cut.pcap").write_bytes(whole[:-5])
    found = pcap.read_captures(spark, str(tmp_path / "cut.pcap")).collect()
    assert [r.packet_index for r in found] == [0, None] and "packet" in found[1].warning
    with pytest.raises(ValueError):
        list(pcap.records("x", b"\xa1\xb2\xc3\xd4" + whole[4:]))


@pytest.mark.parametrize("order", ["<", ">"])
def test_blocks_of_both_byte_orders(order):
    def block(kind, body):
        return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))

    head = block(pcap.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    interface = lambda link, resolution: block(1, struct.pack(order + "HHI", link, 0, 0) + struct.pack(order + "HHB3x", 9, 1, resolution) + b"\0" * 4)
    packet = lambda i, ticks: block(6, struct.pack(order + "IIIII", i, ticks >> 32, ticks & 0xFFFFFFFF, 5, 9) + b"short\0\0\0")
    data = head + interface(1, 9) + interface(50, 6) + packet(0, 1_500) + packet(1, 1) + block(5, b"\0" * 8) + packet(7, 1) + packet(0, 2_499)
    assert [(r[1], r[4], r[6], r[7]) for r in pcap.records("x", data)] == [(0, 2, 9, b"short"), (1, 2, 9, b"short")]
    assert pcap.micros(1 << 9, 0x80 | 10) == 500_000


def test_index_grows_by_new_files_only(spark, tmp_path):
    made = packets_from_events(spark, "/root/testdata/sf0.001")
    inbox, index, progress = (str(tmp_path / x) for x in ("in", "index", "progress"))
    made.where("packet_index < 500").write.parquet(inbox)
    append_new_packets(spark, inbox, made.schema, index, progress)
    first = spark.read.parquet(index).count()
    made.where("packet_index >= 500").write.mode("append").parquet(inbox)
    append_new_packets(spark, inbox, made.schema, index, progress)
    whole = spark.read.parquet(index)
    assert first < whole.count() == made.count()
    assert windowed_totals(whole).agg({"packet_count": "sum"}).first()[0] == made.count()


def test_index_version_and_changed_sources(spark, tmp_path):
    from flowspark.operators import reports
    from flowspark.sources import sinks

    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pcap").write_bytes(pcap.pcap_bytes([(1, 60, PACKETS[0]), (2, 60, PACKETS[1])]))
    here = str(tmp_path / "*.pcap")
    packets = packets_from_events(spark, "/root/testdata/sf0.001")
    index = str(tmp_path / "index")
    sinks.write_index(spark, packets, flows.flows_of(packets), index, reports.describe_sources(spark, here))
    stored_packets, stored_flows, sources = sinks.read_index(spark, index)
    assert stored_packets.count() == packets.count() and stored_flows.count() == flows.flows_of(packets).count()
    assert {r["format"] for r in sources.collect()} == {"pcap"} and reports.changed_sources(sources, reports.describe_sources(spark, here)).count() == 0
    (tmp_path / "a.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:-1] + b"?")
    (tmp_path / "b.pcap").unlink()
    (tmp_path / "d.pcap").write_bytes(b"short")
    wrong = {r["path"][-6:]: r["wrong"] for r in reports.changed_sources(sources, reports.describe_sources(spark, here)).collect()}
    assert wrong == {"a.pcap": "content", "b.pcap": "missing", "d.pcap": "new"}
    spark.createDataFrame([(99, False)], "version int, has_sources boolean").write.mode("overwrite").parquet(f"{index}/meta")
    with pytest.raises(ValueError, match="version"):
        sinks.read_index(spark, index)
