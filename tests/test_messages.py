"""Messages against published samples, planted faults and plain readings."""

import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.operators import details, dissect, layers, messages, query, streams

from .test_captures import ether, ipv4, ipv6, tcp, udp

# The client's Initial of RFC 9001, appendix A: connection id, keys, and the CRYPTO frame.
SAMPLE_ID = bytes.fromhex("8394c8f03e515708")
SAMPLE_KEYS = ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
SAMPLE_CRYPTO = bytes.fromhex(
    "060040f1010000ed0303ebf8fa56f12939b9584a3896472ec40bb863cfd3e868"
    "04fe3a47f06a2b69484c00000413011302010000c000000010000e00000b6578"
    "616d706c652e636f6dff01000100000a00080006001d00170018001000070005"
    "04616c706e000500050100000000003300260024001d00209370b2c9caa47fba"
    "baf4559fedba753de171fa71f50f1ce15d43e994ec74d748002b000302030400"
    "0d0010000e0403050306030203080408050806002d00020101001c0002400100"
    "3900320408ffffffffffffffff05048000ffff07048000ffff08011001048000"
    "75300901100f088394c8f03e51570806048000ffff"
)
SAMPLE_HEADER_MASK = "437b9aec36"
SAMPLE_START = "c000000001088394c8f03e5157080000449e7b9aec34d1b1c98dd7689fb8ec11"


def test_quic_keys_of_the_sample():
    assert tuple(k.hex() for k in messages.initial_keys(1, SAMPLE_ID)) == SAMPLE_KEYS


def test_quic_sample_opens(spark):
    """The sample, protected again by the published keys: header and first sealed bytes are the published ones, and the name comes out."""
    key, iv, hp = (bytes.fromhex(k) for k in SAMPLE_KEYS)
    plain = SAMPLE_CRYPTO + b"\0" * (1162 - len(SAMPLE_CRYPTO))
    head = bytes.fromhex("c300000001088394c8f03e5157080000449e00000002")
    nonce = iv[:11] + bytes([iv[11] ^ 2])
    row = spark.createDataFrame([(plain, key, hp, nonce, head)], "plain binary, key binary, hp binary, nonce binary, head binary")
    sealed = row.select(F.expr("substring(aes_encrypt(plain, key, 'GCM', 'DEFAULT', nonce, head), 13)")).first()[0]
    sample = bytes(sealed[:16])
    mask = row.select(F.aes_encrypt(F.lit(sample), "hp", F.lit("ECB"), F.lit("PKCS"))).first()[0][:5]
    assert bytes(mask).hex() == SAMPLE_HEADER_MASK
    start = bytes([head[0] ^ mask[0] & 15]) + head[1:-4] + bytes(a ^ b for a, b in zip(head[-4:], mask[1:]))
    datagram = start + bytes(sealed)
    assert datagram[:32].hex() == SAMPLE_START and len(datagram) == 1200
    rows = spark.createDataFrame([(1, datagram), (2, datagram[:-1] + b"?"), (3, b"\xc0"), (4, None)], "flow long, payload binary")
    assert [tuple(r) for r in messages.quic_server_names(rows, ["flow"]).select("flow", "version", "server_name").collect()] == [(1, 1, "example.com")]
    assert messages.quic_initials(rows).where("plain is null").count() == 1


def test_frames_join_in_any_order():
    data = bytes(range(200))
    pieces = [(150, data[150:]), (0, data[:60]), (40, data[40:120]), (0, data[:10]), (110, data[110:151])]
    assert messages.joined_frames(pieces) == data and messages.joined_frames([(0, data[:5]), (9, data[9:])]) == data[:5]
    assert messages.crypto_frames(b"\0\1\2\5\0\0\1\6\0\2ab\0") == [(0, b"ab")] and messages.crypto_frames(b"\x1c") is None and messages.crypto_frames(b"\6\0\5ab") is None


def test_http_framing():
    cut = lambda text: [(kind, label, header, body) for kind, label, _, header, body in messages.http_items(text)]
    assert cut(b"GET /a HTTP/1.1\nHost: x\n\nPOST /b HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc") == [("request", "HTTP GET /a", 25, 0), ("request", "HTTP POST /b", 39, 3)]
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n4;x=y\r\nabcd\r\n0\r\nT: v\r\n\r\n"
    assert cut(chunked) == [("response", "HTTP 200 OK", 53, len(chunked) - 53)]
    assert cut(chunked[:-2]) == [("response", "HTTP 200 OK", 53, 0), ("partial", "HTTP Payload (partial)", 0, len(chunked) - 55)]
    assert cut(b"HTTP/1.1 204\r\n\r\n")[0][1] == "HTTP 204" and cut(b"GETX / HTTP/1.1\r\n\r\n")[0][0] == "partial" and cut(b"") == []


def test_dns_faults():
    question = b"\0\7\1\0\0\1\0\0\0\0\0\0" + b"\1a\2bc\0" + b"\0\1\0\1"
    assert messages.dns_message(question)["questions"] == [{"name": "a.bc", "type": 1, "class": 1}]
    assert messages.dns_message(question[:-1])["status"] == "truncated" and messages.dns_message(b"\0" * 11)["status"] == "not_enough_header"
    loop = b"\0\7\1\0\0\1\0\0\0\0\0\0" + b"\1a\xc0\x0c\0\1\0\1"
    assert messages.dns_message(loop)["status"] == "malformed" and messages.dns_message(b"\0\7\1\0\xff\xff" + b"\0" * 6)["status"] == "malformed"
    soa = b"\0\7\x81\x80\0\0\0\1\0\0\0\0" + b"\0\0\6\0\1\0\0\0\5\0\2hi"
    assert messages.dns_message(soa)["answers"] == [{"name": ".", "type": 6, "class": 1, "ttl": 5, "value": "6869"}]


@settings(deadline=None)
@given(st.binary(max_size=80))
def test_readers_survive_any_bytes(data):
    messages.dns_message(data)
    list(messages.http_items(data))
    list(messages.record_items(data))
    list(messages.initials_in(data))
    messages.crypto_frames(data)
    messages.certificate_summary(data)


def test_pages_of_items_equal_the_whole(spark):
    folder = "/root/testdata/sf0.001"
    items = messages.stream_items(messages.http_messages(streams.http_segments(spark, folder)), messages.tls_records(streams.tls_segments(spark, folder)))
    whole = [tuple(r) for r in items.where("flow_index = 3").orderBy("first_packet", "direction", "item").collect()]
    found, after = [], None
    while True:
        page, after = messages.items_page(items, 3, after, 2)
        found += [tuple(r) for r in page]
        if after is None:
            break
    assert found == whole and len(whole) > 4


@pytest.mark.parametrize("wrap", ["ip in ip", "gre", "vlan"])
@pytest.mark.parametrize("depth", [1, 4, 12, 30])
def test_nested_layers(spark, wrap, depth):
    inner = ipv4(6, tcp(7, 8), "9.9.9.9", "8.8.8.8")
    for _ in range(depth if wrap != "vlan" else 0):
        inner = ipv4(4, inner) if wrap == "ip in ip" else ipv4(47, struct.pack(">HH", 0, 0x0800) + inner)
    frame = ether(0x0800, inner, tags=range(depth) if wrap == "vlan" else ())
    row = dissect.dissect(spark.createDataFrame([(1, bytes(frame), 1)], "packet_index long, bytes binary, data_link_type int")).first()
    # A turn is one layer: GRE takes two a level.
    if (depth if wrap != "gre" else 2 * depth) + 4 <= layers.MAX_DEPTH:
        assert (row.reason, row.src_port, bytes(row.src_addr)) == (None, 7, bytes([9] * 4)) and len(row.path) == {"ip in ip": depth + 3, "gre": 2 * depth + 3, "vlan": depth + 3}[wrap]
    else:
        assert row.reason == "Could not extract flow key"


def test_overlays_fall_back_to_the_outer_flow(spark):
    good = ether(0x0800, ipv4(17, udp(5, 6, b"x"), "9.9.9.9", "8.8.8.8"))
    vxlan = lambda frame: ether(0x0800, ipv4(17, udp(9, 4789, b"\x08\0\0\0\0\0\7\0" + frame)))
    gtpu = lambda flags, rest, n=None: ether(0x0800, ipv4(17, udp(9, 2152, struct.pack(">BBHI", flags, 255, len(rest) if n is None else n, 1) + rest)))
    inside = ipv4(17, udp(5, 6, b"x"), "9.9.9.9", "8.8.8.8")
    cases = [
        (vxlan(good), 5), (vxlan(good[:-1]), 9), (vxlan(ether(0x0806, b"\0" * 28)), 9), (vxlan(ether(0x86DD, ipv6(17, udp(5, 6)))), 5), (vxlan(ether(0x0800, ipv4(17, udp(5, 6), fragment=0x2000))), 9),
        (vxlan(vxlan(good)), 9), (gtpu(0x30, inside), 5), (gtpu(0x32, b"\0\0\0\0" + inside), 5), (gtpu(0x34, b"\0\0\0\x85\1\0\0\xc0\2" + b"\0" * 7 + inside), 5), (gtpu(0x34, b"\0\0\0\x85\0\0\0\0" + inside), 9),
        (gtpu(0x34, b"\0\0\0\x85\xff\0\0\0" + inside), 9), (gtpu(0x30, inside, 0), 9), (gtpu(0x20, inside), 9), (gtpu(0x30, b"\x70" + inside), 9),
    ]
    rows = [(i, bytes(f), 1) for i, (f, _) in enumerate(cases)]
    found = dissect.dissect(spark.createDataFrame(rows, "packet_index long, bytes binary, data_link_type int")).orderBy("packet_index").collect()
    assert [(r.reason, r.src_port) for r in found] == [(None, p) for _, p in cases]
    # A second overlay is not entered: the UDP flow inside the first one stands.
    assert [len(r.path) for r, (_, p) in zip(found, cases) if p == 9] == [3, 3, 3, 7, 3, 3, 3, 3, 3]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.sampled_from([1, 113, 276, 7, None]), st.binary(max_size=120)), max_size=20))
def test_any_bytes_are_walked(packets):
    import pyarrow as pa

    plants = [b"\1" * 12 + x for x in (b"\x08\0E", b"\x86\xdd`", b"\x81\0\0\1\x88G", b"\x88\xe7", b"\x88d\x11\0")]
    data = [p[1] for p in packets] + [head + p[1] for head in plants for p in packets]
    links = [p[0] for p in packets] + [1] * (len(data) - len(packets))
    found = layers.walk_layers(pa.array(data, pa.binary()), pa.array(links, pa.int32()))
    assert all(len(v) == len(data) for v in found.values())
    for reason, protocol in zip(found["reason"].to_pylist(), found["protocol"].to_pylist()):
        assert (reason is None) == (protocol is not None)


def test_hosts_of_requests_only(spark):
    cases = [
        (b"GET /a HTTP/1.1\r\nHost: a.example\r\n\r\n", "a.example"), (b"GET /a HTTP/1.1\nHost: a.example\n\n", "a.example"), (b"HTTP/1.1 200 OK\r\nHost: a.example\r\n\r\n", None),
        (b"POST /a HTTP/1.1\r\nA: b\r\n\r\nHost: a.example\r\n", None), (b"GET / HTTP/1.1\r\nHost: a:80\r\n\r\n", None), (b"GET / HTTP/1.1\r\nX: y\r\nhOsT:  b \r\n", "b"),
    ]
    rows = [(i, bytes(ether(0x0800, ipv4(6, tcp(4000, 80, c)))), 1) for i, (c, _) in enumerate(cases)]
    found = dissect.dissect(spark.createDataFrame(rows, "packet_index long, bytes binary, data_link_type int")).orderBy("packet_index").collect()
    assert [(r.hint, r.service) for r in found] == [("http", s) for _, s in cases]
    texts = spark.createDataFrame([(i, c.decode()) for i, (c, _) in enumerate(cases)], "packet_index long, payload string")
    assert [r.service for r in streams.hinted(texts).orderBy("packet_index").collect()] == [s for _, s in cases]


def test_every_sort_key(spark):
    from flowspark.plans.catalog import rows

    table = rows(spark, "/root/testdata/sf0.001")
    assert len(query.SORT_KEYS) == 12
    for key in query.SORT_KEYS:
        up = [r.flow_index for r in query.FlowQuery(sort=key).apply(table).select("flow_index").collect()]
        down = [r.flow_index for r in query.FlowQuery(sort=key, descending=True).apply(table).select("flow_index").collect()]
        assert sorted(up) == sorted(down) == list(range(1, len(up) + 1))
    ports = [r.p for r in query.FlowQuery(sort="port_a").apply(table).select(F.col("ep_a.port").alias("p")).collect()]
    assert ports == sorted(ports)


def test_a_hot_flow_spans_many_tasks(spark):
    """One flow with nine tenths of the packets: equal gaps and numbers, and its packets lie in several blocks of like size."""
    from flowspark.functions.scan import BLOCK, in_blocks
    from flowspark.operators import analysis

    packets = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70 + 2).otherwise(1).alias("flow_index"), ((F.col("id") * 7919) % 20_011 * 3).alias("ts_us"), F.col("id").alias("packet_index"), F.lit(60).cast("long").alias("original_length"))
    # So few rows would be put together to one block.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in in_blocks(packets, "flow_index", analysis.IN_TIME).groupBy(BLOCK).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    found = {r.packet_index: r.gap_us for r in analysis.with_gaps(packets).select("packet_index", "gap_us").collect()}
    last: dict = {}
    for r in sorted(packets.collect(), key=lambda r: (r.ts_us, r.packet_index)):
        assert found[r.packet_index] == (r.ts_us - last[r.flow_index] if r.flow_index in last else None)
        last[r.flow_index] = r.ts_us
    kept = query.Retention(first_bytes=6000, last=True, every=500).apply(packets)
    own = sorted(r.packet_index for r in packets.where("flow_index = 1").collect())
    wanted = {p for n, p in enumerate(own, 1) if n <= 100 or n == len(own) or (n - 100) % 500 == 0}
    assert {r.packet_index for r in kept.where("flow_index = 1").collect()} == wanted


def plain_rows(data: bytes, places: list[tuple[str, int]]) -> list[dict]:
    """Layers with the fields whose bytes are there, read bit by bit."""
    bits = "".join(f"{x:08b}" for x in data)
    rows = []
    for name, at in places:
        found = []
        for field, first, size, form in details.FIELDS.get(name.partition("(")[0], []):
            own = bits[8 * at + first : 8 * at + first + size]
            if len(own) < size or 8 * at + 8 * -(-(first + size) // 8) > len(bits):
                continue
            value, digits = int(own, 2), f"{int(own, 2):0{-(-size // 4)}x}"
            octets = [int(own[i : i + 8], 2) for i in range(0, size, 8)]
            flags = "|".join(n for i, n in enumerate(details.FLAGS) if value >> i & 1)
            found.append((field, {"number": str(value), "hex": f"0x{digits}", "ipv4": ".".join(map(str, octets)), "mac": ":".join(f"{x:02x}" for x in octets), "ipv6": ":".join(digits[i : i + 4] for i in range(0, 32, 4)), "flags": flags}[form]))
        rows.append({"name": name, "offset": at, "fields": found})
    return rows


def test_details_of_many_packets_at_once():
    """Every field equals a plain reading, cut packets too, and reading them costs little more than walking the layers."""
    import pyarrow as pa

    inner = ether(0x0800, ipv4(6, tcp(4, 5, flags=0xD2)))
    overlays = [(4789, b"\x08\0\0\0\0\1\2\0"), (6081, b"\0\0\x65\x58\0\1\2\0")]
    whole = [ether(0x86DD, ipv6(17, udp(1, 2))), ether(0x8847, b"\1\2\x13\x40" + ipv4(132, b"\7" * 20)), ether(0x88E7, b"\x40\1\2\3" + inner), ether(0x8864, b"\x11\0\0\1\0\x2a\0\x21" + ipv4(50, b"\6" * 20)), ether(0x0800, ipv4(47, b"\x20\0\x08\0\0\0\0\x09" + ipv4(51, b"\6\4" + b"\5" * 22 + tcp(1, 2))), tags=(7, 0xFFF))]
    whole += [ether(0x0800, ipv4(17, udp(9, port, head + inner))) for port, head in overlays] + [ether(0x0800, ipv4(17, udp(9, 2152, b"\x30\xff\0\x28\0\0\0\5" + ipv4(6, tcp(4, 5)))))]
    cut = [x[:n] for x in whole for n in range(len(x) + 1)]
    packets, links = pa.array(cut, pa.binary()), pa.array([1] * len(cut), pa.int32())
    found = details.layer_rows(packets, links).to_pylist()
    assert found == [plain_rows(x, [(r["name"], r["offset"]) for r in rows]) for x, rows in zip(cut, found, strict=True)]
    names = {r["name"].partition("(")[0] for rows in found for r in rows}
    assert {"EthernetII", "VLAN", "MPLS", "PBB", "PPPoE", "PPP", "IPv4", "IPv6", "AH", "ESP", "GRE", "UDP", "TCP", "SCTP", "VXLAN", "Geneve", "GTP-U"} <= names
    assert details.layer_rows(packets[:0], links[:0]).to_pylist() == []
    many, links = pa.array([inner] * 20_000, pa.binary()), pa.array([1] * 20_000, pa.int32())
    least = lambda f: min((began := time.monotonic(), f(many, links), time.monotonic() - began)[2] for _ in range(3))
    walk, read = least(layers.machine_over), least(details.layer_rows)
    assert read < 20 * walk + 0.1
