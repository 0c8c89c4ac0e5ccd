"""Captures read in byte ranges give what one walk through the file gives."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.sources import pcap


def classic_file(n, seed):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        # Payloads that look like record headers, and runs of zeros.
        body = rng.choice([b"\0" * rng.randint(0, 300), struct.pack("<IIII", 5, 6, 7, 8) * rng.randint(0, 20), rng.randbytes(rng.randint(0, 200))])
        made.append((1_600_000_000_000_000 + i * 1000, len(body) + 1, body))
    return pcap.pcap_bytes(made)


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def block_file(n, seed):
    """Sections of both byte orders, interfaces named late, packets of unknown interfaces."""
    rng = random.Random(seed)
    data = b""
    for order in ("<", ">", "<"):
        data += block(order, pcap.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        known = 0
        for i in range(n):
            if i % 40 == 0:
                data += block(order, 1, struct.pack(order + "HHI", (1, 50, 113)[known % 3], 0, 0) + struct.pack(order + "HHB3x", 9, 1, (6, 9, 0x8A)[known % 3]) + b"\0" * 4)
                known += 1
            body = rng.randbytes(rng.randint(0, 120))
            ticks = rng.getrandbits(50)
            data += block(order, 6, struct.pack(order + "IIIII", rng.randint(0, known), ticks >> 32, ticks & 0xFFFFFFFF, len(body), len(body) + 3) + body)
            if i % 17 == 0:
                data += block(order, 5, b"\0" * 60)
    return data


def rows_of(frame):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [512, 4096, 1 << 20])
def test_ranges_equal_one_walk(spark, tmp_path, range_bytes):
    data = {"a.pcap": classic_file(300, 1), "b.pcapng": block_file(150, 2), "cut.pcap": classic_file(200, 3)[:-7], "cut.pcapng": block_file(60, 4)[:-5], "one.pcap": pcap.pcap_bytes([(1, 2, b"x" * 1_500)])}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = pcap.read_captures(spark, str(tmp_path), range_bytes)
    wanted = sorted((r[1:] for name, content in data.items() for r in pcap.records(name, content)), key=str)
    assert rows_of(found) == wanted
    ranges = pcap.capture_ranges(spark, str(tmp_path), range_bytes)
    assert ranges.count() > 20 if range_bytes == 512 else True


def test_short_block_is_refused(spark, tmp_path):
    head = block("<", pcap.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block("<", 1, struct.pack("<HHI", 1, 0, 0))
    packet = lambda claimed, body: block("<", 6, struct.pack("<IIIII", 0, 0, 1, claimed, 40) + body)
    (tmp_path / "short.pcapng").write_bytes(head + packet(8, b"x" * 8) + packet(40, b"y" * 8) + packet(8, b"z" * 8))
    found = pcap.read_captures(spark, str(tmp_path)).orderBy(F.col("packet_index").asc_nulls_last()).collect()
    assert [r.captured_length for r in found] == [8, None] and "longer than its block" in found[1].warning


def test_bytes_by_reference(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic_file(200, 5))
    (tmp_path / "b.pcapng").write_bytes(block_file(80, 6))
    packets = pcap.read_captures(spark, str(tmp_path), 4096)
    chosen = packets.where("packet_index % 7 = 3")
    missing = spark.createDataFrame([(None, None, None), (str(tmp_path / "a.pcap"), None, 5)], "file string, byte_offset long, captured_length long")
    late = pcap.fetch_bytes(chosen.select("file", "byte_offset", "captured_length").unionByName(missing), gap=100, most=2000)
    key = lambda f: sorted((r.file or "", r.byte_offset or 0, bytes(r["bytes"]) if r["bytes"] is not None else None) for r in f.collect())
    assert [r for r in key(late) if r[2] is not None] == key(chosen) and late.where("bytes is null").count() == 2
    joined = chosen.select("file", "packet_index").join(late.withColumnRenamed("bytes", "late"), "file").count()
    assert joined > 0


def test_packets_are_not_broadcast(spark, tmp_path):
    """A join sorts packets, however few bytes Spark takes them for: 6,000,000 of them stand in nine rows of ranges."""
    (tmp_path / "a.pcap").write_bytes(classic_file(200, 7))
    packets = pcap.read_captures(spark, str(tmp_path))
    many = spark.range(10_000_000).withColumnRenamed("id", "packet_index")
    late = pcap.fetch_bytes(packets.select("packet_index", "file", "byte_offset", "captured_length"))
    for found in (packets, packets.where("captured_length > 0").select("packet_index"), late):
        joined = found.join(many, "packet_index")
        # The first join of the plan is the last one made.
        first = next(line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
        assert "SortMergeJoin" in first, first
    assert late.join(many, "packet_index").count() == 200


def test_last_second():
    assert pcap.micros(1 << 63, 0) == 0xFFFFFFFF * 1_000_000 + 999_999
