"""Golden numbers of small captures."""

import pytest
from pyspark.sql import functions as F

from flowspark.operators import analysis, flows, query, stats
from flowspark.operators.query import FlowQuery, Retention, parse_numbers

SCHEMA = "packet_index long, ts_us long, src string, src_port int, dst string, dst_port int, protocol int, original_length long, path array<string>, hint string, service string"


def packets(spark, rows):
    address = lambda c: F.when(F.col(c).contains("."), F.unhex(F.concat(*[F.lpad(F.hex(F.split(c, "\\.")[i].cast("long")), 2, "0") for i in range(4)]))).otherwise(F.unhex(F.translate(c, ":", "")))
    made = spark.createDataFrame(rows, SCHEMA)
    family = F.when(F.col("src").contains("."), "IPv4").otherwise("IPv6")
    return made.select("*", family.alias("family"), address("src").alias("src_addr"), address("dst").alias("dst_addr"), F.col("original_length").alias("captured_length"), F.lit(16).alias("tcp_flags"), F.lit(False).alias("is_ip_fragmented"), F.lit(10).alias("payload_length"))


TCP = ["EthernetII", "IPv4", "TCP"]


def test_first_packet_gives_the_direction_and_vlan_zero_is_no_identity(spark):
    rows = [
        (1, 0, "10.0.0.9", 5, "10.0.0.1", 80, 6, 60, TCP, None, None),
        (2, 10, "10.0.0.1", 80, "10.0.0.9", 5, 6, 40, ["EthernetII", "VLAN(vid=0)", "IPv4", "TCP"], "http", "a"),
        (3, 20, "10.0.0.9", 5, "10.0.0.1", 80, 6, 60, ["EthernetII", "VLAN(vid=7)", "IPv4", "TCP"], None, None),
    ]
    found = {r.protocol_path: r for r in flows.list_flows(packets(spark, rows)).collect()}
    plain = found["EthernetII -> IPv4 -> TCP"]
    assert (plain.endpoint_a, plain.endpoint_b, plain.packets_a_to_b, plain.bytes_b_to_a, plain.protocol_hint, plain.flow_index) == ("10.0.0.9:5", "10.0.0.1:80", 1, 40, "http", 1)
    assert found["EthernetII -> VLAN(vid=7) -> IPv4 -> TCP"].packet_count == 1


def test_self_flow_is_all_a_to_b_and_counts_twice_for_its_endpoint(spark):
    listed = flows.list_flows(packets(spark, [(1, 0, "10.0.0.1", 7, "10.0.0.1", 7, 6, 50, TCP, None, None)]))
    row = listed.first()
    assert (row.packets_a_to_b, row.packets_b_to_a) == (1, 0)
    assert [tuple(r) for r in stats.top_endpoints(listed).collect()] == [("10.0.0.1:7", 2, 100)]


def test_addresses_compare_unsigned_and_v6_is_written_in_full(spark):
    v6 = "2001:0db8:0000:0000:0000:0000:0000:0031", "2001:0db8:0000:0000:0000:0000:0000:0032"
    rows = [(1, 0, "200.0.0.1", 1, "10.0.0.1", 2, 17, 70, TCP, None, None), (2, 0, v6[0], 54000, v6[1], 54001, 17, 70, TCP, None, None)]
    found = flows.list_flows(packets(spark, rows)).orderBy("flow_index").collect()
    assert [r.family for r in found] == ["IPv4", "IPv6"]
    assert found[0].ep_lo.port == 2
    assert found[1].endpoint_a == f"[{v6[0]}]:54000"


def test_time_analysis_of_three_packets(spark):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 2000)
    rows = [(1, 1000100, *a, *b, 6, 100, TCP, None, None), (2, 2000250, *b, *a, 6, 90, TCP, None, None), (3, 3000450, *a, *b, 6, 110, TCP, None, None)]
    made = packets(spark, rows)
    listed = flows.list_flows(made)
    own = flows.with_flow(made, listed, "flow_index")
    gaps = analysis.inter_arrival(own).first()
    assert (gaps.gap_count, gaps.largest_gap_us, gaps.mean_gap_us) == (2, 1000200, 1000175.0)
    rate = analysis.rates(listed).first()
    assert rate.duration_us == 2000350 and rate.packets_per_second == pytest.approx(1.499738, abs=1e-6)
    ways = analysis.directions(listed).first()
    assert tuple(ways)[1:] == ("2 : 1", "2.3 : 1", "Balanced", "Mostly A->B")
    assert {r.bucket_label: r.all_count for r in analysis.inter_arrival_histogram(own).collect()}["1-8 s"] == 2
    assert [r.delta_us for r in analysis.preview(own).orderBy("number").collect()] == [0, 1000150, 1000200]


def test_bursts_and_retention(spark):
    rows = [(i, t, "10.0.0.1", 1, "10.0.0.2", 2, 6, 100, TCP, None, None) for i, t in enumerate([0, 500, 900, 5000, 300000, 300999], 1)]
    made = packets(spark, rows)
    own = flows.with_flow(made, flows.list_flows(made), "flow_index")
    assert tuple(analysis.bursts(own).first())[1:] == (2, 3, 300)
    assert tuple(analysis.idle_gaps(own).first())[1:] == (1, 295000)
    numbers = lambda r: sorted(x.number for x in r.apply(own).collect())
    assert numbers(Retention(first_packets=2)) == [1, 2]
    assert numbers(Retention(first_bytes=250)) == [1, 2, 3]
    assert numbers(Retention(first_packets=1, last=True, every=2)) == [1, 3, 5, 6]
    with pytest.raises(ValueError):
        Retention(first_packets=0)


def test_number_lists_and_limits():
    assert parse_numbers("1-3,8, 2") == [1, 2, 3, 8]
    for wrong in ("", "0", "3-1", "a", "1-"):
        with pytest.raises(ValueError):
            parse_numbers(wrong)
    with pytest.raises(ValueError):
        FlowQuery(limit=0).apply(None)
    assert query.SORT_KEYS["index"] == ["flow_index"]


def test_unknown_flow_numbers_and_ascii_case(spark):
    import pytest

    from flowspark.operators.query import FlowQuery, Retention

    rows = spark.createDataFrame([(1, "A"), (2, "b")], "flow_index long, protocol_text string")
    assert FlowQuery(numbers=(2,)).apply(rows).count() == 1
    for wrong in ((3,), (0, 1)):
        with pytest.raises(ValueError, match="no such flow"):
            FlowQuery(numbers=wrong).apply(rows)
    packets = spark.createDataFrame([(i, 100) for i in range(50)], "packet_index long, original_length long")
    kept = lambda r: sorted(x.packet_index for x in r.apply(packets, group=None).collect())
    assert kept(Retention(first_packets=3)) == [0, 1, 2] and kept(Retention(first_bytes=201, last=True)) == [0, 1, 2, 49]
    assert kept(Retention(first_packets=2, every=20)) == [0, 1, 21, 41] and len(kept(Retention())) == 50
