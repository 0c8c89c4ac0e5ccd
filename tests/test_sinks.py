import pathlib

from flowspark.functions.storage import stored
from flowspark.operators import dissect, flows
from flowspark.sources import pcap, sinks

from .test_captures import PACKETS


def test_captures_come_back_as_they_were_written(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes([(1_000_000 * i + 7, len(p) + 3, p) for i, p in enumerate(PACKETS[:5])]))
    found = stored(dissect.dissect(pcap.read_captures(spark, str(tmp_path / "a.pcap"))), "packets")
    whole, each = str(tmp_path / "whole"), str(tmp_path / "each")
    sinks.write_captures(found, whole)
    back = pcap.read_captures(spark, whole)
    assert sorted((r.ts_us, r.original_length, bytes(r.bytes)) for r in back.collect()) == sorted((1_000_000 * i + 7, len(p) + 3, p) for i, p in enumerate(PACKETS[:5]))
    own = flows.with_flow(found, flows.list_flows(found), "flow_index")
    sinks.write_captures(own, each, by_flow=True)
    names = sorted(p.name for p in pathlib.Path(each).iterdir())
    assert len(names) == own.select("flow_index").distinct().count() and names[0] == "flow-00000001.pcap"


def test_link_types_and_one_file(spark, tmp_path):
    """Cooked packets come back as cooked ones; ``single`` makes one file of each link type, in packet order."""
    rows = [(i, 1_000_000 + i, 60, (1, 113)[i % 3 == 0], b"\0" * 14 + b"\x08\0" + bytes([i])) for i in range(40)]
    packets = spark.createDataFrame(rows, "packet_index long, ts_us long, original_length long, data_link_type int, bytes binary").repartition(4)
    for single in (False, True):
        place = tmp_path / str(single)
        sinks.write_captures(packets, str(place), single=single)
        back = pcap.read_captures(spark, str(place)).collect()
        assert sorted((r.ts_us, r.data_link_type, bytes(r["bytes"])) for r in back) == [(t, k, b) for _, t, _, k, b in rows]
        names = sorted(p.name for p in place.iterdir())
        assert all(n.endswith(".pcap") for n in names) and (not single or names == ["packets-link113.pcap", "packets.pcap"])
    alone = [r.ts_us for r in pcap.read_captures(spark, str(tmp_path / "True" / "packets.pcap")).orderBy("packet_index").collect()]
    assert alone == sorted(alone)


def test_failed_attempts_leave_nothing(tmp_path, monkeypatch):
    import pyspark
    from pyspark.sql.types import StringType, StructField, StructType

    class Context:
        attempt = 0

        def taskAttemptId(self):
            return Context.attempt

        def partitionId(self):
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Context))
    writer = sinks.CaptureWriter({"path": str(tmp_path / "out")}, StructType([StructField("name", StringType())]))
    row = {"name": "packets-%", "data_link_type": 1, "ts_us": 5, "original_length": 9, "bytes": b"abc"}

    def killed():
        yield row
        raise RuntimeError("executor lost")

    try:
        writer.write(killed())
    except RuntimeError:
        Context.attempt = 1
    done = writer.write(iter([row]))
    Context.attempt = 2
    writer.write(iter([row]))  # a speculative copy that was not chosen
    writer.commit([done])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["packets-00000.pcap"]
    assert [r[7] for r in pcap.records("x", (tmp_path / "out" / "packets-00000.pcap").read_bytes())] == [b"abc"]
    writer.write(iter([row]))
    writer.abort([None])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["packets-00000.pcap"]
