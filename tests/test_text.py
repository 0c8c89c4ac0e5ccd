"""Texts of values, and what is left when the optional subpackage is gone."""

import base64
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowspark.functions import text as X
from flowspark.functions.buckets import CAPTURE_SIZE, FLOW_PACKETS, labels
from flowspark.operators import reports


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (721510, "704.6 KB"), (5 << 20, "5 MB")])
def test_sizes(spark, value, shown):
    assert one(spark, value, "long", X.size_text) == shown


@pytest.mark.parametrize(("value", "shown"), [(0.0, "0%"), (0.004, "<0.01%"), (0.25, "0.25%"), (99.6, "100%"), (12.4, "12%")])
def test_percents(spark, value, shown):
    assert one(spark, value, "double", X.percent_text) == shown


def test_other_texts(spark):
    assert one(spark, 86_400_000_000 + 3_723_000_045, "long", X.time_of_day) == "01:02:03.000045"
    assert one(spark, 1234567, "long", X.count_text) == "1 234 567"
    assert one(spark, 0x12, "int", X.flags_text) == "ACK|SYN"
    assert one(spark, 'a "b"', "string", X.csv_field) == '"a ""b"""'
    assert one(spark, "plain", "string", X.csv_field) == "plain"
    assert one(spark, ["EthernetII", "VLAN(vid=10)", "IPv4", "TCP"], "array<string>", X.compact_path) == "EII|Vl|Ip4|TCP"
    assert one(spark, "a b/c", "string", X.file_name) == "a_b_c"
    assert labels(FLOW_PACKETS)[:3] == ["1", "2", "3-5"] and labels(CAPTURE_SIZE)[-1] == "25001+"


def test_queries_import_without_the_text_operators(tmp_path):
    top = Path(__file__).resolve().parents[1]
    (tmp_path / "flowspark").mkdir()
    for part in (top / "flowspark").iterdir():
        if part.name != "llm":
            (tmp_path / "flowspark" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((top / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flow_listing' in q and set(q) == set(e.oracle_sql()), q"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_tree_percent_and_hex_dump(spark):
    values = [(0.0, "0%"), (0.004, "<0.01%"), (0.25, "0.25%"), (1.0, "1%"), (12.34, "12.3%"), (99.9, "99.9%")]
    found = spark.createDataFrame([(v,) for v, _ in values], "p double").select(X.tree_percent_text(F.col("p"))).collect()
    assert [r[0] for r in found] == [t for _, t in values]
    row = spark.createDataFrame([(bytearray(b"GET / HTTP/1.1\r\nHost"),), (bytearray(),)], "b binary").select(X.hex_dump(F.col("b"))).collect()
    assert row[0][0].split("\n") == ["00000000  47 45 54 20 2f 20 48 54 54 50 2f 31 2e 31 0d 0a  GET / HTTP/1.1..", "00000010  48 6f 73 74" + " " * 36 + "  Host"] and row[1][0] == ""


def test_byte_texts_of_any_length_in_linear_time(spark):
    def texts(sizes):
        data = [bytes((7 * i + n) % 256 for i in range(n)) for n in sizes]
        began = time.monotonic()
        rows = spark.createDataFrame([(n, x) for n, x in enumerate(data)], "n int, b binary").select("n", *[c.alias(n) for n, c in reports.byte_texts(F.col("b")).items()]).orderBy("n").collect()
        return data, rows, time.monotonic() - began

    for x, r in zip(*texts([0, 1, 15, 16, 17, 31, 32, 33, 57, 300])[:2], strict=True):
        pairs = [f"{b:02X}" for b in x]
        lines = [", ".join(f"0x{p}" for p in pairs[i : i + 16]) for i in range(0, len(pairs), 16)]
        assert (r.hex, r.hex_spaced, r.base64, r.c_list, r.escaped) == ("".join(pairs), " ".join(pairs), base64.b64encode(x).decode(), "\n".join(lines), "".join(f"\\x{p}" for p in pairs))
    short, long = texts([2000] * 64)[2], texts([128_000])[2]
    assert long < 5 * short + 2
