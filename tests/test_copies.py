"""Queries against their SQL on copies of a table with shifted keys, as larger tables have them."""

from pathlib import Path

import duckdb
import pytest

from flowspark.queries import ORACLE, QUERIES

from .compare import TABLES, as_rows, sql_rows

FOLDER = Path("/root/testdata/sf0.001")


def copies(place: Path, table: str, key: str, steps: list[int]) -> str:
    """A folder with the tables of the smallest size, and one of them repeated with ``key`` moved by each step."""
    for name in TABLES:
        if name != table:
            (place / f"{name}.parquet").symlink_to(FOLDER / f"{name}.parquet")
    moved = " UNION ALL ".join(f"SELECT * REPLACE ({key} + {step} AS {key}) FROM '{FOLDER}/{table}.parquet'" for step in steps)
    duckdb.connect().execute(f"COPY ({moved}) TO '{place}/{table}.parquet' (FORMAT parquet)")
    return str(place)


def equal(spark, name: str, folder: str) -> None:
    found = as_rows(QUERIES[name](spark, folder).toPandas())
    assert found and found == as_rows(sql_rows(ORACLE[name], folder))


@pytest.mark.parametrize("steps", [[0, 1000], [0, 7777]])
def test_bytes_by_reference_on_copies(spark, tmp_path, steps):
    """Cut ARP frames have the SQL's size; the packets of a file are counted without the gaps of their numbers."""
    equal(spark, "packet_bytes_by_reference", copies(tmp_path, "events", "event_id", steps))


def test_quic_services_of_many_pages(spark, tmp_path):
    """Pages beyond 65535 have clients outside 10.0.0.0/16, which the SQL names by their number."""
    equal(spark, "quic_flow_services", copies(tmp_path, "pages", "page_id", [0, 65_500, 200_000]))
