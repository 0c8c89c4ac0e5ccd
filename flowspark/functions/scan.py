"""Running values over the ordered rows of groups, worked in blocks so that one group may span many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

BLOCK = "_block"


def in_blocks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows in ranges of (group, order), with the number of each row's range. A large group is cut into several ranges."""
    if BLOCK in rows.columns:
        return rows
    # Stored first, as ranges are made of a sample and then of the rows themselves.
    return stored(stored(rows, "rows").repartitionByRange(by, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def with_running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row of its group: sums over the rows before it, values of the row before it, and values of the group's first row.

    ``order`` puts a group's rows in one sequence, without ties. Inside a block windows do it; what
    a block starts with is carried over from the blocks before, of which a group has one row each.
    """
    sums, previous, first = sums or {}, previous or {}, first or {}
    cut = in_blocks(rows, by, order)
    at = F.struct(*order)
    whole = cut.groupBy(by, BLOCK).agg(
        *[F.sum(x).alias(f"_s_{n}") for n, x in sums.items()],
        *[F.max_by(F.struct(x.alias("v")), at).alias(f"_p_{n}") for n, x in previous.items()],
        *[F.min_by(F.struct(x.alias("v")), at).alias(f"_f_{n}") for n, x in first.items()],
    )
    blocks = Window.partitionBy(by).orderBy(BLOCK)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        by,
        BLOCK,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.lag(f"_p_{n}").over(blocks).alias(f"_p_{n}") for n in previous],
        *[F.first(f"_f_{n}").over(blocks).alias(f"_f_{n}") for n in first],
    )
    inside = Window.partitionBy(by, BLOCK).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns({**{f"_i_{n}": F.coalesce(F.sum(x).over(earlier), F.lit(0)) for n, x in sums.items()}, **{f"_i_{n}": F.lag(F.struct(x.alias("v"))).over(inside) for n, x in previous.items()}})
    joined = own.join(carried, [by, BLOCK])
    found = {n: F.col(f"_s_{n}") + F.col(f"_i_{n}") for n in sums}
    found |= {n: F.coalesce(f"_i_{n}", f"_p_{n}")["v"] for n in previous} | {n: F.col(f"_f_{n}")["v"] for n in first}
    made = [f"_{k}_{n}" for k, names in (("s", sums), ("i", [*sums, *previous]), ("p", previous), ("f", first)) for n in names]
    return joined.withColumns(found).drop(*made)
