"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranked

KEY_BITS, PARTS = 60, 64


def shuffle_key(seed: str, column):
    """60 bits of md5 over seed and key: the seeded shuffle's order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def interleave_shards(docs: DataFrame, n_shards: int = 8, seed: str = "mix-1", carry: tuple[str, ...] = ()) -> DataFrame:
    """Give each row a shard and a slot so that every shard has the mixture of all sources.

    Rows of a source are ranked in a seeded shuffle; (rank - 0.5) / rows of the source orders
    all rows, and the sequence is cut into ``n_shards`` runs whose row counts are at most one
    apart (law ``rows``). Ranks come from two sorts in sampled ranges and the ranges' counts; equal
    rows are told apart by a number of their own, so neither a hot source, nor a hot doc_id, nor
    many sources of one row (which share one rank) are ever sorted in one task.

    Null source counts as the source ''; null text has size 1 and crc 0; null doc_id hashes as
    ''. Repeated rows take neighbouring ranks; ties in every key are between equal rows. An
    empty table gives an empty result. Only doc_id, text and source are read, so other columns
    cannot clash; ``carry`` names further input columns to take along.
    """
    own = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce("source", F.lit("")).alias("_source"),
        shuffle_key(seed, F.col("doc_id")).alias("_key"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    # Rows that are equal in all keys may change places: a number of their own spreads them over ranges.
    own = materialize(own.withColumn("_salt", F.monotonically_increasing_id()), "shard-keys")
    ties = ["_key", "doc_id", "text_crc32", "size", "_salt"]
    total = own.count()
    by_source = ranked(own, ["_source", *ties], "_n")
    # One row a source, for each of 64 parts of its rows: a source with many rows is joined in as many tasks.
    first = by_source.groupBy("_source").agg(F.min("_n").alias("_first"), F.count("*").alias("_of_source"))
    first = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    by_source = by_source.withColumn("_part", (F.col("_salt") % PARTS).cast("int"))
    share = (F.col("_n") - F.col("_first") + F.lit(0.5)) / F.col("_of_source")
    shared = by_source.join(first, ["_source", "_part"]).withColumn("_share", share).drop("_n", "_first", "_of_source", "_part")
    placed = ranked(shared, ["_share", "_source", *ties], "_position")
    shard = F.expr(f"(_position * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_position") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry_{c}").alias(f"{c}_carried" if c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard") else c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: str = "mix-1", chunk_rows: int = 50_000) -> None:
    """Write texts as one folder per shard, in slot order inside chunks of ``chunk_rows`` slots."""
    out = interleave_shards(docs, n_shards, seed, carry=("text", "source"))
    out = out.withColumn("chunk", F.expr(f"slot div {chunk_rows}"))
    out.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "slot").write.partitionBy("shard", "chunk").parquet(path)


def op9_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    return interleave_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
