"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import broadcast_if_small, materialize
from flowspark.llm.mixing import mix
from flowspark.llm.near_duplicates import near_duplicates
from flowspark.llm.packing import default_tokenizer, pack_documents
from flowspark.llm.quality import judge_quality, language_references
from flowspark.llm.sanitise import sanitise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    references = materialize(language_references(docs), "language-references")
    return judge_quality(docs, references).where("kept").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows with one doc_id the one of the greatest text. Rows without doc_id stay."""
    found = materialize(near_duplicates(docs).select("doc_id", "kept"), "groups")
    dropped = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    single = docs.join(broadcast_if_small(materialize(dropped, "dropped"), 200_000), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return single
    once = single.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*single.columns), F.coalesce("text", F.lit(""))).alias("_row"))
    return single.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("_row.*"))


def sanitise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and disclosing terms replaced; n_chars follows the text."""
    found = sanitise(docs)
    changed = {"text": F.col("clean_text"), "n_chars": F.coalesce(F.length("clean_text"), F.lit(0)).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rates say: with rates of 1 at most, once or not at all.

    Columns travel with the rates, so no text is shuffled; a null doc_id is drawn as ''.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = mix(docs, labels, max_rate=1.0, carry=True).where("copies >= 1")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("personal data", sanitise_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Several stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
