"""Nulls anywhere, repeated rows and ids, string ids, names that clash, long texts and empty tables, for each operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import language_id, licenses, mixing, near_duplicates, packing, quality, sanitise, sharding, url_filter, webp
from flowspark.llm.common import discard, free_name, materialize

from .test_operators import brute_components

WORDS = "the river runs past the old mill and the town where many people live and work every day of the year"
CLASHING = {"key": "k", "row": "r", "rank": "n", "bucket": "b", "rate": "x", "tokens": "t", "tier": "i", "terms": "m", "_row": "u", "rest": "v", "kept": "w", "rep": "p"}
ROWS = [
    ("a", f"{WORDS} {WORDS} with more"), ("a", f"{WORDS} {WORDS} with more"), ("b", None), (None, f"{WORDS} {WORDS} with more"), (None, None), ("c", ""), ("d", " \n\t"),
    ("e", "short"), ("e", f"{WORDS} and another text of the same id mail x@y.example.com"), ("f", "w " * 200_000), ("g", "x" * 1_000_000), ("h", f"{WORDS} {WORDS} with less"), ("", "10.1.1.1 \U0001f600"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(i, t, "en" if n % 2 else None, None if n % 3 else "s", None) for n, (i, t) in enumerate(ROWS)], "doc_id string, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.lit(v).alias(c) for c, v in CLASHING.items()])


def kept_columns(frame, names):
    row = frame.first()
    return all(row[c] == CLASHING[c] for c in names)


def test_quality(docs):
    references = quality.language_references(docs)
    found = quality.judge_quality(docs, references)
    assert found.count() == len(ROWS) and kept_columns(found, [c for c in CLASHING if c != "kept"])
    assert quality.judge_quality(docs.where("false"), references).count() == 0
    assert quality.judge_quality(docs, references.where("false")).count() == len(ROWS)




def test_packing(docs):
    found = packing.pack(packing.tokenize(docs, packing.default_tokenizer()).withColumn("rank", F.lit("mine")))
    assert found.where("rank = 'mine'").count() == found.count()
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("tier").alias("t")).where("n > t").count() == 0
    assert found.where("start = 0").count() == len(ROWS)


def test_near_duplicates(docs):
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    largest: dict = {}
    for i, t in ROWS:
        if i is not None and len(set((t or "").split())) >= len(set((largest.get(i) or "").split())):
            largest[i] = t
    wanted = brute_components(largest)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id]


def test_sanitise(docs):
    found = sanitise.sanitise(docs)
    assert found.count() == len(ROWS) and kept_columns(found, CLASHING)
    few = sanitise.sanitise(docs, broadcast_terms=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, found.collect()))
    assert sanitise.sanitise(docs.where("text is null")).where("clean_text is null and base_spans = ''").count() == 2


def test_mixing(spark, docs):
    labels = spark.createDataFrame([("a", 1, 0), ("e", 0, 0), ("e", 0, 0), (None, 1, 1), ("zz", None, 0)], "doc_id string, quality int, toxic int")
    found = mixing.mix(docs, labels, carry=True)
    assert found.count() == len(ROWS) and found.where("rate is null or copies is null").count() == 0
    assert kept_columns(found.select("rest.*"), CLASHING)


def test_languages_shards_media_licences_and_urls(spark, docs):
    model = language_id.fit_languages(docs)
    assert language_id.identify_languages(docs, model).count() == len(ROWS)
    shards = sharding.interleave_shards(docs).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == len(ROWS) and max(r["count"] for r in shards) <= 2
    assert sharding.interleave_shards(docs, carry=("rank", "kept")).where("rank = 'n' and kept = 'w'").count() == len(ROWS)
    media = webp.decode_media(webp.encode_media(docs))
    assert media.where("pixels is not null").count() == len(ROWS)
    assert licenses.scan_licenses(docs, licenses.default_model()).where("n_notices = 0").count() == len(ROWS)
    pages = spark.createDataFrame([(None, None, 1), (1, "https://example.com/" + "a" * 100_000, 2), (1, "x", 3)], "page_id long, url string, host int")
    assert url_filter.filter_urls(pages, url_filter.fit_url_model(url_filter.labelled_urls())).where("verdict is not null").count() == 3


def test_stages_on_nulls_and_on_an_empty_table(spark):
    rows = [(n, t, "en" if n % 2 else None, None, None) for n, (_, t) in enumerate(ROWS) if len(t or "") < 10_000] + [(None, WORDS, None, None, None), (0, f"{WORDS} {WORDS} with more", "en", "s", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (table, table.where("false")):
            found = materialize(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
            assert name == "packing" or found.columns == docs.columns
            assert found.count() == 0 if docs is not table else found.count() > 0
    single = corpus_pipeline.dedup_stage(spark, table, "/root/testdata/sf0.001")
    assert single.where("doc_id = 0").count() == 1 and single.where("doc_id is null").count() == 1


def test_helpers(spark):
    assert free_name("key", ["KEY", "_key"]) == "__key"
    table = materialize(spark.range(3), "gone")
    discard(table)
    with pytest.raises(Exception, match="(?i)exist|found"):
        table.count()
