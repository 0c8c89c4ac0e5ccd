"""The pipeline's stages, each held against what a plain reading of its input gives."""

import re

import corpus_pipeline
from flowspark.llm import sanitise
from flowspark.llm.common import materialize

from .test_operators import brute_components, words

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        results.append(docs.toPandas())
        assert name == "packing" or docs.columns == columns
    raw, good, single, clean, mixed, packed = results
    assert all(len(words(t)) >= 20 for t in good.text) and set(good.doc_id) < set(raw.doc_id)
    groups = brute_components(dict(zip(good.doc_id, good.text, strict=True)))
    assert set(single.doc_id) == {root for _, root in groups.values()}
    assert set(clean.doc_id) == set(single.doc_id)
    assert not any(sanitise.base_spans(re.sub(r"\[[A-Z]+\]", "|", t)) for t in clean.text)
    assert (clean.n_chars == clean.text.str.len()).all()
    assert set(mixed.doc_id) <= set(clean.doc_id)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    wanted = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id) & set(clean.doc_id)
    assert len(wanted & set(mixed.doc_id)) >= 0.97 * len(wanted)
    assert packed.groupby("doc_id")["length"].sum().eq(packed.groupby("doc_id").doc_tokens.first()).all()
    assert set(packed.doc_id) == set(mixed.doc_id)
