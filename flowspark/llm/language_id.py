"""Language proportions of a document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 16
SEGMENT_CHARS = 48


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters or marks that belong to letters."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def trigram_buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of each character trigram of ``points`` with a space before and after; runs of anything but letters are one space."""
    padded = np.concatenate([[32], points, [32]]).astype(np.uint32)
    padded = np.where(letters()[np.minimum(padded, 0x10FFFF)], padded, np.uint32(32))
    padded = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    if len(padded) < 3:
        return np.zeros(0, np.int64)
    x = padded.astype(np.uint64)
    mixed = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1] * np.uint64(0x85EBCA77) + x[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


def is_held_out(doc_id):
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over every text with a language; counts are combined per task before the shuffle."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found += np.bincount(trigram_buckets(code_points(text)), minlength=BUCKETS) if len(text) > 20_000 else 0
                if len(text) <= 20_000:
                    np.add.at(found, trigram_buckets(code_points(text)), 1)
        for lang, found in totals.items():
            used = np.flatnonzero(found)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": found[used]})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInPandas(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, max_languages: int = 250) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their log-probabilities of each trigram bucket (0.5 added to each count).

    The model has 65536 numbers a language whatever the corpus holds, so it may go to the driver
    and to every task; more than ``max_languages`` languages are an error.
    """
    counts = materialize(ngram_counts(docs), "language-counts")
    rows = counts.limit(max_languages * BUCKETS + 1).toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table = np.zeros((max(1, len(langs)), BUCKETS))
    table[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    table += 0.5
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(loglik: np.ndarray, chosen: np.ndarray, of: np.ndarray, docs: int, steps: int, gain: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions (docs x languages) and log-likelihoods.

    loglik: segments x languages; of: each segment's document; chosen: docs x languages, the
    languages that a document may use. It ends when a step gains no document more than ``gain`` of
    log-likelihood, or after ``steps``.
    """
    share = chosen / np.maximum(chosen.sum(1, keepdims=True), 1)
    sizes = np.maximum(np.bincount(of, minlength=docs), 1)[:, None]
    top = loglik.max(1, keepdims=True)
    raised = np.exp(np.maximum(loglik - top, -700))
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
    total = np.zeros(docs)
    for step in range(steps):
        weighted = raised * share[of]
        sums = np.maximum(weighted.sum(1, keepdims=True), 1e-300)
        new = np.zeros_like(share)
        before, total = total, np.zeros(docs)
        if len(of):
            new[of[starts]] = np.add.reduceat(weighted / sums, starts)
            total[of[starts]] = np.add.reduceat(np.log(sums[:, 0]) + top[:, 0], starts)
        share = new / sizes
        if step and (total - before).max(initial=0.0) < gain:
            break
    return share, total


def infer(texts: list[str | None], langs: list[str], table: np.ndarray, steps: int = 1000, penalty: float = 1.0, most: int | None = None, segment: int = SEGMENT_CHARS, slice_cells: int = 4_000_000) -> list[tuple[str, float, str]]:
    """(language, its proportion, all proportions as text) for each text.

    A text is cut into runs of ``segment`` trigrams. For k = 1, 2, ... the k languages that a full
    mixture favours are fitted again; the k with the least Bayesian information criterion
    (penalty x (2k - 1) / 2 x log segments - log-likelihood) gives the proportions. k goes up to the
    number of languages with a share in the full mixture; it stops earlier, without loss, where the
    penalty alone is too high even if each segment had its best language to itself. ``most`` bounds k;
    ``slice_cells`` bounds the n-grams x languages that are held at a time.
    """
    n, k = len(texts), len(langs)
    grams = [trigram_buckets(code_points(x)) if x and any(map(str.isalpha, x)) else np.zeros(0, np.int64) for x in texts]
    pieces = np.array([-(-len(g) // segment) for g in grams])
    lettered = pieces > 0
    if not k or not lettered.any():
        return [("und", 0.0, "")] * n
    lengths = np.array([len(g) for g in grams])
    starts = np.concatenate([np.arange(0, m, segment) + at for m, at in zip(lengths, np.cumsum(lengths) - lengths, strict=True)]).astype(int)
    flat, runs = np.concatenate(grams), max(1, slice_cells // (k * segment))
    ends = np.append(starts[1:], len(flat))
    # A slice of runs at a time: memory depends on runs x languages, not on n-grams x languages.
    parts = [np.add.reduceat(table[:, flat[starts[at] : ends[min(at + runs, len(starts)) - 1]]].astype(np.float64), starts[at : at + runs] - starts[at], axis=1).T for at in range(0, len(starts), runs)]
    loglik = np.concatenate(parts)
    of = np.repeat(np.arange(n), pieces)
    share, _ = mixture(loglik, np.ones((n, k)), of, n, steps)
    order = np.argsort(-share, axis=1, kind="stable")
    best, least = share.copy(), np.full(n, np.inf)
    ceiling = np.bincount(of, loglik.max(1), n)
    shared = (share > 0).sum(1)
    for size in range(1, min(k if most is None else most, k) + 1):
        fee = penalty * (2 * size - 1) / 2 * np.log(np.maximum(pieces, 2))
        open_ = lettered & (size <= np.maximum(shared, 1)) & (fee - ceiling < least)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        chosen = np.zeros((len(at), k))
        np.put_along_axis(chosen, order[at, :size], 1.0, axis=1)
        mine = open_[of]
        again, total = mixture(loglik[mine], chosen, (np.cumsum(open_) - 1)[of[mine]], len(at), steps if size > 1 else 1)
        cost = fee[at] - total
        better = cost < least[at]
        best[at[better]], least[at[better]] = again[better], cost[better]
    out = []
    for row, has in zip(best, lettered, strict=True):
        first = int(np.argmax(row))
        out.append((langs[first], min(1.0, float(row[first])), ",".join(f"{langs[i]}:{row[i]:.3f}" for i in np.flatnonzero(row > 0.0005))) if has else ("und", 0.0, ""))
    return out


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], batch_docs: int = 64) -> DataFrame:
    """doc_id, lang_pred, score and proportions for every row of ``docs``.

    Null text or text without a letter: ``und`` and 0. The most likely language wins; ties go to
    the first in sorted order. Repeated rows are predicted alike; an empty table or a model of no
    languages gives no rows or ``und``. Only doc_id and text are read.
    """
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def predict(batches):
        for batch in batches:
            for at in range(0, len(batch), batch_docs):
                part = batch.iloc[at : at + batch_docs]
                found = infer([x if isinstance(x, str) else None for x in part["text"]], langs, shared.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "proportions": [x[2] for x in found]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(predict, f"doc_id {kind}, lang_pred string, score double, proportions string")


def op7_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(~is_held_out(F.col("doc_id"))))
    found = identify_languages(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "proportions")
