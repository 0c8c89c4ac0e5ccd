"""Mixing to target weights: domain posteriors from labels, document rates by projected gradient."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, worker_memory

#: Domains of the labelled table: toxic whatever its quality, low quality, and clean.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}
BUCKETS = 1 << 15
SHAPES = 6
LETTERS = re.compile(r"[^\W\d_]+")
MARKS = b"#*$%&|<>!"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Buckets(dict):
    """Buckets of the letter runs of a token, remembered for up to ``limit`` tokens."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[token] = tuple({zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in LETTERS.findall(token)})
        return found


def token_buckets() -> Buckets:
    return worker_memory(("buckets",), Buckets)


def features(text: str | None) -> tuple[int, list[int], list[float]]:
    """Number of words, distinct word buckets in order, and shape measures of the whole text."""
    text, buckets = text or "", token_buckets()
    words = text.lower().split()
    distinct, n = set(words), max(1, len(words))
    at = sorted({b for w in distinct for b in buckets[w]})
    data = text.encode("utf-8", "surrogatepass")
    length = max(1, len(data))
    marks, capitals = ((len(data) - len(data.translate(None, x))) / length for x in (MARKS, CAPITALS))
    return len(words), at, [10 * min(marks, 0.2), 2 * capitals, 1 - len(distinct) / n, float(np.log1p(len(words))) / 10, data.count(b"|") / n, data.count(b"!!") / n]


def feature_rows(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with at (word buckets) and shapes."""
    keep = [c for c in docs.columns if c != "text"]

    def compute(batches):
        for batch in slices(batches):
            found = [features(x) for x in batch.column("text").to_pylist()]
            new = [pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *new], names=[*keep, "at", "shapes"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(compute, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", at array<long>, shapes array<double>")


def posteriors_of(found: list, model) -> np.ndarray:
    """Posteriors of each text's ``features``, in thousandths that sum to 1000."""
    words, shape_weights, bias = model
    z = np.tile(bias, (len(found), 1)) + np.array([f[2] for f in found]).reshape(-1, SHAPES) @ shape_weights
    sizes = np.array([len(f[1]) for f in found])
    used = np.flatnonzero(sizes)
    if len(used):
        flat = np.concatenate([np.array(found[i][1], np.int64) for i in used])
        z[used] += np.add.reduceat(words[flat].astype(np.float64), np.cumsum(sizes[used]) - sizes[used])
    p = np.exp(z - z.max(1, keepdims=True))
    p = np.floor(1000 * p / p.sum(1, keepdims=True) + 0.5).astype(np.int64)
    best = p.argmax(1)
    p[np.arange(len(p)), best] += 1000 - p.sum(1)
    return p


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, steps: int = 150, ridge: float = 2e-4):
    """Multinomial logistic regression on the words and shape of at most ``max_rows`` labelled documents.

    The rows are those of least md5 of doc_id, so the sample is the same however the table is
    stored. Of repeated labels the worse count, of repeated documents the greatest text. Rows with a
    null label are left out; with no labelled row all domains are as likely.
    """
    usable = labels.where("quality is not null and toxic is not null and doc_id is not null")
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("y")
    sample = usable.select("doc_id", domain).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    sampled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    rows = feature_rows(sampled).toPandas().sort_values("doc_id", kind="stable")
    k = len(DOMAINS)
    words, shape_weights, bias = np.zeros((BUCKETS, k)), np.zeros((SHAPES, k)), np.zeros(k)
    if not len(rows):
        return words, shape_weights, bias
    y = np.eye(k)[rows["y"].to_numpy(int)]
    shapes = np.stack(rows["shapes"].to_list())
    lengths = np.array([len(a) for a in rows["at"]])
    at, of = np.concatenate(rows["at"].to_list()).astype(int), np.repeat(np.arange(len(rows)), lengths)
    squares = [np.full_like(w, 1e-8) for w in (words, shape_weights, bias)]
    for _ in range(steps):
        z = bias + shapes @ shape_weights + np.stack([np.bincount(of, words[at, c], len(rows)) for c in range(k)], 1)
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - y) / len(rows)
        by_word = np.stack([np.bincount(at, error[of, c], BUCKETS) for c in range(k)], 1)
        for w, g, s in zip((words, shape_weights, bias), (by_word + ridge * words, shapes.T @ error, error.sum(0)), squares, strict=True):
            s += g * g
            w -= 0.3 * g / np.sqrt(s)
    return words.astype(np.float32), shape_weights, bias


def domain_posteriors(docs: DataFrame, model) -> DataFrame:
    """Adds tokens (words of the whole text) and a posterior p_<domain>, in thousandths of 1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, added = docs.columns, ["tokens", *[f"p_{d}" for d in DOMAINS]]
    schema = ", ".join([f"`{c}` {k}" for c, k in docs.dtypes] + ["tokens long", *[f"p_{d} double" for d in DOMAINS]])

    def score(batches):
        for batch in slices(batches):
            found = [features(x) for x in batch.column("text").to_pylist()]
            p = posteriors_of(found, shared.value) / 1000
            new = [pa.array([f[0] for f in found], pa.int64()), *[pa.array(p[:, i]) for i in range(len(DOMAINS))]]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *new], names=[*keep, *added])

    return docs.mapInArrow(score, schema)


def fit_rates(posteriors: DataFrame, targets: dict[str, float], max_rate: float | None = None, tolerance: float = 1e-3, most_steps: int = 400, stored_every: int = 4) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(p_<domain>, rate) for each posterior that occurs, target totals and achieved totals, by domain.

    Projected-gradient least squares for rates r >= 0 with sum of r x tokens x posterior = T. With
    c the totals at rate 1 the objective is sum (A r - T)^2 / c; in the norm that weighs documents
    by tokens its gradient at a document is sum of posterior x (A r - T) / c. So the rate depends
    on the posterior alone, a step of 1 always descends, and rows are summed by posterior once: at
    most 501,501 rows, as posteriors are thousandths. Each step is one aggregation of that table,
    which brings a few numbers a domain to the driver; steps carry momentum (Beck and Teboulle 2009),
    which is dropped when the objective rises.

    Without ``max_rate``, T are the target weights times all tokens, and steps go on until each
    total is within ``tolerance`` of its target; ValueError if no rates give that, as for a domain
    without tokens. With it, rates stay in [0, max_rate]; at 1 at most, the domain of the largest
    weight keeps all its tokens, the others get their weight relative to it, or all they have if
    that is less; steps go on until they move less than ``tolerance`` / 10 of the tokens. More than
    ``most_steps`` steps are an error. With no tokens all rates stay 1.
    """
    columns = [f"p_{d}" for d in DOMAINS]
    weights = np.array([max(0.0, targets[d]) for d in DOMAINS])
    weights = weights / weights.sum()
    groups = materialize(posteriors.groupBy(*columns).agg(F.sum("tokens").alias("tokens")), "posterior-groups")
    state = groups.withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)})

    def measure(ahead: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals at the rates and at those ahead of them, and the share of tokens that the last step moved."""
        moved = F.sum(F.col("tokens") * F.abs(F.col("rate") - F.col("before"))) / F.sum("tokens")
        sums = [F.sum(F.col("tokens") * F.col(p) * rate) for rate in (F.col("rate"), ahead) for p in columns]
        row = [float(x or 0.0) for x in state.agg(*sums, moved).first()]
        return np.array(row[: len(columns)]), np.array(row[len(columns) : -1]), row[-1]

    now, _, _ = measure(F.col("rate"))
    current, main = np.maximum(now, 1e-9), int(weights.argmax())
    aim = weights * now.sum()
    if max_rate is not None and max_rate <= 1:
        aim = np.minimum(weights * (now[main] / weights[main]), now)
    momentum, last = 1.0, np.inf
    for step in range(most_steps + 1):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = F.col("rate") + F.lit(float((momentum - 1) / following)) * (F.col("rate") - F.col("before"))
        now, then, moved = measure(ahead)
        if (np.abs(now - aim) <= tolerance * aim).all() or (step and moved <= tolerance / (10 if max_rate is not None else 1e6)):
            break
        if step == most_steps:
            raise ValueError(f"rates have not settled after {most_steps} steps")
        objective = float(((now - aim) ** 2 / current).sum())
        if objective > last:  # start again from here
            ahead, then, following = F.col("rate"), now, 1.0
        momentum, last = following, objective
        slope = sum((F.col(p) * F.lit(float(e)) for p, e in zip(columns, (then - aim) / current, strict=True)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), ahead - slope)
        state = state.select(*columns, "tokens", (rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)).alias("rate"), F.col("rate").alias("before"))
        if step % stored_every == stored_every - 1:
            state = materialize(state, "rates")
    if max_rate is None and not (np.abs(now - aim) <= tolerance * np.maximum(aim, 1e-9)).all():
        raise ValueError(f"no rates give the target totals {dict(zip(DOMAINS, aim.round(1).tolist(), strict=True))}; reached {dict(zip(DOMAINS, now.round(1).tolist(), strict=True))}")
    return materialize(state.select(*columns, "rate"), "rates"), aim, now


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from md5 of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float | None = 1.0, seed: str = "mix-1", carry: bool = False) -> DataFrame:
    """doc_id, tokens, p_<domain>, target_<domain>, achieved_<domain>, rate and copies for every row of ``docs``.

    target and achieved are the totals of tokens that the rates aim at and give (``fit_rates``);
    with ``max_rate`` None they are equal within its tolerance, or ValueError is raised. copies is
    the rate rounded up or down by a hash of doc_id, with the rate as its expectation. Null or
    empty text has no tokens and the posterior of the bias; a null doc_id hashes as ''; repeated
    rows get one rate; an empty table gives no rows. Only doc_id and text are read; with ``carry``
    text and a struct ``rest`` of all other columns are added.
    """
    model = fit_domains(docs, labels)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *([F.struct(*others).alias("rest")] if carry and others else []))
    found = domain_posteriors(own, model)
    found = materialize(found if carry else found.drop("text"), "posteriors")
    rates, aim, now = fit_rates(found, TARGETS if targets is None else targets, max_rate)
    told = [F.lit(float(v)).alias(f"{kind}_{d}") for kind, totals in (("target", aim), ("achieved", now)) for d, v in zip(DOMAINS, totals, strict=True)]
    rated = found.join(F.broadcast(rates), [f"p_{d}" for d in DOMAINS], "left")
    columns = ["doc_id", "tokens", *[f"p_{d}" for d in DOMAINS]]
    rated = rated.select(*columns, *told, F.round("rate", 6).alias("rate"), *[c for c in own.columns[1:] if carry])
    return rated.withColumn("copies", F.floor(F.col("rate") + uniform(F.col("doc_id"), seed)).cast("int"))


def op6_soft_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rate=None)
