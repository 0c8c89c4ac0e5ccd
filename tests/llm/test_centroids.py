"""Centroid clustering against a plain version in Python integers, with vectors of any magnitude."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from flowspark.llm import centroids
from flowspark.llm.oracles import oracle_sql

from ..compare import as_rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def brute(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v in kept]
    of = {n: sum(d for _, d, m in found if m == n) for n in range(k)}
    limit = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, n, limit(d), limit(of[n]), limit(sum(of.values())), digest[n]) for i, d, n in found]


def vectors(n, scale, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.choice((-1, 1)), 0.5) * scale for _ in range(64)]) for i in range(n)]


def run(spark, rows, **settings):
    table = spark.createDataFrame([(i, v, "mine", 7) for i, v in rows], SCHEMA)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in centroids.cluster_vectors(table, **settings).collect()), key=key), sorted(brute(rows), key=key)


@pytest.mark.parametrize("scale", [1.0, 3e4, 3e30])
def test_equals_plain_integers(spark, scale):
    rows = vectors(60, scale, 5)
    found, wanted = run(spark, rows)
    assert found == wanted


def test_magnitudes_are_mixed_inside_a_block(spark):
    rows = vectors(40, 1.0, 6) + [(100 + i, v) for i, v in vectors(5, 1e20, 7)]
    found, wanted = run(spark, rows)
    assert found == wanted


def test_odd_rows(spark):
    good = vectors(12, 1.0, 8)
    odd = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [float("inf")] * 64), (1005, [None] + [1.0] * 63), (None, [0.25] * 64), (3, good[3][1]), (3, [2.0] * 64), (1006, [-0.0] * 64)]
    found, wanted = run(spark, good + odd)
    assert found == wanted and len(found) == 16
    same, plain = run(spark, [(i, [0.5] * 64) for i in range(20)])
    assert same == plain and {r[1] for r in same} == {0}
    few, plain = run(spark, good[:3])
    assert few == plain and len({r[1] for r in few}) == 3
    none, _ = run(spark, [])
    assert none == []


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = vectors(50, 1.0, 9)
    whole, _ = run(spark, rows)
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    assert run(spark, rows)[0] == whole


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert as_rows(centroids.op11_centroid_clustering(spark, folder).toPandas()) == as_rows(sql_rows(oracle_sql()["op11_centroid_clustering"], folder))
