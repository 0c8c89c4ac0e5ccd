"""Centroid clustering (k-means) in exact integers: distances by matrix products, sums by a tree over partitions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
BLOCK_ROWS = 4096
#: Integers below this are exact in float64, and so are sums and products that stay below it.
EXACT = 2.0**53
LONG_MAX = 2**63 - 1


def finite_vectors(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Rows whose vector has exactly ``dimensions`` components, none of them null, NaN or infinite (before or after scaling)."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float("inf")))
    return vectors.where((F.size(vector) == dimensions) & good)


def integer_blocks(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Vectors as blocks of up to 4096: ids, and floor(scale * x) of every component as bytes of the narrowest type.

    ``scale`` is a power of two, so the product and its floor are exact in float64.
    """

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                values = np.floor(scale * values) + 0.0  # no negative zero
                most = np.abs(values).max(initial=0.0)
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([values.astype(kind).tobytes()], pa.binary())], names=["ids", "kind", "components"])

    kept = finite_vectors(vectors, vector, dimensions, scale).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return kept.mapInArrow(pack, f"ids array<{dict(kept.dtypes)['id']}>, kind string, components binary")


def unpack(kind: str, components: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(components, kind).astype(np.float64).reshape(-1, dimensions)


class Centroids:
    """Centroids as integers of any size, with float64 copies for those that are exact in it."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.most = max((abs(v) for row in rows for v in row), default=0)
        self.floats = np.array(rows, np.float64) if self.most < EXACT else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance (int64, or Python integers if one is too large) of the nearest centroid of each row; ties go to the smaller number.

        |x|^2 - 2 x.c + |c|^2 by one matrix product. No term of a row whose components and the
        centroids' stay so small that d * (|x| + |c|)^2 < 2^53 can leave the exact integers of
        float64; the other rows are worked in integers of any size.
        """
        bound = x.shape[1] * (np.abs(x).max(axis=1, initial=0.0) + float(self.most)) ** 2
        inside = bound < EXACT if self.floats is not None else np.zeros(len(x), bool)
        number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if inside.all() else object)
        if inside.any():
            y, c = x[inside], self.floats
            found = (y * y).sum(axis=1)[:, None] - 2.0 * (y @ c.T) + (c * c).sum(axis=1)[None, :]
            number[inside] = found.argmin(axis=1)
            distance[inside] = found.min(axis=1).astype(np.int64)
        for i in np.flatnonzero(~inside):
            row = [int(v) for v in x[i]]
            found = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in self.rows]
            distance[i] = min(found)
            number[i] = found.index(distance[i])
        return number, distance

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each cluster: component sums, rows and summed distance, as integers of any size."""
        number, distance = self.nearest(x)
        k = len(self.rows)
        counts, inertia = np.bincount(number, minlength=k).astype(object), np.zeros(k, object)
        if len(x) * distance.max(initial=0) < EXACT:
            inertia += np.bincount(number, distance.astype(np.float64), k).astype(np.int64)
        else:
            np.add.at(inertia, number, distance.astype(object))
        if len(x) * np.abs(x).max(initial=0.0) < EXACT:
            member = np.zeros((k, len(x)))
            member[number, np.arange(len(x))] = 1.0
            total = (member @ x).astype(np.int64).astype(object)
        else:
            total = np.zeros((k, x.shape[1]), object)
            for n, row in zip(number, x, strict=True):
                total[n] += np.array([int(v) for v in row], object)
        return total, counts, inertia


def summed(blocks: DataFrame, centroids: Centroids, dimensions: int):
    """Component sums, counts and summed distances of every cluster over all blocks, added up in a tree of tasks."""
    k = len(centroids.rows)
    nothing = (np.zeros((k, dimensions), object), np.zeros(k, object), np.zeros(k, object))
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    return blocks.select("kind", "components").rdd.treeAggregate(nothing, lambda sums, row: add(sums, centroids.sums(unpack(row.kind, row.components, dimensions))), add)


def start_centroids(vectors: DataFrame, seed: int, k: int, vec_id: str, vector: str, dimensions: int, scale: int) -> Centroids:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``; equal ids by vector, null ids last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    first = finite_vectors(vectors, vector, dimensions, scale).select(hashed.alias("hash"), F.col(vector).cast("array<double>").alias("x")).orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()
    return Centroids([[int(np.floor(scale * v)) for v in row.x] for row in first])


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, scale: int = SCALE) -> DataFrame:
    """Lloyd's rounds over integer vectors; one row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another size, null ones and those with a null or non-finite component are left out.
    Repeated ids and repeated vectors are rows of their own; a null id is kept. Fewer vectors than
    ``k`` give as many clusters; no vector gives no row. Other columns are not read, so their names
    cannot clash. A distance or sum beyond a long is null. Each round reads the stored blocks and
    sends ``k`` sums per task, so the work grows with the vectors and what the driver gets does not.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vec_id]
    schema = f"{vec_id} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start_centroids(vectors, seed, k, vec_id, vector, dimensions, scale)
    if not centroids.rows:
        return spark.createDataFrame([], schema)
    blocks = materialize(integer_blocks(vectors, vec_id, vector, dimensions, scale), "vectors")
    for _ in range(rounds):
        total, counts, _ = summed(blocks, centroids, dimensions)
        moved = Centroids([[int(s) // int(n) for s in row] if n else old for row, n, old in zip(total, counts, centroids.rows, strict=True)])
        if moved.rows == centroids.rows:
            break  # further rounds change nothing
        centroids = moved
    inertia = [int(v) for v in summed(blocks, centroids, dimensions)[2]]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.rows]
    fits = lambda v: int(v) if v <= LONG_MAX else None

    def assign(batches):
        for batch in batches:
            for ids, kind, components in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                number, distance = centroids.nearest(unpack(kind, components, dimensions))
                own = pa.array(number)
                columns = [ids.values, pa.array(number, pa.int32()), pa.array(distance if distance.dtype != object else map(fits, distance), pa.int64())]
                columns += [pa.array(map(fits, inertia), pa.int64()).take(own), pa.array([fits(sum(inertia))] * len(number), pa.int64()), pa.array(digests).take(own)]
                yield pa.RecordBatch.from_arrays(columns, names=[vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    found = materialize(blocks.mapInArrow(assign, schema), "clusters")
    discard(blocks)
    return found


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
