"""Centroid clustering by ball k-means, in exact integers.

A cluster is a ball: its centroid and a radius that no member exceeds. In a round each centroid moves to the floored mean of its
members. Its neighbours are then the centroids less than two radii away; the ball's members nearer to it than half the way to its first
neighbour are the stable core and stay. The others lie in annuli between the half ways to one neighbour and to the next: a member
of an annulus is compared exactly with the neighbours up to it and with no others, for by the triangle inequality those are farther away.

A round reads the vectors with their clusters twice: once for sums, of which a row per cluster leaves each task, and once to assign them, which writes
them again. Nothing is shuffled but those rows, and only k centroids reach the driver. The radius after a move is the largest distance
before it plus the way of the move, so it costs no pass.

Components are floor(scale * x), x as double, held to +-2^30 / sqrt(dims) so that squared distances fit a long. Vectors that are null, of another length, or hold
null or non-finite components take no part. Distances that tie go to the smaller number. A table with fewer than k vectors has a cluster for each;
an empty one gives no rows. Null ids and repeated ids are vectors like others; null ids come last among the starting centroids. Other columns, also of
names used here, play no part. In random vectors of 64 dimensions few neighbours can be left out; the balls pay on clustered ones (a test counts it).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import dropped, scratch

SCALE, DIMS, K, ROUNDS, SEED = 256, 64, 40, 5, 2


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, q: the vectors that take part."""
    bound = math.isqrt((1 << 60) // dims)
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    value = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * F.least(F.greatest(x.cast("double"), F.lit(-1e15)), F.lit(1e15))), F.lit(bound)), F.lit(-bound))
    return vectors.where((F.size(v) == dims) & ~bad).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda x: value(x).cast("int")).alias("q"))


class Balls:
    """Centroids, and of each its neighbours by distance: those that lie within twice its radius."""

    def __init__(self, centroids: np.ndarray, radii: list[float] | None = None):
        self.centroids = centroids
        self.neighbours: list[tuple[np.ndarray, np.ndarray]] = []
        if radii is not None:
            between = distances(centroids, centroids)
            for i, r in enumerate(radii):
                reach = min(4.0 * r * r * (1 + 1e-9) + 1, 2.0**62)
                near = np.array([j for j in np.argsort(between[i], kind="stable") if j != i and between[i, j] <= reach], dtype=np.int64)
                self.neighbours.append((near, between[i, near]))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact: doubles while all sums stay below 2^53."""
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def assign(q: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of rows that stood in these clusters; -1 is none yet."""
    out, best, work = cluster.copy(), np.zeros(len(q), dtype=np.int64), 0
    new = np.flatnonzero(cluster < 0)
    if len(new):
        d = distances(q[new], balls.centroids)
        out[new] = d.argmin(axis=1)  # the first of equal ones
        best[new], work = d.min(axis=1), d.size
    for i in np.unique(cluster[cluster >= 0]):
        rows = np.flatnonzero(cluster == i)
        own = distances(q[rows], balls.centroids[i : i + 1])[:, 0]
        best[rows], work = own, work + len(rows)
        near, between = balls.neighbours[i]
        annulus = np.searchsorted(between, 4 * own, side="right")  # as many neighbours may be as near; 0 is the stable core
        for a in np.unique(annulus[annulus > 0]):
            members = np.flatnonzero(annulus == a)
            numbers = np.sort(np.append(near[:a], i))
            d = distances(q[rows[members]], balls.centroids[numbers])
            out[rows[members]], best[rows[members]] = numbers[d.argmin(axis=1)], d.min(axis=1)
            work += len(members) * int(a)
    return out, best, work


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(vectors: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """vec_id, q, cluster, distance after a round, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = assign(_matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), balls)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "q", "cluster", "distance"])

    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, q array<int>, cluster int, distance long"
    return scratch(vectors.select("vec_id", "q", "cluster").mapInArrow(run, kind), "clusters")


def _means(vectors: DataFrame, old: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """The next centroids and radii: floored means of the members; a cluster without members keeps its own, with radius 0."""
    k, dims = old.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, far = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            q = _matrix(batch.column(1), dims)
            for i in np.unique(cluster):
                total[i] += q[cluster == i].sum(axis=0)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(far, cluster, batch.column(2).to_numpy())
        there = np.flatnonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * dims, pa.int32()), pa.array(total[there].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(far[there]), flat], ["cluster", "count", "far", "total"])

    partial = vectors.select("cluster", "q", "distance").mapInArrow(sums, "cluster int, count long, far long, total array<long>")
    each = partial.select("cluster", "count", "far", F.posexplode("total").alias("i", "x"))
    rows = each.groupBy("cluster", "i").agg(F.sum("count").alias("count"), F.max("far").alias("far"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k times dims
    new, radii = old.copy(), [0.0] * k
    for r in rows:
        new[r["cluster"], r["i"]] = int(r["x"]) // r["count"]
        radii[r["cluster"]] = math.sqrt(r["far"])
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    return new, [float(r + m) for r, m in zip(radii, moved, strict=True)]


def ball_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, distance of every vector; the centroids). Starts from the k vectors with the least SHA-256 of `seed:id`."""
    taking = integers(vectors, id_col, vector_col, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = taking.orderBy(key.asc_nulls_last(), "q").limit(k).collect()  # k rows
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dims)
    table = _assigned(taking.withColumn("cluster", F.lit(-1)), Balls(centroids), dims)
    for _ in range(rounds if first else 0):
        centroids, radii = _means(table, centroids)
        before, table = table, _assigned(table, Balls(centroids, radii), dims)
        dropped(before)
    return table, centroids


def clusters(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the centroid of every vector; sums that don't fit a long are null."""
    table, centroids = ball_means(vectors, **parameters)
    spark = vectors.sparkSession
    shas = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    inertia = table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    whole = sum(int(r["own"]) for r in inertia)
    fits = lambda x: x if x < 1 << 63 else None
    sums = spark.createDataFrame([(r["cluster"], fits(int(r["own"])), fits(whole)) for r in inertia], "cluster int, cluster_inertia long, inertia long")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(sums), "cluster").join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
