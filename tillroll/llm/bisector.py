"""Centroid clustering of integer vectors by a tournament of bisecting hyperplanes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: Largest size of a scaled component: with it a squared distance of up to 128 components fits a long.
LARGEST = 1 << 27
#: Vectors compared at a time.
BLOCK_ROWS = 4096


class Tournament:
    """Nearest of ``k`` integer centroids by k-1 sign tests a vector.

    For centroids a < b, ``2 x.(b-a) - (|b|^2 - |a|^2)`` is |x-a|^2 - |x-b|^2:
    above zero b is nearer, and zero keeps a, the smaller number. Normals and
    thresholds of all pairs are made once; the numbers are taken in
    ascending order, so that whoever leads always has the smaller number.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        leader = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[leader, challenger]) - self.thresholds[leader, challenger]
            leader[side > 0] = challenger
        return leader

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[cluster]
        return np.einsum("ij,ij->i", gap, gap)


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns ``id`` and ``v``: the vectors of exactly ``dims`` finite components, as floor(scale * component)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where((F.size("x") == dims) & finite)
    large = F.exists("x", lambda c: F.abs(c * scale) >= LARGEST)
    error = F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}: squared distances would not fit a long"))
    return rows.select("id", F.when(large, error.cast("array<int>")).otherwise(
        F.transform("x", lambda c: F.floor(c * scale).cast("int"))).alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors become integers floor(scale * component). The first centroids are
    the ``k`` vectors of smallest SHA-256 of ``1:<id>``. Each round assigns
    every vector to its nearest centroid (squared Euclidean distance, ties to
    the smaller number) by ``Tournament`` and moves every centroid that has
    vectors to the componentwise floor of their mean; then all are assigned once more.

    Only the centroids (k x dims numbers) pass through the driver: a task
    returns one partial sum per cluster, so a cluster of any share of the
    vectors, or one vector repeated, costs no more than any other.

    Nulls and others: a null vector, one with a null, NaN or infinite
    component, or of another length is left out; a null id counts as the
    empty text and is kept. Rows that repeat an id or a vector are vectors of
    their own; among equal ids the smaller vector comes first as a start.
    With fewer than ``k`` vectors all of them are starts, with none the
    result is empty. A component of 2^27 / scale or more raises an error, as
    its squared distances would not fit a long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = stored(integer_vectors(vectors, dims, scale, id_col, vec_col), "bisector-vectors")
    start = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k)
    centroids = np.array([r["v"] for r in start.collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids)
    assigned = stored(kept.mapInArrow(_assign(centroids), f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"),
                      "bisector-clusters")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = sum(int(r["s"]) for r in totals)
    sums = spark.createDataFrame(
        [(r["cluster"], int(r["s"]), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
         for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sums), "cluster").select(  # at most k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors."""
    partial = kept.mapInArrow(_sums(centroids), "cluster int, n long, s array<long>")
    rows = (partial.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
    moved = centroids.copy()
    for r in rows:
        moved[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return moved


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids) if len(centroids) else None
        for part, x in _blocks(batches, centroids.shape[1]):
            cluster = game.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(game.distance(x, cluster))],
                                             ["id", "cluster", "distance"])

    return run


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches, centroids.shape[1]):
            cluster = game.nearest(x)
            np.add.at(total, cluster, x)
            n += np.bincount(cluster, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "s"])

    return run
