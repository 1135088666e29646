"""Operator 8: approximate nearest neighbours by an adaptive dimension scan inside the probed lists of an inverted file."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: Vectors, about, on which the lists' centres are fitted; every vector is indexed.
SAMPLE = 20_000
#: Vectors picked to measure how many lists must be probed, and the share of their true neighbours that the probed lists must hold.
TRIALS, RECALL = 256, 0.96
#: Sampled vectors compared with all centres at a time.
FIT_ROWS = 2_048
#: Vectors of one list, and queries that probe it, that meet in one task.
VECTORS_PER_TASK, QUERIES_PER_TASK = 16_384, 2_048
#: Rotated dimensions that are read before each test.
COLUMN_BLOCK = 16
#: Slack of the test: a candidate is given up when its estimated distance is beyond (1 + SLACK / sqrt(dimensions read)) times the limit.
SLACK = 2.1


@dataclass
class Index:
    centres: np.ndarray  # lists x dimensions
    rotation: np.ndarray

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def valid(vector: Column) -> Column:
    """Vectors with components, all of them finite and not null, and not all zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def probes_for(indexed: DataFrame, dim: int, index: Index, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The least number of lists that hold the share ``recall`` of the ``k`` nearest of ``trials`` vectors.

    The trial vectors are picked by a hash of the id; their true neighbours are taken
    from all vectors of ``indexed`` (vec_id, v, list), in one pass in which every task keeps its ``k`` best per trial.
    """
    drawn = indexed.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(trials).select("vec_id", "v").toArrow()
    if not drawn.num_rows:
        return 1
    ids, x = drawn.column(0).to_numpy(), matrix(drawn.column(1), dim)
    known = indexed.sparkSession.sparkContext.broadcast((ids, x))

    def nearest_of_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, asked = known.value
        best = np.full((len(asked), k), np.inf)
        lists = np.full((len(asked), k), -1, np.int32)
        for part in parts:
            own, of = part.column("vec_id").to_numpy(), part.column("list").to_numpy()
            v = matrix(part.column("v"), dim)
            for at in range(0, len(v), FIT_ROWS):
                gap = ((v[at : at + FIT_ROWS] ** 2).sum(axis=1) - 2 * asked @ v[at : at + FIT_ROWS].T) + (asked**2).sum(axis=1)[:, None]
                gap[asked_ids[:, None] == own[at : at + FIT_ROWS]] = np.inf
                both = np.concatenate([best, gap], axis=1)
                all_lists = np.concatenate([lists, np.broadcast_to(of[at : at + FIT_ROWS], gap.shape)], axis=1)
                keep = np.argpartition(both, k - 1, axis=1)[:, :k]
                best, lists = np.take_along_axis(both, keep, 1), np.take_along_axis(all_lists, keep, 1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, j]), pa.array(lists[q, j])], names=["q", "d", "list"])

    near = indexed.mapInArrow(nearest_of_task, "q int, d double, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "list"))
    true = near.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "list").toArrow()  # trials x k rows
    if not true.num_rows:
        return 1
    order = index.nearest_lists(x, len(index.centres))
    place = np.argsort(order, axis=1)[true.column(0).to_numpy(), true.column(1).to_numpy()]
    return int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1


def fit(vectors: DataFrame, dim: int, id_col: str, vector_col: str, lists: int, sample: int = SAMPLE, rounds: int = 12) -> Index:
    """Fit list centres (k-means) on about ``sample`` vectors picked by a hash of the id, and draw the rotation."""
    n = vectors.count()
    draw = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    rows = vectors.where(draw < sample / max(n, 1)).select(F.xxhash64(id_col).alias("h"), vector_col).toArrow() if n else None
    rng = np.random.default_rng(5)
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    if rows is None or rows.num_rows == 0:
        return Index(np.zeros((1, dim)), rotation)
    x = matrix(rows.column(1), dim)[np.argsort(rows.column(0).to_numpy(), kind="stable")]
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: max(1, min(lists, len(distinct) // 8))]]
    for _ in range(rounds):
        of = np.concatenate([((centres**2).sum(axis=1) - 2 * distinct[i : i + FIT_ROWS] @ centres.T).argmin(axis=1)
                             for i in range(0, len(distinct), FIT_ROWS)])
        total = np.zeros_like(centres)
        np.add.at(total, of, distinct)
        size = np.bincount(of, minlength=len(centres))[:, None]
        centres = np.where(size > 0, total / np.maximum(size, 1), centres)
    return Index(centres, rotation)


def scan(queries: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, rotation: np.ndarray,
         k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the indices and distances of the nearest vectors of its ``k`` nearest ids (without its own), ties to the smaller id.

    Rotated vectors are read in blocks of columns. After each block a
    candidate's distance is estimated from the part read; the candidates that a
    hypothesis test finds beyond the query's current k-th distance are given
    up. The distances of the others are taken on the original vectors.
    """
    dim = vectors.shape[1]
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    turned, asked = vectors @ rotation, queries @ rotation
    # Bound of the rounding of a rotated difference, in units of both norms.
    eps = 4 * dim * np.finfo(np.float64).eps
    slack, own_slack = eps * np.sqrt((vectors**2).sum(axis=1)), eps * np.sqrt((queries**2).sum(axis=1))
    edges = list(range(0, dim, COLUMN_BLOCK)) + [dim]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:])]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    first, repeated = starts[: 8 * k], len(starts) < len(ids)  # one vector of an id
    for q in range(len(queries)):
        near = np.sort(((vectors[first] - queries[q]) ** 2).sum(axis=1)[ids[first] != query_ids[q]])
        limit = np.sqrt(near[k - 1]) if len(near) >= k else np.inf
        alive, part = np.flatnonzero(ids != query_ids[q]), None
        for (a, b), block in zip(zip(edges, edges[1:]), blocks):
            gap = block[alive] - asked[q, a:b]
            add = np.einsum("ij,ij->i", gap, gap)
            part = add if part is None else part + add
            keep = np.sqrt(part) <= limit * np.sqrt(b / dim) * (1 + SLACK / np.sqrt(b)) + slack[alive] + own_slack[q]
            alive, part = alive[keep], part[keep]
        exact = np.sqrt(((vectors[alive] - queries[q]) ** 2).sum(axis=1))
        best = np.argsort(exact, kind="stable")  # alive is in the order of ids
        if repeated:
            best = best[np.sort(np.unique(ids[alive[best]], return_index=True)[1])]
        best = best[:k]
        yield q, order[alive[best]], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` approximately nearest vectors by Euclidean distance of every query, out of all ``vectors``.

    ``queries`` has the same columns; a query's candidates are the vectors
    with other ids. Vectors go to the list of their nearest centre; a query
    scans ``probes`` lists (``scan``). Unless they are given, there are about as many lists as the
    square root of the vectors (at most an eighth of the sample), and as many probes as
    hold ``RECALL`` of the true neighbours of some of the vectors (``probes_for``): few where vectors
    lie in clusters, many where they fill the space evenly. A list with many vectors, such as
    that of one vector that fills a third of the table, is dealt over several
    tasks by a hash of the id, and so are the queries that probe a list; only
    each task's ``k`` best per query are shuffled to the final ranking.

    Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do those of another dimension than the most frequent one
    (of equally frequent ones, the smallest). A repeated id counts as one candidate at its
    nearest distance, and as one query. Null ids take no part.

    Returns (query_id, rank, vec_id, score): rank from 1, nearest first, ties
    to the smaller id; score is the distance in double precision on the
    original vectors. Empty inputs give no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = clean.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim = sizes["dim"]
    clean = clean.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    asked = queries.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(
        F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).where(F.size("q") == dim)
    clean = stored(clean, "ann-vectors")
    if lists is None:
        lists = max(16, math.isqrt(clean.count()))
    index = spark.sparkContext.broadcast(fit(clean, dim, "vec_id", "v", lists))

    def lists_of(n: int):
        @F.arrow_udf("array<int>")
        def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                found = index.value.nearest_lists(matrix(part, dim), n)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel(), pa.int32()))

        return find

    # Vectors travel as floats of the input's own precision; both sides are cut into bounded pieces.
    indexed = stored(clean.withColumn("list", lists_of(1)("v")[0]), "ann-index")
    if probes is None:
        probes = probes_for(indexed, dim, index.value, k)
    probing = stored(asked.withColumn("list", F.explode(lists_of(probes)("q"))), "ann-probes")
    in_list = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    at_list = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    both = sorted(in_list.keys() & at_list.keys())
    if not both:
        return empty
    cuts = spark.createDataFrame([(c, -(-in_list[c] // VECTORS_PER_TASK), -(-at_list[c] // QUERIES_PER_TASK)) for c in both],
                                 "list int, vcuts int, qcuts int")
    cuts = F.broadcast(cuts)  # one row per list; the number of lists is a parameter
    left = (indexed.join(cuts, "list").withColumn("vcut", F.pmod(F.xxhash64("vec_id"), "vcuts"))
            .withColumn("qcut", F.explode(F.sequence(F.lit(0), F.col("qcuts") - 1))).select("list", "vcut", F.col("qcut").cast("long"), "vec_id", "v"))
    right = (probing.join(cuts, "list").withColumn("qcut", F.pmod(F.xxhash64("query_id"), "qcuts"))
             .withColumn("vcut", F.explode(F.sequence(F.lit(0), F.col("vcuts") - 1))).select("list", F.col("vcut").cast("long"), "qcut", "query_id", "q"))
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        cols = [[], [], []]
        if v.num_rows and q.num_rows:
            ids, query_ids = v.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
            found = scan(matrix(q.column("q"), dim), matrix(v.column("v"), dim), query_ids, ids, index.value.rotation, k)
            for i, at, score in found:
                cols[0].append(np.full(len(at), query_ids[i]))
                cols[1].append(ids[at])
                cols[2].append(score)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, result)], schema=result)

    keys = ["list", "vcut", "qcut"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
