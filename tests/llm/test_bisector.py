import hashlib
import math
import random

import pytest

from tillroll.llm.bisector import Tournament, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, v string"


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in out)
    return sorted(((i, c, d, sum(r[2] for r in out if r[1] == c), total,
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def vectors(n, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # a third of all: one vector
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (-1, None), (-2, []), (-3, [1.0] * (dims + 1)), (-4, [0.0] * dims),
             (-5, [float("nan")] + [0.0] * (dims - 1)), (-6, [None] + [0.0] * (dims - 1)), (-7, [float("inf")] + [0.0] * (dims - 1))]
    return [(*r, "x", 1, "y") for r in rows]


@pytest.mark.parametrize("k, rounds", [(1, 1), (5, 3), (16, 3), (400, 2)])
def test_equals_brute_force(spark, k, rounds):
    rows = vectors(120)
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA), k, rounds, dims=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, rounds, 8, 64)


def test_ties_go_to_the_smaller_number():
    import numpy as np
    game = Tournament(np.array([[5, 0], [0, 0], [0, 0], [10, 0]]))
    assert game.nearest(np.array([[0, 0], [5, 3], [10, 0], [7, 1], [8, 0]])).tolist() == [1, 0, 3, 0, 3]
    middle = Tournament(np.array([[0, 0], [10, 0]]))
    assert middle.nearest(np.array([[5, 7], [6, 7]])).tolist() == [0, 1]


def test_empty_and_too_large(spark):
    few = spark.createDataFrame(vectors(6), SCHEMA)
    assert cluster_vectors(few.where("false"), 4, dims=8).count() == 0
    assert cluster_vectors(few, 4, dims=64).count() == 0  # no vector of that length
    with pytest.raises(Exception, match="squared distances"):
        cluster_vectors(spark.createDataFrame([(1, [3e7] * 8, "", 1, "")], SCHEMA), 4, dims=8)
