import numpy as np
import pytest

from tillroll.llm import nearest
from tillroll.llm.nearest import search

def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = []
    for q in sorted(queries):
        d = np.sqrt(((x - np.array(queries[q], float)) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out += [(q, r + 1, int(ids[keep][o]), float(d[keep][o])) for r, o in enumerate(order)]
    return out


def recall(got, want):
    return len({(r[0], r[2]) for r in got} & {(w[0], w[2]) for w in want}) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    """At two sizes, with the lists and probes that the sizes and the measured recall give."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    queries = {i: v for i, v in vectors.items() if i % 100 == 0}
    want = brute(vectors, queries, 10)
    got = sorted(tuple(r) for r in search(df, df.where("vec_id % 100 = 0")).collect())
    assert recall(got, want) >= 0.95
    for q, rank, i, score in got:
        assert abs(score - np.sqrt(((np.array(vectors[i], float) - np.array(vectors[q], float)) ** 2).sum())) < 1e-12
    for q in queries:
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r[3], r[2])) and q not in [r[2] for r in own]


def test_all_lists_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS_PER_TASK", 50)
    monkeypatch.setattr(nearest, "QUERIES_PER_TASK", 3)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=24)], 1) for i in range(300)]
    rows += [(1000 + i, [1.0] * 24, 2) for i in range(200)]  # a third of all: one vector
    bad = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [None] + [1.0] * 23, 1), (2100, [float("nan")] * 24, 1),
           (2200, [float("inf")] * 24, 1), (2300, [1.0] * 5, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    vectors = {i: np.float32(v).astype(float) for i, v, _ in rows}
    queries = {i: v for i, v in vectors.items() if i % 100 == 0}
    got = sorted(tuple(r) for r in search(df, df.where("vec_id % 100 = 0"), lists=16, probes=16).collect())
    want = brute(vectors, queries, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (1, [1.0, 2.5]), (100, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in search(df, df.where("vec_id % 100 = 0")).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert got[0][3] == pytest.approx(0.5)
    assert search(df.where("false"), df).count() == 0 and search(df, df.where("false")).count() == 0


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(2)
    vectors = {int(i): [float(x) for x in np.float32(rng.normal(size=8))] for i in range(60)}
    rows = [(i, v) for i, v in vectors.items() for _ in range(12)] + [(i, [100.0 + j] * 8) for i, v in vectors.items() for j in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = {i: v for i, v in vectors.items() if i % 30 == 0}
    asked = spark.createDataFrame(list(queries.items()), "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in search(df, asked, lists=1, probes=1).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(vectors, queries, 10)]


@pytest.mark.parametrize("offset, step", [(0.0, 1e25), (1e4, 2.0**-9)])
def test_large_and_almost_equal_vectors(spark, offset, step):
    rng = np.random.default_rng(3)
    vectors = {int(i): [float(x) for x in np.float32(offset + step * rng.integers(1, 9, 24))] for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    queries = {i: v for i, v in vectors.items() if i % 100 == 0}
    got = sorted(tuple(r) for r in search(df, df.where("vec_id % 100 = 0"), lists=1, probes=1).collect())
    want = brute(vectors, queries, 10)
    assert len(got) == len(want) and recall(got, want) >= 0.95


def test_probes_follow_the_data(spark):
    """Clustered vectors need few lists; vectors that fill the space evenly need many. Both reach the recall."""
    rng = np.random.default_rng(4)
    centres = 20 * rng.normal(size=(40, 16))
    probed = {}
    for name, x in (("clustered", np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16))), ("even", rng.normal(size=(2000, 16)))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        clean = df.select("vec_id", df["embedding"].alias("v"))
        index = nearest.fit(clean, 16, "vec_id", "v", 44)
        own = index.nearest_lists(x, 1)[:, 0]
        indexed = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], "vec_id long, v array<double>, list int")
        probed[name] = nearest.probes_for(indexed, 16, index, 10)
        got = [tuple(r) for r in search(df, df.where("vec_id % 100 = 0")).collect()]
        assert recall(got, brute(dict(enumerate(x)), {i: x[i] for i in range(0, 2000, 100)}, 10)) >= 0.92
    assert probed["clustered"] < probed["even"] / 2
