import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import edge_rows, frame, prose, rows_of

from tillroll.llm.near_dedup import IDF_SPAN, RARE, Idf, components, inverse_frequencies, keep_first, near_duplicates, sample, shingles_of, similarity, weigh


def planted():
    rng = random.Random(11)
    rows, passage = [], prose(rng, 70, 3000)
    for g in range(12):  # groups of near copies
        base = prose(rng, 150 + 20 * g, 3000).split()
        for c in range(1 + g):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((1000 * g + c, " ".join(w), "en", "a"))
    rows += [(50_000 + i, passage + " " + prose(rng, rng.randint(10, 150), 3000), "en", "a") for i in range(60)]  # one passage in many
    rows += [(60_000 + i, "An exact copy of a text, more than once.", "en", "a") for i in range(30)]
    return rows


def brute(rows, idf, threshold=0.8):
    """Classes from all pairs."""
    texts = sorted({t for _, t, *_ in rows if t is not None})
    own = list(shingles_of(pa.array(texts)))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            s = similarity(own[i], own[j], idf)
            close += threshold - 0.02 < s < threshold + 0.03
            if s >= threshold:
                parent[find(i)] = find(j)
    first, size = {}, {}
    at = {t: find(i) for i, t in enumerate(texts)}
    for i, t, *_ in rows:
        if t is not None:
            first.setdefault(at[t], []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in first[at[t]] if x is not None] if t is not None else []
        out.append((i, min(ids) if ids else (i if t is None else None), len(first[at[t]]) if t is not None else 1))
    return sorted(out, key=repr), close


def test_equals_all_pairs(spark):
    rows = planted() + edge_rows()
    df = frame(spark, rows)
    idf = inverse_frequencies(df.where("text is not null").select("text"))
    want, close = brute(rows, idf)
    got = near_duplicates(df).select("doc_id", "class_id", "class_size")
    assert rows_of(got) == want
    assert sum(c[0] != c[1] for c in want) > 60


def test_a_chain_of_edits_is_one_class(spark):
    """Each text is a near copy of its neighbours only: no centre links them all."""
    rng = random.Random(5)
    w = prose(rng, 300, 5000).split()
    rows = []
    for i in range(40):
        w[7 * i] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "a"))
    df = frame(spark, rows)
    want, _ = brute(rows, inverse_frequencies(df.select("text")))
    assert {c for _, c, _ in want} == {0}
    assert rows_of(near_duplicates(df).select("doc_id", "class_id", "class_size")) == want


def test_edits_of_edits_in_crowded_buckets(spark):
    """Links between texts far from the most connected one, in buckets that many others share."""
    rng = random.Random(7)
    texts = [prose(rng, 150, 3000).split()]
    while len(texts) < 400:
        w = list(texts[int(len(texts) * rng.random() ** 2)])
        for _ in range(2):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        texts.append(w)
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate(texts)]
    df = frame(spark, rows)
    want, _ = brute(rows, inverse_frequencies(df.select("text")))
    assert rows_of(near_duplicates(df).select("doc_id", "class_id", "class_size")) == want


def test_keep_first(spark):
    rows = planted() + edge_rows()
    df = frame(spark, rows)
    classes, _ = brute(rows, inverse_frequencies(df.where("text is not null").select("text")))
    kept = keep_first(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    # 6 stands for two texts: the class of its first text has a smaller id, its other text is a class of its own
    assert ids == sorted({i for i, c, _ in classes if i is not None and i == c})
    assert kept.where("doc_id is null and text is null").count() == 1
    assert keep_first(df.where("false")).count() == 0


def test_keep_first_keeps_different_texts_without_or_with_the_same_id(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60, 3000) for _ in range(6)]
    rows = [(None, t, "en", "a") for t in texts[:4]] + [(None, texts[0], "en", "b"), (5, texts[4], "en", "a"), (5, texts[5], "en", "a"),
                                                        (5, texts[5], "en", "a"), (None, None, "en", "a"), (None, None, "en", "b"), (7, None, "en", "a"), (7, None, "en", "a")]
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_first(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(None, t) for t in texts[:4]] + [(5, texts[4]), (5, texts[5]), (None, None), (None, None), (7, None)], key=repr)


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_samples_agree_as_often_as_the_weighted_jaccard(share):
    rng = np.random.default_rng(5)
    equal, true, idf = [], [], Idf(np.zeros(0, np.uint64), np.zeros(0))
    for _ in range(150):
        u = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        n = int(len(u) * 2 * share / (1 + share))
        a = u[:100 + n // 2], rng.integers(1, 4, 100 + n // 2)
        b = u[100 - n // 2:], np.concatenate([a[1][100 - n // 2:], rng.integers(1, 4, len(u) - len(a[0]))])
        equal.append((sample(a[0], weigh(*a, idf)) == sample(b[0], weigh(*b, idf))).mean())
        true.append(similarity(a, b, idf))
    assert abs(np.mean(equal) - np.mean(true)) < 0.02


def test_block_size_does_not_matter():
    rng = np.random.default_rng(1)
    u, w = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), rng.random(500) + 0.5
    assert np.array_equal(sample(u, w), sample(u, w, block=7))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 700), (1000, 1001)]
    got = {r["nid"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[700] == got[900] == got[500] == 500 and got[1001] == 1000


def brute_idf(texts):
    own = [set(u.tolist()) for u, _ in shingles_of(pa.array(texts))]
    df = {}
    for shingles in own:
        for u in shingles:
            df[u] = df.get(u, 0) + 1
    return {u: 1 + IDF_SPAN * min(1.0, np.log(len(own) / n) / np.log(1 / RARE)) for u, n in df.items()}


def test_weights_are_exact_and_do_not_depend_on_the_corpus_size(spark):
    rng = random.Random(6)
    texts = [t for _, t, *_ in planted()]
    idf = inverse_frequencies(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).select("text"))
    want = brute_idf(texts)
    u = np.array(sorted(want), np.uint64)
    assert np.allclose(idf.of(u), [want[x] for x in u.tolist()])
    # the same mixture, nine times as many documents, with fresh words in the rest of each text
    more = [t if k == 0 else f"{t} {prose(rng, 20, 10**6)}" for k in range(9) for t in texts]
    large = inverse_frequencies(frame(spark, [(i, t, "en", "a") for i, t in enumerate(more)]).select("text"))
    pair = list(shingles_of(pa.array([texts[-100], texts[-99]])))
    near = list(shingles_of(pa.array([texts[1], texts[2]])))
    for a, b in (pair, near):
        assert abs(similarity(a, b, idf) - similarity(a, b, large)) < 0.002


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    """Blocks bounded by nodes and by bytes, with long texts among short ones."""
    from tillroll.llm import near_dedup
    rng = random.Random(9)
    rows = planted() + [(70_000 + i, prose(random.Random(i // 3), 3000, 4000) + f" tail{i}", "en", "a") for i in range(9)]
    rows += [(80_000 + i, " ".join(["common passage of many words in a row"] * 8) + " " + prose(rng, rng.randint(5, 60), 100), "en", "a") for i in range(60)]
    df = frame(spark, rows)
    want, _ = brute(rows, inverse_frequencies(df.select("text")))
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)
    monkeypatch.setattr(near_dedup, "TASK_BYTES", 20_000)
    assert rows_of(near_duplicates(df).select("doc_id", "class_id", "class_size")) == want
