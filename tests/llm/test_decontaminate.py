import random

from helpers import edge_rows, frame, rows_of, words

from tillroll.llm.decontaminate import covered_words, decontaminate, shared_spans


def brute(docs, items, window=10):
    out = []
    for i, t, *_ in docs:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(window, len(iw))
            if not n:
                continue
            own = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in own:
                    hit |= set(range(p, p + n))
                    names.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


def measured(docs, items_df, **kw):
    got = shared_spans(docs, items_df, **kw).select("doc_id", "n_words", covered_words("hits").alias("n"), "hits", "items").collect()
    for r in got:  # spans name the smallest of the equal items
        assert {h["item"] for h in r["hits"]} <= set(r["items"]) and r["items"] == sorted(set(r["items"]))
    return sorted(((r["doc_id"], r["n_words"], r["n"], tuple(r["items"])) for r in got), key=repr)


def case():
    rng = random.Random(8)
    vocab = ["a", "b", "Ab", "é", "7", "c"]
    text = lambda n, v=vocab: " ".join(rng.choice(v) + rng.choice(["", "", ".", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 4, 5, 7, 9, 10, 11, 14, 25, 60]))) for k in range(24)]
    items += [(100, None), (None, text(12)), (101, "z z z z z z z z z z z z z"), (101, text(15))]
    docs = [(k, text(rng.choice([0, 2, 9, 10, 40, 300])), "en", "a") for k in range(60)]
    docs += [(1000 + k, text(30, ["q", "r"]) + " " + it + " " + text(20, ["q", "r"]), "en", "a") for k, it in items[:24]]
    docs += [(2000, "z " * 5000, "en", "a"), (2001, (items[10][1] + " ") * 40, "en", "a")]
    return docs + edge_rows(), items


def test_equals_brute_force(spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert measured(frame(spark, docs), bench) == want
    assert measured(frame(spark, docs).repartition(5), bench.repartition(7)) == want


def test_a_full_filter_only_adds_work(spark, monkeypatch):
    """With a filter so small that every bit is set, all fingerprints reach the join; the result is the same."""
    from tillroll.llm import decontaminate as module
    monkeypatch.setattr(module, "MAX_BITS", 1 << 4)
    docs, items = case()
    assert measured(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_repeated_items(spark):
    """A text that a third of the items repeat is one item with many ids."""
    docs, items = case()
    items = items + [(500 + i, items[10][1] or "one") for i in range(12)]
    got = measured(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)
    spans = shared_spans(frame(spark, docs[60:]), spark.createDataFrame(items, "item_id long, text string")).select("hits").collect()
    assert all(len({(h["item"], h["first"], h["after"]) for h in r["hits"]}) == len(r["hits"]) for r in spans)


def test_blocks_of_bytes(spark, monkeypatch):
    from tillroll.llm import common
    import numpy as np
    import pyarrow as pa
    texts = pa.array(["Ab cd " * 30 + "e" * 100, None, "", "x" * 70, "é漢 a1B2 " * 9, "end"])
    flat = common.flat_bytes(texts)
    want = common.word_hashes(*flat)
    monkeypatch.setattr(common, "BLOCK", 16)
    got = common.word_hashes(*flat)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    assert np.diff(want[1]).tolist() == [len(words(t)) for t in texts.to_pylist()]


def test_filter_and_empty(spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns
    want = [i for i, _, hit, _ in brute(docs, items) if hit == 0]
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted(want, key=repr)
    none = bench.where("false")
    assert rows_of(decontaminate(df, none).select("doc_id", "text")) == rows_of(df.select("doc_id", "text"))
    assert shared_spans(df.where("false"), bench).count() == 0
