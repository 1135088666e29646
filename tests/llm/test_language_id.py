import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
from helpers import edge_rows, frame
from pyspark.sql import functions as F

from tillroll.llm import language_id
from tillroll.llm.common import crc32_mod
from tillroll.llm.language_id import fit, gram_counts, keep_identified, language, train_ftrl


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(100_000).where("lang is not null").withColumn("held", crc32_mod("doc_id", 4) == 2)
    docs = docs.where("doc_id % 5 = 0")
    model = fit(docs.where("not held"), sample_per_language=300)
    got = docs.where("held").select("lang", language(model, "text", spark).alias("g")).collect()
    assert np.mean([r["lang"] == r["g"]["lang"] for r in got]) >= 0.97
    assert all(0 <= r["g"]["score"] <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_blocks_do_not_change_the_counts(monkeypatch):
    texts = ["Hello  World, 123 été!!", "a", "a b", "  x", "é" * 50 + "   " + "z", "one two three four five"]
    want = [gram_counts(t) for t in texts]
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        for t, w in zip(texts, want):
            assert np.array_equal(gram_counts(t), w), (t, block)
    assert gram_counts("123 !!") is None


def test_edges(spark):
    df = frame(spark, edge_rows())
    model = fit(df)
    assert model.languages == ["en", "fr"]
    for r in df.select("text", language(model, "text", spark).alias("g")).collect():
        no_letter = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["g"]["lang"] == "und") == no_letter and 0 <= r["g"]["score"] <= 1
    kept = keep_identified(df, 0.0)
    assert kept.columns == df.columns and kept.where("text is null or text = ''").count() == 0
    assert keep_identified(df.where("false")).count() == 0
    assert keep_identified(df.withColumn("lang", df["lang"].substr(9, 1).cast("string")).where("lang is null")).count() > 0


def test_elastic_net_shrinks_to_zero():
    rng = np.random.default_rng(0)
    rows = [(np.array([c, 10 + int(rng.integers(0, 50))]), np.array([1.0, 0.3]), c) for c in rng.integers(0, 3, 600)]
    w, b, t = train_ftrl([(np.sort(d), v[np.argsort(d)], int(c)) for d, v, c in rows], 3, l1=5e-2)
    assert (w[:3].argmax(axis=1) == np.arange(3)).all() and (w[10:60] == 0).mean() > 0.9 and t > 0


M = 1 << 32


def plain_grams(text):
    """Hashed runs of 1 to 3 characters, one by one."""
    if not any(c.isalpha() for c in text):
        return None
    clean = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()))
    out = Counter()
    for i in range(len(clean)):
        for gram in (clean[i : i + n] for n in (1, 2, 3) if i + n <= len(clean)):
            c = [ord(x) for x in gram]
            h = c[0] * 0x9E3779B1 % M
            if len(c) > 1:
                h = (c[0] * 0x85EBCA77 + c[1] * 0xC2B2AE3D) % M
            if len(c) > 2:
                h = ((h ^ h >> 15) * 0x27D4EB2F + c[2] * 0x165667B1) % M
            out[((h ^ h >> 16) * 0x7FEB352D % M) >> (32 - language_id.BITS)] += 1
    return out


def plain_probabilities(logits, t=1.0):
    e = [math.exp((z - max(logits)) / t) for z in logits]
    return [x / sum(e) for x in e]


def plain_model(rows, epochs=4, batch=16, alpha=0.5, beta=1.0, l1=2e-4, l2=1e-4):
    """rows: (order, label, text). TF-IDF, follow the regularised leader per coordinate, temperature by a grid, all with dicts."""
    grams = [(o, y, g) for o, y, t in rows if t is not None and y is not None and (g := plain_grams(t))]
    df = Counter(k for _, _, g in grams for k in g)
    idf = lambda k: math.log((1 + len(grams)) / (1 + df[k])) + 1

    def vector(g):
        x = {k: math.log(1 + c) * idf(k) for k, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / norm for k, v in x.items()} | {"bias": 1.0}

    names = sorted({y for _, y, _ in grams})
    seen = [(vector(g), names.index(y)) for _, y, g in sorted(grams, key=lambda r: (r[0], r[1], len(r[2])))]
    learn, aside = [r for i, r in enumerate(seen) if i % 5 != 4], [r for i, r in enumerate(seen) if i % 5 == 4]
    w, z, n = {}, {}, {}
    logits = lambda x: [sum(v * w.get((k, c), 0.0) for k, v in x.items()) for c in range(len(names))]
    for at in [a for _ in range(epochs) for a in range(0, len(learn), batch)]:
        g = Counter()
        for x, y in learn[at : at + batch]:
            for c, p in enumerate(plain_probabilities(logits(x))):
                for k, v in x.items():
                    g[k, c] += v * (p - (c == y))
        for key, slope in g.items():
            old = n.get(key, 0.0)
            n[key] = old + slope * slope
            z[key] = z.get(key, 0.0) + slope - (math.sqrt(n[key]) - math.sqrt(old)) / alpha * w.get(key, 0.0)
            over = abs(z[key]) - (0 if key[0] == "bias" else l1 * len(learn) / batch)
            w[key] = -math.copysign(max(over, 0.0), z[key]) / ((beta + math.sqrt(n[key])) / alpha + l2)
    outs = [(logits(x), y) for x, y in aside]
    grid = [math.exp(math.log(0.02) + i * (math.log(20) - math.log(0.02)) / 199) for i in range(200)]
    t = min(grid, key=lambda t: sum(-math.log(plain_probabilities(o, t)[y] + 1e-12) for o, y in outs))

    def predict(text):
        g = plain_grams(text) if text else None
        if g is None:
            return "und", 0.0
        p = plain_probabilities(logits(vector(g)), t)
        return names[p.index(max(p))], max(p)

    return predict, t


def test_equals_plain_tfidf_ftrl_and_temperature(spark):
    rng = random.Random(6)
    sounds = {"en": ["th", "ing", "wh", "e", "a"], "fr": ["eau", "é", "qu", "e", "a"], "de": ["sch", "ü", "ung", "e", "a"]}

    def text(lang):
        return ", ".join("".join(rng.choice(sounds[lang if rng.random() < 0.6 else rng.choice(sorted(sounds))]) for _ in range(rng.randint(1, 3)))
                         for _ in range(rng.randint(1, 6)))

    rows = [(i, text(lang := "en fr de".split()[i % 3]), lang if rng.random() < 0.8 else "en", "a") for i in range(150)]
    rows += [(500, None, "en", "a"), (501, "ohne", None, "a"), (502, "123 !!", "fr", "a"), (503, "", "fr", "a"), (None, "Eau THING İ 漢字", "fr", "a")]
    rows += rows[:3]
    df = frame(spark, rows)
    ordered = [tuple(r) for r in df.select(F.xxhash64("doc_id", F.lit(7)), "lang", "text").collect()]
    predict, t = plain_model(ordered)
    model = fit(df)
    assert math.isclose(model.temperature, t, rel_tol=1e-9) and 0.03 < t < 15  # a minimum inside the grid
    held = frame(spark, rows + [(900 + i, text(lang), lang, "a") for i, lang in enumerate(["en", "fr", "de"] * 10)] + edge_rows()[:12])
    for r in held.select("text", language(model, "text", spark).alias("g")).collect():
        lang, score = predict(r["text"])
        assert r["g"]["lang"] == lang and abs(r["g"]["score"] - score) < 1e-6


def test_counting_a_long_text_needs_little_memory_beside_it(monkeypatch):
    """Grams are hashed in steps: equal counts whatever the step, and temporary arrays far below 80 bytes a character."""
    text = "Straße ΑΣ,  ΟΔΟΣ the quick br0wn fox \n" * 5000
    gram_counts("a")
    tracemalloc.start()
    got = gram_counts(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text) and got.sum() > len(text)
    short = gram_counts(text[:4000])
    for step in (1, 7, 1 << 22):
        monkeypatch.setattr(language_id, "STEP", step)
        assert np.array_equal(gram_counts(text[:4000]), short)
