import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import UPPER, edge_rows, frame
from sentencepiece import SentencePieceProcessor

from tillroll.llm import lattice_lm
from tillroll.llm.lattice_lm import Pieces, most_frequent, score_documents, word_scores

PATH = public_tokenizers.path("piece_bpe_32k.model")


def toks(t):
    return (t or "").translate(UPPER).encode().split()


def brute_word(word, logs):
    text = b" " + word
    best = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        best[j] = sum(best[i] * 10 ** logs[text[i:j]] for i in range(max(0, j - 60), j) if text[i:j] in logs)
    return math.log10(best[-1])


def logs_of(pieces, counts, total):
    return {raw: math.log10(sum((counts[i] + 0.5) / total for i in ids)) for raw, ids in pieces.ids.items()}


@pytest.fixture(scope="module")
def scored():
    pieces = Pieces.load(PATH)
    counts = np.random.default_rng(3).integers(0, 1000, 32_000)
    total = float(counts.sum() + 20_000)
    return pieces.score(counts, total), logs_of(pieces, counts, total)


def test_all_segmentations(scored, monkeypatch):
    pieces, logs = scored
    rng = random.Random(2)
    words = [b"a", b"the", "étrange漢字".encode(), b"\xff\x00", b"aaaaaaaaaaaa"] + [
        "".join(rng.choice(["the", "tion", "er", "x", "é", "in", "g"]) for _ in range(rng.randint(1, 8))).encode() for _ in range(50)]
    want = [brute_word(w, logs) for w in words]
    assert np.allclose(word_scores(words, pieces), want, atol=1e-9)
    monkeypatch.setattr(lattice_lm, "SHORT", 0)
    assert np.allclose(word_scores(words, pieces), want, atol=1e-9)
    long = [("ab" * 300 + "tion" * 50).encode()]
    one = word_scores(long, pieces)
    monkeypatch.setattr(lattice_lm, "SHORT", 5000)
    assert np.allclose(one, word_scores(long, pieces), atol=1e-6)
    assert np.allclose(one, lattice_lm._forward_long(np.frombuffer(b" " + long[0], np.uint8), pieces, block=13), atol=1e-6)


def test_next_piece_probabilities_are_proper(scored):
    pieces, logs = scored
    assert sum(10**x for x in logs.values()) <= 1.0


@pytest.mark.parametrize("head", [0, 40, 150_000])
def test_equals_brute_force(spark, head):
    rows = edge_rows()
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    c = Counter(w for r in train for w in toks(r[1]))
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    model, counts = SentencePieceProcessor(model_file=PATH), Counter()
    for w, k in c.items():
        for i in model.encode(w.decode()):
            counts[i] += k
    pieces = Pieces.load(PATH)
    used = [i for ids in pieces.ids.values() for i in ids]
    total = sum(counts[i] for i in used) + ends + 0.5 * (len(used) + 1)
    logs = logs_of(pieces, counts, total)
    cache = {}
    want = []
    for i, t, *_ in rows:
        own = toks(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        for w in set(own):
            if w not in cache:
                cache[w] = brute_word(w, logs) if len(w) < 100 else float(word_scores([w], pieces.score(np.array([counts[j] for j in range(32_000)]), total))[0])
        score = sum(cache[w] for w in own) + math.log10((ends + 0.5) / total)
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(own) + 1, sum(c[w] > 0 for w in own) + 1, n, base, score))
    df = frame(spark, rows)
    got = [tuple(r) for r in score_documents(df, PATH, head_words=head).collect()]
    key = lambda r: (repr(r[:5]), round(r[5], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5]) and abs(g[6] - w[6]) < 1e-6 * abs(w[6])


def test_empty_and_no_training(spark):
    df = frame(spark, edge_rows())
    assert score_documents(df.where("false"), PATH).count() == 0
    held = df.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    got = score_documents(held, PATH).collect()
    assert got and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_head_holds_every_hot_word(spark):
    """Also words that training texts lack; what is left out is rare, and the head is bounded by rows and bytes."""
    rng = random.Random(8)
    times = {f"w{i}": rng.randint(1, 9) for i in range(500)} | {"held": 4000, "often": 900, "x" * 3000: 5000}
    words = spark.createDataFrame([(w.encode(), 0 if w == "held" else m, m) for w, m in times.items()], "word binary, c long, m long")
    for rows, size in ((0, 10**6), (2, 10**6), (3, 10**6), (100, 10**6), (1000, 10**6), (1000, 3100), (1000, 1000)):
        head = {r["word"].decode() for r in most_frequent(words, rows, size).collect()}
        assert len(head) <= rows and sum(map(len, head)) <= size
        for w in times.keys() - head:
            assert times[w] < 2 * sum(times.values()) / (rows + 1) or times[w] * (size + 1) < 2 * sum(m * len(v) for v, m in times.items())
    assert "held" in {r["word"].decode() for r in most_frequent(words, 3, 10**6).collect()}
