import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from helpers import edge_rows, frame

from tillroll.llm import periodic_runs
from tillroll.llm.catalog import LLM_QUERIES, looped_texts
from tillroll.llm.periodic_runs import Extensions, find_runs, gram_words, live_stretches, word_codes


def split(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if text else []


def words(text):
    return [w for w in split(text) if w]


def brute(w, exponent=4, least=6):
    """All runs by trying every period at every place; a run found with a multiple of its period is dropped."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(
                    all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 5)])
def test_equals_brute_force(spark, exponent, least, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TREE_WORDS", 200)  # several pairs of trees
    rng, rows = random.Random(3), []
    for i in range(300):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 6]))}" for _ in range(rng.randint(0, 70))]
        if w and i % 2:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // (3 + rng.randrange(8))
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        rows.append((i, " \t".join(w), "en", "a"))
    got = {r["doc_id"]: r for r in find_runs(frame(spark, rows), min_exponent=exponent, min_length=least).collect()}
    for i, text, *_ in rows:
        want = brute(words(text), exponent, least)
        assert [tuple(r) for r in got[i]["runs"]] == want
        assert got[i]["collapsed_text"] == collapsed(words(text), want)
        top = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert (tuple(got[i]["best"]) if got[i]["best"] else None) == top


def test_edges(spark):
    rows = edge_rows() + [(50, "a " * 40_000, "en", "a"), (51, "x y z " * 5 + "x y", "en", "a"), (52, "a a a a a", "en", "a")]
    got = find_runs(frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "best", "collapsed_text"]
    out = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert out[1]["runs"] == [] and out[1]["collapsed_text"] == "" and out[1]["best"] is None and out[2]["n_words"] == 0
    assert [tuple(r) for r in out[50]["runs"]] == [(0, 40_000, 1)] and out[50]["collapsed_text"] == "a"
    assert [tuple(r) for r in out[51]["runs"]] == [(0, 17, 3)] and out[51]["collapsed_text"] == "x y z"
    assert out[52]["runs"] == [] and out[52]["collapsed_text"] == "a a a a a"
    assert find_runs(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        find_runs(frame(spark, rows), min_exponent=1)


def test_extensions_and_stretches():
    rng = random.Random(5)
    for _ in range(100):
        text = [rng.randrange(3) for _ in range(rng.randint(2, 40))] + [3]
        lce = Extensions(text, 4)
        pairs = [(a, b) for a in range(len(text)) for b in range(len(text)) if a != b]
        got = lce.common(*map(__import__("numpy").array, zip(*pairs)))
        for (a, b), n in zip(pairs, got.tolist()):
            want = 0
            while max(a, b) + want < len(text) and text[a + want] == text[b + want]:
                want += 1
            assert n == want
    assert gram_words(4, 6) == 5 and gram_words(2, 2) == 1
    codes = [word_codes("a b c d e f g h"), word_codes("p q r s t a b c d e f g h p q r s t")]
    assert [(d, a, len(c)) for d, a, c in live_stretches(codes, 4, 6)] == []  # each five words come twice, but five words are no run
    assert [(d, a, len(c)) for d, a, c in live_stretches([word_codes("x " * 9)], 4, 6)] == [(0, 0, 9)]


def test_query_equals_brute_force_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: words(r["text"]) for r in looped_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == {
        i: looped(i, t) for i, t in docs.items()}
    rows = LLM_QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = looped(r["doc_id"], docs[r["doc_id"]])
        if len(w) > 3000:
            continue  # the plain search takes a time in the square of the words
        want = brute(w)
        top = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, want).encode()).hexdigest()


def test_words_in_blocks(monkeypatch):
    text = "alpha \t beta\n" * 50 + "ß\x1c é"
    whole = word_codes(text).tolist()
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    assert word_codes(text).tolist() == whole and len(whole) == len(words(text))
    assert pa.array([text])[0].as_py().encode().split() == [w.encode() for w in words(text)]
