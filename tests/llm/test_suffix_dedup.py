import hashlib
import random

import numpy as np
import pytest
from helpers import edge_rows, frame, prose

from tillroll.llm import induced_sort
from tillroll.llm.catalog import LLM_QUERIES
from tillroll.llm.suffix_dedup import anchors, remove_repeats


def brute(texts, length):
    """Spans and kept bytes per text, from a count of every window."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cut = np.cumsum(gone)[: len(d)] > 0
        edge = np.diff(np.concatenate([[0], cut.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~cut])))
    return out


def got_rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def want_rows(rows, length):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length))), key=repr)


def planted(seed, passages=4, size=90):
    """Texts with shared passages around the length, cut and shifted, with copies, and with one passage in a third of them."""
    rng = random.Random(seed)
    shared = [prose(rng, size // 4, 60) for _ in range(passages)]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randint(0, 30), 50)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a, b = rng.randint(0, 20), rng.randint(len(p) - 20, len(p))
            parts += [p[a:b], prose(rng, rng.randint(0, 12), 50)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[0])
        rows.append((i, "".join(parts), "en", "a"))
    rows += [(100 + i, rows[7][1], "en", "a") for i in range(5)]
    return rows + [(200, "ab" * 200, "en", "a"), (201, "é" * 90, "en", "a"), (202, "\0" * 50, "en", "a"), (203, "x" * 39, "en", "a"), (204, "x" * 40, "en", "a")]


@pytest.mark.parametrize("length, shard_bytes, queue_bytes", [(40, 1 << 20, 1 << 20), (40, 3000, 2000), (40, 200, 1 << 20), (64, 800, 500), (2, 4000, 1 << 16)])
def test_equals_brute_force(spark, length, shard_bytes, queue_bytes):
    rows = planted(length + shard_bytes) if length > 2 else planted(3)[:12]
    got = remove_repeats(frame(spark, rows), length, shard_bytes=shard_bytes, queue_bytes=queue_bytes)
    assert got_rows(got) == want_rows(rows, length)


def test_edges(spark):
    rows = edge_rows()
    got = remove_repeats(frame(spark, rows), 60, shard_bytes=4000)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert got_rows(got) == want_rows(rows, 60)
    assert remove_repeats(frame(spark, rows).where("false"), 60).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, rows), 1)


def test_query_equals_brute_force_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for (i, _), (n, spans, kept) in
            zip(rows, brute([t for _, t in rows], 400))}
    got = LLM_QUERIES["op11_remove_repeats"](spark, sf).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert sum(r["n_removed"] for r in got) > 0


def test_anchors_do_not_depend_on_the_block(monkeypatch):
    from tillroll.llm import suffix_dedup
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 200))) for _ in range(20)] + [b"z" * 100]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = [x.tolist() for x in anchors(data, offsets, 30, 12)]
    starts = {s + i for s, m in zip(whole[0], whole[1]) for i in range(m)}
    assert starts == {o + i for o, t in zip(offsets.tolist(), texts) for i in range(len(t) - 29)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    assert [x.tolist() for x in anchors(data, offsets, 30, 12)] == whole


@pytest.mark.parametrize("memory", [64, 500, 1 << 20])
def test_suffix_order(monkeypatch, memory):
    monkeypatch.setattr(induced_sort, "BLOCK", 7)
    rng = random.Random(memory)
    for _ in range(150):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 90))]
        if text and rng.random() < 0.5:
            text = (text[: rng.randint(1, len(text))] * 9)[:150]
        text, cap = [*text, 0], rng.choice([4, 30, 500])
        order, common = induced_sort.suffix_order(np.array(text), cap, memory)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for a, b, n in zip(want, want[1:], common[1:].tolist()):
            both = 0
            while both < cap and text[a + both : a + both + 1] == text[b + both : b + both + 1]:
                both += 1
            assert n == both
