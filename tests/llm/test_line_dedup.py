import random

import pytest
from helpers import UPPER, edge_rows, frame, prose

from tillroll.llm import line_dedup
from tillroll.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars):
    by = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = line.strip(SPACE).translate(UPPER)
            if len(k) >= min_chars:
                by.setdefault(k, set()).add((i is not None, i or 0))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(own := by.get(x.strip(SPACE).translate(UPPER), ())) < min_docs or max(own) == (i is not None, i or 0)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"  Shared LINE number {k} of the pool é\t" for k in range(8)] + [f"shared line number {k} of the pool é " for k in range(3)] + ["short", "", " "]
    rows = [(i // 2 if i % 7 == 0 else i, "\n".join(rng.choice([*pool, f"own line of document {i}"]) for _ in range(rng.randint(0, 12))), "en", "a")
            for i in range(80)] + edge_rows()
    rows += [(300, "\n".join(f"line {k % 50} of a text of many lines" for k in range(20_000)), "en", "a")]
    rows += [(301 + j, "\n".join(f"line {k} of a text of many lines" for k in range(50)), "en", "a") for j in range(3)]
    for docs, chars in ((3, 20), (2, 5)):
        got = dedup_lines(frame(spark, rows), docs, chars).select("doc_id", "kept_text", "n_lines", "n_dropped")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, docs, chars)


@pytest.mark.parametrize("lines", [0, 1, 5, 40])
def test_shuffled_joins_give_the_same(spark, monkeypatch, lines):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", lines)
    rng = random.Random(5)
    rows = edge_rows() + [(400 + i // 2, "\n".join(["a line in all of the documents", "own line " + prose(rng, 9)] + [f"shared {rng.randint(0, 9)}"] * 3), "en", "a")
                          for i in range(60)]
    rows += [(None, "a line of texts without an id", None, None)] * 30  # often, but in one document
    got = dedup_lines(frame(spark, rows), 2, 5).select("doc_id", "kept_text", "n_lines", "n_dropped")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2, 5)


def test_places_of_frequent_lines_are_not_shuffled(spark, monkeypatch):
    """Beyond the bound on broadcast lines, a line in a third of all places is not among those shuffled by line."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 20)
    tables = {}
    real = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: tables.setdefault(name, real(df, name)))
    rows = [(i, "\n".join(["a line in all of the documents", f"in three documents: {i // 3}", f"only in document {i}"]), "en", "a") for i in range(90)]
    got = dedup_lines(frame(spark, rows), 3, 5)
    assert got.agg({"n_dropped": "sum"}).first()[0] == 89 + 60
    often = [r for r in tables["known-lines"].collect() if r["hot"]]
    assert len(often) == 1 and often[0]["shared"] and tables["known-lines"].where("shared").count() == 31


def test_empty(spark):
    assert dedup_lines(frame(spark, edge_rows()).where("false")).count() == 0
