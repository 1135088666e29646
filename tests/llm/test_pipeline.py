"""The pipeline, each stage against a brute-force version on its own input."""

import re
import sys

import pyarrow as pa
from helpers import edge_rows, frame, words

import corpus_pipeline
from tillroll.llm.common import stored
from tillroll.llm.near_dedup import inverse_frequencies, shingles_of, similarity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "decontam", "mix", "shard"]

    told = stored(stages["language"](spark, docs, SF), "t")
    assert told.columns == columns
    before, after = docs.collect(), told.collect()
    assert set(after) <= set(before)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(r["doc_id"] in gone for r in before if not re.search(r"[^\W\d_]", r["text"] or "")) and len(gone) <= 0.05 * len(before)

    unique = stored(stages["near_dedup"](spark, told, SF), "t")
    kept = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert unique.columns == columns and len(kept) == unique.count()
    idf = inverse_frequencies(told.where("text is not null").select("text"))
    own = dict(zip((r["doc_id"] for r in after), shingles_of(pa.array([r["text"] for r in after]))))
    ids = sorted(own)
    link = {i: [j for j in ids if j != i and similarity(own[i], own[j], idf) >= 0.8] for i in ids}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in link[todo.pop()] if j not in seen and not seen.add(j)]
        assert sum(j in kept for j in seen) >= 1 and (i in kept) == (i == min(seen))

    clean = stored(stages["decontam"](spark, unique, SF), "t")
    assert clean.columns == columns
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + min(10, len(w))]) for w in items if w for k in range(max(1, len(w) - 9))}

    def dirty(t):
        w = words(t)
        return any(tuple(w[p:p + n]) in grams for n in {len(g) for g in grams} for p in range(len(w) - n + 1))

    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in kept.items() if not dirty(t)}

    mixed = stored(stages["mix"](spark, clean, SF), "t")
    assert mixed.columns == columns
    count = {}
    for r in mixed.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert max(count.values()) <= 2 and set(count) <= {r["doc_id"] for r in clean.collect()}

    last = stages["shard"](spark, mixed, SF)
    assert last.columns == [*columns, "shard", "slot"]
    rows = last.collect()
    assert len(rows) == mixed.count()
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_on_edge_rows(spark, tmp_path):
    for df in (frame(spark, edge_rows()), frame(spark, edge_rows()).where("false")):
        out, before = df, {repr(tuple(r[c] for c in df.columns if c not in ("shard", "slot"))) for r in df.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, SF), "t")
            rows = out.collect()
            # every row is one of the input, whole, but for the columns that the last stage replaces
            assert {repr(tuple(r[c] for c in df.columns if c not in ("shard", "slot"))) for r in rows} <= before, name
            if name in ("language", "near_dedup", "decontam"):
                assert all(any(c.isalpha() for c in r["text"] or "") for r in rows)
            if name == "near_dedup":
                assert len({r["text"] for r in rows}) == len(rows)
        assert set(out.columns) == set(df.columns)
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and bool(slots) == bool(before)


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (root / "tillroll").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in re.findall(r"^\s*(?:from|import)\s+tillroll\.(\w+)", p.read_text(), re.M), p
    assert "tillroll.llm.near_dedup" in sys.modules
