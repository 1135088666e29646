import random

import public_tokenizers
import pytest
from helpers import edge_rows, frame
from tokenizers import Tokenizer

from tillroll.llm.token_counts import Counter, token_count

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def texts(rng):
    bits = ["word", "Ünïcode", "don't", "<|endoftext|>", "<|startoftext|>", "  ", "\n", "\t", " ", " ", "漢字", "é", " ́x", "12345",
            "!!??", "\x1c", "\x85", "antidisestablishmentarianism", "'s", "ΑΣ", "😀👩‍👩‍👧", "\u0000", "|>", "<|"]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120))) for _ in range(120)]


@pytest.mark.parametrize("memo", [1_000_000, 5, 0])
def test_equals_the_library(library, monkeypatch, memo):
    from tillroll.llm import token_counts
    monkeypatch.setattr(token_counts, "MEMO", memo)
    counter = Counter(PATH)
    some = texts(random.Random(1))
    want = [library(t) for t in some]
    assert counter.count(some) == want and counter.count(some[::-1]) == want[::-1]
    assert len(counter.memo) <= memo


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (40, 8), (64, 60), (200, 20)])
def test_splicing_equals_the_library(library, chunk, overlap):
    counter = Counter(PATH)
    for t in [*texts(random.Random(3)), "a" * 500, " " * 300, " " + "b" * 400 + " c", "x" * 90 + " " + "y" * 300 + " z " * 50, ""]:
        assert counter.count_long(t, chunk, overlap) == library(t), t


def test_column(spark, library):
    rows = edge_rows() + [(500, "lorem ipsum " * 20_000, "en", "a"), (501, "q" * 140_000, "en", "a")]
    got = frame(spark, rows).select("doc_id", "text", token_count("text", PATH).alias("n")).collect()
    assert [r["n"] for r in got] == [library(r["text"]) for r in got]
    assert frame(spark, rows).where("false").select(token_count("text", PATH)).count() == 0
