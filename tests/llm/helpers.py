"""Small inputs for the training-data operators."""

import random
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Extra columns whose names the operators use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, size long, digest string, "
          "class_id long, label string, hits string, n_words int, copies string, _row string, part int, nid long, word string")


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def prose(rng, n, vocab=400):
    return " ".join(f"w{int(vocab * rng.random() ** 2)}" for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 7, 9, 9, -1, "x", -1, "x", "x", 1, "y", "z", 3, 4, "w") for r in rows], SCHEMA)


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(4)
    long_text = prose(rng, 30_000, 5000) + "\n" + "x" * 3000 + "\n\n" + "ß é 漢字 " * 50
    same = "The same line stands in many documents\nand more " + prose(rng, 30)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, long_text, "en", "b"), (4, same, "en", None), (5, same, None, "a"),
            (6, same, "fr", "a"), (6, same, "fr", "a"), (None, same, "fr", "b"), (7, " \t\n\x0b\x0c\r ", "en", "c"), (8, "!!! ... 123", "en", "c"),
            (9, "one", "fr", "c"), (10, "one", "fr", "c"), (None, None, None, None), (11, "a\n\na\n", "en", "a"), (6, "other text with the id six", "en", "b")]
    return rows + [(100 + i, prose(rng, 20 + 7 * i), ("en", "fr")[i % 2], "abc"[i % 3]) for i in range(20)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
