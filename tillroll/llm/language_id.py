"""Operator 10: language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-gram dimensions.
BITS = 15
DIM = 1 << BITS
#: Labelled texts per language, on average, that the regression is fitted on. Document frequencies come from all of them.
SAMPLE_PER_LANGUAGE = 1500
BLOCK = 1 << 20
#: Code points whose grams are hashed at a time: bounds the temporary arrays (some 80 bytes a code point).
STEP = 1 << 15

UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter; made on first use in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _code_points(text: str) -> Iterator[np.ndarray]:
    """The lower-cased text's code points, ``STEP`` at a time; lower-cased in larger blocks, since a letter's neighbours may count."""
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for i in range(0, len(code), STEP):
            yield code[i : i + STEP]


def gram_counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram of 1 to 3 characters occurs in the whole text; None if it has no letter.

    Letters are lower-cased; every run of other characters becomes one space.
    """
    letter, counts, tail, any_letter = _is_letter(), None, np.array([32], np.uint32), False
    for code in _code_points(text):
        is_letter = letter[code]
        any_letter |= bool(is_letter.any())
        code = np.concatenate([tail, np.where(is_letter, code, np.uint32(32))])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep]
        old = 0 if counts is None else min(len(tail), 2)  # grams that lie within the carried characters are counted already
        one = code * np.uint32(0x9E3779B1)
        two = code[:-1] * np.uint32(0x85EBCA77) + code[1:] * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + code[2:] * np.uint32(0x165667B1)
        g = np.concatenate([one[old:], two[max(0, old - 1):], three])
        g = (g ^ (g >> np.uint32(16))) * np.uint32(0x7FEB352D)
        found = np.bincount(g >> np.uint32(32 - BITS), minlength=DIM)
        counts = found if counts is None else counts + found
        tail = code[-2:]
    return counts if any_letter else None


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # DIM
    weights: np.ndarray  # DIM x languages, most rows zero
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        return tfidf(counts[at], self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(counts)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
        sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from texts with a known language.

    Rows with a null text or label, or a text without letters, teach nothing. Document
    frequencies count every labelled text once. The regression is fitted, in
    one task, on a sample of about ``sample_per_language`` texts of each language,
    picked by a hash of the id; of that sample a fifth is kept aside to
    calibrate the temperature. Without labelled rows the model has no languages.
    Repeated rows count as often as they occur; rows of equal ids are ordered by label and length for training.
    Very long texts are read whole, in blocks; empty texts have no letter. Other columns are not looked at.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for part in parts:
            for text in part.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())],
                                         names=["gram", "df"])

    df, n = np.zeros(DIM), 0
    for r in rows.select("text").mapInArrow(frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        if r["gram"] < 0:
            n = r["df"]
        else:
            df[r["gram"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((DIM, 0)), np.zeros(0), 1.0)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    known = spark.sparkContext.broadcast((languages, idf))

    @F.arrow_udf("struct<gram:array<int>,n:array<int>>")
    def features(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            grams, ns = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for t in part:  # the dense counts of one text at a time
                counts = gram_counts(t.as_py())
                at = np.flatnonzero(counts) if counts is not None else np.zeros(0, np.int64)
                grams.append(at.astype(np.int32))
                ns.append(counts[at].astype(np.int32) if len(at) else grams[0])
            ends = pa.array(np.cumsum([0] + [len(g) for g in grams[1:]]), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (grams, ns)], names=["gram", "n"])

    sample = (rows.where(draw < F.element_at(share, F.col("label")))
              .select("label", F.xxhash64("id", F.lit(7)).alias("order"), features("text").alias("x")))

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight = known.value
        got = []
        for part in parts:
            labels, order, x = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            grams, ns = x.field("gram"), x.field("n")
            for i, label in enumerate(labels):
                at = grams[i].values.to_numpy()
                if len(at):
                    got.append((order[i], label, at, tfidf(ns[i].values.to_numpy(), weight[at])))
        got.sort(key=lambda g: (g[0], g[1], len(g[2])))
        w, b, t = train_ftrl([(at, x, names.index(label)) for _, label, at, x in got], len(names))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([t])],
                                         names=["w", "b", "t"])

    row = sample.repartition(1).mapInArrow(train, "w binary, b binary, t double").first()
    return Model(languages, idf, np.frombuffer(row["w"]).reshape(DIM, -1), np.frombuffer(row["b"]), row["t"])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, batch: int = 16,
               alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4):
    """Follow the regularised leader with an elastic-net penalty, then temperature scaling.

    rows: (dimensions, values, class), in the order in which they are learnt. Every fifth row only calibrates.
    Returns weights (DIM x classes), bias and temperature.
    """
    learn, aside = [r for i, r in enumerate(rows) if i % 5 != 4], [r for i, r in enumerate(rows) if i % 5 == 4]
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))  # the last row is the bias
    w = np.zeros_like(z)
    penalty = np.full((DIM + 1, 1), l1)
    penalty[-1] = 0
    for _ in range(epochs):
        for at in range(0, len(learn), batch):
            part = learn[at : at + batch]
            dims = np.unique(np.concatenate([d for d, _, _ in part] + [[DIM]]))
            x = np.zeros((len(part), len(dims)))
            for i, (d, v, _) in enumerate(part):
                x[i, np.searchsorted(dims, d)] = v
            x[:, -1] = 1
            p = softmax(x @ w[dims])
            p[np.arange(len(part)), [c for _, _, c in part]] -= 1
            g = x.T @ p
            grown = n[dims] + g * g
            z[dims] += g - (np.sqrt(grown) - np.sqrt(n[dims])) / alpha * w[dims]
            n[dims] = grown
            zd = z[dims]
            w[dims] = -np.sign(zd) * np.maximum(np.abs(zd) - penalty[dims] * len(learn) / batch, 0) / ((beta + np.sqrt(grown)) / alpha + l2)
    weights, bias = w[:DIM].copy(), w[DIM].copy()
    if not aside:
        return weights, bias, 1.0
    logits = np.array([v @ weights[d] + bias for d, v, _ in aside])
    true = np.array([c for _, _, c in aside])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(true)), true] + 1e-12).mean() for t in grid]
    return weights, bias, float(grid[int(np.argmin(loss))])


def language(model: Model, text: Column | str, spark) -> Column:
    """Predict (lang, score) of whole texts: ``und`` and 0.0 if the text is null or has no letter.

    The score is the calibrated probability of the predicted language; of equally probable
    ones the first in code point order is taken. Texts of any length are read whole; repeated rows get equal results. The
    model (a few MB, of fixed size per language) goes to the executors once.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = [shared.value.predict(t.as_py()) for t in part]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["lang", "score"])

    return predict(text)


def keep_identified(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", label_col: str = "lang",
                    id_col: str = "doc_id") -> DataFrame:
    """The documents, with their own columns, whose language is told with a score of at least ``min_score``.

    Learns from the labelled documents themselves. Rejected are null texts,
    texts without letters and texts on which the model cannot decide. Without
    any labelled document nothing can be told, and every text with a letter stays.
    Each of repeated rows is judged alike; an empty table stays empty.
    """
    model = fit(docs, text_col, label_col, id_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    guess = docs.select(F.struct(*own).alias("_row"), language(model, text_col, docs.sparkSession).alias("_guess"))
    return guess.where((F.col("_guess.lang") != UNDETERMINED) & (F.col("_guess.score") >= min_score)).select("_row.*")
