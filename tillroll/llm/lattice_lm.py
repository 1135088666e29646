"""Operator 5: language-model scores from a subword lattice over an existing vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import crc32_mod, stored

#: Frequent words whose counts and scores go to every executor; all other words are joined.
HEAD_WORDS = 150_000
#: Bytes of these words at most.
HEAD_BYTES = 16 << 20
#: Distinct words a task counts before it passes the counts on.
FLUSH = 300_000
#: Words up to this many bytes are scored many at a time.
SHORT = 1024

_MARK = "▁"  # how the vocabulary writes the start of a word
_START = b" "  # a byte that no word holds stands for it here


@dataclass
class Pieces:
    """The vocabulary's pieces as bytes, and their log10 probabilities."""

    path: str
    ids: dict[bytes, list[int]] = field(default_factory=dict)
    by_length: list = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Pieces of a sentencepiece vocabulary; a byte may be written as itself and as its byte piece."""
        from sentencepiece import SentencePieceProcessor

        model, out = SentencePieceProcessor(model_file=path), cls(path)
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                raw = bytes([int(model.id_to_piece(i)[1:-1], 16)])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                piece = model.id_to_piece(i)
                if _MARK in piece[1:]:
                    continue  # white space inside a piece never occurs in a word
                raw = piece.replace(_MARK, _START.decode()).encode()
            out.ids.setdefault(raw, []).append(i)
        if not all(bytes([b]) in out.ids for b in range(256)):
            raise ValueError("the vocabulary must have a piece for every byte")
        return out

    def score(self, counts: np.ndarray, total: float) -> Pieces:
        """Give every piece log10((count + 0.5) / total); pieces of the same bytes add up."""
        p = (counts + 0.5) / total
        by: dict[int, list[tuple[int, float]]] = {}
        for raw, ids in self.ids.items():
            by.setdefault(len(raw), []).append((_key(raw), float(np.log10(sum(p[i] for i in ids)))))
        self.by_length = []
        for n in sorted(by):
            keys, logs = zip(*sorted(by[n]))
            self.by_length.append((n, np.array(keys, np.uint64), np.array(logs)))
        return self


_BASE = 0x9E3779B97F4A7C15


def _key(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def word_scores(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """log10 of each word's probability: the sum over all ways to write it, with its start mark, as a sequence of pieces."""
    out = np.zeros(len(words))
    marked = [_START + w for w in words]
    order = sorted(range(len(words)), key=lambda i: len(marked[i]))
    at = 0
    while at < len(order) and len(marked[order[at]]) <= SHORT:
        end, least = at, len(marked[order[at]])
        while end < len(order) and (n := len(marked[order[end]])) <= min(SHORT, least * 5 // 4 + 1) and (end - at) * n < 400_000:
            end += 1
        some = order[at:end]
        longest = len(marked[some[-1]])
        text = np.frombuffer(b"".join(marked[i].ljust(longest, b"\0") for i in some), np.uint8).reshape(-1, longest)
        out[some] = _forward(text, np.array([len(marked[i]) for i in some]), pieces)
        at = end
    for i in order[at:]:
        out[i] = _forward_long(np.frombuffer(marked[i], np.uint8), pieces)
    return out


def _lookup(h: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, logs[at], -np.inf)


def _edges(text: np.ndarray, pieces: Pieces):
    """For every piece length n, log10 probabilities of the pieces that end at each place; text: words x bytes."""
    b, h, done = text.astype(np.uint64) + np.uint64(1), None, 0
    for n, keys, logs in pieces.by_length:
        if n > text.shape[1]:
            return
        while done < n:  # hash of the last ``done`` bytes up to each place
            h = b.copy() if h is None else h[:, :-1] * np.uint64(_BASE) + b[:, done:]
            done += 1
        yield n, _lookup(h, keys, logs)


def _forward(text: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Forward recursion in log space over words of similar length, all at once; what follows a word's own length is not used."""
    words, n = text.shape
    edges = list(_edges(text, pieces))
    alpha = np.full((n + 1, words), -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        into = np.array([alpha[j - m] + e[:, j - m] for m, e in edges if m <= j])
        top = into.max(axis=0)
        alpha[j] = top + np.log10((10.0 ** (into - top)).sum(axis=0))
    return alpha[lengths, np.arange(words)]


def _forward_long(text: np.ndarray, pieces: Pieces, block: int = 1 << 16) -> float:
    """The same for one word of any length, in blocks of places; only the last few sums are kept."""
    longest = pieces.by_length[-1][0]
    alpha = np.full(longest + 1, -np.inf)  # alpha[-m]: log10 probability of the text up to m bytes before the current place
    alpha[-1] = 0
    for at in range(0, len(text), block):
        end, back = min(len(text), at + block), min(at, longest - 1)
        part = text[at - back : end][None, :]
        lengths, rows = [], []
        for m, e in _edges(part, pieces):
            row = np.full(end - at, -np.inf)
            places = e[0]  # piece that starts at place p of part ends at p + m
            ends = np.arange(len(places)) + m - back - 1
            row[ends[ends >= 0]] = places[ends >= 0]
            lengths.append(m)
            rows.append(row)
        lengths, table = np.array(lengths), np.array(rows)
        for j in range(end - at):
            into = alpha[-lengths] + table[:, j]
            top = into.max()
            alpha[:-1] = alpha[1:]
            alpha[-1] = top + np.log10((10.0 ** (into - top)).sum())
    return float(alpha[-1])


def tokens_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                    held_out_fold: int = 1, head_words: int = HEAD_WORDS) -> DataFrame:
    """log10 probability of every text under a subword lattice model.

    ``vocabulary`` is the path, on driver and executors, of a sentencepiece file;
    its pieces stay as they are. Training texts are those whose
    crc32(id as text) modulo ``folds`` is not ``held_out_fold``. A text is its
    words, lower-cased in A-Z, and an end. The words' pieces in training texts are
    counted as the tokenizer writes them, and give each piece the unigram
    score log10((count + 0.5) / (total + 0.5 pieces)); the end is one more piece. The
    probability of a word is the sum over all its segmentations
    into pieces (by log-space forward recursion over the bytes, with a mark at the word's start; bytes are
    pieces, so every text has a probability), and that of a text the product over its words and the end.

    Words are counted and scored once each over the whole corpus. The
    ``head_words`` most frequent ones of all texts, training or not, go to the executors (at most, and at most
    ``HEAD_BYTES`` of them); each text's other words are joined with the table of all words, which is never
    collected. None of those is a hot key: see ``most_frequent``.

    Returns one row per input row: the id, ``held_out``, ``n_tokens`` (words
    and the end), ``n_known`` (tokens that occur in training texts),
    ``train_tokens``, ``base_score`` (smoothed log10 unigram score of the
    whole words: (c + 0.5) / (N + 0.5 (V + 1))) and ``score``. A null text
    is the empty one: only an end. A null id counts as the empty text in the crc. Repeated rows are
    scored, and counted, each for itself. Without training texts all counts are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (crc32_mod(id_col, folds) == held_out_fold).alias("held_out"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = Counter(), Counter()
        for part in parts:
            for text, held in zip(part.column(0), part.column(1).to_pylist()):
                if held:
                    other.update(tokens_of(text.as_py()))
                else:
                    known.update(tokens_of(text.as_py()))
                if len(known) + len(other) > FLUSH:
                    yield _counted(known, other)
                    known, other = Counter(), Counter()
        yield _counted(known, other)

    words = rows.select("text", "held_out").mapInArrow(count, "word binary, c long, m long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("m").alias("m"))
    words = stored(words, "lm-words")
    ends = rows.where(~F.col("held_out")).count()
    total = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_tokens, v = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=vocabulary)
        counts = np.zeros(model.vocab_size(), np.int64)
        for part in parts:
            # A word that isn't UTF-8 can't come from a text.
            texts = [w.decode() for w in part.column(0).to_pylist()]
            for ids, c in zip(model.encode(texts, num_threads=1), part.column(1).to_pylist()):
                for i in ids:
                    counts[i] += c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["piece", "c"])

    cuts = words.where("c > 0").mapInArrow(cut, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c"))
    found = cuts.collect()  # at most one row per piece of the vocabulary
    pieces = Pieces.load(vocabulary)
    size = 1 + max(i for ids in pieces.ids.values() for i in ids)
    counts = np.zeros(max([size, *(r["piece"] + 1 for r in found)]))
    for r in found:
        counts[r["piece"]] = r["c"]
    used = [i for ids in pieces.ids.values() for i in ids]
    mass = counts[used].sum() + ends + 0.5 * (len(used) + 1)
    shared = spark.sparkContext.broadcast(pieces.score(counts, mass))
    end_score = float(np.log10((ends + 0.5) / mass))

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = word_scores(part.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=["word", "c", "m", "lp"])

    words = stored(words.mapInArrow(weigh, "word binary, c long, m long, lp double"), "lm-scores")
    base_mass = float(np.log10(n_tokens + 0.5 * (v + 1)))

    head = most_frequent(words, head_words).select("word", "c", "lp").toArrow()
    in_training = head.column(1).to_numpy()
    table = dict(zip(head.column(0).to_pylist(),
                     zip((in_training > 0).tolist(), np.log10(in_training + 0.5).tolist(), head.column(2).to_numpy().tolist())))
    frequent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("struct<n:bigint,known:bigint,base:double,score:double,rest:array<binary>,times:array<int>>")
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = frequent.value.get
        for part in parts:
            n, known, b, s, rest, times, at = [], [], [], [], [], [], [0]
            for text in part:
                own = Counter(tokens_of(text.as_py()))
                seen = hits = 0
                b_sum = s_sum = 0.0
                for w, c in own.items():
                    seen += c
                    if (x := get(w)) is not None:
                        hits += c * x[0]
                        b_sum += c * x[1]
                        s_sum += c * x[2]
                    else:
                        rest.append(w)
                        times.append(c)
                n.append(seen)
                known.append(hits)
                b.append(b_sum)
                s.append(s_sum)
                at.append(len(rest))
            offsets = pa.array(at, pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64()),
                 pa.ListArray.from_arrays(offsets, pa.array(rest, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=["n", "known", "base", "score", "rest", "times"])

    texts = stored(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "held_out", split("text").alias("x")), "lm-texts")
    rare = texts.select("rid", F.explode(F.arrays_zip("x.rest", "x.times")).alias("w")).select(
        "rid", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(words.drop("m"), "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("base2"), F.sum(F.col("times") * F.col("lp")).alias("score2"))
    tokens = F.col("x.n") + 1
    zero = F.lit(0.0)
    end_base = float(np.log10(ends + 0.5))
    return texts.join(rare, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", tokens.alias("n_tokens"),
        (F.col("x.known") + F.coalesce("known2", F.lit(0)) + (1 if ends else 0)).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("x.base") + F.coalesce("base2", zero) + end_base - tokens * base_mass).alias("base_score"),
        (F.col("x.score") + F.coalesce("score2", zero) + end_score).alias("score"))


def most_frequent(words: DataFrame, rows: int, size: int = HEAD_BYTES) -> DataFrame:
    """The most frequent of ``words`` (word, m: times in all texts), at most ``rows`` of them with at most ``size`` bytes in all.

    Whole ranges of frequency are taken, from a power of two to the next, the highest
    first, until one doesn't fit. The words of that range number more than ``rows``, together with those
    taken, each at least half as frequent as any word left out; so a word left out makes up
    less than 2 / ``rows`` of all words, or, for its length, 2 / ``size`` of all their bytes.
    """
    power = F.floor(F.log2("m"))
    ranges = words.groupBy(power.alias("power")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).orderBy(F.desc("power")).collect()
    least = None
    for r in ranges:  # at most 64
        rows, size = rows - r["n"], size - r["size"]
        if rows < 0 or size < 0:
            break
        least = r["power"]
    return words.where(power >= least) if least is not None else words.where("false")


def _counted(known: Counter, other: Counter) -> pa.RecordBatch:
    """Of every word how often it occurs in training texts (``known``), and in them and the ``other`` ones."""
    new = [w for w in other if w not in known]
    return pa.RecordBatch.from_arrays(
        [pa.array([*known, *new], pa.binary()), pa.array([*known.values(), *[0] * len(new)], pa.int64()),
         pa.array([*(c + other[w] for w, c in known.items()), *(other[w] for w in new)], pa.int64())], names=["word", "c", "m"])
