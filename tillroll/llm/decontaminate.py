"""Operator 2: spans that documents share with benchmark items, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import WORD_BYTES, flat_bytes, gram_hashes, mix, slices, small_side, stored, whole_rows, word_hashes

#: Words of one fingerprint. A window of 10 words then has 6 of them, and winnowing over 6 keeps at least one.
GRAM = 5
#: Bits of the filter of item fingerprints per fingerprint, and the bits it has at most (4 MB).
BITS_PER_PRINT, MAX_BITS = 16, 1 << 25

HIT = "array<struct<item:string,first:int,after:int>>"


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions kept by winnowing: those that hold the minimum of some run of ``window`` hashes.

    A run cut off by either end of the array counts too, which only adds positions.
    """
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    top = np.full(window - 1, np.iinfo(np.uint64).max, np.uint64)
    lows = np.lib.stride_tricks.sliding_window_view(np.concatenate([top, grams, top]), window).min(axis=1)
    # lows[p .. p+window-1] are the runs that hold position p
    return np.flatnonzero(grams == np.lib.stride_tricks.sliding_window_view(lows, window).max(axis=1))


class Index:
    """Fingerprints of some benchmark items, and the items' words to extend hits along."""

    def __init__(self, ids: list[str], words: list[np.ndarray], window: int):
        self.ids, self.window, self.words = ids, window, words
        found, self.short = [], {}
        for i, w in enumerate(self.words):
            if len(w) >= window:
                grams = gram_hashes(w, GRAM)
                kept = winnow(grams, window - GRAM + 1)
                found.append((grams[kept], np.full(len(kept), i), kept))
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(gram_hashes(w, len(w))[0]), []).append(i)
        cols = list(zip(*found)) or [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        h, self.item, self.pos = (np.concatenate(c) for c in cols)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.pos = h[order], self.item[order], self.pos[order]

    def match(self, words: np.ndarray, at: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """For every text, its spans (item id, first word, word after) that occur in an item.

        words, at: word hashes of all texts end to end, and the texts' word offsets.
        """
        hits: list[list[tuple[str, int, int]]] = [[] for _ in at[1:]]
        grams = gram_hashes(words, GRAM)
        kept = winnow(grams, self.window - GRAM + 1)  # of the joined texts: a superset of each text's own
        lo, hi = np.searchsorted(self.hashes, grams[kept]), np.searchsorted(self.hashes, grams[kept], "right")
        some = np.flatnonzero(hi > lo)
        done: dict[tuple[int, int, int], int] = {}  # (text, item, diagonal) → first word after the span found there
        for p, a, b in zip(kept[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            t = int(np.searchsorted(at, p, "right")) - 1
            begin, end = int(at[t]), int(at[t + 1])
            if p + GRAM > end:
                continue  # the fingerprint runs over the end of its text
            for j in range(a, b):
                i, q = int(self.item[j]), int(self.pos[j])
                if done.get((t, i, p - q), -1) > p:
                    continue
                first, after = self._extend(words, begin, end, p, self.words[i], q)
                done[t, i, p - q] = after
                if after - first >= self.window:
                    hits[t].append((self.ids[i], first - begin, after - begin))
        for n, known in self.short.items():
            grams = gram_hashes(words, n)
            wanted = np.sort(np.fromiter(known, np.uint64, len(known)))
            near = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
            for p in np.flatnonzero(wanted[near] == grams).tolist():
                t = int(np.searchsorted(at, p, "right")) - 1
                if p + n <= at[t + 1]:
                    hits[t] += [(self.ids[i], p - int(at[t]), p - int(at[t]) + n) for i in known[int(grams[p])]
                                if np.array_equal(self.words[i], words[p : p + n])]
        return hits

    @staticmethod
    def _extend(words, begin, end, p, item, q) -> tuple[int, int]:
        """The longest run around word ``p`` of a text that equals the item's words around ``q``; empty if not even those are equal."""
        n = min(end - p, len(item) - q)
        other = np.flatnonzero(words[p : p + n] != item[q : q + n])
        after = p + (int(other[0]) if len(other) else n)
        n = min(p - begin, q)
        other = np.flatnonzero(words[p - n : p] != item[q - n : q])
        return p - (n - 1 - int(other[-1]) if len(other) else n), after


def short_hash(grams: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of runs of ``n`` words, for items that short, apart from those of other lengths."""
    return mix(grams + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))


def shared_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", out: str = "hits",
                 words_out: str = "n_words", items_out: str = "items") -> DataFrame:
    """Add to every document the spans of words that it shares with benchmark items.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. A
    span is a longest run of words equal in document and item, of at least
    ``window`` words. Items of fewer words, but not none, must occur whole.

    Winnowing keeps, of every ``window - 4`` neighbouring 5-word hashes, the
    smallest, in documents and items alike. Any shared run of ``window`` words
    therefore shares a kept fingerprint at the same place. The fingerprints of
    documents and items are joined; the pairs of document and item so found
    are extended from the fingerprints word by word, which finds every such run and no other.

    Both sides stay distributed. A filter of bounded size over the items' fingerprints goes to the tasks that
    read the documents, so that few others of theirs reach the join; the join itself is exact.
    Equal items are one item with several ids until the end. Whole texts are
    brought to their items only for documents with a common fingerprint.

    Adds ``out``, an array of (item, first word, word after) with the smallest id of the item's text
    as a string; ``items_out``, the ids of all found items as strings, sorted and distinct; and ``words_out``, the number of words. Input
    columns of these names are replaced. A null text or a text without words has no hits. An
    item without words is never found; an item with a null id is reported
    under the empty string. Repeated documents are handled each for
    itself. An empty benchmark finds nothing. Very long texts are read in blocks.
    """
    own = [c for c in docs.columns if c not in (out, words_out, items_out)]
    rows = whole_rows(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in own or c == text_col]), "decontaminate-rows", text=F.col(f"`{text_col}`"))
    hits = _hits(rows.select("f", "r", "text"), benchmark, window, item_col, item_text_col)
    hits = stored(hits, "decontaminate-hits")
    marked = rows.withColumn("_n", _word_counts("text")).join(
        small_side(hits, hits.count(), 100_000), ["f", "r"], "left")
    none, no_items = F.array().cast(HIT), F.array().cast("array<string>")
    return marked.select(*[F.col("_row")[c].alias(c) for c in own], F.coalesce("_hits", none).alias(out),
                         F.coalesce("_items", no_items).alias(items_out), F.col("_n").alias(words_out))


def _hits(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> DataFrame:
    """(f, r, _hits, _items) of the documents with shared spans."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = rows.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    items = items.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.first("text").alias("text"), F.collect_set("id").alias("ids"))
    items = stored(items.mapInArrow(_item_prints(window), "key string, ids array<string>, n int, words binary, prints array<bigint>"), "decontaminate-items")
    prints = items.select("key", F.explode("prints").alias("h"))
    n = prints.count()
    lengths = sorted(r["n"] for r in items.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())  # below window
    seen = spark.sparkContext.broadcast(_filter(prints, n))
    found = rows.mapInArrow(_document_prints(window, lengths, seen), "f bigint, r bigint, h bigint")
    pairs = found.join(prints, "h").select("f", "r", "key").distinct()
    of_doc = pairs.join(items.select("key", "ids", "words"), "key").groupBy("f", "r").agg(F.collect_list(F.struct("key", "ids", "words")).alias("w"))
    of_doc = stored(of_doc, "decontaminate-pairs")
    texts = rows.join(small_side(of_doc, of_doc.count(), 10_000), ["f", "r"])
    return texts.mapInArrow(_extended(window), f"f bigint, r bigint, _hits {HIT}, _items array<string>")


def _word_counts(text: str) -> F.Column:
    """Number of words of a text column; a null text has none."""

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            counts = [np.zeros(0, np.int64)]
            for piece in slices(part):
                data, at = flat_bytes(piece)
                inside = WORD_BYTES[data] != 0
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                first = at[:-1][at[:-1] < len(data)]
                begins[first] = inside[first]
                counts.append(np.diff(np.concatenate([[0], np.cumsum(begins)])[at]))
            yield pa.array(np.concatenate(counts))

    return count(text)


def _filter(prints: DataFrame, n: int) -> np.ndarray:
    """A bit for every value that the top bits of an item's fingerprint take; merged in the tasks, of bounded size."""
    bits = min(MAX_BITS, 1 << max(10, (BITS_PER_PRINT * n).bit_length()))
    shift = 64 - (bits.bit_length() - 1)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for part in parts:
            own[part.column("h").to_numpy().view(np.uint64) >> np.uint64(shift)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for part in parts:
            for row in part.column("bits").to_pylist():
                own |= np.frombuffer(row, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    marked = prints.select("h").coalesce(16).mapInArrow(mark, "bits binary").coalesce(1).mapInArrow(merge, "bits binary").first()
    return np.unpackbits(np.frombuffer(marked["bits"], np.uint8)).astype(bool) if marked else np.zeros(bits, bool)


def _item_prints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(*flat_bytes(batch.column("text")))
            own = [words[a:b] for a, b in zip(at, at[1:])]
            prints = []
            for w in own:
                if len(w) >= window:
                    grams = gram_hashes(w, GRAM)
                    prints.append(np.unique(grams[winnow(grams, window - GRAM + 1)]).view(np.int64))
                else:
                    prints.append(short_hash(gram_hashes(w, len(w)), len(w)).view(np.int64) if len(w) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), pa.array(np.diff(at).astype(np.int32)), pa.array([w.tobytes() for w in own], pa.binary()),
                 pa.array(prints, pa.list_(pa.int64()))], names=["key", "ids", "n", "words", "prints"])

    return run


def _document_prints(window: int, lengths: list[int], seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        shift = np.uint64(64 - (len(bits).bit_length() - 1))
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                words, at = word_hashes(*flat_bytes(texts))
                grams = gram_hashes(words, GRAM)
                kept = winnow(grams, window - GRAM + 1)  # of the joined texts: a superset of each text's own
                found = [(kept, grams[kept], GRAM)]
                for n in lengths:
                    grams = short_hash(gram_hashes(words, n), n)
                    found.append((np.arange(len(grams)), grams, n))
                for place, h, n in found:
                    some = bits[h >> shift]
                    place, h = place[some], h[some]
                    doc = np.searchsorted(at, place, "right") - 1
                    inside = place + n <= at[doc + 1]
                    pairs = np.unique(np.stack([doc[inside], h[inside].view(np.int64)], axis=1), axis=0)
                    doc = done + pairs[:, 0]
                    yield pa.RecordBatch.from_arrays([batch.column("f").take(pa.array(doc)), batch.column("r").take(pa.array(doc)), pa.array(pairs[:, 1])],
                                                     names=["f", "r", "h"])
                done += len(texts)

    return run


def _extended(window: int):
    span = pa.struct([("item", pa.string()), ("first", pa.int32()), ("after", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                wanted, keys = {}, []
                for row in batch.column("w").slice(done, len(texts)).to_pylist():
                    keys.append({item["key"] for item in row})
                    wanted.update((item["key"], item) for item in row)
                index = Index(list(wanted), [np.frombuffer(item["words"], np.uint64) for item in wanted.values()], window)
                hits, items = [], []
                for found in index.match(*word_hashes(*flat_bytes(texts))):
                    hits.append([{"item": min(wanted[k]["ids"]), "first": a, "after": b} for k, a, b in found])
                    items.append(sorted({i for k, _, _ in found for i in wanted[k]["ids"]}))
                at = np.flatnonzero([len(h) > 0 for h in hits])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("f").take(pa.array(done + at)), batch.column("r").take(pa.array(done + at)),
                     pa.array([hits[i] for i in at], pa.list_(span)), pa.array([items[i] for i in at], pa.list_(pa.string()))], names=["f", "r", "_hits", "_items"])
                done += len(texts)

    return run


def covered_words(hits: str) -> F.Column:
    """Number of words inside at least one span of the array ``hits``."""
    step = "struct(acc.n + greatest(0, h.after - greatest(h.first, acc.upto)) as n, greatest(acc.upto, h.after) as upto)"
    return F.expr(f"aggregate(array_sort(transform({hits}, h -> struct(h.first as first, h.after as after))), "
                  f"struct(0 as n, 0 as upto), (acc, h) -> {step}, acc -> cast(acc.n as bigint))")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.0,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, of whose words at most ``max_share`` lie in spans shared with the benchmark."""
    rows = whole_rows(docs, "decontaminate-rows", text=F.col(f"`{text_col}`"))
    hits = _hits(rows.select("f", "r", "text"), benchmark, window, item_col, item_text_col)
    dirty = stored(hits.select("f", "r", covered_words("_hits").alias("_hit")), "decontaminate-dirty")
    marked = rows.join(small_side(dirty, dirty.count()), ["f", "r"], "left")
    clean = F.coalesce("_hit", F.lit(0)) <= (F.lit(max_share) * _word_counts("text") if max_share else F.lit(0))
    return marked.where(clean).select("_row.*")
