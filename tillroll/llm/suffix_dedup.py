"""Removing every byte of a string that starts anywhere else too, by external induced suffix sorting of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import _POW, _POW_INV, BLOCK, flat_bytes, mix, row_numbered, slices, small_side, stored
from tillroll.llm.induced_sort import suffix_order

#: Bytes of pieces that one shard sorts; a group of pieces above half of it is split.
SHARD_BYTES = 2 << 20
#: Bytes of suffix tuples that a shard holds before it spills.
QUEUE_BYTES = 64 << 20
_KEY = ["g1", "g2"]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, spans, kept.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes
    that covers it also starts at another place, in the same document or in
    another; all strings are judged on the input. ``spans`` lists the maximal
    removed runs as (start, end), the end not included; ``kept`` is the rest, as binary.

    1. Of every window of ``length`` bytes, the gram of smallest hash is the
       anchor (leftmost among equals): equal windows have equal anchors at equal
       offsets. The windows of one anchor place are consecutive and make a
       piece. Pieces of equal bytes are counted and stand for one another from here on.
    2. Only pieces of one anchor gram can share a window. Grams with one
       distinct piece need no comparison. Where a group of pieces exceeds half
       a shard, it is halved by the windows' distance to the anchor, again and
       again if need be: each half is told by the bytes all its windows hold,
       so that windows parted are different. A half of one window is settled by that.
    3. Groups are dealt to shards of about ``shard_bytes``. Each shard sorts its
       suffixes with their common prefixes (``induced_sort``); neighbours with
       ``length`` bytes in common are repeats.

    No group of copies, however large, meets in one task: equal pieces are
    counted by partial aggregation, and the groups of different pieces are split as above.

    A null text counts as empty. A text shorter than ``length`` keeps all.
    Ids are only passed on: null and repeated ones are rows of their own, and
    rows that repeat a text lose every byte of it that a string of ``length`` covers.
    A very long text is read in blocks. An empty table gives none; other columns are ignored.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    rows = row_numbered(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "repeats-texts")
    gram = max(1, 2 * length // 5)
    seen = stored(rows.mapInArrow(_pieces(length, gram), "f long, r long, s long, m int, a int, h long, d1 long, d2 long"), "repeats-pieces")
    one = ("f", "r", "s", "m", "a")  # all from one of the equal pieces, whichever it is
    distinct = stored(seen.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in one]), "repeats-distinct")
    # windows of pieces that occur more than once are repeats wherever they occur
    more = distinct.where("n > 1").select("d1", "d2")
    found = seen.select("f", "r", "s", "m", "d1", "d2").join(more, ["d1", "d2"]).select("f", "r", F.col("s").alias("b"), (F.col("s") + F.col("m")).alias("e"))
    for part in _compared(rows, distinct, length, gram, shard_bytes, queue_bytes):
        found = found.unionByName(part)
    spans = found.groupBy("f", "r").agg(F.collect_list(F.struct("b", "e")).alias("w"))  # at most one for every few bytes of a text
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    cut = rows.join(spans, ["f", "r"], "left").select("id", "text", "w").mapInArrow(_cut(length), kind)
    return cut.withColumnRenamed("id", id_col)


def _compared(rows: DataFrame, distinct: DataFrame, length: int, gram: int, shard_bytes: int, queue_bytes: int) -> list[DataFrame]:
    """The ranges (f, r, b, e) of windows that different pieces share."""
    mixed = distinct.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h")
    wanted = distinct.join(mixed, "h", "left_semi")
    of_row = wanted.groupBy("f", "r").agg(F.collect_list(F.struct("h", "s", "m", "a", "n")).alias("w"))
    size = 1 << (length - gram).bit_length()  # distances to the anchor are below length - gram + 1
    kind = "g1 long, g2 long, f long, r long, s long, m int, a int, n long, b binary"
    pieces = stored(rows.join(of_row, ["f", "r"]).select("f", "r", "text", "w").mapInArrow(_cut_pieces(length), kind), "repeats-mixed")
    found, sorted_parts = [], []
    while True:
        sums = pieces.groupBy(_KEY).agg(F.sum(F.octet_length("b")).alias("bytes"))
        large = stored(sums.where(F.col("bytes") > shard_bytes // 2), "repeats-large")
        n = large.count()
        large = small_side(large.select(_KEY), n)
        sorted_parts.append(pieces.join(large, _KEY, "left_anti") if n else pieces)
        if not n:
            break
        halves = stored(pieces.join(large, _KEY, "left_semi").mapInArrow(_halved(length, size), kind + ", u1 long, u2 long"), "repeats-halves")
        size //= 2
        state = halves.groupBy(_KEY).agg(
            F.count("*").alias("k"), F.min(F.struct("u1", "u2")).alias("lo"), F.max(F.struct("u1", "u2")).alias("hi")).where("k > 1")
        state = stored(state.select(*_KEY, (F.col("lo") == F.col("hi")).alias("same")), "repeats-state")
        halves = halves.drop("u1", "u2").join(state, _KEY)
        found.append(halves.where("same and n = 1").select("f", "r", F.col("s").alias("b"), (F.col("s") + F.col("m")).alias("e")))
        pieces = stored(halves.where("not same").drop("same"), "repeats-mixed")
    for part in sorted_parts:
        total = part.agg(F.sum(F.octet_length("b"))).first()[0] or 0
        shard = F.pmod(F.xxhash64(*_KEY), F.lit(1 + total // shard_bytes))
        found.append(part.withColumn("shard", shard).groupBy("shard").applyInArrow(
            _sorted_shard(length, queue_bytes), "f long, r long, b long, e long"))
    return found


# ---------------------------------------------------------------- in the tasks


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor place, hash of the anchor gram) of every piece of the texts that lie end to end in ``data``."""
    reach = length - gram + 1  # grams of a window
    out = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK - length):
        block = data[at : at + BLOCK - 1]
        n = len(block) - length + 1
        prefix = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _POW[: len(block)], out=prefix[1:])
        grams = mix((prefix[gram:] - prefix[:-gram]) * _POW_INV[: len(block) - gram + 1])
        low = np.full(-(-len(grams) // reach) * reach, np.iinfo(np.uint64).max)
        low[: len(grams)] = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        by = low.reshape(-1, reach)
        before = np.minimum.accumulate(by, axis=1).ravel()
        after = np.minimum.accumulate(by[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:n], before[reach - 1 : reach - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        # windows that would go beyond their text
        bound = np.zeros(n + 1, np.int64)
        ends = offsets[1:] - at
        begins = np.maximum(offsets[:-1] - at, ends - length + 1)
        some = (ends > 0) & (begins < n) & (begins < ends)
        np.add.at(bound, np.maximum(begins[some], 0), 1)
        np.add.at(bound, np.minimum(ends[some], n), -1)
        place[np.cumsum(bound[:n]) > 0] = -1
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, n))
        inside = place[first] >= 0
        first, count = first[inside], count[inside]
        anchor = place[first]
        out.append(np.stack([first + at, count, anchor + at, grams[anchor].view(np.int64)], axis=1))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    found = np.concatenate(out)
    # a piece that goes over the edge of a block is one piece
    joined = np.concatenate([[False], (found[1:, 2] == found[:-1, 2]) & (found[1:, 0] == found[:-1, 0] + found[:-1, 1])])
    group = np.flatnonzero(~joined)
    total = np.add.reduceat(found[:, 1], group) if len(group) else np.zeros(0, np.int64)
    return found[group, 0], total, found[group, 2], found[group, 3]


def _digests(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.md5(p).digest() for p in parts), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _pieces(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, f, r = 0, batch.column("f").to_numpy(), batch.column("r").to_numpy()
            for texts in slices(batch.column("text")):
                data, offsets = flat_bytes(texts)
                first, count, anchor, h = anchors(data, offsets, length, gram)
                doc = np.searchsorted(offsets, first, "right") - 1
                view = memoryview(data)
                d1, d2 = _digests(view[a:b] for a, b in zip(first.tolist(), (first + count - 1 + length).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[at + doc]), pa.array(r[at + doc]), pa.array(first - offsets[doc]), pa.array(count.astype(np.int32)),
                     pa.array((anchor - first).astype(np.int32)), pa.array(h), pa.array(d1), pa.array(d2)],
                    ["f", "r", "s", "m", "a", "h", "d1", "d2"])
                at += len(texts)

    return run


def _cut_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                data, offsets = flat_bytes(texts)
                lists = batch.column("w").slice(at, len(texts))
                w = lists.flatten()
                doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                s, m = w.field("s").to_numpy(), w.field("m").to_numpy()
                begin = offsets[doc] + s
                view = memoryview(data)
                b = [view[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + m - 1 + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [w.field("h"), pa.array(np.zeros(len(s), np.int64)), batch.column("f").slice(at, len(texts)).take(doc),
                     batch.column("r").slice(at, len(texts)).take(doc), w.field("s"), w.field("m"), w.field("a"), w.field("n"),
                     pa.array(b, pa.binary())], ["g1", "g2", "f", "r", "s", "m", "a", "n", "b"])
                at += len(texts)

    return run


def _halved(length: int, size: int):
    """Each piece as two, by the windows' distance to the anchor.

    All pieces of a group hold windows of distances in one range of ``size``
    that begins at a multiple of it. A half is told by its group, its range and the bytes common to every window of that range.
    """
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                least = p["a"] - p["m"] + 1
                for x in range(least // half * half, p["a"] + 1, half):
                    t0, t1 = max(0, p["a"] - (x + half - 1)), min(p["m"] - 1, p["a"] - x)
                    m, a, b = t1 - t0 + 1, p["a"] - t0, p["b"][t0 : t1 + length]
                    common = b[a - x : a - (x + half - 1) + length] if half > 1 else b
                    g = hashlib.md5(f"{p['g1']},{p['g2']},{x};".encode() + common).digest()
                    u = hashlib.md5(b).digest()
                    out.append((*np.frombuffer(g, np.int64).tolist(), p["f"], p["r"], p["s"] + t0, m, a, p["n"], b, *np.frombuffer(u, np.int64).tolist()))
            cols = list(zip(*out)) or [[]] * 11
            names = [*batch.schema.names, "u1", "u2"]
            types = [*batch.schema.types, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _sorted_shard(length: int, queue_bytes: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        data, offsets = flat_bytes(shard.column("b"))
        n, count = len(shard), shard.column("m").to_numpy()
        # bytes from 2 up; 1 after every piece, 0 at the end
        text = np.zeros(len(data) + n + 1, np.uint16)
        text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data.astype(np.uint16) + 2
        begin = offsets[:-1] + np.arange(n)
        text[offsets[1:] + np.arange(n)] = 1
        order, common = suffix_order(text, length, queue_bytes)
        pairs = np.flatnonzero(common >= length)
        hit = np.zeros(len(text) + 1, bool)
        hit[order[pairs]] = True
        hit[order[pairs - 1]] = True
        # a window's start is one of the first m places of its piece; pieces that occur more than once are known already
        piece = np.repeat(np.arange(n), count)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + begin[piece]
        wanted = hit[place] & (shard.column("n").to_numpy()[piece] == 1)
        piece, place = piece[wanted], (place - begin[piece])[wanted]
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)])[: len(piece)])
        last = np.append(new[1:], len(piece))[: len(new)] - 1
        s = shard.column("s").to_numpy()
        return pa.table({"f": shard.column("f").take(piece[new]), "r": shard.column("r").take(piece[new]),
                         "b": pa.array(s[piece[new]] + place[new]), "e": pa.array(s[piece[new]] + place[last] + 1)})

    return run


def _cut(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                data, offsets = flat_bytes(texts)
                spans, kept = [], []
                for i, w in enumerate(batch.column("w").slice(at, len(texts))):
                    whole = memoryview(data[offsets[i] : offsets[i + 1]])
                    merged = _merged(w, length) if w.is_valid else []
                    edges = [0, *(x for pair in merged for x in pair), len(whole)]
                    kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"])
                at += len(texts)

    return run


def _merged(windows: pa.ListScalar, length: int) -> list[tuple[int, int]]:
    """The removed runs: each range of window starts with the last window's bytes, joined where they touch."""
    b, e = (windows.values.field(c).to_numpy() for c in ("b", "e"))
    by = np.argsort(b, kind="stable")
    start, end = b[by], np.maximum.accumulate(e[by] - 1 + length)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()))
