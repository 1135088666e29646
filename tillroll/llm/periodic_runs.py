"""Periodic runs of words: Ukkonen suffix trees of the text and its reversal give common extensions in constant time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import mix, slices

RUN = "struct<start:long,length:long,period:long>"
#: Words that one pair of trees holds, unless one stretch alone has more.
TREE_WORDS = 1 << 15
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, runs, best, collapsed_text.

    Words are maximal runs of characters other than ASCII white space, numbered
    from 0. A run is a maximal stretch of words with smallest period q, at
    least ``max(min_length, min_exponent * q)`` long (``min_exponent`` is 2 or
    more). ``runs`` lists them by start, then period; ``best`` is the one of
    greatest length / period, ties to the smallest start, then period, null if there is none.
    ``collapsed_text`` keeps the words that no run holds after its first
    period, joined by one space.

    Method: words that can lie in no run are cut out first (see
    ``live_stretches``: exact, no run is lost). Over the stretches left,
    suffix trees of the words and of their reversal are built by Ukkonen's
    method; a tour of a tree makes every longest common extension one lookup.
    The longest Lyndon words at every place, in both orders of the words,
    are the candidate roots, extended both ways.

    A null or empty text has no words, no runs and an empty collapsed text;
    null, repeated and any other ids are only passed on; repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    A text is one task's work: its words take 4 bytes each, and some 500
    bytes each where they can lie in a run.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, best {RUN}, collapsed_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 1 << 20):
                codes, found = _runs_of(texts, min_exponent, min_length)
                out = {"n_words": [], "runs": [], "best": [], "collapsed_text": []}
                for text, n, runs in zip(texts, (len(c) for c in codes), found):
                    out["n_words"].append(n)
                    out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    out["best"].append(dict(zip(("start", "length", "period"), best(runs))) if runs else None)
                    out["collapsed_text"].append(_collapsed(text.as_py() or "", n, runs))
                ids = batch.column("id").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out["n_words"], pa.int64()), pa.array(out["runs"], pa.list_(kind)),
                     pa.array(out["best"], kind), pa.array(out["collapsed_text"], pa.string())], ["id", *out])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The (start, length, period) of greatest length / period; the first of ``runs`` among equals."""
    top = runs[0]
    for r in runs[1:]:
        if r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def _collapsed(text: str, n: int, runs: list[tuple[int, int, int]]) -> str:
    data = text.encode()
    if not runs:
        return b" ".join(data.split()).decode()
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, k in zip(data.split(), keep.tolist()) if k).decode()


def _runs_of(texts: pa.Array, min_exponent: int, min_length: int) -> tuple[list[np.ndarray], list[list[tuple[int, int, int]]]]:
    codes = [word_codes(t.as_py()) for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    pending, size = [], 0
    for stretch in live_stretches(codes, min_exponent, min_length):
        if pending and size + len(stretch[2]) > TREE_WORDS:
            _search(pending, found, min_exponent, min_length)
            pending, size = [], 0
        pending.append(stretch)
        size += len(stretch[2])
    if pending:
        _search(pending, found, min_exponent, min_length)
    return codes, [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def word_codes(text: str | None) -> np.ndarray:
    """The words of a text as numbers, equal for equal words; read in blocks that end between words."""
    data, ids, out, at = (text or "").encode(), {}, [np.zeros(0, np.int32)], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        out.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(out)


def gram_words(min_exponent: int, min_length: int) -> int:
    """The most words k such that every k consecutive words of any run occur in that run at two places or more.

    A run of length L and period q has L - k + 1 places for k words; every
    one has its like a period away if these are 2 q or more.
    """
    return max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)))


def live_stretches(codes: list[np.ndarray], min_exponent: int, min_length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, first word, codes) of the maximal stretches in which every gram of ``gram_words`` words comes twice or more in its document.

    A run lies wholly in one such stretch, so nothing outside them need be
    searched; grams are told by 64-bit hashes, where a chance equality only keeps a stretch too many.
    """
    k = gram_words(min_exponent, min_length)
    lengths = np.array([len(c) for c in codes], np.int64)
    words = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    if len(words) < k:
        return
    doc = np.repeat(np.arange(len(codes)), lengths)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x2545F4914F6CDD1D) + mix(words[i : len(words) - k + 1 + i].astype(np.uint64) + np.uint64(1))
    h = mix(h + doc[: len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = doc[: len(h)] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    order = np.argsort(h[at], kind="stable")
    same = h[at][order]
    equal = same[1:] == same[:-1]
    live = np.zeros(len(h) + 1, bool)
    live[at[order[1:][equal]]] = True
    live[at[order[:-1][equal]]] = True
    edge = np.diff(np.concatenate([[0], live.astype(np.int8)]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # two stretches of different documents never touch: between them lie the last k - 1 words, no gram's start
    if k == 1:
        begin, end = _cut_at_documents(live, lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    for b, e in zip(begin.tolist(), end.tolist()):
        if e - b + k - 1 >= min_length:
            yield int(doc[b]), int(b - first[doc[b]]), words[b : e + k - 1]


def _cut_at_documents(live: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(live), bool)
    bounds = np.cumsum(lengths)[:-1]
    starts[np.concatenate([[0], bounds])] = True
    before = np.concatenate([[False], live[:-1]])
    after = np.concatenate([live[1:], [False]])
    ends = np.concatenate([starts[1:], [True]])
    return np.flatnonzero(live & (starts | ~before)), np.flatnonzero(live & (ends | ~after)) + 1


def _search(stretches: list[tuple[int, int, np.ndarray]], found: list, min_exponent: int, min_length: int) -> None:
    """Find all runs of the stretches by one pair of trees, and add them to their documents' lists."""
    values, codes = np.unique(np.concatenate([s[2] + (s[0] << 32) for s in [(d, a, c.astype(np.int64)) for d, a, c in stretches]]), return_inverse=True)
    lengths = np.array([len(s[2]) for s in stretches])
    # one separator of its own after every stretch: no extension crosses it
    text = np.insert(codes, np.cumsum(lengths), len(values) + np.arange(len(stretches)))
    alphabet = len(values) + len(stretches) + 1
    forward = Extensions(text.tolist(), alphabet)
    backward = Extensions([*text[::-1].tolist(), alphabet - 1], alphabet)
    begin, after = lyndon_words(forward.rank[: len(text)])
    period, last = after - begin, len(text) - 1
    right = forward.common(begin, after)
    left = np.zeros(len(begin), np.int64)
    inner = begin > 0
    left[inner] = backward.common(last - begin[inner] + 1, last - after[inner] + 1)
    start, length = begin - left, period + left + right
    good = length >= np.maximum(min_length, min_exponent * period)
    runs = np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0)
    first = np.cumsum(lengths + 1) - lengths - 1
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    for (s, n, q), o in zip(runs.tolist(), owner.tolist()):
        doc, offset, _ = stretches[o]
        found[doc].append((s - int(first[o]) + offset, n, q))


def lyndon_words(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and place after the end of the longest Lyndon word at every place, for the order of the symbols and its reverse.

    That word ends before the next smaller suffix. Every two suffixes differ
    in a symbol, as every text ends in one of its own, so the reverse order is the reverse of the ranks.
    """
    begins, afters = [], []
    for keys in (rank.tolist(), (-rank).tolist()):
        stack: list[int] = []
        for i, r in enumerate(keys):
            while stack and keys[stack[-1]] > r:
                begins.append(stack.pop())
                afters.append(i)
            stack.append(i)
    return np.array(begins, np.int64), np.array(afters, np.int64)


class Extensions:
    """Longest common extensions to the right of any two places of a text whose last symbol occurs once.

    Ukkonen's suffix tree is toured once, children by symbol. The tour gives
    the order of the suffixes and, between two neighbours, the depth of the
    highest node passed: their lowest common ancestor. The least such depth
    between any two leaves, from a table of powers of two, is the depth of theirs.
    """

    def __init__(self, text: list[int], alphabet: int):
        order, between = _tour(text, alphabet)
        self.rank = np.empty(len(text), np.int64)
        self.rank[order] = np.arange(len(text))
        self.table = [np.array(between, np.int32)]
        step = 1
        while 2 * step <= len(between):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places ``a`` and ``b``, different in each pair."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _tour(text: list[int], alphabet: int) -> tuple[np.ndarray, list[int]]:
    """Suffixes in order, and for each but the last the depth of the lowest common ancestor with the next."""
    child, start, end = ukkonen(text, alphabet)
    keys = np.fromiter(child.keys(), np.int64, len(child))
    nodes = np.fromiter(child.values(), np.int64, len(child))
    by = np.argsort(keys)
    parents, nodes = (keys[by] // alphabet), nodes[by]
    bounds = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
    kids, n = nodes.tolist(), len(text)
    order, between, low = [], [], 0
    stack = [(0, 0, False)]  # node, depth of its parent, whether it is not the first child
    while stack:
        node, above, later = stack.pop()
        if later:
            low = above
        stop = end[node]
        depth = above + (n if stop < 0 else stop) - start[node] if node else 0
        a, b = bounds[node], bounds[node + 1]
        if a == b:
            order.append(n - depth)
            between.append(low)
            continue
        for i in range(b - 1, a, -1):
            stack.append((kids[i], depth, True))
        stack.append((kids[a], depth, False))
    return np.array(order, np.int64), between[1:]


def ukkonen(text: list[int], alphabet: int) -> tuple[dict[int, int], list[int], list[int]]:
    """The suffix tree: child by ``node * alphabet + symbol``, and per node the span of its edge in ``text``; a leaf's end is -1, the root is node 0."""
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node, edge, length, open_suffixes = 0, 0, 0, 0
    for i, symbol in enumerate(text):
        open_suffixes += 1
        fresh = 0  # the inner node made last in this step, still without a link
        while open_suffixes:
            if not length:
                edge = i
            key = node * alphabet + text[edge]
            below = child.get(key, 0)
            if not below:
                child[key] = len(start)
                start.append(i)
                end.append(-1)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin, stop = start[below], end[below]
                span = (i + 1 if stop < 0 else stop) - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                middle = begin + length
                if text[middle] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                child[key] = inner
                start += (begin, i)
                end += (middle, -1)
                link += (0, 0)
                child[inner * alphabet + symbol] = inner + 1
                start[below] = middle
                child[inner * alphabet + text[middle]] = below
                if fresh:
                    link[fresh] = inner
                fresh = inner
            open_suffixes -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_suffixes + 1
    return child, start, end
