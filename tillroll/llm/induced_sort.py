"""External induced suffix sorting of one shard, with common-prefix values.

Only the leftmost S-type (LMS) suffixes are sorted outright: their substrings
are named in order, and the names form a text a third as long that is sorted
by recursion. The order of all suffixes is then induced: a suffix is the tuple
(symbols up to its next LMS place, rank of that LMS suffix). All tuples pass
through ``DiskQueue``, which holds a set number of bytes and spills sorted
runs, so the tuples of a shard may be far larger than memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples taken from a queue, or packed for one, at a time.
BLOCK = 1 << 18


class DiskQueue:
    """A priority queue of (key, value) in bulk: push all, then pop in ascending order of the keys.

    Pushed tuples beyond ``memory`` bytes are sorted and written as a run into
    Spark's own spill folders of this executor; the files have no name and go
    with the task. Popping merges the runs block by block.
    """

    def __init__(self, memory: int):
        self.limit = max(1, memory // 32)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.runs: list[tuple[object, int]] = []

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        for at in range(0, len(keys), self.limit):
            self.held.append((keys[at : at + self.limit], values[at : at + self.limit]))
            self.n += len(self.held[-1][0])
            if self.n >= self.limit:
                self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.held]) if self.held else np.zeros(0, np.uint64)
        values = np.concatenate([v for _, v in self.held]) if self.held else np.zeros(0, np.int64)
        self.held, self.n = [], 0
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def _spill(self) -> None:
        keys, values = self._sorted()
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        keys.tofile(file)
        values.tofile(file)
        self.runs.append((file, len(keys)))

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.runs:
            keys, values = self._sorted()
            for at in range(0, len(keys), BLOCK):
                yield keys[at : at + BLOCK], values[at : at + BLOCK]
            return
        if self.n:
            self._spill()
        step = max(1, self.limit // len(self.runs))
        ends = [0] * len(self.runs)  # tuples read of each run
        heads = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(self.runs)
        while True:
            for i, (file, n) in enumerate(self.runs):
                if not len(heads[i][0]) and ends[i] < n:
                    heads[i] = self._read(file, n, ends[i], step)
                    ends[i] += len(heads[i][0])
            open_ends = [h[0][-1] for h, (_, n), e in zip(heads, self.runs, ends) if e < n]
            takes = [np.searchsorted(h[0], min(open_ends), "right") if open_ends else len(h[0]) for h in heads]
            keys = np.concatenate([h[0][:t] for h, t in zip(heads, takes)])
            values = np.concatenate([h[1][:t] for h, t in zip(heads, takes)])
            heads = [(h[0][t:], h[1][t:]) for h, t in zip(heads, takes)]
            if not len(keys):
                break
            order = np.argsort(keys, kind="stable")
            yield keys[order], values[order]
        for file, _ in self.runs:
            file.close()
        self.runs = []

    @staticmethod
    def _read(file, n: int, at: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        file.seek(8 * at)
        keys = np.fromfile(file, np.uint64, min(step, n - at))
        file.seek(8 * (n + at))
        return keys, np.fromfile(file, np.int64, len(keys))


def suffix_order(text: np.ndarray, cap: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order, and each one's common prefix with the one before it, ``cap`` at most.

    ``text`` is an array of numbers from 0 up whose last, and only its last, is 0.
    """
    n = len(text)
    lms, following = _lms(text)
    ends = np.append(lms[1:], lms[-1])
    names = rank_prefixes(text, lms, ends, None, memory)[1]
    distinct, names = np.unique(names, return_inverse=True)
    if len(distinct) == len(names):
        lms_order = np.empty(len(names), np.int64)
        lms_order[names] = np.arange(len(names))
        same = np.zeros(len(names), np.int64)
    else:
        lms_order, same = suffix_order(names, cap, memory)
    # what names have in common, in symbols of this text, plus what the first two different ones have in common
    a, b = lms_order[:-1], lms_order[1:]
    known = lms[a + same[1:]] - lms[a]
    prefixes = np.concatenate([[0], extend(text, lms[a], lms[b], known, cap)])
    lms_rank = np.empty(len(lms), np.int64)
    lms_rank[lms_order] = np.arange(len(lms))
    tie = lms_rank[np.searchsorted(lms, following)]
    rank, group = rank_prefixes(text, np.arange(n), following, tie, memory)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    induced = group[a] == group[b]
    lcp = np.zeros(n, np.int64)
    least = RangeMinimum(prefixes)
    ia, ib = a[induced], b[induced]
    lcp[1:][induced] = following[ia] - ia + least(tie[ia] + 1, tie[ib])
    lcp[1:][~induced] = extend(text, a[~induced], b[~induced], np.zeros(np.count_nonzero(~induced), np.int64), cap)
    return order, np.minimum(lcp, cap)


def _lms(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LMS places, and for every place the next LMS place after it (the last place: itself)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # the last places of runs of one symbol, but the last run
    run_end = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    smaller = np.ones(n, bool)  # S type; the last place is
    inner = run_end < n - 1
    smaller[inner] = text[run_end[inner] + 1] > text[run_end[inner]]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if n == 1:
        lms = np.zeros(1, np.int64)
    following = np.append(lms, n - 1)[np.searchsorted(lms, np.arange(n), "right")]
    return lms, following


def rank_prefixes(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, tie: np.ndarray | None,
                  memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, group) of the strings text[start..stop], the stop included.

    Where one string is the beginning of another, the longer one comes first:
    it goes on from an L-type place where the other ends at an S-type one.
    Equal strings have one group, the number of strings before them; their
    ranks follow ``tie``, or are the group where there is none.
    """
    n, pad = len(starts), int(text.max()) + 1
    bits, wide = pad.bit_length(), max(1, n.bit_length())
    rank, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    queue, done, per = DiskQueue(memory), 0, 63 // bits
    for at in range(0, n, BLOCK):
        items = np.arange(at, min(n, at + BLOCK))
        queue.push(_pack(text, starts[items], stops[items], per, bits, pad), items)
    first_round = True
    while True:
        following, low = DiskQueue(memory), (63 - wide) if not first_round else 0
        count, seen = 0, 0
        begin_old = begin_new = 0
        last_old = last_key = None
        done += per
        step = (63 - wide) // bits
        for keys, items in queue.pop():
            old = (keys >> np.uint64(low)).astype(np.int64) if not first_round else np.zeros(len(keys), np.int64)
            index = np.arange(seen, seen + len(keys))
            new_key = np.append(True if last_key is None else keys[0] != last_key, keys[1:] != keys[:-1])
            new_old = np.append(True if last_old is None else old[0] != last_old, old[1:] != old[:-1])
            start_old = np.maximum.accumulate(np.where(new_old, index, begin_old))
            start_new = np.maximum.accumulate(np.where(new_key, index, begin_new))
            begin_old, begin_new, last_old, last_key = start_old[-1], start_new[-1], old[-1], keys[-1]
            seen += len(keys)
            place = old + start_new - start_old
            rank[items] = place
            ended = starts[items] + done > stops[items] + 1  # the end has been seen
            # a tie was ordered by the round after its end, which leaves no equal keys
            closing = ended & (starts[items] + done - per > stops[items] + 1)
            group[items[~closing]] = place[~closing]
            alone = new_key & np.append(new_key[1:], False)  # a block's last item may have equals in the next block
            on = ~alone & ~closing & (~ended if tie is None else np.ones(len(items), bool))
            if on.any():
                going, at = items[on], place[on].astype(np.uint64)
                word = _pack(text, starts[going] + done, stops[going], step, bits, pad)
                if tie is not None:
                    word = np.where(ended[on], tie[going].astype(np.uint64), word)
                following.push((at << np.uint64(63 - wide)) | word, going)
                count += len(going)
        if not count:
            return rank, group
        queue, first_round, per = following, False, step


def _pack(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, symbols: int, bits: int, pad: int) -> np.ndarray:
    """The next ``symbols`` symbols of every string in one number; after its stop a string has pads, above all symbols."""
    key = np.zeros(len(starts), np.uint64)
    for c in range(symbols):
        at = starts + c
        key = (key << np.uint64(bits)) | np.where(at <= stops, text[np.minimum(at, len(text) - 1)], pad).astype(np.uint64)
    return key


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the different suffixes ``a`` and ``b`` of which ``known`` symbols are known to agree, ``cap`` at most."""
    out = np.minimum(known, cap)
    active = np.flatnonzero(out < cap)
    while len(active):
        n = out[active]
        active = active[text[a[active] + n] == text[b[active] + n]]
        out[active] += 1
        active = active[out[active] < cap]
    return out


class RangeMinimum:
    """Minima of values[low..high], both included, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values.astype(np.int32)]
        step = 1
        while 2 * step <= len(values):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k) + 1])
        return out
