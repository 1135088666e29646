"""Operator 7: exact token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of more characters than this are encoded in overlapping chunks.
CHUNK = 65_536
OVERLAP = 512
#: Distinct words whose counts a Python worker remembers from task to task; further words are counted anew in each batch.
MEMO = 1_000_000

_SPACES = " \t\n\r\x0b\x0c"


class Counter:
    """Counts tokens with a tokenizer of the ``tokenizers`` library whose tokens never cross ASCII white space.

    That holds when the pre-tokenizer drops white space, which is checked when
    the tokenizer is loaded. White space is then a proven boundary: the words
    on either side are encoded independently of each other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, int] = {}
        probe = ["a b", "ab cd", "1 2", "x\ty", "é\nß", "' s"]
        joined = [e.ids for e in self._encode(probe)]
        apart = [[i for e in self._encode(p.split()) for i in e.ids] for p in probe]
        if joined != apart:
            raise ValueError("this tokenizer's tokens may cross white space")

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of texts of ordinary length: the counts of their white-space separated words, each encoded once."""
        split = [t.encode().split() for t in texts]
        new = list({w for words in split for w in words if w not in self.memo})
        room = MEMO - len(self.memo)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.memo.update(zip(part, map(len, encoded)))
        known = self.memo.__getitem__
        counts = [sum(map(known, words)) for words in split]
        for w in new[max(room, 0):]:
            del self.memo[w]
        return counts

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Token count of a text of any length, holding one or two chunks at a time.

        Neighbouring chunks are encoded with offsets. They are spliced at the
        last white space in their overlap from which both have the same
        tokens up to the next white space. If the overlap has no such place,
        it is doubled, up to the whole rest of the text.
        """
        total, start, skip, size = 0, 0, 0, chunk  # tokens of the chunk at ``start`` count from offset ``skip`` on
        ids, spans = self._chunk(text, 0, size)
        while start + size < len(text):
            end, wide, joint = start + size, min(overlap, size // 2), None
            while joint is None:
                begin = end - wide
                if begin <= start + skip:  # the overlap is all that is left of this chunk: take more text
                    size *= 2
                    ids, spans = self._chunk(text, start, size)
                    end = start + size
                    if end >= len(text):
                        break
                    continue
                right = self._chunk(text, begin, size)
                joint = self._splice(text, start, ids, spans, begin, *right, end)
                wide *= 2
            if joint is None:
                break
            total += sum(1 for a, _ in spans if skip <= a and a < joint - start)
            start, skip, (ids, spans) = begin, joint - begin, right
        return total + sum(1 for a, _ in spans if a >= skip)

    def _chunk(self, text: str, begin: int, size: int):
        e = self._encode([text[begin : begin + size]])[0]
        return e.ids, e.offsets

    @staticmethod
    def _splice(text, start, ids, spans, begin, right_ids, right_spans, end) -> int | None:
        """The place in text[begin:end] at which the left and right chunk are joined, or None."""
        stops = [p for p in range(begin, end) if text[p] in _SPACES]
        for p, q in zip(reversed(stops[:-1]), reversed(stops)):  # the words between p and q lie whole in both chunks
            if q - p < 2:
                continue
            left = [i for i, (a, b) in zip(ids, spans) if p <= a + start and b + start <= q]
            right = [i for i, (a, b) in zip(right_ids, right_spans) if p <= a + begin and b + begin <= q]
            crossing = any(a + start < p < b + start for a, b in spans) or any(a + begin < p < b + begin for a, b in right_spans)
            if left and left == right and not crossing:
                return p
        return None


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """This process's counter; Spark's Python workers serve many tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_count(text: Column | str, tokenizer_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of a whole text, without added special tokens; null and empty texts have none.

    ``tokenizer_path`` is read on the executors (the file comes with an
    installed package there). Texts of at most ``chunk`` characters are counted word by word; longer ones by
    overlap resynchronisation (``Counter.count_long``). Special strings inside
    a text count as the library's default has it.
    """

    @F.arrow_udf("bigint")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(tokenizer_path)
        for part in parts:
            texts = [t or "" for t in part.to_pylist()]
            short = iter(counter.count([t for t in texts if len(t) <= chunk]))
            yield pa.array([next(short) if len(t) <= chunk else counter.count_long(t, chunk, overlap) for t in texts],
                           pa.int64())

    return count(text)
