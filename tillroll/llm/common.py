"""Helpers shared by the training-data operators: stored intermediate tables, byte-level word hashing, safe broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

#: Largest number of rows of narrow (id, number) data sent to every executor.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


#: Narrow rows that one file of a small intermediate table holds.
ROWS_PER_FILE = 200_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files instead of
    recomputing what made them, and a table used several times is made once.
    All files of an application lie under one folder; see ``drop_stored``.
    With ``rows``, the number of narrow rows at most, the table gets as many
    files as these need: a loop over a small table then runs few tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this application, when its results are no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (as ``--py-files`` does), once per application."""
    sc = spark.sparkContext
    if any(f.startswith("tillroll-") for f in sc._python_includes):
        return
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tillroll-code-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"tillroll-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for inner, _, names in os.walk(os.path.join(here, "tillroll")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(inner, name)
                    z.write(full, os.path.relpath(full, here))
    sc.addPyFile(path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only if its counted ``rows`` are within ``limit``; beyond it the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def row_numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with columns ``f`` and ``r`` that tell every row apart and stay the same when it is read again.

    They are the hash of the row's file and its place in it. A table that is
    not read from files as it is (``df`` has no file metadata) is written first.
    """
    try:
        numbered = df.select("*", F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
        numbered.schema  # noqa: B018 - analysed here
        return numbered
    except AnalysisException:
        return row_numbered(stored(df, name), name)


def whole_rows(docs: DataFrame, name: str, **cols: Column) -> DataFrame:
    """Every row of ``docs`` as the struct ``_row``, with ``cols`` and the ``row_numbered`` keys ``f`` and ``r``.

    Operators work on the keys and narrow columns (the rest is not read then); ``attach`` brings decisions back to the rows.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    return row_numbered(docs.select(F.struct(*own).alias("_row"), *[c.alias(k) for k, c in cols.items()]), name)


def attach(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``whole_rows`` joined with the ``decisions`` (f, r and others) on them.

    Keys are unique, so no task gets more than its share. The decisions of a
    partition are hashed and the rows stream past them: no sort and no window holds whole texts.
    """
    return rows.join(decisions.hint("shuffle_hash"), ["f", "r"]).drop("f", "r")


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with exclusive running sums (columns named by ``sums``) in the given order, which should have no ties.

    The rows are range-partitioned on the order and stored; one row of totals
    per partition passes through the driver, so no task holds all rows.
    """
    df = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_part").collect()
    before, at = [], {k: 0 * totals[0][k] for k in sums} if totals else {}  # zeros of the sums' types
    for t in totals:
        before.append((t["_part"], *at.values()))
        at = {k: at[k] + t[k] for k in sums}
    kinds = ", ".join(f"_before_{k} {df.select(c.alias(k)).groupBy().agg(F.sum(k)).schema[0].dataType.simpleString()}" for k, c in sums.items())
    before = small_side(df.sparkSession.createDataFrame(before, f"_part int, {kinds}"), len(before))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = [(F.col(f"_before_{k}") + F.sum(c).over(here) - c).alias(k) for k, c in sums.items()]
    own = [c for c in df.columns if c != "_part"]
    return df.join(before, "_part").select(*own, *run)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ---------------------------------------------------------------- byte-level words

_B = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; bounds the temporary arrays whatever the text's length.
BLOCK = 1 << 20


def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW, _POW_INV = _powers(_B), _powers(pow(_B, -1, 1 << 64))

#: Lower-cased byte, or 0 where the byte ends a word: words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lowered.
WORD_BYTES = np.zeros(256, dtype=np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_BYTES[_c] = _c
for _c in range(0x41, 0x5B):
    WORD_BYTES[_c] = _c + 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n+1 offsets of the texts in them; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """The texts in order, in runs of about ``limit`` bytes (at least one text), so that a task holds little at a time whatever Spark's batch size."""
    _, offsets = flat_bytes(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of every text, in order, and the n+1 word offsets of the texts.

    A word's hash is a polynomial over its bytes, taken from prefix sums.
    Whole texts of any length are read in blocks that end between words.
    """
    hashes, firsts, at, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        b = WORD_BYTES[data[at:end]]
        inside = b != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        text_starts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)] - at
        begin[text_starts] = inside[text_starts]
        s = np.flatnonzero(begin)
        if end < n and inside[-1]:  # the last word may go on: leave it to the next block
            if s[-1] == 0:
                h, after = _long_word(data, offsets, at)
                hashes.append(h)
                firsts.append(np.array([at]))
                at = after
                continue
            end, b, s = at + int(s[-1]), b[: s[-1]], s[:-1]
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * _POW[: len(b)], out=prefix[1:])  # separators are 0
        stop = np.append(s[1:], len(b))
        hashes.append((prefix[stop[: len(s)]] - prefix[s]) * _POW_INV[s])
        firsts.append(s + at)
        at = end
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(firsts), offsets).astype(np.int64)


def _long_word(data: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """Hash of the word that begins at ``at`` and fills at least a block, and where it ends."""
    last = int(offsets[np.searchsorted(offsets, at, "right")])  # a word ends with its text
    h, here = np.zeros(1, np.uint64), at
    while here < last:
        b = WORD_BYTES[data[here : min(last, here + BLOCK)]]
        gap = np.flatnonzero(b == 0)
        b = b[: gap[0]] if len(gap) else b
        h += np.sum(b * _POW[: len(b)], dtype=np.uint64) * np.array([pow(_B, here - at, 1 << 64)], np.uint64)
        here += len(b)
        if len(gap):
            break
    return h, here


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[i : i + n]
    return mix(h)
