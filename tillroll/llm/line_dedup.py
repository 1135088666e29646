"""Operator 6: drop lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import SPACES, ascii_lower, row_numbered, stored

#: Hashes of lines (20 bytes each) that may be sent to every executor.
BROADCAST_LINES = 500_000


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Drop repeated lines from every text.

    A text is split at newlines. A line's key is the line stripped of
    [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that occur in at least ``min_docs`` documents
    lose all their lines, except in the document with the largest id that
    holds them. The remaining lines keep their order.

    Returns one row per input row: the id, ``kept_text``, ``n_lines`` (before)
    and ``n_dropped``. A null or empty text is one empty line. Documents are
    told apart by id; a null id counts as one document that is smaller than
    all others, and rows that repeat an id are one document, each with its own
    lines. Other input columns are not looked at.

    Only hashes and positions are shuffled for the counts. Lines are counted
    per (line, document) first and per line after, both with map-side partial
    aggregation, so a line that is in every document is no hot key. Nor is it one where
    the shared lines meet their places: up to ``BROADCAST_LINES`` shared lines are broadcast; of more, those that
    make up over 1 / ``BROADCAST_LINES`` of all places are, and only the places of
    others are shuffled by line. Decisions come back to the texts by file and row, which no two texts share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = row_numbered(docs.select(F.col(id_col).alias("id"), text.alias("text")), "line-texts")
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    lines = stored(
        base.select("id", "f", "r", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "f", "r", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
        .select("id", "f", "r", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")), "lines")
    hot = F.col("places") * BROADCAST_LINES > lines.count()  # fewer lines than BROADCAST_LINES
    known = (lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("places"))
             .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"), F.sum("places").alias("places"))
             .select("h1", "h2", "keeper", (F.col("n") >= min_docs).alias("shared"), hot.alias("hot")).where("shared or hot"))
    known = stored(known, "known-lines")
    shared = known.where("shared").select("h1", "h2", "keeper")
    if shared.count() <= BROADCAST_LINES:
        met = lines.join(F.broadcast(shared), ["h1", "h2"])
    else:
        often = known.where("hot")
        met = lines.join(F.broadcast(often.where("shared").select("h1", "h2", "keeper")), ["h1", "h2"]).unionByName(
            lines.join(F.broadcast(often.select("h1", "h2")), ["h1", "h2"], "left_anti")
            .join(known.where("shared and not hot").select("h1", "h2", "keeper"), ["h1", "h2"]))
    dropped = (met.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("f", "r").agg(F.collect_list("pos").alias("gone")))
    # The positions of a partition are hashed and the texts stream past them, at every size alike.
    joined = base.join(stored(dropped, "dropped-lines").hint("shuffle_hash"), ["f", "r"], "left")
    # array_except uses a hash set: linear in the number of lines, and it keeps the order.
    parts = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone"), lambda i: F.get(parts, i))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
