"""Operator 1: contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import attach, small_side, stored, whole_rows

#: Bytes a document counts besides its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                   slack: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cut the documents into ``shards`` contiguous runs of about equal bytes.

    Documents are ordered by (MD5 of the text, id), so equal texts are
    neighbours. The rows are range-partitioned on that order, each
    partition's total is taken, and the running sum of the totals gives every
    document its global byte position. The target cuts are k/shards of all
    bytes. A cut goes to the nearer end of the group of equal texts around its
    target, if that is at most ``slack`` of a shard away, so that the group
    stays in one shard at a bounded loss of balance. Otherwise, as a third of
    all rows cannot stay in one shard, it goes to the nearer end of the document that holds the target.

    Returns one row per input row: the id, ``text_md5``, ``size`` (UTF-8 bytes
    + 8; a null text has none), ``text_crc32``, ``shard``, ``slot`` (gapless
    from 0 in each shard, in the global order), ``start`` (the byte
    position) and the columns ``keys`` of the input. A null text counts as the empty text. Null ids come first among
    equal texts, and equal rows take places next to each other. An empty table
    gives no rows; with fewer documents than shards some shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("digest"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"), *keys)
    # The range partitioner splits a group of equal texts by id, so a hot text is no hot partition.
    rows = stored(rows.repartitionByRange(F.col("digest"), F.col("id")).withColumn("part", F.spark_partition_id()),
                  "shard-order")
    parts = (rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
             .orderBy("part").collect())  # one row per partition
    total = sum(p["bytes"] for p in parts)

    spark = docs.sparkSession
    starts, at, row = [], 0, 0
    for p in parts:
        starts.append((p["part"], at, row))
        at, row = at + p["bytes"], row + p["n"]
    offsets = small_side(spark.createDataFrame(starts, "part int, bytes_before long, rows_before long"), len(starts))
    order = Window.partitionBy("part").orderBy("digest", F.col("id").asc_nulls_first())
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.join(offsets, "part")
              .withColumn("start", F.col("bytes_before") + F.sum("size").over(run) - F.col("size"))
              .withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1))

    cuts = _cuts(placed, total, shards, slack)
    # Each partition needs only the cuts that lie in its own byte range.
    inner = [(part, bisect_right(cuts, first), cuts[bisect_right(cuts, first):bisect_left(cuts, after)])
             for (part, first, _), after in zip(starts, [s[1] for s in starts[1:]] + [total])]
    inner = small_side(spark.createDataFrame(inner, "part int, shard_before int, inner array<long>"), len(inner))
    sharded = placed.join(inner, "part").withColumn(
        "shard", (F.col("shard_before") + F.size(F.filter("inner", lambda c: c <= F.col("start")))).cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(small_side(firsts, shards), "shard").select(
        F.col("id").alias(id_col), F.col("digest").alias("text_md5"), "size", F.col("crc").alias("text_crc32"),
        "shard", (F.col("row") - F.col("first_row")).alias("slot"), "start", *keys)


def _cuts(placed: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """The byte positions at which shards 1, 2, ... begin; ``shards - 1`` numbers in ascending order."""
    if not total:
        return [0] * (shards - 1)

    # Documents that hold a target, at most one row per cut.
    across = (placed.where(F.expr(f"(cast(start as decimal(28,0)) * {shards}) div {total} "
                                  f"< (cast(start + size as decimal(28,0)) * {shards}) div {total}"))
              .select("digest", "start", "size").orderBy("start").collect())
    digests = sorted({r["digest"] for r in across})
    groups = {}
    if digests:
        groups = {r["digest"]: (r["first"], r["after"]) for r in
                  placed.where(F.col("digest").isin(digests)).groupBy("digest")
                  .agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("after")).collect()}
    limit, cuts, i = slack * total / shards, [], 0
    for k in range(1, shards):
        target = k * total / shards
        while i + 1 < len(across) and across[i]["start"] + across[i]["size"] < target:
            i += 1
        first, after = across[i]["start"], across[i]["start"] + across[i]["size"]
        group = groups[across[i]["digest"]]
        if min(target - group[0], group[1] - target) <= limit:
            first, after = group
        cuts.append(first if target - first < after - target else after)
    return sorted(cuts)


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard (``shard=<k>``), each sorted by slot."""
    (attach_shards(docs, shards, id_col, text_col).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def attach_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """The input rows with their shard and slot. Columns of these names in the input are replaced.

    Repeated rows (same id and text) are paired with their places one to one.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (shard_col, slot_col)])
    rows = whole_rows(own, "shard-rows", id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`"))
    places = shard_by_bytes(rows, shards, "id", "text", keys=("f", "r")).select("f", "r", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    placed = attach(rows.select("_row", "f", "r"), places)
    return placed.select("_row.*", F.col("_shard").alias(shard_col), F.col("_slot").alias(slot_col))
