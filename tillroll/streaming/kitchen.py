"""The kitchen board kept live from a stream of checkouts and status requests.

The application re-queries the pending list every 15 s. Here one stream
carries both what the till sends (checked-out orders with their lines) and
what the kitchen and the cashiers send (status requests), and the board is
state updated per micro-batch:

* A checked-out order joins the board; it leaves it at its first *valid*
  status request: a complete by a Kitchen/Manager user, a void or refund by
  the owning cashier. Nothing brings an order back to pending. A request for an
  order that the board does not hold (finished, or never pending) changes
  nothing, as the server refuses it. So the result does not depend on how
  the stream is cut into batches, as long as a checkout is read no later than
  its requests.
* The board lives in Spark's state store, keyed by a bucket of order ids: a
  bucket's state holds its open orders only, and is removed when it has none. So
  the state is bounded by the kitchen queue, not by all orders ever taken, and an
  epoch costs its own rows and the buckets they touch, however many epochs came
  before. The store's commits make a retried epoch and a restart exact.
* The stream's output is what changed: one row per order that arrived on the board
  or left it. The whole board is read from the committed state.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillroll.schema import KITCHEN_ROLES
from tillroll.session import ensure_checkpoint_dir

#: R09's columns.
BOARD_SCHEMA = ("id bigint, status string, notes string, created_at timestamp_ntz, total decimal(10,2), cashier_name string, "
                "cashier_username string, item_count bigint")

# One feed row is a checkout (``checkout`` set) or a status request (``request`` set).
FEED_SCHEMA = ("feed_seq bigint, order_id bigint, "
               "checkout struct<status:string,notes:string,created_at:timestamp_ntz,total:decimal(10,2),cashier_id:bigint,"
               "quantities:array<bigint>>, "
               "request struct<event_type:string,actor_id:bigint,event_time:timestamp_ntz>")


#: Rows of a delivery that share a file.
ROWS_PER_FILE = 1_000_000
#: Rows of users that may be broadcast to every executor.
BROADCAST_USERS = 500_000
#: Parts into which a user's feed rows are dealt where the users are too many to broadcast.
SALT = 4
#: Buckets of order ids. Fixed for the life of a stream's checkpoint.
BUCKETS = 64

_ARRIVES, _COMPLETED, _UNDONE = 0, 1, 2
_MOVES = "bucket int, order_id bigint, kind int, who bigint, card string"
_CARD = "status string, notes string, created_at string, total string, cashier_name string, cashier_username string, item_count string"


def moves(feed: DataFrame, users: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What the feed may change on the board: (bucket, order_id, kind, who, card).

    A pending checkout of a known cashier arrives with its ``card`` (R09's columns as JSON of texts);
    a completion counts only from a Kitchen or Manager user; a void or refund
    goes on with its actor, who must be the order's cashier. Repeats are
    dropped per batch of rows, before the shuffle. Users are joined once, for checkouts and completions; voids and
    refunds, most of the requests, need nothing of them and are not shuffled for it.
    """
    checkout, request = F.col("checkout"), F.col("request")
    kind = (F.when((checkout["status"] == "pending") & request.isNull(), _ARRIVES).when(request["event_type"] == "complete", _COMPLETED)
            .when(request["event_type"].isin("voided", "refunded"), _UNDONE))
    rows = feed.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn(
        "who", F.when(F.col("kind") == _ARRIVES, checkout["cashier_id"]).otherwise(request["actor_id"]))
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int").alias("bucket")
    undone = rows.where((F.col("kind") == _UNDONE) & F.col("who").isNotNull()).select(
        bucket, "order_id", "kind", "who", F.lit(None).cast("string").alias("card"))
    rows = rows.where(F.col("kind") != _UNDONE)
    known = users.select(F.col("id").cast("bigint").alias("u_id"), "name", "username", F.col("role").isin(*KITCHEN_ROLES).alias("in_kitchen"))
    on = F.col("who") == F.col("u_id")
    if users.count() <= BROADCAST_USERS:
        known = F.broadcast(known)
    else:  # a busy user's rows go to several tasks
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("order_id", "feed_seq"), F.lit(SALT)).cast("int"))
        known = known.withColumn("u_salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
        on = on & (F.col("salt") == F.col("u_salt"))
    units = F.aggregate(checkout["quantities"], F.lit(0).cast("bigint"), lambda acc, q: acc + F.coalesce(q, F.lit(0)))
    texts = [F.col(c).cast("string").alias(n) for c, n in (
        ("checkout.status", "status"), ("checkout.notes", "notes"), ("checkout.created_at", "created_at"), ("checkout.total", "total"),
        ("name", "cashier_name"), ("username", "cashier_username"))]
    card = F.when(F.col("kind") == _ARRIVES, F.to_json(F.struct(*texts, F.coalesce(units, F.lit(0)).cast("string").alias("item_count"))))
    rows = rows.join(known, on).where((F.col("kind") == _ARRIVES) | F.col("in_kitchen"))
    rows = rows.select(bucket, "order_id", "kind", F.when(F.col("kind") == _ARRIVES, F.col("who")).alias("who"), card.alias("card"))
    return rows.unionByName(undone).mapInArrow(_distinct, _MOVES)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([])
        yield from seen.select(batch.schema.names).combine_chunks().to_batches()


def _fold(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bring one bucket's board up to date: first the arrivals of the epoch, then its requests."""
    (bucket,) = key
    board = {i: (cashier, card) for i, cashier, card in json.loads(state.get[0])} if state.exists else {}
    before, finals, undone = set(board), set(), set()
    for part in parts:
        for order, kind, who, card in zip(part["order_id"].tolist(), part["kind"].tolist(), part["who"].tolist(), part["card"].tolist()):
            if kind == _COMPLETED:
                finals.add(order)
            elif kind == _UNDONE:
                undone.add((order, int(who)))
            elif order not in before:  # a checkout on the board already was read twice; of two in one epoch the smaller card counts
                new = (int(who), card)
                board[order] = min(board.get(order, new), new)
    gone = {i for i, (cashier, _) in board.items() if i in finals or (i, cashier) in undone}
    changes = [(i, "left", None) for i in sorted(gone & before)]
    changes += [(i, "arrived", board[i][1]) for i in sorted(board.keys() - before - gone)]
    if changes:
        kept = [(i, *board[i]) for i in sorted(board.keys() - gone)]
        if kept:
            state.update((json.dumps(kept, separators=(",", ":")),))
        elif state.exists:
            state.remove()
    yield pd.DataFrame({"bucket": bucket, "order_id": [c[0] for c in changes], "change": [c[1] for c in changes], "card": [c[2] for c in changes]})


def board_changes(feed: DataFrame, users: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streaming: one row (bucket, order_id, change, card) per order that arrived on the board or left it in an epoch.

    An order taken and finished within one epoch never shows."""
    return moves(feed, users, buckets).groupBy("bucket").applyInPandasWithState(
        _fold, "bucket int, order_id bigint, change string, card string", "orders string", "update", GroupStateTimeout.NoTimeout)


def run_board_stream(spark: SparkSession, feed_path: str, users: DataFrame, work_dir: str, files_per_batch: int = 1,
                     buckets: int = BUCKETS) -> DataFrame:
    """Read every new file under ``feed_path`` (available-now trigger, at most
    ``files_per_batch`` files a micro-batch) and return the board (R09's
    columns). Called again on the same ``work_dir`` it goes on where it stopped."""
    feed = (spark.readStream.schema(FEED_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").parquet(feed_path))
    query = (board_changes(feed, users, buckets).writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", _checkpoint(work_dir)).trigger(availableNow=True).start())
    query.awaitTermination()
    return board(spark, work_dir)


def board(spark: SparkSession, work_dir: str) -> DataFrame:
    """The board as of the last committed epoch, from the stream's state."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_checkpoint(work_dir), "commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(f.getPath().getName().isdigit() for f in fs.listStatus(path)):
        return spark.createDataFrame([], BOARD_SCHEMA)
    held = spark.read.format("statestore").load(_checkpoint(work_dir)).select(F.explode(
        F.from_json("value.groupState.orders", "array<array<string>>")).alias("o"))
    card = F.from_json(F.col("o")[2], _CARD)
    cols = {c: (F.col("o")[0] if c == "id" else card[c]).cast(t) for c, t in (x.split(" ", 1) for x in BOARD_SCHEMA.split(", "))}
    return held.select(*[c.alias(n) for n, c in cols.items()])


def _checkpoint(work_dir: str) -> str:
    return os.path.join(work_dir, "stream-checkpoint")


def feed_rows(orders: DataFrame, order_items: DataFrame, status_events: DataFrame) -> DataFrame:
    """The stand-in feed in ``FEED_SCHEMA``: one row per checkout with its lines'
    quantities, one per status request, numbered so that a checkout comes
    before its requests."""
    lines = order_items.groupBy(F.col("order_id").alias("l_order")).agg(
        F.collect_list(F.col("quantity").cast("bigint")).alias("quantities"))
    o = orders.join(lines, orders["id"] == lines["l_order"], "left")
    no_lines = F.array().cast("array<bigint>")
    checkouts = o.select(
        (F.col("id") * 1000).alias("feed_seq"), F.col("id").alias("order_id"),
        F.struct("status", "notes", "created_at", "total", F.col("cashier_id").cast("bigint").alias("cashier_id"),
                 F.coalesce("quantities", no_lines).alias("quantities")).alias("checkout"))
    requests = status_events.select(F.col("seq").alias("feed_seq"), "order_id", F.struct(
        "event_type", F.col("actor_id").cast("bigint").alias("actor_id"), "event_time").alias("request"))
    return checkouts.unionByName(requests, allowMissingColumns=True)


def write_feed(feed: DataFrame, path: str, drops: int, files: int = 1) -> None:
    """Write the feed as ``drops`` deliveries of ``files`` files at most, one after the other, by
    ranges of ``feed_seq``. Within a delivery the rows of an order share a file, so a
    checkout is never read after its requests."""
    cuts = feed.select(F.percentile_approx("feed_seq", [i / drops for i in range(1, drops)] or [0.5])).first()[0] or []
    bounds = [None, *(cuts if drops > 1 else []), None]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = feed
        if low is not None:
            part = part.filter(F.col("feed_seq") > low)
        if high is not None:
            part = part.filter(F.col("feed_seq") <= high)
        part.repartition(files, "order_id").write.mode("overwrite").parquet(os.path.join(path, f"drop={k}"))


def kitchen_queue_stream(spark: SparkSession, orders: DataFrame, users: DataFrame, order_items: DataFrame,
                         status_events: DataFrame, batches: int = 4) -> DataFrame:
    """S01 end to end from an empty board: checkouts and status requests arrive
    in ``batches`` deliveries under the checkpoint folder and are streamed;
    the final board is returned. It equals R09 over the orders after B08."""
    work_dir = os.path.join(ensure_checkpoint_dir(spark), f"kitchen-stream-{uuid.uuid4().hex}")
    feed_path, whole = os.path.join(work_dir, "feed"), os.path.join(work_dir, "whole")
    feed = feed_rows(orders, order_items, status_events)
    feed.write.parquet(whole)  # made once; each delivery is a part of it
    feed = spark.read.schema(FEED_SCHEMA).parquet(whole)
    files = 1 + feed.count() // batches // ROWS_PER_FILE
    write_feed(feed, feed_path, batches, files)
    return run_board_stream(spark, feed_path, users, work_dir, files_per_batch=files)
