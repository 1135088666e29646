"""The streamed kitchen board equals the batch board (R09 over the
orders after B08), however the feed is cut, and survives a restart."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest

from tillroll.operators import reports, writes
from tillroll.session import ensure_checkpoint_dir
from tillroll.streaming import kitchen
from tillroll.streaming.kitchen import BOARD_SCHEMA, FEED_SCHEMA, board, feed_rows, kitchen_queue_stream, run_board_stream, write_feed

T = dt.datetime(2024, 1, 30, 9)
USERS = "id bigint, username string, name string, role string"


def board_of(tables):
    after = writes.apply_order_status(tables.orders, tables.status_events, tables.users)["orders"]
    return reports.kitchen_queue(after, tables.users, tables.order_items)


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_stream_board_equals_batch(spark, tables, batches):
    batch = board_of(tables)
    got = kitchen_queue_stream(spark, tables.orders, tables.users, tables.order_items, tables.status_events, batches=batches)
    assert got.columns == batch.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def checkout(order_id, cashier=7, status="pending", quantities=(1,)):
    return (order_id * 1000, order_id, (status, None, T, Decimal("1.00"), cashier, list(quantities)), None)


def request(order_id, n, kind, actor):
    return (order_id * 1000 + n, order_id, None, (kind, actor, T + dt.timedelta(minutes=5)))


def users(spark):
    return spark.createDataFrame([(7, "a", "A", "Cashier"), (9, "k", "K", "Kitchen")], USERS)


def drops(spark):
    return [[checkout(1), checkout(2, quantities=(2, 3)), request(3, 1, "complete", 9)],      # 3 is not taken yet: refused
            [request(1, 1, "complete", 7), checkout(3), checkout(4, status="held"), checkout(5), request(5, 1, "voided", 7)],
            [request(1, 2, "complete", 9), request(2, 1, "voided", 9), checkout(6, cashier=8)],    # no cashier 8
            [request(1, 3, "refunded", 7)]]


def test_orders_arrive_and_finish_in_different_batches_across_a_restart(spark):
    work = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    seen = []
    for k, drop in enumerate(drops(spark)):          # each call restarts the query on the same folders
        spark.createDataFrame(drop, FEED_SCHEMA).coalesce(1).write.parquet(f"{work}/feed/drop={k}")
        board = run_board_stream(spark, f"{work}/feed", users(spark), work)
        seen.append(sorted((r.id, r.item_count) for r in board.collect()))
    assert seen == [[(1, 1), (2, 5)], [(1, 1), (2, 5), (3, 1)], [(2, 5), (3, 1)], [(2, 5), (3, 1)]]


def state_rows(spark, work):
    return spark.read.format("statestore").load(f"{work}/stream-checkpoint")


@pytest.mark.parametrize("users_too_many", [False, True])
def test_a_retried_epoch_gives_the_same_board_and_finished_buckets_leave_the_store(spark, monkeypatch, users_too_many):
    if users_too_many:
        monkeypatch.setattr(kitchen, "BROADCAST_USERS", 1)
    work = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(work).getFileSystem(spark._jsc.hadoopConfiguration())
    all_drops = [*drops(spark), [checkout(21)], [checkout(22)], [checkout(22)]]
    for k, drop in enumerate(all_drops):
        spark.createDataFrame(drop, FEED_SCHEMA).coalesce(1).write.parquet(f"{work}/feed/drop={k}")
        once = sorted(map(tuple, run_board_stream(spark, f"{work}/feed", users(spark), work).collect()))
        # the epoch's commit is lost: it is run again
        assert fs.delete(hadoop(f"{work}/stream-checkpoint/commits/{k}"), False)
        assert sorted(map(tuple, run_board_stream(spark, f"{work}/feed", users(spark), work).collect())) == once
    assert [r[0] for r in once] == [2, 3, 21, 22]
    assert state_rows(spark, work).count() <= 4
    spark.createDataFrame([request(i, 9, "complete", 9) for i in (2, 3, 21, 22)], FEED_SCHEMA).coalesce(1).write.parquet(f"{work}/feed/drop=last")
    assert run_board_stream(spark, f"{work}/feed", users(spark), work).count() == 0
    assert state_rows(spark, work).count() == 0


def test_a_hot_order_and_odd_texts(spark):
    """One order holds a third of the feed; notes and amounts come back as they were."""
    work = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    odd = (5000, 5, ("pending", 'say "hi"\n\\ ☕ ,[]', T.replace(microsecond=123456), Decimal("12345678.90"), 7, [1, None, 2]), None)
    rows = [checkout(1), odd, checkout(9, quantities=())] + [request(1, n, "voided", 8) for n in range(1, 900)]
    spark.createDataFrame(rows, FEED_SCHEMA).repartition(3, "order_id").write.parquet(f"{work}/feed")
    got = {r.id: r for r in run_board_stream(spark, f"{work}/feed", users(spark), work, files_per_batch=3).collect()}
    assert sorted(got) == [1, 5, 9]
    assert (got[5].notes, got[5].created_at, got[5].total, got[5].item_count) == (odd[2][1], odd[2][2], odd[2][3], 3)
    assert got[9].item_count == 0 and got[9].notes is None


def test_an_empty_feed_leaves_an_empty_board(spark, tables):
    work = f"{ensure_checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    write_feed(feed_rows(tables.orders.limit(0), tables.order_items.limit(0), tables.status_events.limit(0)), f"{work}/feed", 2)
    assert run_board_stream(spark, f"{work}/feed", users(spark), work).count() == 0
    assert board(spark, f"{work}/none").columns == [c.split()[0] for c in BOARD_SCHEMA.split(", ")]
