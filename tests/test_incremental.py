"""Batch-to-batch forms give what one batch gives, and read and write only what a batch touches."""

import datetime as dt
import functools
import os
import random

import pytest
from pyspark.sql import functions as F

from test_traps import EVENTS, ORDERS, SESSIONS, TS, USERS, order, rows
from tillroll.operators import incremental, insights, writes
from tillroll.plans.inspect import plan_text, scan_summaries
from tillroll.sources.stage import staged

ADDS = "seq bigint, cart_id bigint, product_id bigint, size_id int, addon_id bigint, change int"
LOGINS = "id bigint, user_id bigint, ts timestamp_ntz, event_type string"


# ---- B02 -----------------------------------------------------------------------------------
def lines(df):
    return rows(df, "cart_id", "cart_key", "quantity")


@pytest.mark.parametrize("cuts", [(), (0,), (1, 2), (37, 200, 201), (100, 100), (299,)])
def test_cart_changes_in_any_cut(spark, cuts):
    rnd = random.Random(17)
    adds = [(seq * 5 - 400, rnd.randrange(3), rnd.randrange(2), None, None, rnd.choice([1, 1, -1, -1, 0])) for seq in range(300)]
    df = spark.createDataFrame(adds, ADDS)
    ends = [-401, *[c * 5 - 400 for c in cuts], 2000]
    batches = [staged(incremental.cart_summaries(df.filter((F.col("seq") >= a) & (F.col("seq") < b))), "t") for a, b in zip(ends, ends[1:])]
    want = lines(writes.merge_cart_lines(df))
    assert lines(incremental.summary_lines(*batches)) == want
    assert lines(incremental.summary_lines(*reversed(batches))) == want         # whatever order they came in
    one_by_one = functools.reduce(lambda a, b: staged(incremental.fold_summaries(a, b), "t"), batches)
    assert lines(incremental.summary_lines(one_by_one)) == want


def test_a_minus_at_the_start_of_a_batch_meets_the_line_kept(spark):
    df = spark.createDataFrame([(1, 1, 1, None, None, 1), (2, 1, 1, None, None, -1), (3, 1, 1, None, None, -1), (4, 1, 1, None, None, 1),
                                (5, 1, 2, None, None, 0), (6, 1, 2, None, None, -1)], ADDS)
    parts = [incremental.cart_summaries(df.filter(c)) for c in ("seq <= 1", "seq = 2", "seq > 2")]
    assert lines(incremental.summary_lines(*parts)) == [(1, "1|base|", 1)]


# ---- B10 -----------------------------------------------------------------------------------
def test_logins_in_any_cut(spark):
    rnd = random.Random(23)
    base = TS(2024, 1, 1)
    evs = [(i, rnd.choice([0, 0, 0, 1, 2, 3]), base + dt.timedelta(seconds=rnd.randrange(60)), rnd.choice(["login", "login", "logout"]))
           for i in range(120)]
    df = spark.createDataFrame(evs, LOGINS)
    want = rows(writes.sessionize_logins(df).filter("logged_out_at is not null"), "id", "user_id", "logged_in_at", "logged_out_at")
    still = rows(writes.sessionize_logins(df).filter("logged_out_at is null"), "id", "user_id", "logged_in_at")
    for cuts in ((30,), (0, 60), (10, 11, 59)):
        ends = [base - dt.timedelta(seconds=1), *[base + dt.timedelta(seconds=c) for c in cuts], base + dt.timedelta(hours=1)]
        closed, carry = [], writes.sessionize_logins(df.limit(0))
        for a, b in zip(ends, ends[1:]):
            out = incremental.sessionize_batch(df.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))), carry)
            closed += rows(out["closed"], "id", "user_id", "logged_in_at", "logged_out_at")
            carry = staged(out["open"], "t")
            assert carry.groupBy("user_id").count().filter("count > 1").count() == 0
        assert sorted(closed) == want
        assert rows(carry, "id", "user_id", "logged_in_at") == still


def test_a_batch_without_events_carries_all_open_sessions(spark):
    opened = spark.createDataFrame([(1, 5, TS(2024, 1, 1, 8), None), (2, None, TS(2024, 1, 1, 9), None)], SESSIONS)
    out = incremental.sessionize_batch(spark.createDataFrame([], LOGINS), opened)
    assert out["closed"].count() == 0
    assert sorted(r.id for r in out["open"].collect()) == [1, 2]
    late = spark.createDataFrame([(9, 5, TS(2024, 1, 2, 8), "login"), (10, 6, TS(2024, 1, 2, 8), "logout")], LOGINS)
    out = incremental.sessionize_batch(late, opened)
    assert rows(out["closed"], "id", "logged_out_at") == [(1, TS(2024, 1, 1, 8))]
    assert sorted(r.id for r in out["open"].collect()) == [2, 9]


# ---- U06 -----------------------------------------------------------------------------------
def random_day_tables(spark, seed):
    rnd = random.Random(seed)
    base = TS(2024, 1, 1)

    def when():
        return base + dt.timedelta(seconds=rnd.randrange(6 * 86400), microseconds=rnd.choice([0, 500_000]))
    odata = []
    for i in range(150):
        created, st = when(), rnd.choice(["pending", "completed", "refunded", "voided"])
        done = created + dt.timedelta(seconds=rnd.randrange(86400))
        odata.append(order(i, 1, st, total=f"{rnd.randrange(1, 90)}.25", created=created,
                           completed_at=done if st in ("completed", "refunded") else None,
                           refunded_at=done + dt.timedelta(seconds=rnd.randrange(2 * 86400)) if st == "refunded" else None,
                           voided_at=done if st == "voided" else None))
    sdata = []
    for i in range(120):
        start = when()
        sdata.append((i, rnd.choice([1, 2, 3, 40_000, 70_000, None]), start, rnd.choice([None, start + dt.timedelta(seconds=rnd.randrange(100_000))])))
    return spark.createDataFrame(odata, ORDERS), spark.createDataFrame(sdata, SESSIONS)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_day_by_day_equals_the_full_run(spark, seed):
    orders, sessions = random_day_tables(spark, seed)
    as_of = TS(2024, 1, 12, 12)
    cuts = [TS(2024, 1, 3), TS(2024, 1, 4), TS(2024, 1, 6, 15)]
    kept = incremental.day_partials(incremental.orders_as_of(orders, cuts[0]), incremental.sessions_as_of(sessions, cuts[0])).staged()
    for a, b in zip(cuts, [*cuts[1:], TS(2024, 2, 1)]):
        now_o, now_s = incremental.orders_as_of(orders, b), incremental.sessions_as_of(sessions, b)
        new_o, new_s = incremental.orders_changed_since(now_o, a), incremental.sessions_changed_since(now_s, a)
        kept = kept.plus(incremental.day_changes(incremental.orders_as_of(new_o, a), new_o,
                                                 incremental.sessions_as_of(new_s, a), new_s)).staged()
        cols = insights.daily_history(now_o, now_s, as_of).columns
        assert rows(incremental.partials_history(kept, as_of), *cols) == rows(insights.daily_history(now_o, now_s, as_of), *cols)


def test_history_partials_do_not_fix_the_report_time(spark):
    orders, sessions = random_day_tables(spark, 5)
    kept = incremental.day_partials(orders, sessions).staged()
    for as_of in (TS(2024, 1, 8), TS(2024, 1, 20, 7, 30, 1)):
        want = insights.daily_history(orders, sessions, as_of)
        assert rows(incremental.partials_history(kept, as_of), *want.columns) == rows(want, *want.columns)
    none = incremental.day_partials(orders.limit(0), sessions.limit(0))
    assert rows(incremental.partials_history(none, TS(2024, 1, 8)), "day", "staff_count") == [(dt.date(2024, 1, 8), 0)]


def test_a_day_left_by_all_its_orders_counts_as_quiet(spark):
    before = spark.createDataFrame([order(1, 1, "completed", completed_at=TS(2024, 1, 1, 9))], ORDERS)
    after = spark.createDataFrame([order(1, 1, "refunded", completed_at=TS(2024, 1, 1, 9), refunded_at=TS(2024, 1, 3, 9))], ORDERS)
    none = spark.createDataFrame([], SESSIONS)
    kept = incremental.day_partials(before, none).plus(incremental.day_changes(before, after, none, none))
    got = rows(incremental.partials_history(kept, TS(2024, 1, 4)), "day", "transactions_made", "orders_refunded")
    assert got == [(dt.date(2024, 1, 3), 0, 1), (dt.date(2024, 1, 4), 0, 0)]


def test_a_days_changes_are_found_by_filters_in_the_scan(tables):
    cut = TS(2024, 1, 30)
    for df, columns in ((incremental.orders_changed_since(tables.orders, cut), ("completed_at", "refunded_at", "voided_at")),
                        (incremental.sessions_changed_since(tables.user_sessions, cut), ("logged_in_at", "logged_out_at"))):
        (scan,) = scan_summaries(df)
        assert all(f"GreaterThanOrEqual({c}," in scan["pushed"] for c in columns)


def test_touched_buckets_prune_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    incremental.write_orders(spark.createDataFrame([order(i, 3, "pending") for i in range(50)], ORDERS), path, 8)
    buckets, stored = incremental.stored_orders(spark, path)
    assert buckets == 8
    assert "PartitionFilters: [bucket#" in plan_text(stored.filter(F.col("bucket").isin([1, 5])))


# ---- B08 -----------------------------------------------------------------------------------
def files_of(path):
    return {os.path.join(folder, f) for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_buckets_with_requests_are_written_again(spark, tmp_path):
    users = spark.createDataFrame([(1, "u1", "n", "e1", "Kitchen", "active", TS(2024, 1, 1))], USERS)
    orders = spark.createDataFrame([order(i, 3, "pending") for i in range(200)], ORDERS)
    events = spark.createDataFrame([(7, 1, "complete", 1, TS(2024, 1, 30, 10)), (7, 2, "refunded", 3, TS(2024, 1, 30, 11)),
                                    (11, 3, "voided", 3, TS(2024, 1, 30, 12)), (11, 4, "complete", 1, TS(2024, 1, 30, 13)),
                                    (9999, 5, "voided", 3, TS(2024, 1, 30, 14)), (None, 6, "voided", 3, TS(2024, 1, 30, 14))], EVENTS)
    path = str(tmp_path / "orders")
    incremental.write_orders(orders, path, 16)
    before = files_of(path)
    want = writes.apply_order_status(orders, events, users)
    outcomes = incremental.apply_status_stored(spark, path, events, users)
    after = files_of(path)
    assert len(before & after) >= len(before) - 3                # orders 7, 11 and perhaps the bucket of the unknown one
    assert len(after) == len(before)
    key = sorted(tuple(map(str, r)) for r in want["orders"].collect())
    assert sorted(tuple(map(str, r)) for r in incremental.read_orders(spark, path).collect()) == key
    assert incremental.read_orders(spark, path).columns == want["orders"].columns
    assert rows(outcomes, "seq", "outcome") == rows(want["outcomes"], "seq", "outcome")
    # again, as after a run lost while buckets were replaced: the orders stay as they are
    incremental.apply_status_stored(spark, path, events, users)
    assert sorted(tuple(map(str, r)) for r in incremental.read_orders(spark, path).collect()) == key
    # no requests: no file is touched
    now = files_of(path)
    incremental.apply_status_stored(spark, path, events.limit(0), users)
    assert files_of(path) == now


def test_status_in_batches_equals_one_run(spark, tmp_path):
    rnd = random.Random(31)
    roles = {1: "Kitchen", 2: "Manager", 3: "Cashier", 4: "Cashier"}
    users = spark.createDataFrame([(k, f"u{k}", "n", f"e{k}", r, "active", TS(2024, 1, 1)) for k, r in roles.items()], USERS)
    orders = spark.createDataFrame([order(i, rnd.choice([3, 4]), rnd.choice(["pending", "pending", "held"])) for i in range(40)], ORDERS)
    events = spark.createDataFrame([(rnd.randrange(45), seq, rnd.choice(["complete", "voided", "refunded"]), rnd.choice([1, 2, 3, 4]),
                                     TS(2024, 1, 30, 10) + dt.timedelta(minutes=rnd.randrange(500))) for seq in range(120)], EVENTS)
    want = writes.apply_order_status(orders, events, users)
    path, got = str(tmp_path / "orders"), []
    incremental.write_orders(orders, path, 8)
    for a, b in ((0, 50), (50, 51), (51, 120)):
        got += rows(incremental.apply_status_stored(spark, path, events.filter((F.col("seq") >= a) & (F.col("seq") < b)), users), "seq", "outcome")
    assert sorted(got) == rows(want["outcomes"], "seq", "outcome")
    assert sorted(tuple(map(str, r)) for r in incremental.read_orders(spark, path).collect()) == \
        sorted(tuple(map(str, r)) for r in want["orders"].collect())


def test_status_on_an_empty_stored_table_is_refused(spark, tmp_path):
    users = spark.createDataFrame([], USERS)
    path = str(tmp_path / "orders")
    incremental.write_orders(spark.createDataFrame([], ORDERS), path, 4)
    events = spark.createDataFrame([(1, 1, "voided", 4, TS(2024, 1, 30, 10))], EVENTS)
    assert rows(incremental.apply_status_stored(spark, path, events, users), "seq", "outcome") == [(1, "refused")]
    assert incremental.read_orders(spark, path).count() == 0
