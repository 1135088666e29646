"""Physical-plan checks: no Cartesian product or nested-loop join, no Python
UDF, filters and column pruning reach the Parquet scans."""

import pytest

from tillroll.operators import audit, writes
from tillroll.plans.catalog import QUERIES
from tillroll.plans.inspect import plan_text, scan_summaries

SMALL = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")
NAMES = sorted(set(QUERIES) - {"kitchen_queue_stream"})


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_python(spark, name):
    text = plan_text(QUERIES[name](spark, SMALL))
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"


def _orders_scan(df):
    scans = [s for s in scan_summaries(df) if s["location"].rstrip("]").rstrip("/").endswith("/orders")]
    assert len(scans) == 1, scans
    return scans[0]


def test_daily_report_pushes_day_ranges_into_the_orders_scan(spark):
    scan = _orders_scan(QUERIES["daily_report"](spark, SMALL))
    for col in ("created_at", "completed_at", "refunded_at", "voided_at"):
        assert f"GreaterThanOrEqual({col},2024-01-29T00:00" in scan["pushed"], scan["pushed"]
    assert "notes" not in scan["read_schema"] and "payment_method" not in scan["read_schema"]


def test_order_stats_reads_only_needed_columns(spark):
    scan = _orders_scan(QUERIES["order_stats"](spark, SMALL))
    assert scan["read_schema"] == "struct<status:string,total:decimal(10,2)>"


def test_lines_and_orders_join_without_shuffle(spark):
    text = plan_text(QUERIES["items_sold"](spark, SMALL), "simple")
    assert "Exchange hashpartitioning(order_id" not in text
    assert "Exchange hashpartitioning(id" not in text


def test_sessionize_splits_a_user(tables):
    text = plan_text(writes.sessionize_logins(tables.login_events), "simple")
    assert "Exchange hashpartitioning(user_id#" in text and ", part#" in text
    # the per-user window runs over the summary of one row per part, not over events
    assert "Window [lead(first" in text


def test_audit_log_describes_only_the_top_rows(spark):
    text = plan_text(QUERIES["audit_log"](spark, SMALL), "simple")
    assert "LeftSemi" in text and "BroadcastExchange" in text
    assert "TakeOrderedAndProject" not in text      # the limit ran before, in the written phase


def test_session_events_never_meet_the_cashiers(tables):
    text = plan_text(audit.audit_events(tables.orders, tables.order_items, tables.users, tables.user_sessions), "simple")
    assert "CartesianProduct" not in text and "Union" in text


# Largest number of hash exchanges per query when nothing fits a broadcast.
EXCHANGES = {"price_lines": 2, "checkout_items": 3, "kitchen_queue": 2, "audit_listed": 2, "audit_completed": 4, "audit_voided": 2,
             "items_sold": 0, "order_lines_nested": 3, "apply_order_status": 4}


@pytest.fixture
def without_broadcasts(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_shuffles_when_nothing_is_broadcast(spark, without_broadcasts, name):
    text = plan_text(QUERIES[name](spark, SMALL), "simple")
    assert "BroadcastHashJoin" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("Exchange hashpartitioning") <= EXCHANGES[name], text
