"""What a query reads, shuffles and sorts per task as its tables grow."""

import random

import pytest
from conftest import SMALL

from tillroll.operators import incremental, writes
from tillroll.plans.catalog import QUERIES
from tillroll.plans.inspect import plan_text
from tillroll.sources import store
from tillroll.sources.fixtures import PosTables
from tillroll.streaming import kitchen


@pytest.mark.parametrize("name, read", [("audit_voided", {"orders", "users"}), ("audit_clock_in", {"user_sessions", "users"}),
                                        ("audit_listed", {"orders", "order_items", "users"})])
def test_an_audit_kind_names_its_own_tables_only(spark, monkeypatch, name, read):
    seen, table = set(), PosTables.table
    monkeypatch.setattr(PosTables, "table", lambda self, n: seen.add(n) or table(self, n))
    PosTables(spark, SMALL).order_items, PosTables(spark, SMALL).user_sessions, PosTables(spark, SMALL).orders   # stored before
    seen.clear()
    QUERIES[name](spark, SMALL)
    assert seen - {"users"} == read - {"users"} and "users" in seen


def test_stored_tables_get_a_bucket_per_16_mb_of_their_source(spark, monkeypatch):
    monkeypatch.setattr(store, "_source_files", lambda spark, sf_dir, source: ({"lineitem": 640 << 20}.get(source, 1 << 20), source))
    assert {store.bucket_count(spark, SMALL, t) for t in ("lines", "order_items", "carts", "products", "product_sizes")} == {40}
    assert store.bucket_count(spark, SMALL, "users") <= 32


@pytest.fixture
def without_broadcasts(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_are_built_with_the_fewest_shuffles(spark, tables, without_broadcasts):
    n = store.bucket_count(spark, SMALL, "lines")
    tables.lines, tables.products, tables.product_sizes, tables.cart_lines, tables.carts
    built = tables._build_lines().repartition(n, "order_id")
    assert plan_text(built, "simple").count("Exchange hashpartitioning") == 1      # numbered where they are written
    assert plan_text(tables._build_order_items(), "simple").count("Exchange hashpartitioning") <= 1
    text = plan_text(tables._build_held_carts(), "simple")
    assert "Union" not in text and text.count("Exchange hashpartitioning") <= 6


def test_held_cart_documents_and_their_odd_ones(tables):
    from tillroll.sources.fixtures import ODD_DOCUMENTS
    rows = tables.held_carts.collect()
    odd = {r.holder_id: r.held_json for r in rows if r.holder_id.count("-") == 2}
    own = [r.holder_id for r in rows if r.holder_id.count("-") == 1]
    assert len(own) == len(set(own)) and len(rows) == len(own) + len(odd)
    assert odd == {f"{i}-{ODD_DOCUMENTS[int(i.split('-')[0]) % 7][0]}": ODD_DOCUMENTS[int(i.split("-")[0]) % 7][1] for i in own}


def adds(spark, n=3000):
    rng = random.Random(4)
    rows = [(seq * 40_000, rng.randint(1, 3), rng.randint(1, 4), None, None, rng.choice([1, 1, -1, 0])) for seq in range(n)]
    return rows, spark.createDataFrame(rows, "seq bigint, cart_id bigint, product_id bigint, size_id int, addon_id bigint, change int")


def replay(rows):
    held = {}
    for _, cart, product, _, _, change in rows:
        key = (cart, f"{product}|base|")
        held[key] = max(held.get(key, 0) + change, 0) if change else 0
    return sorted((*k, q) for k, q in held.items() if q > 0)


def test_folds_of_many_changes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(writes, "ROWS_PER_TASK", 300)
    rows, df = adds(spark)
    whole = writes.merge_cart_lines(df)
    batches = [incremental.cart_summaries(df.where(c)) for c in ("seq < 40000000", "seq >= 40000000")]
    for got in (whole, incremental.summary_lines(*batches)):
        assert sorted((r.cart_id, r.cart_key, r.quantity) for r in got.collect()) == replay(rows)
    text = plan_text(writes.merge_cart_lines(df), "simple")
    assert text.count(", 10), REPARTITION_BY_NUM") == text.count("Exchange hashpartitioning") == 2  # one per level of ranges
    monkeypatch.setattr(writes, "ROWS_PER_TASK", 2)
    text = plan_text(incremental.fold_summaries(*batches), "simple")
    assert ", 12), REPARTITION_BY_NUM" in text or ", 11), REPARTITION_BY_NUM" in text


@pytest.mark.parametrize("users_too_many", [False, True])
def test_voids_and_refunds_never_meet_the_users(spark, tables, monkeypatch, users_too_many):
    if users_too_many:
        monkeypatch.setattr(kitchen, "BROADCAST_USERS", 1)
    feed = kitchen.feed_rows(tables.orders, tables.order_items, tables.status_events)
    found = kitchen.moves(feed, tables.users)
    text = plan_text(found, "simple")
    assert "Union" in text and "Inner" in text
    want = feed.where("request.event_type in ('voided', 'refunded')").selectExpr("order_id", "request.actor_id").distinct()
    got = found.where(found["kind"] == 2).select("order_id", "who").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    kitchen_ids = {r.id for r in tables.users.where("role in ('Kitchen', 'Manager')").collect()}
    done = {r.order_id for r in feed.where("request.event_type = 'complete'").select("order_id", "request.actor_id").collect() if r.actor_id in kitchen_ids}
    assert {r.order_id for r in found.where(found["kind"] == 1).collect()} == done
