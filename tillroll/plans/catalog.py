"""Registered queries: each binds an operator to the derived point-of-sale
tables of one scale-factor folder and to the fixed report time.

Every query reads whole tables; none takes an id subset or a row cap. The
only limits are the features themselves (the audit log's newest 100, the
pending list's newest 10).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import audit, checkout, incremental, insights, reports, writes
from tillroll.schema import AS_OF
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources.fixtures import PosTables
from tillroll.sources.stage import stage_path, staged
from tillroll.sources.store import bucket_count
from tillroll.streaming.kitchen import kitchen_queue_stream

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[PosTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str, store: bool = True) -> DataFrame:
            return fn(PosTables(spark, sf_dir, store))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---- reports ---------------------------------------------------------------
@register("order_stats")
def _order_stats(t: PosTables):
    return reports.order_stats(t.orders)


@register("items_sold")
def _items_sold(t: PosTables):
    return reports.items_sold(t.order_items, t.orders)


@register("audit_log")
def _audit_log(t: PosTables):
    return audit.audit_log(t.orders, t.order_items, t.users, t.user_sessions)


def _audit_kind(name: str, kind: str):
    @register(name)
    def _q(t: PosTables):
        # Only the tables that the kind's events come from: naming a table makes the store write it.
        of_orders = kind in audit.ORDER_KINDS
        return audit.audit_events(t.orders if of_orders else None, t.order_items if kind in audit.UNIT_KINDS else None,
                                  t.users, None if of_orders else t.user_sessions, kinds=(kind,))
    _q.__doc__ = f"Every '{kind}' audit event (no limit)."


for _name, _kind in (("audit_listed", "listed"), ("audit_completed", "completed"),
                     ("audit_voided", "voided"), ("audit_refunded", "refunded"),
                     ("audit_clock_in", "clocked-in"), ("audit_clock_out", "clocked-out")):
    _audit_kind(_name, _kind)


@register("daily_report")
def _daily_report(t: PosTables):
    return reports.daily_report(t.orders, AS_OF)


@register("hours_report")
def _hours_report(t: PosTables):
    return reports.hours_report(t.user_sessions, AS_OF)


@register("pending_registrations")
def _pending(t: PosTables):
    return reports.pending_registrations(t.registrations)


@register("staff_profiles")
def _staff(t: PosTables):
    return reports.staff_profiles(t.users)


@register("menu_catalog")
def _menu(t: PosTables):
    return reports.menu_catalog(t.products, t.categories)


@register("kitchen_queue")
def _kitchen_queue(t: PosTables):
    return reports.kitchen_queue(t.orders, t.users, t.order_items)


@register("kitchen_tickets")
def _kitchen_tickets(t: PosTables):
    """R10 in flat form: the nested tickets exploded back to one row per
    (order, item, addon) with array positions."""
    nested = reports.kitchen_tickets(t.orders, t.users, t.order_items, t.order_item_addons)
    keep = ["id", "status", "notes", "created_at", "total", "cashier_name", "cashier_username", "item_count"]
    return reports.flatten_lines(nested, keep)


@register("order_lines_nested")
def _order_lines(t: PosTables):
    """R11 in flat form (one row per item and addon, with positions)."""
    return reports.flatten_lines(reports.order_lines_nested(t.order_items, t.order_item_addons),
                                 ["order_id"])


@register("item_display_names")
def _item_names(t: PosTables):
    return reports.item_display_names(t.order_items, t.order_item_addons)


@register("cashier_transactions")
def _cashier_tx(t: PosTables):
    return reports.cashier_transactions(t.orders, t.order_items)


@register("cashier_order_count")
def _cashier_count(t: PosTables):
    return reports.cashier_order_count(t.orders, t.users)


@register("session_revenue")
def _session_revenue(t: PosTables):
    return reports.session_revenue(t.orders, t.user_sessions)


@register("cashier_time_summary")
def _cashier_time(t: PosTables):
    return reports.cashier_time_summary(t.user_sessions, AS_OF)


@register("transaction_detail")
def _tx_detail(t: PosTables):
    return reports.transaction_detail(t.orders, t.payments)


@register("active_menu")
def _active_menu(t: PosTables):
    return reports.active_menu(t.products, t.product_sizes, t.product_addons)


@register("product_sizes_list")
def _sizes(t: PosTables):
    return reports.product_sizes_list(t.products, t.product_sizes)


@register("product_addons_list")
def _addons(t: PosTables):
    return reports.product_addons_list(t.products, t.product_addons)


# ---- write paths ------------------------------------------------------------
def _priced(t: PosTables):
    return writes.price_lines(t.cart_lines, t.products, t.product_sizes, t.product_addons)


@register("price_lines")
def _price_lines(t: PosTables):
    return _priced(t)


@register("merge_cart_lines")
def _merge(t: PosTables):
    return writes.merge_cart_lines(t.cart_adds)


@register("cart_totals")
def _cart_totals(t: PosTables):
    return writes.cart_totals(_priced(t), t.carts)


@register("checkout_orders")
def _checkout_orders(t: PosTables):
    accepted = writes.accepted_carts(t.carts, t.cart_lines, t.products)
    return writes.checkout_orders(t.carts, writes.cart_totals(_priced(t), t.carts), t.user_sessions, accepted)


@register("checkout_items")
def _checkout_items(t: PosTables):
    return writes.checkout_items(_priced(t), t.carts)


@register("checkout_addons")
def _checkout_addons(t: PosTables):
    return writes.checkout_addons(t.cart_lines, t.product_addons, t.carts)


@register("checkout_payments")
def _checkout_payments(t: PosTables):
    return writes.checkout_payments(t.carts, writes.cart_totals(_priced(t), t.carts))


@register("checkout_sessions")
def _checkout_sessions(t: PosTables):
    return writes.checkout_sessions(t.carts, None, t.user_sessions, writes.accepted_carts(t.carts, t.cart_lines, t.products))


@register("checkout_write_set")
def _checkout_write_set(t: PosTables):
    """All five results of one staged checkout, counted."""
    return checkout.write_set(checkout.checkout(t.carts, t.cart_lines, t.products, t.product_sizes, t.product_addons, t.user_sessions))


@register("accept_registrations")
def _accept(t: PosTables):
    return writes.accept_registrations(t.registration_requests, t.registrations, t.users, AS_OF)["outcomes"]


@register("accept_registrations_users")
def _accept_users(t: PosTables):
    return writes.accept_registrations(t.registration_requests, t.registrations, t.users, AS_OF)["new_users"]


@register("accept_registrations_remaining")
def _accept_left(t: PosTables):
    return writes.accept_registrations(t.registration_requests, t.registrations, t.users, AS_OF)["remaining"]


@register("reject_registrations")
def _reject(t: PosTables):
    return writes.reject_registrations(t.registration_requests, t.registrations)["outcomes"]


@register("reject_registrations_remaining")
def _reject_left(t: PosTables):
    return writes.reject_registrations(t.registration_requests, t.registrations)["remaining"]


@register("registration_conflicts")
def _conflicts(t: PosTables):
    ensure_checkpoint_dir(t.spark)
    return writes.registration_conflicts(t.signups, t.users, t.registrations)


@register("apply_order_status")
def _apply_status(t: PosTables):
    return writes.apply_order_status(t.orders, t.status_events, t.users)["orders"]


@register("order_status_outcomes")
def _status_outcomes(t: PosTables):
    return writes.apply_order_status(t.orders, t.status_events, t.users)["outcomes"]


@register("apply_staff_status")
def _staff_status(t: PosTables):
    return writes.apply_staff_status(t.users, t.staff_updates)


@register("apply_availability")
def _availability(t: PosTables):
    return writes.apply_availability(t.products, t.availability_updates)


@register("apply_image_url")
def _image(t: PosTables):
    return writes.apply_image_url(t.products, t.image_updates)


@register("staff_status_outcomes")
def _staff_outcomes(t: PosTables):
    return writes.staff_status_outcomes(t.users, t.staff_updates)


@register("availability_outcomes")
def _availability_outcomes(t: PosTables):
    return writes.availability_outcomes(t.products, t.availability_updates)


@register("image_outcomes")
def _image_outcomes(t: PosTables):
    return writes.image_outcomes(t.products, t.image_updates)


@register("sessionize_logins")
def _sessions(t: PosTables):
    ensure_checkpoint_dir(t.spark)
    return writes.sessionize_logins(t.login_events)


@register("held_cart_totals")
def _held(t: PosTables):
    return writes.held_cart_totals(t.held_carts)


# ---- browser computations ------------------------------------------------------
@register("category_counts")
def _cat_counts(t: PosTables):
    """U01, manager form: every product."""
    return insights.category_counts(t.products, t.categories)


@register("category_counts_available")
def _cat_counts_avail(t: PosTables):
    """U01, cashier form: available products only."""
    return insights.category_counts(t.products, t.categories, available_only=True)


@register("menu_by_category")
def _menu_by_cat(t: PosTables):
    """U02 with the cashier's tab set to category 2 (the operator's
    parameter, not a sample: every product of that category is returned)."""
    return insights.menu_by_category(reports.active_menu(t.products, t.product_sizes, t.product_addons), 2)


@register("products_grouped")
def _grouped(t: PosTables):
    return insights.products_grouped(reports.active_menu(t.products, t.product_sizes, t.product_addons))


@register("kitchen_status")
def _kitchen_status(t: PosTables):
    return insights.kitchen_status(t.orders, AS_OF)


@register("daily_comparison")
def _comparison(t: PosTables):
    return insights.daily_comparison(reports.daily_report(t.orders, AS_OF),
                                     reports.hours_report(t.user_sessions, AS_OF))


@register("daily_history")
def _history(t: PosTables):
    return insights.daily_history(t.orders, t.user_sessions, AS_OF)


@register("transaction_labels")
def _labels(t: PosTables):
    return insights.transaction_labels(reports.cashier_transactions(t.orders, t.order_items))


# ---- batch by batch -----------------------------------------------------------------
@register("merge_cart_lines_batches")
def _merge_batches(t: PosTables):
    """B02 in three batches of ``seq``, each kept as its summary only."""
    ends = t.cart_adds.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    low, high = (ends.low or 0, ends.high or 0)
    first, second = low + (high - low) // 3, low + 2 * (high - low) // 3
    cuts = (F.col("seq") < first, (F.col("seq") >= first) & (F.col("seq") < second), F.col("seq") >= second)
    return incremental.summary_lines(*[staged(incremental.cart_summaries(t.cart_adds.filter(c)), "cart-batch") for c in cuts])


@register("sessionize_logins_batches")
def _session_batches(t: PosTables):
    """B10 in two batches, the open sessions carried over."""
    ev = t.login_events
    ends = ev.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if ends.low is None:
        return writes.sessionize_logins(ev)
    middle = reports.ntz(ends.low + (ends.high - ends.low) / 2)
    none = writes.sessionize_logins(ev.limit(0))
    first = incremental.sessionize_batch(ev.filter(F.col("ts") < middle), none)
    second = incremental.sessionize_batch(ev.filter(F.col("ts") >= middle), staged(first["open"], "open-sessions"))
    return first["closed"].unionByName(second["closed"]).unionByName(second["open"])


@register("daily_history_kept")
def _history_kept(t: PosTables):
    """U06 from partials: all days up to the report's, then the changes since that day began."""
    cut = dt.datetime.combine(AS_OF.date(), dt.time())
    orders, sessions = incremental.orders_changed_since(t.orders, cut), incremental.sessions_changed_since(t.user_sessions, cut)
    kept = incremental.day_partials(incremental.orders_as_of(t.orders, cut), incremental.sessions_as_of(t.user_sessions, cut)).staged()
    changes = incremental.day_changes(incremental.orders_as_of(orders, cut), orders, incremental.sessions_as_of(sessions, cut), sessions)
    return incremental.partials_history(kept.plus(changes).staged(), AS_OF)


@register("apply_order_status_stored")
def _apply_status_stored(t: PosTables):
    """B08 on a stored order table of which only the buckets with requests are written again."""
    path = stage_path(t.spark, "order-buckets")
    incremental.write_orders(t.orders, path, bucket_count(t.spark, t.sf_dir, "orders"))
    incremental.apply_status_stored(t.spark, path, t.status_events, t.users)
    return incremental.read_orders(t.spark, path)


# ---- streaming -------------------------------------------------------------------
@register("kitchen_queue_stream")
def _kitchen_stream(t: PosTables):
    """The kitchen board after streaming every checkout and status request
    from an empty board; equals R09 over the orders after B08."""
    return kitchen_queue_stream(t.spark, t.orders, t.users, t.order_items, t.status_events)
