"""Reports the point-of-sale server computes in SQL.

Every operator is a plain function DataFrame(s) → DataFrame over *all* ids;
a request for one cashier or one order is one row (or a filter) of the
result. None of them collects, loops over rows or reads the clock: report
time is the explicit ``as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.scalars import (duration_text, initials, item_display_name, product_image,
                                        seconds_between)
from tillroll.schema import MONEY_OUT, PENDING_LIMIT


# ---- shared pieces -----------------------------------------------------------
def ntz(value: dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def on_day(col: Column, day: dt.date) -> Column:
    """DATE(col) = day, written as a half-open range on the raw column so the
    Parquet reader can skip row groups by min/max."""
    return (col >= ntz(day)) & (col < ntz(day + dt.timedelta(days=1)))


def report_days(as_of: dt.datetime) -> tuple[dt.date, dt.date]:
    today = as_of.date()
    return today, today - dt.timedelta(days=1)


def item_counts(order_items: DataFrame) -> DataFrame:
    """Units per order. Aggregated before any join: the partial aggregate on
    the map side shrinks lines to at most one row per order and partition."""
    return order_items.groupBy("order_id").agg(F.sum("quantity").alias("item_count"))


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value).otherwise(0)), F.lit(0)).cast(MONEY_OUT)


# ---- R01 / R02: dashboard metrics -------------------------------------------
def order_stats(orders: DataFrame) -> DataFrame:
    """All orders counted; revenue and average over completed ones only."""
    done = F.col("status") == "completed"
    return orders.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _sum_if(done, F.col("total")).alias("total_revenue"),
        F.coalesce(F.avg(F.when(done, F.col("total"))), F.lit(0)).cast("decimal(18,6)")
         .alias("avg_transaction"),
    )


def items_sold(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Units on completed orders."""
    completed = orders.filter(F.col("status") == "completed").select(F.col("id").alias("order_id"))
    return item_counts(order_items).join(completed, "order_id").agg(
        F.coalesce(F.sum("item_count"), F.lit(0)).cast("bigint").alias("items_sold"))


# ---- R04 / R05: today versus yesterday --------------------------------------
def daily_report(orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Completed / refunded / voided counts and amounts, today and
    yesterday, by *current* status (a refund removes the order from its
    completion day). One pass of conditional aggregation."""
    today, yday = report_days(as_of)
    st, tot = F.col("status"), F.col("total")
    window_days = F.lit(False)
    for c in ("created_at", "completed_at", "refunded_at", "voided_at"):
        window_days = window_days | on_day(F.col(c), yday) | on_day(F.col(c), today)
    cols = []
    for status, ts, count_name, amount_name in (
            ("completed", "completed_at", "transactions_made", "daily_revenue"),
            ("refunded", "refunded_at", "orders_refunded", "refunded_total"),
            ("voided", "voided_at", "orders_voided", "voided_total")):
        for day, suffix in ((today, ""), (yday, "_yesterday")):
            cond = (st == status) & on_day(F.col(ts), day)
            cols.append(_count_if(cond).alias(count_name + suffix))
            cols.append(_sum_if(cond, tot).alias(amount_name + suffix))
    return orders.filter(window_days).agg(*cols)


def hours_report(user_sessions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seconds clocked and distinct staff, today and yesterday. An open
    session runs to ``as_of`` and belongs wholly to its login day."""
    today, yday = report_days(as_of)
    start = F.col("logged_in_at")
    dur = seconds_between(start, F.coalesce(F.col("logged_out_at"), ntz(as_of)))
    t, y = on_day(start, today), on_day(start, yday)
    agg = user_sessions.filter(t | y).agg(
        F.coalesce(F.sum(F.when(t, dur).otherwise(0)), F.lit(0)).cast("bigint").alias("seconds_clocked"),
        F.coalesce(F.sum(F.when(y, dur).otherwise(0)), F.lit(0)).cast("bigint")
         .alias("seconds_clocked_yesterday"),
        F.count_distinct(F.when(t, F.col("user_id"))).alias("staff_count"),
        F.count_distinct(F.when(y, F.col("user_id"))).alias("staff_count_yesterday"),
    )
    return agg.select("*",
                      (F.col("seconds_clocked") / F.lit(3600.0)).alias("hours_clocked"),
                      (F.col("seconds_clocked_yesterday") / F.lit(3600.0)).alias("hours_clocked_yesterday"))


# ---- R06 - R08: lists ----------------------------------------------------------
def pending_registrations(registrations: DataFrame, limit: int = PENDING_LIMIT) -> DataFrame:
    """Newest pending sign-ups (a top-k: each partition keeps its own k)."""
    return (registrations.filter(F.col("status") == "Pending")
            .select("id", "username", "name", "email", "role", "status", "submitted_at")
            .orderBy(F.col("submitted_at").desc(), F.col("id").desc())
            .limit(limit))


def staff_profiles(users: DataFrame) -> DataFrame:
    """All staff, newest first, with the avatar initials the manager
    screen shows; the password never leaves the table."""
    return (users.select("id", "username", "name", "email", "role", "is_active", "created_at",
                         initials(F.col("name")).alias("initials"))
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


def menu_catalog(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Every product with its category name and the image the manager
    screen shows (its own, else the category's, else the default), by
    category then name (case- and accent-insensitive, as the database
    collation sorts)."""
    c = categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    p = products
    return (p.join(c, p["category_id"] == c["c_id"])
            .select(p["id"], p["category_id"], "category_name", p["name"], p["description"],
                    p["base_price"], p["image_url"], p["is_available"],
                    product_image(p["image_url"], p["category_id"]).alias("image"))
            .orderBy(F.col("category_id"), F.collate(F.col("name"), "UNICODE_CI_AI"), F.col("id")))


# ---- R09 - R12: kitchen and cashier views ---------------------------------------
def kitchen_queue(orders: DataFrame, users: DataFrame, order_items: DataFrame) -> DataFrame:
    """Pending orders, oldest first, with cashier names and unit count
    (0 when the order has no lines)."""
    pending = orders.filter(F.col("status") == "pending").select(
        "id", "status", "notes", "created_at", "total", "cashier_id")
    u = users.select(F.col("id").alias("u_id"), F.col("name").alias("cashier_name"),
                     F.col("username").alias("cashier_username"))
    ic = item_counts(order_items)
    # Orders and lines share the order-id buckets: count before the cashier join moves the rows.
    counted = pending.join(ic, pending["id"] == ic["order_id"], "left")
    return (counted.join(u, counted["cashier_id"] == u["u_id"])
            .select("id", "status", "notes", "created_at", "total", "cashier_name", "cashier_username",
                    F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint").alias("item_count"))
            .orderBy("created_at", "id"))


ITEM_FIELDS = ("id", "order_id", "product_id", "product_name", "product_size_id", "size_label",
               "quantity", "unit_price", "line_subtotal")
ADDON_FIELDS = ("id", "order_item_id", "addon_id", "addon_name", "quantity", "addon_price",
                "addon_subtotal")


def order_lines_nested(order_items: DataFrame, order_item_addons: DataFrame) -> DataFrame:
    """Per order, its items by id, each with its addons by id.

    Grouped collects replace the per-order and per-item query loops. The
    addons learn their order id through a narrow (item id, order id)
    projection. Item and addon rows then meet in one shuffle on the order
    id: they are grouped per (order, item), which gives each item its addons
    without looking through the order's other addons, and then per order.
    Every array is bounded by one order. Items without addons carry an empty
    array.
    """
    item = F.struct(*[F.col(c) for c in ITEM_FIELDS])
    addon = F.struct(*[F.col(c) for c in ADDON_FIELDS])
    item_order = order_items.select(F.col("id").alias("io_item"), F.col("order_id").alias("io_order"))
    items = order_items.select("order_id", F.col("id").alias("item_id"), item.alias("it"))
    addons = order_item_addons.join(item_order, order_item_addons["order_item_id"] == item_order["io_item"]).select(
        F.col("io_order").alias("order_id"), F.col("order_item_id").alias("item_id"), addon.alias("ad"))
    rows = items.unionByName(addons, allowMissingColumns=True).repartition("order_id")
    per_item = rows.groupBy("order_id", "item_id").agg(
        F.first("it", ignorenulls=True).alias("it"), F.array_sort(F.collect_list("ad")).alias("addons"))
    nested = F.struct(*[F.col(f"it.{c}").alias(c) for c in ITEM_FIELDS], F.col("addons"))
    return per_item.groupBy("order_id").agg(F.array_sort(F.collect_list(nested)).alias("items"))


def item_display_names(order_items: DataFrame, order_item_addons: DataFrame) -> DataFrame:
    """F12 over every order item: the profile's 'Name (Size) + A, B', the
    kitchen's 'Name (Size)' and its 'Add-ons: A, B' line ('' without
    addons). Addon names are gathered per item (an item's addons, by id)
    and joined back."""
    a = order_item_addons.groupBy(F.col("order_item_id").alias("a_item_id")).agg(
        F.array_sort(F.collect_list(F.struct("id", "addon_name"))).alias("a"))
    j = order_items.join(a, order_items["id"] == a["a_item_id"], "left")
    names = F.transform(F.coalesce(F.col("a"), F.array().cast(a.schema["a"].dataType)), lambda x: x["addon_name"])
    return j.select(
        "order_id", F.col("id").alias("item_id"),
        item_display_name(F.col("product_name"), F.col("size_label"), names).alias("display_name"),
        item_display_name(F.col("product_name"), F.col("size_label"), F.array().cast("array<string>"))
         .alias("kitchen_name"),
        F.when(F.size(names) > 0, F.concat(F.lit("Add-ons: "), F.array_join(names, ", "))).otherwise(F.lit(""))
         .alias("addon_text"))


def kitchen_tickets(orders: DataFrame, users: DataFrame, order_items: DataFrame,
                    order_item_addons: DataFrame) -> DataFrame:
    """The kitchen queue with each order's items and addons nested.

    Only the queued orders' lines are nested: lines and addons are cut to
    the queue by semi-joins first (lines share the order-id buckets with
    orders, so that cut needs no shuffle), instead of nesting every order
    ever taken and keeping the pending few."""
    queued = orders.filter(F.col("status") == "pending").select(F.col("id").alias("q_id"))
    items = order_items.join(queued, order_items["order_id"] == queued["q_id"], "left_semi")
    item_ids = items.select(F.col("id").alias("q_item_id"))
    addons = order_item_addons.join(item_ids, order_item_addons["order_item_id"] == item_ids["q_item_id"],
                                    "left_semi")
    queue = kitchen_queue(orders, users, items)
    nested = order_lines_nested(items, addons)
    empty = F.array().cast(nested.schema["items"].dataType)
    return (queue.join(nested, queue["id"] == nested["order_id"], "left")
            .select(*[queue[c] for c in queue.columns],
                    F.coalesce(nested["items"], empty).alias("items"))
            .orderBy("created_at", "id"))


def flatten_lines(nested: DataFrame, keep: list[str]) -> DataFrame:
    """Flat form of a nested item/addon result: one row per (item, addon),
    with 0-based array positions, so the nesting and its order can be
    compared with a plain SQL answer. Empty arrays give one row of NULLs."""
    items = nested.select(*keep, F.posexplode_outer("items").alias("item_pos", "item"))
    rows = items.select(*keep, "item_pos", "item",
                        F.posexplode_outer("item.addons").alias("addon_pos", "addon"))
    return rows.select(
        *keep, "item_pos",
        F.col("item.id").alias("item_id"),
        *[F.col(f"item.{c}").alias(c) for c in ITEM_FIELDS[2:]],
        "addon_pos",
        F.col("addon.id").alias("addon_row_id"),
        F.col("addon.addon_id").alias("addon_id"),
        F.col("addon.addon_name").alias("addon_name"),
        F.col("addon.quantity").alias("addon_quantity"),
        F.col("addon.addon_price").alias("addon_price"),
        F.col("addon.addon_subtotal").alias("addon_subtotal"))


def cashier_transactions(orders: DataFrame, order_items: DataFrame,
                         cashier_id: int | None = None) -> DataFrame:
    """Each cashier's orders, newest first, with the unit count."""
    o = orders if cashier_id is None else orders.filter(F.col("cashier_id") == cashier_id)
    ic = item_counts(order_items)
    return (o.join(ic, o["id"] == ic["order_id"], "left")
            .select("id", "cashier_id", "status", "subtotal", "tax_amount", "discount_amount", "total",
                    "payment_method", "created_at", "completed_at",
                    F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint").alias("item_count"))
            .orderBy(F.col("cashier_id"), F.col("created_at").desc(), F.col("id").desc()))


# ---- R13 - R15: cashier summary ------------------------------------------------
def _with_missing(found: DataFrame, keys: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``found`` plus the rows of ``keys`` that it lacks, whose other columns are NULL."""
    same = [found[c].eqNullSafe(keys[f"k_{c}"]) for c in names]
    cond = same[0] if len(same) == 1 else same[0] & same[1]
    return found.join(keys, cond, "full_outer").select(
        *[F.coalesce(found[c], keys[f"k_{c}"]).alias(c) for c in names], *[found[c] for c in found.columns if c not in names])


def cashier_order_count(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders per cashier (any status), 0 for a user without orders."""
    counts = orders.groupBy("cashier_id").agg(F.count(F.lit(1)).alias("n"))
    keys = users.select(F.col("id").cast("bigint").alias("k_cashier_id"))
    return _with_missing(counts, keys, ("cashier_id",)).select(
        "cashier_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("total_transactions"))


def session_revenue(orders: DataFrame, user_sessions: DataFrame) -> DataFrame:
    """Completed revenue per (cashier, session); 0 when none completed, also for a session without orders."""
    done = F.col("status") == "completed"
    sums = orders.groupBy("cashier_id", "session_id").agg(_sum_if(done, F.col("total")).alias("r"))
    keys = user_sessions.select(F.col("user_id").cast("bigint").alias("k_cashier_id"), F.col("id").alias("k_session_id"))
    return _with_missing(sums, keys, ("cashier_id", "session_id")).select(
        "cashier_id", "session_id", F.coalesce("r", F.lit(0)).cast(MONEY_OUT).alias("session_revenue"))


def cashier_time_summary(user_sessions: DataFrame, as_of: dt.datetime,
                         current_sessions: DataFrame | None = None) -> DataFrame:
    """Per user, seconds over all sessions and in the current one.

    Closed sessions count their length; the current session, if still open,
    counts up to ``as_of``; other open sessions count 0. The current-session
    time runs to ``as_of`` even when that session is closed.

    Both durations also come as the profile prints them ('2h 5m', '7m').

    ``current_sessions`` (user_id, session_id) names each user's current
    session; by default it is the latest by (logged_in_at, id), found in the
    same single aggregation (no join, no window).
    """
    now = ntz(as_of)
    start, end = F.col("logged_in_at"), F.col("logged_out_at")
    closed = F.when(end.isNotNull(), seconds_between(start, end))
    if current_sessions is None:
        g = user_sessions.groupBy("user_id").agg(
            F.sum(closed).alias("closed_s"),
            F.max(F.struct(start.alias("s"), F.col("id").alias("id"), end.alias("e"))).alias("cur"))
        open_cur = F.when(F.col("cur.e").isNull(), seconds_between(F.col("cur.s"), now)).otherwise(0)
        return _with_time_texts(g.select(
            "user_id", F.col("cur.id").alias("current_session_id"),
            (F.coalesce(F.col("closed_s"), F.lit(0)) + open_cur).cast("bigint").alias("total_time_seconds"),
            seconds_between(F.col("cur.s"), now).cast("bigint").alias("session_time_seconds")))
    cur = current_sessions.select(F.col("user_id").alias("c_user"), F.col("session_id").alias("c_id"))
    s = user_sessions.join(cur, (user_sessions["id"] == cur["c_id"])
                           & (user_sessions["user_id"] == cur["c_user"]), "left")
    is_cur = F.col("c_id").isNotNull()
    return _with_time_texts(s.groupBy("user_id").agg(
        F.max("c_id").alias("current_session_id"),
        F.coalesce(F.sum(F.when(end.isNotNull(), seconds_between(start, end))
                         .when(is_cur, seconds_between(start, now)).otherwise(0)), F.lit(0))
         .cast("bigint").alias("total_time_seconds"),
        F.coalesce(F.max(F.when(is_cur, seconds_between(start, now))), F.lit(0))
         .cast("bigint").alias("session_time_seconds")))


def _with_time_texts(df: DataFrame) -> DataFrame:
    """The profile's 'Xh Ym' / 'Ym' texts for both durations."""
    return df.select("*", duration_text(F.col("total_time_seconds")).alias("total_time_text"),
                     duration_text(F.col("session_time_seconds")).alias("session_time_text"))


# ---- R16 - R18: details and menu options -------------------------------------------
def transaction_detail(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Every order with its payment columns (NULL when unpaid)."""
    p = payments.select(F.col("order_id").alias("p_order_id"), "amount_due", "amount_received",
                        "change_due", "reference_no", "paid_at")
    return (orders.join(p, orders["id"] == p["p_order_id"], "left")
            .select(*[orders[c] for c in orders.columns],
                    "amount_due", "amount_received", "change_due", "reference_no", "paid_at"))


def active_menu(products: DataFrame, product_sizes: DataFrame, product_addons: DataFrame) -> DataFrame:
    """Available products; has_options = 1 when the product has any size
    or any *available* addon. The two existence tests become one set of keys
    (a union aggregated once) and one left join."""
    keys = (product_sizes.select("product_id")
            .unionByName(product_addons.filter(F.col("is_available") == 1).select("product_id"))
            .groupBy(F.col("product_id").alias("opt_product_id")).agg(F.lit(1).alias("has_opt")))
    p = products.filter(F.col("is_available") == 1)
    return (p.join(keys, p["id"] == keys["opt_product_id"], "left")
            .select("id", "category_id", "name", "description", "base_price", "image_url",
                    F.coalesce(F.col("has_opt"), F.lit(0)).alias("has_options")))


def _available_ids(products: DataFrame) -> DataFrame:
    return products.filter(F.col("is_available") == 1).select(F.col("id").alias("avail_id"))


def product_sizes_list(products: DataFrame, product_sizes: DataFrame) -> DataFrame:
    """Sizes of available products, cheapest first (position from 1)."""
    s = product_sizes.join(_available_ids(products),
                           product_sizes["product_id"] == F.col("avail_id"), "left_semi")
    w = Window.partitionBy("product_id").orderBy("price", "id")
    return s.select("product_id", "id", "label", "price", F.row_number().over(w).alias("position"))


def product_addons_list(products: DataFrame, product_addons: DataFrame) -> DataFrame:
    """Available addons of available products, by name (position from 1)."""
    a = product_addons.filter(F.col("is_available") == 1).join(
        _available_ids(products), product_addons["product_id"] == F.col("avail_id"), "left_semi")
    w = Window.partitionBy("product_id").orderBy(F.collate(F.col("name"), "UNICODE_CI_AI"), "id")
    return a.select("product_id", "id", "name", "extra_price", F.row_number().over(w).alias("position"))
