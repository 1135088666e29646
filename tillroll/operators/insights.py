"""Computations the browser does over fetched rows, re-aimed as queries
(U01-U07): category badges, the visible menu, grouped products, the kitchen
status cards, the day-over-day comparison and its every-day history, and the
cashier's history labels.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.scalars import (capitalize_first, peso_cents, peso_whole, seconds_between,
                                        tenths_text, wait_text)
from tillroll.operators.reports import ntz
from tillroll.schema import CATEGORY_EMOJIS, CATEGORY_NAMES, MONEY_OUT, PESO


# ---- U01 - U03: menu views -------------------------------------------------------
def category_counts(products: DataFrame, categories: DataFrame, available_only: bool = False) -> DataFrame:
    """Products per category plus an 'all' row; categories without
    products show 0. The cashier screen counts available products, the
    manager screen all of them. The 'all' row counts every product, also one
    without a category, and is 0 for an empty table. ``showing_text`` is the
    line the menu prints for that tab (U02): 'Showing 1 item', 'Showing 12 items'."""
    p = products.filter(F.col("is_available") == 1) if available_only else products
    counts = p.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    per_cat = categories.select(F.col("id").alias("cat_id")).join(
        counts, F.col("cat_id") == F.col("category_id"), "left")
    rows = per_cat.select(F.col("cat_id").cast("string").alias("category"),
                          F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("product_count"))
    total = p.agg(F.count(F.lit(1)).alias("product_count")).select(F.lit("all").alias("category"), "product_count")
    n = F.col("product_count")
    showing = F.concat(F.lit("Showing "), n.cast("string"), F.when(n == 1, F.lit(" item")).otherwise(F.lit(" items")))
    return rows.unionByName(total).select("category", "product_count", showing.alias("showing_text"))


def menu_by_category(menu: DataFrame, category: str | int = "all") -> DataFrame:
    """The products shown for the selected category tab ('all' shows
    every product). The tab's count is U01's row for the same category."""
    if str(category) == "all":
        return menu
    return menu.filter(F.col("category_id").cast("string") == F.lit(str(category)))


def category_header(category_id: Column) -> Column:
    names = F.create_map(*[x for k, v in CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    emojis = F.create_map(*[x for k, v in CATEGORY_EMOJIS.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.coalesce(F.element_at(emojis, category_id), F.lit("")), F.lit(" "),
                    F.coalesce(F.element_at(names, category_id),
                               F.concat(F.lit("Category "), category_id.cast("string"))))


def products_grouped(menu: DataFrame, range_ids: int = 65_536) -> DataFrame:
    """The products of each category by id, with the header the upload
    page prints: one row per product with its place ``pos`` (from 0) in the
    whole category.

    A category can hold most of the catalogue, so no window holds a whole
    category: products are numbered within id ranges of ``range_ids``, and a
    running sum over the ranges' counts gives each range its offset. The
    result does not depend on ``range_ids``.
    """
    cut = menu.withColumn("id_range", F.floor(F.col("id") / range_ids))
    counts = cut.groupBy("category_id", "id_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("category_id").orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("category_id").alias("o_category"), F.col("id_range").alias("o_range"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("category_id", "id_range").orderBy("id"))
    numbered = cut.withColumn("place", place)
    j = numbered.join(offsets, numbered["category_id"].eqNullSafe(F.col("o_category"))
                      & (numbered["id_range"] == F.col("o_range")))
    return j.select("category_id", category_header(F.col("category_id")).alias("header"),
                    (F.col("offset") + F.col("place") - 1).cast("bigint").alias("pos"),
                    "id", "name", "description", "base_price", "image_url", "has_options")


# ---- U04: kitchen status cards -----------------------------------------------------
def kitchen_status(orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active ticket count and the oldest ticket's wait in whole
    minutes (never below 0) as 'Xm' or 'Xh Ym'; '0m' with no tickets."""
    pending = orders.filter(F.col("status") == "pending")
    g = pending.agg(F.count(F.lit(1)).alias("active_orders"), F.min("created_at").alias("oldest"))
    minutes = F.greatest(F.floor(seconds_between(F.col("oldest"), ntz(as_of)) / 60), F.lit(0)).cast("bigint")
    return g.select(
        F.col("active_orders").cast("bigint").alias("active_orders"),
        F.when(F.col("active_orders") > 0, minutes).otherwise(F.lit(0).cast("bigint")).alias("oldest_wait_minutes"),
        F.when(F.col("active_orders") > 0, wait_text(minutes)).otherwise(F.lit("0m")).alias("oldest_wait"))


# ---- U05 / U06: today versus yesterday ---------------------------------------------
def _count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def _signed_count(d: Column) -> Column:
    return F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), _count_text(d))


def _count_metric(name: str, today: Column, yday: Column) -> list[Column]:
    d = today - yday
    return [F.lit(name), _count_text(today),
            F.when(d == 0, F.lit("0")).otherwise(_signed_count(d)),
            F.when(d == 0, F.lit("No change vs yesterday"))
             .otherwise(F.concat(_signed_count(d), F.lit(" vs yesterday")))]


def _money_metric(name: str, today: Column, yday: Column) -> list[Column]:
    d = (today - yday).cast(MONEY_OUT)
    sign = F.when(d > 0, F.lit("+")).otherwise(F.lit("-"))
    return [F.lit(name), peso_whole(today),
            F.when(d == 0, F.lit(PESO + "0")).otherwise(F.concat(sign, peso_whole(F.abs(d)))),
            F.when(d == 0, F.lit("No change vs yesterday"))
             .otherwise(F.concat(sign, peso_cents(F.abs(d)), F.lit(" vs yesterday")))]


def _hours_metric(name: str, s_today: Column, s_yday: Column, staff: Column) -> list[Column]:
    d = s_today - s_yday
    sign = F.when(d > 0, F.lit("+")).otherwise(F.lit("-"))
    return [F.lit(name), F.concat(tenths_text(s_today, 3600), F.lit("h")),
            F.concat(staff.cast("string"), F.lit(" staff")),
            F.when(d == 0, F.lit("No change vs yesterday"))
             .otherwise(F.concat(sign, tenths_text(F.abs(d), 3600), F.lit("h vs yesterday")))]


COMPARISON_COLS = ("metric", "today", "delta", "comparison")


def _rows(df: DataFrame, metrics: list[list[Column]]) -> DataFrame:
    structs = [F.struct(*[c.alias(n) for c, n in zip(m, COMPARISON_COLS)]) for m in metrics]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def daily_comparison(daily: DataFrame, hours: DataFrame) -> DataFrame:
    """The five dashboard cards (transactions, revenue, refunds, voids,
    hours) as rows: the figure, the small delta pill and the comparison
    sentence. Inputs are R04's and R05's one-row results; each card reads
    only its own source row, so the two are unioned, never joined. Money
    differences are exact decimals; hour texts round seconds/3600 half up
    to one decimal."""
    c = F.col
    order_cards = _rows(daily, [
        _count_metric("transactions", c("transactions_made"), c("transactions_made_yesterday")),
        _money_metric("revenue", c("daily_revenue"), c("daily_revenue_yesterday")),
        _count_metric("refunded", c("orders_refunded"), c("orders_refunded_yesterday")),
        _count_metric("voided", c("orders_voided"), c("orders_voided_yesterday")),
    ])
    hour_card = _rows(hours, [_hours_metric("hours", c("seconds_clocked"), c("seconds_clocked_yesterday"),
                                            c("staff_count"))])
    return order_cards.unionByName(hour_card)


DAY_METRICS = ("transactions_made", "daily_revenue", "orders_refunded", "refunded_total",
               "orders_voided", "voided_total", "seconds_clocked", "staff_count")


def daily_history(orders: DataFrame, user_sessions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """R04's and R05's figures for *every* calendar day from the first with
    activity to ``as_of``'s day (or the last with activity, if later), each
    with the value of the day before. A day without activity shows 0.

    An order counts once, on the day of the timestamp of its current status
    (completed_at / refunded_at / voided_at); a session counts on its login
    day and runs to ``as_of`` while open. Both sides aggregate to one row per
    day before they meet, so the day join and the yesterday self-join are
    over a few thousand rows at most, whatever the input size.
    """
    return history_rows(order_days(orders), staff_days(user_sessions, as_of), as_of)


def order_days(orders: DataFrame) -> DataFrame:
    """Counts and sums of the orders per day of their current status."""
    st = F.col("status")
    ts = (F.when(st == "completed", F.col("completed_at")).when(st == "refunded", F.col("refunded_at"))
          .when(st == "voided", F.col("voided_at")))
    o = orders.filter(st.isin("completed", "refunded", "voided")).select(
        st.alias("st"), F.to_date(ts).alias("day"), "total").filter(F.col("day").isNotNull())

    def cnt(kind):
        return F.sum(F.when(F.col("st") == kind, 1).otherwise(0)).cast("bigint")

    def amt(kind):
        return F.sum(F.when(F.col("st") == kind, F.col("total")).otherwise(0)).cast(MONEY_OUT)

    return o.groupBy("day").agg(cnt("completed").alias("transactions_made"), amt("completed").alias("daily_revenue"),
                                cnt("refunded").alias("orders_refunded"), amt("refunded").alias("refunded_total"),
                                cnt("voided").alias("orders_voided"), amt("voided").alias("voided_total"))


def staff_days(user_sessions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seconds clocked and distinct staff per login day."""
    dur = seconds_between(F.col("logged_in_at"), F.coalesce(F.col("logged_out_at"), ntz(as_of)))
    return user_sessions.groupBy(F.to_date("logged_in_at").alias("s_day")).agg(
        F.sum(dur).cast("bigint").alias("seconds_clocked"),
        F.count_distinct("user_id").alias("staff_count"))


def history_rows(od: DataFrame, sd: DataFrame, as_of: dt.datetime) -> DataFrame:
    """U06's rows from the days of ``order_days`` and ``staff_days``."""
    report_day = F.lit(as_of.strftime("%Y-%m-%d")).cast("date")
    active = od.select("day").unionByName(sd.select(F.col("s_day").alias("day")))
    spine = active.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence(
        F.least("a", report_day), F.greatest("b", report_day))).alias("c_day"))
    kept = {m: MONEY_OUT if m.endswith(("revenue", "total")) else "bigint" for m in DAY_METRICS}
    days = (spine.join(od, spine["c_day"] == od["day"], "left").join(sd, spine["c_day"] == sd["s_day"], "left")
            .select(F.col("c_day").alias("day"), *[F.coalesce(F.col(m), F.lit(0)).cast(t).alias(m) for m, t in kept.items()]))
    prev = days.select(F.date_add(F.col("day"), 1).alias("p_day"), *[F.col(m).alias(f"{m}_yesterday") for m in DAY_METRICS])
    j = days.join(prev, days["day"] == prev["p_day"], "left")
    return j.select("day", *DAY_METRICS, *[F.coalesce(F.col(f"{m}_yesterday"), F.lit(0)).cast(t).alias(f"{m}_yesterday")
                                           for m, t in kept.items()])


# ---- U07: history row labels --------------------------------------------------------
def transaction_labels(transactions: DataFrame) -> DataFrame:
    """The cashier's history rows as shown: 'Order #id', the display
    time (completed_at, else created_at), 'n item(s)', the total in pesos and
    the status title ('Completed Order')."""
    return transactions.select(
        "id", "cashier_id", F.concat(F.lit("Order #"), F.col("id").cast("string")).alias("title"),
        F.coalesce(F.col("completed_at"), F.col("created_at")).alias("display_time"),
        F.concat(F.coalesce(F.col("item_count"), F.lit(0)).cast("string"), F.lit(" item(s)")).alias("items_text"),
        peso_cents(F.col("total")).alias("total_text"), "status",
        F.concat(capitalize_first(F.col("status")), F.lit(" Order")).alias("status_title"))
