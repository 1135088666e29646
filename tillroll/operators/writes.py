"""Write paths re-aimed as batch operators.

The application changes its tables one request at a time. Here each write
path takes a *table of requests* and returns new tables (no in-place update,
no request loop). Request order is an explicit ``seq`` column; operators
that depend on order express it with aggregates over ordered keys
(``max_by``, ``min`` of structs) instead of per-key windows where they can,
so a single hot key (one busy order, user or cart) is still pre-aggregated
on the map side rather than landing whole in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.scalars import blank_to_null, money, quantity_or_one
from tillroll.operators.reports import ntz
from tillroll.schema import (ACCOUNT_STATES, CHECKOUT_PAYMENT_METHODS, DISCOUNT_RATE, KITCHEN_ROLES,
                             MONEY, MONEY_OUT, TAX_RATE)
from tillroll.sources.stage import staged


def _ci(c: Column) -> Column:
    """Comparison key under the case- and accent-insensitive collation."""
    return F.collate(c, "UNICODE_CI_AI")


# ---- B01: cart line pricing --------------------------------------------------------
def price_lines(cart_lines: DataFrame, products: DataFrame, product_sizes: DataFrame,
                product_addons: DataFrame) -> DataFrame:
    """Unit price = (size price, else base price) + chosen addon prices.

    ``with_addons`` chooses every available addon of the product. Everything
    a line needs is first gathered in one row per product (its sizes in an
    array, its addons' count and sum), where the menu tables lie together;
    the lines then meet the menu in a single join.
    """
    s = product_sizes.groupBy(F.col("product_id").alias("s_product_id")).agg(
        F.collect_list(F.struct("id", "label", "price")).alias("sizes"))
    a = (product_addons.filter(F.col("is_available") == 1)
         .groupBy(F.col("product_id").alias("a_product_id"))
         .agg(F.count(F.lit(1)).alias("n_addons"), F.sum("extra_price").alias("sum_addons")))
    menu = (products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"), "base_price")
            .join(s, F.col("p_id") == s["s_product_id"], "left").join(a, F.col("p_id") == a["a_product_id"], "left"))
    j = cart_lines.join(menu, cart_lines["product_id"] == menu["p_id"])
    size = F.get(F.filter("sizes", lambda x: x["id"] == F.col("size_id")), 0)
    addon_total = F.when(F.col("with_addons"), F.coalesce(F.col("sum_addons"), F.lit(0))).otherwise(0).cast(MONEY_OUT)
    return j.select(
        "line_id", "cart_id", "product_id", "product_name", "size_id", size["label"].alias("size_label"), "quantity",
        "with_addons",
        F.when(F.col("with_addons"), F.coalesce(F.col("n_addons"), F.lit(0))).otherwise(0).cast("bigint").alias("addon_count"),
        addon_total.alias("addon_total"),
        (F.coalesce(size["price"], F.col("base_price")) + addon_total).cast(MONEY).alias("unit_price"))


def line_addons(cart_lines: DataFrame, product_addons: DataFrame) -> DataFrame:
    """The addon rows chosen by each line (every available addon of the
    product when ``with_addons``)."""
    a = product_addons.filter(F.col("is_available") == 1).select(
        F.col("id").alias("addon_id"), F.col("product_id").alias("a_product_id"),
        F.col("name").alias("addon_name"), F.col("extra_price"))
    cl = cart_lines.filter(F.col("with_addons"))
    return cl.join(a, cl["product_id"] == a["a_product_id"]).select(
        "line_id", "cart_id", "quantity", "addon_id", "addon_name", "extra_price")


# ---- B02: merging repeated adds ---------------------------------------------------------
def cart_key(product_id: Column, size_id: Column, addon_ids: Column) -> Column:
    """'product|size-or-base|sorted,addon,ids' (ids sorted as numbers)."""
    ids = F.array_join(F.transform(F.array_sort(addon_ids), lambda x: x.cast("string")), ",")
    return F.concat_ws("|", product_id.cast("string"),
                       F.coalesce(size_id.cast("string"), F.lit("base")), ids)


RANGE_BITS = 16
#: Rows of changes, at most, that one task of a fold sorts on average.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt on ``keys`` into parts of ``ROWS_PER_TASK`` rows on average, where the session's shuffle would make larger ones."""
    parts = -(-rows // ROWS_PER_TASK)
    default = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(parts, *keys) if parts > int(default) else df


def fold_parts(parts: DataFrame, parent: Column | None, rows: int = 0) -> DataFrame:
    """Combine neighbouring parts of a key's change sequence, those with the
    same ``parent`` (None: all of the key), into one part each. ``rows`` bounds
    the parts' number, if known: then no task sorts more than its share of them.

    A part is (pos, reset, t, m): on a quantity q it acts as
    max(q + t, t - m), or, with ``reset``, it gives t whatever q was.
    """
    group = Window.partitionBy("cart_id", "cart_key", "parent")
    keys = ["cart_id", "cart_key"]
    if parent is None:
        p = spread(parts, rows, *keys).withColumn("parent", F.lit(0).cast("bigint"))
    else:
        p = spread(parts.withColumn("parent", parent), rows, *keys, "parent")
    p = p.withColumn("last_reset", F.max(F.when(F.col("reset"), F.col("pos"))).over(group)) \
         .filter(F.col("last_reset").isNull() | (F.col("pos") >= F.col("last_reset")))
    before = group.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("low", F.coalesce(F.sum("t").over(before), F.lit(0)) + F.col("m"))
    g = p.groupBy("cart_id", "cart_key", F.col("parent").alias("pos")).agg(
        F.bool_or("reset").alias("reset"), F.sum("t").alias("s"), F.least(F.min("low"), F.lit(0)).alias("lowest"))
    return g.select("cart_id", "cart_key", "pos", "reset",
                    F.when(F.col("reset"), F.col("s") - F.col("lowest")).otherwise(F.col("s")).alias("t"),
                    F.when(F.col("reset"), 0).otherwise(F.col("lowest")).cast("bigint").alias("m"))


def merge_cart_lines(cart_adds: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """Replay the changes per (cart, line key) in ``seq`` order and keep
    lines above 0. A change of +1 / -1 is added with the quantity floored at
    0 (a minus on a missing line does nothing; a later add restarts at 1); a
    change of 0 removes the line at once.

    Floored adding has a closed form, q = S - min(0, lowest prefix sum), and
    its (sum, lowest prefix) summary is associative; a removal makes what
    came before irrelevant. Changes are folded over ranges of ``seq``, then
    ranges of ranges, and so on (``2 ** range_bits`` at each level, as many
    levels as the largest ``seq`` needs). However a hot key's changes are spread over
    ``seq``, no window holds more than ``2 ** range_bits`` rows of it.
    """
    parts, _ = fold_sequence(cart_adds, range_bits)
    return lines_left(parts)


def cart_changes(cart_adds: DataFrame) -> DataFrame:
    """Each change as a part of its own: (cart_id, cart_key, pos, reset, t, m), see ``fold_parts``."""
    if "addon_ids" in cart_adds.columns:
        ids = F.coalesce(F.col("addon_ids"), F.array().cast("array<bigint>"))
    else:
        ids = F.when(F.col("addon_id").isNull(), F.array().cast("array<bigint>")) \
               .otherwise(F.array(F.col("addon_id").cast("bigint")))
    change = F.col("change").cast("bigint")
    return cart_adds.select(
        "cart_id", cart_key(F.col("product_id"), F.col("size_id"), ids).alias("cart_key"),
        F.col("seq").cast("bigint").alias("pos"), (change == 0).alias("reset"), change.alias("t"),
        F.least(change, F.lit(0)).cast("bigint").alias("m"))


def fold_sequence(cart_adds: DataFrame, range_bits: int = RANGE_BITS) -> tuple[DataFrame, int | None]:
    """One part per line for all its changes, and the smallest ``seq`` (None without changes)."""
    parts = cart_changes(cart_adds)
    ends = cart_adds.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n")).first()
    bits = max((abs(int(ends[x])).bit_length() for x in ("low", "high") if ends[x] is not None), default=0)
    for _ in range(-(-bits // range_bits) - 1):
        parts = fold_parts(parts, F.shiftright("pos", range_bits), ends["n"])
    return fold_parts(parts, None, ends["n"]), ends["low"]


def lines_left(parts: DataFrame) -> DataFrame:
    """The lines above 0 that parts reaching back to an empty cart leave."""
    return parts.select("cart_id", "cart_key", (F.col("t") - F.col("m")).cast("bigint").alias("quantity")) \
        .filter(F.col("quantity") > 0)


# ---- B03 / B04: totals and checkout --------------------------------------------------------
def cart_totals(priced_lines: DataFrame, carts: DataFrame) -> DataFrame:
    """Per cart, lines, units, subtotal, 5 % discount when flagged, 12 % tax on
    the subtotal before discount, and total = subtotal - discount + tax.
    Each amount is rounded half up on its own from exact decimals, so the
    total may differ by 0.01 from the sum of the rounded parts."""
    q = quantity_or_one(F.col("quantity"))
    sums = priced_lines.groupBy(F.col("cart_id").alias("t_cart_id")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(q).cast("bigint").alias("item_count"),
        F.sum(F.col("unit_price") * q).alias("sub"))
    j = carts.join(sums, carts["cart_id"] == sums["t_cart_id"], "left")
    sub = F.coalesce(F.col("sub"), F.lit(0)).cast("decimal(30,2)")
    disc = F.when(F.col("discount"), sub * F.lit(DISCOUNT_RATE).cast("decimal(3,2)")).otherwise(F.lit(0))
    tax = sub * F.lit(TAX_RATE).cast("decimal(3,2)")
    return j.select(
        "cart_id", F.coalesce(F.col("line_count"), F.lit(0)).cast("bigint").alias("line_count"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint").alias("item_count"),
        F.round(sub, 2).cast(MONEY_OUT).alias("subtotal"),
        F.round(disc, 2).cast(MONEY_OUT).alias("discount_amount"),
        F.round(tax, 2).cast(MONEY_OUT).alias("tax_amount"),
        F.round(sub - disc + tax, 2).cast(MONEY_OUT).alias("total"))


def judged_carts(carts: DataFrame, totals: DataFrame) -> DataFrame:
    """Carts with their totals and the reason the server would refuse them:
    no items (no lines, whatever their quantities), then a payment method
    other than cash or gcash."""
    t = totals.withColumnRenamed("cart_id", "t_cart_id")
    j = carts.join(t, carts["cart_id"] == t["t_cart_id"], "left")
    return j.withColumn("reason", F.when(F.coalesce(F.col("line_count"), F.lit(0)) == 0, "no_items").when(
        ~F.coalesce(F.col("payment_method").isin(*CHECKOUT_PAYMENT_METHODS), F.lit(False)), "invalid_payment_method"))


def cart_sessions(accepted: DataFrame, user_sessions: DataFrame) -> DataFrame:
    """The session of each accepted cart (cart_id, cashier_id, created_at):
    adds ``session_id`` and ``new_since``.

    A cart belongs to the cashier's last session begun by then, if that is
    still open. Otherwise the cart opens a session, which the cashier's next
    carts up to the next login share; its id is the highest session id plus
    that first cart's id, so re-runs agree. ``new_since`` is the time the
    session was opened by a cart, else NULL.

    Logins and carts are range-partitioned together by (user, time); each
    cart looks back within its own part of a user, and a summary with one row
    per user and part carries the last login over to the next parts. No
    window holds a whole user.
    """
    logins = user_sessions.select(
        F.col("user_id").cast("bigint").alias("uid"), F.col("logged_in_at").alias("ts"), F.lit(0).alias("kind"),
        F.col("id").cast("bigint").alias("rid"), F.struct(F.col("logged_in_at").alias("at"), F.col("id").cast("bigint").alias("id"),
                                                          F.col("logged_out_at").alias("out")).alias("s"))
    carts = accepted.select(F.col("cashier_id").cast("bigint").alias("uid"), F.col("created_at").alias("ts"), F.lit(1).alias("kind"),
                            F.col("cart_id").cast("bigint").alias("rid"), F.lit(None).cast(logins.schema["s"].dataType).alias("s"))
    ev = staged(logins.unionByName(carts).repartitionByRange("uid", "ts", "kind", "rid")
                .withColumn("part", F.spark_partition_id()), "cart-sessions")
    lasts = ev.groupBy("uid", "part").agg(F.max("s").alias("last"))
    earlier = Window.partitionBy("uid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("uid").alias("c_uid"), F.col("part").alias("c_part"), F.max("last").over(earlier).alias("carried"))
    here = Window.partitionBy("uid", "part").orderBy("ts", "kind", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ev.withColumn("own", F.last("s", ignorenulls=True).over(here)).filter(F.col("kind") == 1)
    found = found.join(carried, found["uid"].eqNullSafe(F.col("c_uid")) & (found["part"] == F.col("c_part")), "left") \
        .withColumn("cur", F.coalesce("own", "carried"))
    still_open = F.col("cur").isNotNull() & (F.col("cur.out").isNull() | (F.col("cur.out") > F.col("ts")))
    found = found.select("uid", "ts", "rid", F.col("cur.id").alias("after"), F.when(still_open, F.col("cur.id")).alias("open_id"))
    first = found.filter(F.col("open_id").isNull()).groupBy(F.col("uid").alias("f_uid"), F.col("after").alias("f_after")).agg(
        F.min(F.struct("ts", "rid")).alias("first"))
    top = user_sessions.select(F.max("id").cast("bigint")).scalar()
    j = found.join(first, found["uid"].eqNullSafe(F.col("f_uid")) & found["after"].eqNullSafe(F.col("f_after"))
                   & found["open_id"].isNull(), "left")
    return j.select(F.col("rid").alias("cart_id"), F.col("uid").alias("cashier_id"), F.col("ts").alias("created_at"),
                    F.coalesce("open_id", F.coalesce(top, F.lit(0)) + F.col("first.rid")).alias("session_id"),
                    F.col("first.ts").alias("new_since"))


def accepted_carts(carts: DataFrame, cart_lines: DataFrame, products: DataFrame) -> DataFrame:
    """The carts that checkout accepts, (cart_id, cashier_id, created_at), found without pricing a line: those with a
    payment method the server takes and a line of a known product."""
    known = cart_lines.join(products.select(F.col("id").alias("p_id")), F.col("product_id") == F.col("p_id"), "left_semi")
    payable = carts.filter(F.col("payment_method").isin(*CHECKOUT_PAYMENT_METHODS))
    return payable.join(known.select(F.col("cart_id").alias("l_cart_id")), F.col("cart_id") == F.col("l_cart_id"), "left_semi").select(
        "cart_id", "cashier_id", "created_at")


def checkout_orders(carts: DataFrame, totals: DataFrame, user_sessions: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """One row per cart. Accepted carts become pending orders of the
    cashier's open session (see ``checkout_sessions`` for those that open
    one); the others have no session and carry the reason they are refused.
    With ``accepted`` (see ``accepted_carts``) the totals are computed once; without, they also tell the accepted carts."""
    j = judged_carts(carts, totals)
    if accepted is None:
        accepted = j.filter(F.col("reason").isNull()).select("cart_id", "cashier_id", "created_at")
    return order_rows(j, cart_sessions(accepted, user_sessions))


def order_rows(judged: DataFrame, of_cart: DataFrame) -> DataFrame:
    """B04a's rows from carts with totals and reason, and the accepted carts' sessions."""
    of_cart = of_cart.select(F.col("cart_id").alias("s_cart_id"), "session_id")
    j = judged.join(of_cart, judged["cart_id"] == of_cart["s_cart_id"], "left")
    return j.select(
        F.col("cart_id").alias("id"), "cashier_id", "session_id",
        F.when(F.col("reason").isNull(), F.lit("pending")).alias("status"),
        money("subtotal").alias("subtotal"), money("tax_amount").alias("tax_amount"),
        money("discount_amount").alias("discount_amount"), money("total").alias("total"),
        "payment_method",
        blank_to_null(F.col("notes")).alias("notes"),      # trimmed by the till, '' stored as NULL
        "created_at", F.col("reason").alias("reject_reason"))


def checkout_sessions(carts: DataFrame, totals: DataFrame | None, user_sessions: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """B04e: the sessions that checkouts open, for cashiers without an open one. With ``accepted`` no totals are needed."""
    if accepted is None:
        accepted = judged_carts(carts, totals).filter(F.col("reason").isNull()).select("cart_id", "cashier_id", "created_at")
    return session_rows(cart_sessions(accepted, user_sessions))


def session_rows(of_cart: DataFrame) -> DataFrame:
    opened = of_cart.filter(F.col("new_since").isNotNull())
    return opened.groupBy(F.col("session_id").alias("id")).agg(
        F.min("cashier_id").alias("user_id"), F.min("new_since").alias("logged_in_at"))


def _payable(carts: DataFrame) -> DataFrame:
    """Carts whose payment method the server accepts.

    A priced line makes its cart one with items, so the only other refusal
    (no items) never applies to it: the line rows of accepted carts are
    exactly the lines of payable carts. The item and addon rows are therefore
    found without computing the totals (and pricing the lines) a second time."""
    return carts.filter(F.col("payment_method").isin(*CHECKOUT_PAYMENT_METHODS)).select(
        F.col("cart_id").alias("acc_id"))


def checkout_items(priced_lines: DataFrame, carts: DataFrame) -> DataFrame:
    """order_items rows for accepted carts; quantity 0 / NULL → 1,
    empty size → NULL, amounts rounded to cents."""
    pl = priced_lines.join(_payable(carts), priced_lines["cart_id"] == F.col("acc_id"), "left_semi")
    q = quantity_or_one(F.col("quantity"))
    return pl.select(
        F.col("line_id").alias("id"), F.col("cart_id").alias("order_id"), "product_id", "product_name",
        F.when(F.col("size_id") != 0, F.col("size_id")).alias("product_size_id"),
        F.nullif(F.col("size_label"), F.lit("")).alias("size_label"),
        q.alias("quantity"), money("unit_price").alias("unit_price"),
        money(F.col("unit_price") * q).alias("line_subtotal"))


def checkout_addons(cart_lines: DataFrame, product_addons: DataFrame, carts: DataFrame) -> DataFrame:
    """order_item_addons rows of accepted carts; an addon's quantity is
    its line's. (A line with an addon is a line of a known product, so it is
    priced and its cart has items.)"""
    la = line_addons(cart_lines, product_addons)
    la = la.join(_payable(carts), la["cart_id"] == F.col("acc_id"), "left_semi")
    q = quantity_or_one(F.col("quantity"))
    return la.select(
        F.col("line_id").alias("order_item_id"), "addon_id", "addon_name", q.alias("quantity"),
        money("extra_price").alias("addon_price"), money(F.col("extra_price") * q).alias("addon_subtotal"))


def checkout_payments(carts: DataFrame, totals: DataFrame) -> DataFrame:
    """B04d: one payment per accepted cart: received = due, change 0. No session is looked up."""
    return payment_rows(judged_carts(carts, totals))


def payment_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull()).select(
        F.col("cart_id").alias("order_id"), "payment_method", money("total").alias("amount_due"),
        money("total").alias("amount_received"), F.lit(0).cast(MONEY).alias("change_due"),
        F.lit(None).cast("string").alias("reference_no"), F.col("created_at").alias("paid_at"))


# ---- B05 - B07: registrations ------------------------------------------------------------
def _identity_keys(df: DataFrame, id_col: str | None) -> DataFrame:
    """(id, kind, key) rows: one for the username, one for the email, keyed
    under the insensitive collation. Username and email clashes become a
    single equi-join on (kind, key) instead of a join on an OR."""
    pairs = F.array(F.struct(F.lit("u").alias("kind"), _ci(F.col("username")).alias("key")),
                    F.struct(F.lit("e").alias("kind"), _ci(F.col("email")).alias("key")))
    cols = [F.col(id_col).alias("kid")] if id_col else []
    return df.select(*cols, F.explode(pairs).alias("p")).select(*([F.col("kid")] if id_col else []),
                                                                 "p.kind", "p.key")


def _clashing_ids(df: DataFrame, id_col: str, existing: DataFrame) -> DataFrame:
    """Ids of ``df`` whose username or email exists in ``existing``."""
    keys = _identity_keys(existing, None)
    mine = _identity_keys(df, id_col)
    return mine.join(keys, ["kind", "key"], "left_semi").select("kid").distinct()


def accept_registrations(requests: DataFrame, registrations: DataFrame, users: DataFrame,
                         as_of: dt.datetime) -> dict[str, DataFrame]:
    """Accept each requested registration.

    Outcome per requested id: ``not_pending`` (unknown or not Pending),
    ``conflict`` (username or email already a user, case- and
    accent-insensitively), else ``accepted``. Returns the outcomes, the new
    user rows (id = current max user id + registration id, so ids are
    stable across re-runs), the user table with them added, and the
    registrations left after the deletes.
    """
    req = requests.select(F.col("registration_id").alias("rid")).distinct()
    pending = registrations.filter(F.col("status") == "Pending")
    found = pending.join(req, pending["id"] == req["rid"], "left_semi")
    clash = _clashing_ids(found, "id", users).withColumnRenamed("kid", "clash_id")
    tagged = req.join(found.select(F.col("id").alias("f_id")), req["rid"] == F.col("f_id"), "left") \
                .join(clash, req["rid"] == clash["clash_id"], "left")
    outcome = (F.when(F.col("f_id").isNull(), "not_pending")
               .when(F.col("clash_id").isNotNull(), "conflict").otherwise("accepted"))
    outcomes = tagged.select(F.col("rid").alias("registration_id"), outcome.alias("outcome"))
    accepted = outcomes.filter(F.col("outcome") == "accepted").select(F.col("registration_id").alias("a_id"))
    new = found.join(accepted, found["id"] == accepted["a_id"], "left_semi")
    max_id = users.select(F.max("id")).scalar()
    new_users = new.select(
        (F.coalesce(max_id, F.lit(0)) + F.col("id")).cast("bigint").alias("id"), "username", "name", "email", "role",
        F.lit("active").alias("is_active"), ntz(as_of).alias("created_at"))
    remaining = registrations.join(accepted, registrations["id"] == accepted["a_id"], "left_anti")
    users_after = users.select(*new_users.columns).unionByName(new_users)
    return {"outcomes": outcomes, "new_users": new_users, "users": users_after, "remaining": remaining}


def reject_registrations(requests: DataFrame, registrations: DataFrame) -> dict[str, DataFrame]:
    """Delete requested Pending registrations; other ids report
    ``not_pending``. Returns the outcomes and the registrations left."""
    req = requests.select(F.col("registration_id").alias("rid")).distinct()
    pending = registrations.filter(F.col("status") == "Pending").select(F.col("id").alias("p_id"))
    tagged = req.join(pending, req["rid"] == pending["p_id"], "left")
    outcomes = tagged.select(F.col("rid").alias("registration_id"),
                             F.when(F.col("p_id").isNotNull(), "deleted").otherwise("not_pending")
                             .alias("outcome"))
    deleted = outcomes.filter(F.col("outcome") == "deleted").select(F.col("registration_id").alias("d_id"))
    remaining = registrations.join(deleted, registrations["id"] == deleted["d_id"], "left_anti")
    return {"outcomes": outcomes, "remaining": remaining}


#: Contested sign-ups that one task may decide in order.
FOLD_ROWS = 200_000


def registration_conflicts(signups: DataFrame, users: DataFrame, registrations: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Outcome of each new sign-up: ``user_exists`` (username or email
    is a user), else ``request_exists`` (a registration of any status has
    it), else ``accepted``. Within the batch, requests are served in
    (requested_at, id) order, so a sign-up clashing with an *earlier
    accepted* one gets ``request_exists``.

    Sign-ups that share no username or email with another one in the batch
    are accepted at once. The contested rest falls into connected parts, which
    do not touch each other; a part is decided by one pass over its
    sign-ups in order. Up to ``fold_rows`` contested sign-ups are one such pass. Beyond,
    parts are labelled (``_parts``) and dealt to tasks; only parts that alone have more rows are
    resolved in rounds (``_by_rounds``), which need no part in one place.
    So a long chain of clashes takes no more jobs than a short one.
    """
    user_clash = _clashing_ids(signups, "id", users).withColumnRenamed("kid", "u_id")
    reg_clash = _clashing_ids(signups, "id", registrations).withColumnRenamed("kid", "r_id")
    base = staged(signups.join(user_clash, signups["id"] == user_clash["u_id"], "left")
                  .join(reg_clash, signups["id"] == reg_clash["r_id"], "left")
                  .select("id", "username", "email", "requested_at",
                          F.when(F.col("u_id").isNotNull(), "user_exists")
                          .when(F.col("r_id").isNotNull(), "request_exists").alias("outcome")), "signups")
    decided = base.filter(F.col("outcome").isNotNull()).select("id", "username", "email", "outcome")
    cand = base.filter(F.col("outcome").isNull()).select(
        "id", "username", "email", F.struct("requested_at", "id").alias("ord"))
    # Only sign-ups sharing a username or email with another one in the
    # batch depend on the order; the rest are accepted outright.
    ckeys = _identity_keys(cand, "id")
    shared = ckeys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    contested_ids = staged(ckeys.join(shared, ["kind", "key"], "left_semi").select(F.col("kid").alias("c_id")).distinct(), "signups-contested")
    free = cand.join(contested_ids, cand["id"] == contested_ids["c_id"], "left_anti").select(
        "id", "username", "email", F.lit("accepted").alias("outcome"))
    contested = cand.join(contested_ids, cand["id"] == contested_ids["c_id"], "left_semi")
    n = contested_ids.count()
    if not n:
        return decided.unionByName(free)
    # Each username and each email as a number, the smallest id that has it.
    mine = _identity_keys(contested, "id")
    number = mine.groupBy("kind", "key").agg(F.min("kid").alias("first"))
    numbers = mine.join(number, ["kind", "key"]).groupBy("kid").agg(
        F.max(F.when(F.col("kind") == "u", F.col("first"))).alias("ukey"), F.max(F.when(F.col("kind") == "e", F.col("first"))).alias("ekey"))
    keyed = contested.join(numbers, contested["id"] == numbers["kid"], "left").drop("kid")
    done = decided.unionByName(free)
    if n <= fold_rows:
        return done.unionByName(_in_order(keyed.coalesce(1)))
    keyed = staged(keyed, "signups-keyed")
    label = staged(_parts(keyed), "signups-parts")
    large = staged(label.groupBy("part").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > fold_rows).select("part"), "signups-large")
    labelled = keyed.join(label, "id")
    done = done.unionByName(_in_order(labelled.join(large, "part", "left_anti").repartition("part")))
    if large.limit(1).count():
        done = done.unionByName(_by_rounds(labelled.join(large, "part", "left_semi").drop("part")))
    return done


def _in_order(keyed: DataFrame) -> DataFrame:
    """Decide sign-ups by one pass in order over each partition, which must hold whole parts."""
    rows = keyed.sortWithinPartitions("ord").select("id", "username", "email", "ukey", "ekey")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, emails = set(), set()
        for batch in batches:
            out = []
            for name, email in zip(batch.column("ukey").to_pylist(), batch.column("ekey").to_pylist()):
                free = (name is None or name not in names) and (email is None or email not in emails)
                out.append("accepted" if free else "request_exists")
                if free:
                    names.add(name)
                    emails.add(email)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "username", "email")), pa.array(out, pa.string())],
                                             ["id", "username", "email", "outcome"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(decide, f"id {kind['id']}, username string, email string, outcome string")


def _parts(keyed: DataFrame) -> DataFrame:
    """(id, part): sign-ups that share a username or an email, directly or over others, have one part, its smallest id.

    Every sign-up is linked to the numbers of its username and email, which are ids. Rounds of two steps then hang each id's larger
    neighbours, and next its smaller ones, on its smallest neighbour, until nothing
    changes: every part is a star, after about as many rounds as its longest chain has binary digits.
    """
    links = keyed.select(F.col("id").alias("a"), F.explode(F.array("ukey", "ekey")).alias("b")).filter(F.col("a") > F.col("b")).distinct()
    links = staged(links, "signups-links")  # a > b
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "signups-links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        nxt = staged(small.select("l.a", "l.b").filter(F.col("a") > F.col("b")).distinct(), "signups-links")
        state = [d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for d in (links, nxt)]
        links = nxt
        if state[0] == state[1]:
            break
    return keyed.select("id").join(links, keyed["id"] == links["a"], "left").select("id", F.coalesce("b", "id").alias("part"))


def _by_rounds(contested: DataFrame) -> DataFrame:
    """Decide sign-ups in rounds, without pairing rows: per username and per
    email group, the earliest live (undecided or accepted) request and the
    earliest accepted one are aggregates; a request that is the earliest live
    in both its groups is accepted, one with an earlier accepted clash is
    refused. Each round decides at least the earliest undecided request."""
    contested = staged(contested, "signups-rounds")
    pairs = F.array(F.struct(F.lit("u").alias("kind"), F.col("ukey").alias("key")), F.struct(F.lit("e").alias("kind"), F.col("ekey").alias("key")))
    keys = contested.select(F.col("id").alias("kid"), "ord", F.explode(pairs).alias("p")).select("kid", "ord", "p.kind", "p.key")
    keys = staged(keys.filter(F.col("key").isNotNull()), "signups-keys")
    # state: 0 undecided, 1 accepted, 2 refused
    state = staged(contested.select("id", F.lit(0).alias("state")), "signups-state")
    while state.filter(F.col("state") == 0).limit(1).count():
        ks = keys.join(state.withColumnRenamed("id", "kid"), "kid")
        live = F.col("state") < 2
        groups = ks.groupBy("kind", "key").agg(
            F.min(F.when(live, F.col("ord"))).alias("first_live"),
            F.min(F.when(F.col("state") == 1, F.col("ord"))).alias("first_acc"))
        per = (ks.filter(F.col("state") == 0).join(groups, ["kind", "key"])
               .groupBy("kid").agg(
                   F.bool_and(F.col("first_live") == F.col("ord")).alias("earliest"),
                   F.bool_or(F.coalesce(F.col("first_acc") < F.col("ord"), F.lit(False))).alias("beaten")))
        nxt = (state.join(per, state["id"] == per["kid"], "left")
               .select("id", F.when(F.col("state") != 0, F.col("state"))
                       .when(F.col("beaten"), 2).when(F.col("earliest"), 1).otherwise(0).alias("state")))
        state = staged(nxt, "signups-state")
    return contested.join(state, "id").select(
        "id", "username", "email", F.when(F.col("state") == 1, "accepted").when(F.col("state") == 2, "request_exists").alias("outcome"))


# ---- B08: order status changes ------------------------------------------------------------
def _classified_events(orders: DataFrame, status_events: DataFrame, users: DataFrame) -> DataFrame:
    """Each event with its order's cashier and base status and whether the
    actor may apply it (void/refund: the owning cashier; complete: a
    Kitchen or Manager user; unknown order: never)."""
    o = orders.select(F.col("id").alias("o_id"), F.col("cashier_id").alias("o_cashier"),
                      F.col("status").alias("base_status"))
    ev = status_events.join(o, status_events["order_id"] == o["o_id"], "left")
    # Only completions need a role, and only Kitchen and Manager users matter
    # for them: the other events never leave their order's bucket.
    kitchen = users.filter(F.col("role").isin(*KITCHEN_ROLES)).select(F.col("id").alias("u_id"))
    is_complete = F.coalesce(F.col("event_type") == "complete", F.lit(False))
    complete = ev.filter(is_complete).join(kitchen, F.col("actor_id") == kitchen["u_id"], "left") \
        .withColumn("allowed", F.col("u_id").isNotNull()).drop("u_id")
    other = ev.filter(~is_complete).withColumn(
        "allowed", F.col("event_type").isin("voided", "refunded") & (F.col("actor_id") == F.col("o_cashier")))
    valid = F.col("o_id").isNotNull() & F.coalesce(F.col("allowed"), F.lit(False))
    return complete.unionByName(other).select("order_id", "seq", "event_type", "actor_id", "event_time", "base_status",
                                              valid.alias("valid"))


def _status_summary(classified: DataFrame) -> DataFrame:
    """Per order, from its valid events only: the first valid event (the
    only one a complete can be, since any applied event leaves 'pending'),
    the last valid void/refund and the time of the last of each kind."""
    ev = classified.filter("valid")
    vr = F.col("event_type").isin("voided", "refunded")
    return ev.groupBy(F.col("order_id").alias("s_order_id")).agg(
        F.min_by(F.struct("seq", "event_type", "event_time", "actor_id"), F.col("seq")).alias("first"),
        F.max_by(F.col("event_type"), F.when(vr, F.col("seq"))).alias("last_vr_type"),
        F.max_by(F.col("event_time"), F.when(F.col("event_type") == "voided", F.col("seq"))).alias("void_time"),
        F.max_by(F.col("event_time"), F.when(F.col("event_type") == "refunded", F.col("seq")))
         .alias("refund_time"))


def apply_order_status(orders: DataFrame, status_events: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Fold complete / void / refund requests into orders in ``seq``
    order, as the server's guarded UPDATEs would.

    * void / refund apply from any status when the actor owns the order;
    * complete applies only while the order is pending and the actor is
      Kitchen or Manager; so it applies exactly when the order's base status
      is pending and it is the order's first valid event;
    * old timestamps are not cleared.

    One aggregation per order over valid events replaces a replay; the
    events are then tagged applied / refused by joining that summary back.
    Returns ``orders`` (the new order table) and ``outcomes``.
    """
    cl = _classified_events(orders, status_events, users)
    summ = _status_summary(cl)
    complete_first = (F.col("first.event_type") == "complete") & (F.col("status") == "pending")
    o = orders.join(summ, orders["id"] == summ["s_order_id"], "left")
    new_orders = o.select(
        "id", "cashier_id", "session_id",
        F.when(F.col("last_vr_type").isNotNull(), F.col("last_vr_type"))
         .when(complete_first, F.lit("completed")).otherwise(F.col("status")).alias("status"),
        "subtotal", "tax_amount", "discount_amount", "total", "payment_method", "notes", "created_at",
        F.when(complete_first, F.col("first.event_time")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(complete_first, F.col("first.actor_id")).otherwise(F.col("completed_by")).alias("completed_by"),
        F.coalesce(F.col("void_time"), F.col("voided_at")).alias("voided_at"),
        F.coalesce(F.col("refund_time"), F.col("refunded_at")).alias("refunded_at"))
    firsts = summ.select("s_order_id", F.col("first.seq").alias("first_seq"))
    tagged = cl.join(firsts, cl["order_id"] == firsts["s_order_id"], "left")
    applied = F.col("valid") & ((F.col("event_type") != "complete")
                                | ((F.col("seq") == F.col("first_seq")) & (F.col("base_status") == "pending")))
    outcomes = tagged.select("order_id", "seq", "event_type",
                             F.when(applied, "applied").otherwise("refused").alias("outcome"))
    return {"orders": new_orders, "outcomes": outcomes}


# ---- B09: latest-wins attribute updates ----------------------------------------------------
def _latest(updates: DataFrame, key: str, value: str, valid: Column | None = None) -> DataFrame:
    u = updates if valid is None else updates.filter(valid)
    return u.groupBy(F.col(key).alias("upd_key")).agg(F.max_by(F.col(value), F.col("seq")).alias("upd_value"))


def _apply_latest(table: DataFrame, latest: DataFrame, column: str) -> DataFrame:
    j = table.join(latest, table["id"] == latest["upd_key"], "left")
    return j.select(*[F.coalesce(F.col("upd_value"), table[c]).cast(table.schema[c].dataType).alias(c)
                      if c == column else table[c] for c in table.columns])


def apply_staff_status(users: DataFrame, staff_updates: DataFrame) -> DataFrame:
    """Latest valid active/disabled per user; a value outside the
    domain and a manager disabling their own account are refused."""
    valid = F.col("is_active").isin(*ACCOUNT_STATES) & \
        ~((F.col("manager_id") == F.col("user_id")) & (F.col("is_active") == "disabled"))
    return _apply_latest(users, _latest(staff_updates, "user_id", "is_active", valid), "is_active")


def apply_availability(products: DataFrame, availability_updates: DataFrame) -> DataFrame:
    """Latest 0/1 availability per product; other values refused."""
    valid = F.col("is_available").isin(0, 1)
    return _apply_latest(products, _latest(availability_updates, "product_id", "is_available", valid),
                         "is_available")


def apply_image_url(products: DataFrame, image_updates: DataFrame) -> DataFrame:
    """Latest image path per product."""
    return _apply_latest(products, _latest(image_updates, "product_id", "image_url"), "image_url")


def _update_outcomes(updates: DataFrame, table: DataFrame, key: str, refusal: Column | None = None) -> DataFrame:
    """(seq, key, outcome) of every request: the refusal, else ``not_found`` for an unknown id, else ``updated``."""
    known = table.select(F.col("id").alias("known_id"))
    j = updates.join(known, updates[key] == known["known_id"], "left")
    outcome = F.when(F.col("known_id").isNull(), "not_found").otherwise("updated")
    return j.select("seq", key, (outcome if refusal is None else F.coalesce(refusal, outcome)).alias("outcome"))


def staff_status_outcomes(users: DataFrame, staff_updates: DataFrame) -> DataFrame:
    """B09a per request: ``invalid_status``, ``own_account``, ``not_found`` or ``updated``, checked in this order."""
    status = F.col("is_active")
    refusal = F.when(~F.coalesce(status.isin(*ACCOUNT_STATES), F.lit(False)), "invalid_status").when(
        (F.col("manager_id") == F.col("user_id")) & (status == "disabled"), "own_account")
    return _update_outcomes(staff_updates, users, "user_id", refusal)


def availability_outcomes(products: DataFrame, availability_updates: DataFrame) -> DataFrame:
    """B09b per request: ``invalid_value``, ``not_found`` or ``updated``."""
    refusal = F.when(~F.coalesce(F.col("is_available").isin(0, 1), F.lit(False)), "invalid_value")
    return _update_outcomes(availability_updates, products, "product_id", refusal)


def image_outcomes(products: DataFrame, image_updates: DataFrame) -> DataFrame:
    """B09c per request: ``not_found`` or ``updated``."""
    return _update_outcomes(image_updates, products, "product_id")


# ---- B10: logins into sessions -------------------------------------------------------------
def sessionize_logins(login_events: DataFrame) -> DataFrame:
    """Login / logout events → user_sessions rows.

    A login opens a session; the user's next event decides its end: a
    logout closes it at the logout time, a login closes it with zero length
    (the application closes dangling sessions that way), no next event
    leaves it open. A logout without an open session changes nothing.

    "Next event of the user" is a lead over (ts, id). The events are
    range-partitioned on (user, ts, id), so a very active user, even one
    whose events all fall into one hour, spreads over several parts. The lead
    runs per (user, part); the last event of a part takes the user's first
    event of the next part from a summary with one row per user and part.
    """
    ev = login_events.select("id", "user_id", "ts", "event_type").repartitionByRange("user_id", "ts", "id") \
        .withColumn("part", F.spark_partition_id())
    ev = staged(ev, "login-events")
    w = Window.partitionBy("user_id", "part").orderBy("ts", "id")
    firsts = ev.groupBy("user_id", "part").agg(F.min(F.struct("ts", "id", "event_type")).alias("first"))
    nb = firsts.select(F.col("user_id").alias("nb_user"), F.col("part").alias("nb_part"),
                       F.lead("first").over(Window.partitionBy("user_id").orderBy("part")).alias("next_first"))
    ev = ev.select("*", F.lead("event_type").over(w).alias("nxt_type"), F.lead("ts").over(w).alias("nxt_ts"))
    logins = ev.filter(F.col("event_type") == "login")
    j = logins.join(nb, (logins["user_id"] == nb["nb_user"]) & (logins["part"] == nb["nb_part"])
                    & logins["nxt_type"].isNull(), "left")
    next_type = F.coalesce(F.col("nxt_type"), F.col("next_first.event_type"))
    next_ts = F.when(F.col("nxt_type").isNotNull(), F.col("nxt_ts")).otherwise(F.col("next_first.ts"))
    end = F.when(next_type == "logout", next_ts).when(next_type == "login", F.col("ts"))
    return j.select("id", "user_id", F.col("ts").alias("logged_in_at"), end.alias("logged_out_at"))


# ---- B11: held carts ----------------------------------------------------------------------
HELD_CARTS_SCHEMA = (
    "array<struct<id:string,createdAt:string,"
    "items:array<struct<productId:bigint,productName:string,sizeId:bigint,sizeLabel:string,"
    "addons:array<struct<id:bigint,name:string,extra_price:decimal(24,8)>>,"
    "unitPrice:decimal(24,8),quantity:decimal(14,6)>>,"
    "isDiscountActive:boolean,note:string>>")


def _json_lists(held: DataFrame, holder_col: str, json_col: str) -> DataFrame:
    """(holder, carts): the list of held carts, or NULL unless the whole text is one JSON list.

    The reader ends at the first whole value of a text. So the text is read as the first member of a list that its own
    MD5 ends: the MD5 comes second exactly when the text is one value and nothing follows it.
    """
    text = F.col(json_col)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))
    read = held.select(F.col(holder_col), F.md5(text).alias("_md5"), both.alias("_both"))
    return read.select(holder_col, F.when(F.try_variant_get("_both", "$[1]", "string") == F.col("_md5"),
                                          F.try_variant_get("_both", "$[0]", HELD_CARTS_SCHEMA)).alias("carts"))


def held_cart_totals(held: DataFrame, json_col: str = "held_json", holder_col: str = "holder_id") -> DataFrame:
    """Parse each browser's held-cart list and price every held cart.

    Each document is parsed once, into a Variant, and its carts are taken from that. A document that is not valid JSON
    as a whole, or not a JSON list, holds no carts. A value of another kind, or a number too large, counts as missing and
    costs no other value of its document. An object that names a key twice is read (its last value) only
    under ``spark.sql.variant.allowDuplicateKeys``, as ``build_session`` sets it; else its document holds no carts.

    The list is newest first, so a cart's number is (list length -
    index): the oldest is 1. Prices and quantities keep their decimals; a
    missing price or quantity makes its line 0. ``item_count`` is the sum of
    the quantities without a fraction. Totals follow B03 (12 % tax before the
    5 % discount, each amount rounded on its own) on exact decimals.
    """
    parsed = _json_lists(held, holder_col, json_col)
    # The outer form keeps the planner from filtering on the list first, which would parse every text twice.
    carts = parsed.select(holder_col, F.size("carts").alias("n"), F.posexplode_outer("carts").alias("idx", "cart")) \
        .filter(F.col("cart").isNotNull())
    items = F.coalesce(F.col("cart.items"), F.array().cast(
        carts.schema["cart"].dataType["items"].dataType))
    count = F.aggregate(items, F.lit(0).cast("decimal(30,6)"),
                        lambda acc, i: (acc + F.coalesce(i["quantity"], F.lit(0))).cast("decimal(30,6)"))
    sub = F.aggregate(items, F.lit(0).cast("decimal(30,8)"),
                      lambda acc, i: (acc + F.coalesce(i["unitPrice"] * i["quantity"], F.lit(0))).cast("decimal(30,8)"))
    disc = F.when(F.coalesce(F.col("cart.isDiscountActive"), F.lit(False)),
                  sub * F.lit(DISCOUNT_RATE).cast("decimal(3,2)")).otherwise(F.lit(0))
    tax = sub * F.lit(TAX_RATE).cast("decimal(3,2)")
    return carts.select(
        holder_col, (F.col("n") - F.col("idx")).cast("int").alias("position"),
        F.concat(F.lit("Held Order #"), (F.col("n") - F.col("idx")).cast("string")).alias("title"),
        F.col("cart.id").alias("held_id"), count.cast("bigint").alias("item_count"),
        F.round(sub, 2).cast(MONEY_OUT).alias("subtotal"),
        F.round(disc, 2).cast(MONEY_OUT).alias("discount_amount"),
        F.round(tax, 2).cast(MONEY_OUT).alias("tax_amount"),
        F.round(sub - disc + tax, 2).cast(MONEY_OUT).alias("total"))
