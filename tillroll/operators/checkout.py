"""B04 as one write set: orders, items, addons, payments and sessions of a batch of carts from one stage.

The application answers a checkout request by writing all of them at once. Here the
cart lines are priced once and stored; everything else follows from that stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import writes
from tillroll.sources.stage import staged


@dataclass(frozen=True)
class Checkout:
    """The rows one batch of checkouts adds; ``orders`` also has the refused carts, with the reason."""

    orders: DataFrame
    items: DataFrame
    addons: DataFrame
    payments: DataFrame
    sessions: DataFrame

    def write(self, path: str) -> None:
        """Write the five tables under ``path``. Rows written are final ones: refused carts are left out of the orders."""
        taken = self.orders.where(F.col("reject_reason").isNull()).drop("reject_reason")
        for name, table in (("orders", taken), ("order_items", self.items), ("order_item_addons", self.addons),
                            ("payments", self.payments), ("user_sessions", self.sessions)):
            table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def checkout(carts: DataFrame, cart_lines: DataFrame, products: DataFrame, product_sizes: DataFrame, product_addons: DataFrame,
             user_sessions: DataFrame) -> Checkout:
    """Check out all ``carts``.

    Three stages are written: the priced lines, one row per cart with its
    totals and reason, and the session of each accepted cart. The five results are projections or small joins of them."""
    priced = staged(writes.price_lines(cart_lines, products, product_sizes, product_addons), "checkout-lines")
    judged = staged(writes.judged_carts(carts, writes.cart_totals(priced, carts)), "checkout-carts")
    accepted = judged.where(F.col("reason").isNull()).select("cart_id", "cashier_id", "created_at")
    of_cart = staged(writes.cart_sessions(accepted, user_sessions), "checkout-sessions")
    return Checkout(
        writes.order_rows(judged, of_cart), writes.checkout_items(priced, carts),
        writes.checkout_addons(cart_lines, product_addons, carts), writes.payment_rows(judged), writes.session_rows(of_cart))


def write_set(done: Checkout) -> DataFrame:
    """What a write set holds, by table: (table_name, n_rows, amount), the amount being the sum of the rows' main amount."""
    def of(name: str, table: DataFrame, amount: str | None) -> DataFrame:
        total = F.sum(amount) if amount else F.lit(None)
        return table.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), total.cast("decimal(30,2)").alias("amount"))

    taken = done.orders.where(F.col("reject_reason").isNull())
    parts = [of("orders", taken, "total"), of("order_items", done.items, "line_subtotal"), of("order_item_addons", done.addons, "addon_subtotal"),
             of("payments", done.payments, "amount_due"), of("user_sessions", done.sessions, None)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
