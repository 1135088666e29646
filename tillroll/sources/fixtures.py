"""Point-of-sale tables derived from the driver's Parquet files.

These builders only give rows in the schemas the operators expect (see
FIXTURES.md); they do none of the operators' work. Every table is a lazy
DataFrame over the raw scans, so a query that needs two columns of ``orders``
reads two columns of ``orders.parquet``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.schema import MONEY, T0 as T0_VALUE
from tillroll.sources.parquet import read_table

def t0() -> Column:
    """The fixture clock origin, 2024-01-01 00:00:00, as a TIMESTAMP_NTZ
    literal built from text (a Python datetime literal would be read as a
    local-time TIMESTAMP and shift with the session time zone)."""
    return F.lit(T0_VALUE.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def add_seconds(n: Column, ts: Column) -> Column:
    """FIXTURES macro ADD(n, t). Whole days and seconds of a day, so that no
    part of a BIGINT ``n`` overflows."""
    n = n.cast("bigint")
    return ts + F.make_dt_interval(days=F.floor(n / 86400).cast("int"),
                                   secs=F.pmod(n, F.lit(86400)).cast("decimal(18,6)"))


def whole_second(ts: Column) -> Column:
    """FIXTURES macro SEC(ts): drop the fraction of a second. Built from the
    NTZ fields, so no time-zone conversion takes part."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                                F.floor(F.second(ts)).cast("decimal(8,6)"))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


class PosTables:
    """The point-of-sale tables of one scale-factor folder.

    ``tables.orders`` etc. build each table from the raw scans. With
    ``store=True`` (the default) each table is written once per Spark
    application to the session's checkpoint folder, bucketed on its join key
    (see ``tillroll.sources.store``), and read back from there, as an
    application's stored tables would be; later queries scan the stored
    table instead of re-deriving it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.store = store
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            build = getattr(self, f"_build_{name}")
            if self.store:
                from tillroll.sources.store import stored_table
                self._tables[name] = stored_table(self.spark, self.sf_dir, name, build)
            else:
                self._tables[name] = build()
        return self._tables[name]

    def _buckets(self, name: str) -> int:
        from tillroll.sources.store import bucket_count
        return bucket_count(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- staff and catalogue ---------------------------------------------
    def _build_users(self) -> DataFrame:
        c = self.raw("customer")
        key = F.col("c_custkey")
        return c.select(
            key.cast("bigint").alias("id"),
            _cat("user", key.cast("string")).alias("username"),
            F.col("c_name").alias("name"),
            _cat("user", key.cast("string"), "@example.org").alias("email"),
            F.when(key % 25 == 0, "Manager").when(key % 25 == 1, "Kitchen")
             .otherwise("Cashier").alias("role"),
            F.when(F.col("c_acctbal") < 0, "disabled").otherwise("active").alias("is_active"),
            add_seconds(key * 61, t0()).alias("created_at"),
        )

    def _build_categories(self) -> DataFrame:
        # One row per distinct type: bounded by the type vocabulary, not rows.
        types = self.raw("part").select("p_type").distinct()
        return types.select(
            F.dense_rank().over(Window.orderBy("p_type")).cast("int").alias("id"),
            F.col("p_type").alias("name"),
        )

    def _build_products(self) -> DataFrame:
        p = self.raw("part")
        c = self.categories
        return p.join(c, c["name"] == p["p_type"]).select(
            p["p_partkey"].cast("bigint").alias("id"),
            c["id"].alias("category_id"),
            _cat(p["p_name"], " ", p["p_partkey"].cast("string")).alias("name"),
            p["p_brand"].alias("description"),
            p["p_retailprice"].cast(MONEY).alias("base_price"),
            F.when(p["p_size"] % 3 == 0, _cat("/img/", p["p_partkey"].cast("string")))
             .alias("image_url"),
            F.when(p["p_size"] % 5 == 0, 0).otherwise(1).alias("is_available"),
        )

    def _build_product_sizes(self) -> DataFrame:
        labels = F.when(F.col("k") == 0, "Small").when(F.col("k") == 1, "Medium").otherwise("Large")
        return (self.products.filter(F.col("id") % 3 == 0)
                .select("id", "base_price", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
                .select((F.col("id") * 3 + F.col("k")).alias("id"),
                        F.col("id").alias("product_id"),
                        labels.alias("label"),
                        (F.col("base_price") + F.col("k") * 50).cast(MONEY).alias("price")))

    def _build_product_addons(self) -> DataFrame:
        return (self.products.filter(F.col("id") % 4 == 1)
                .select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
                .select((F.col("id") * 2 + F.col("k")).alias("id"),
                        F.col("id").alias("product_id"),
                        _cat("Addon ", F.col("k").cast("string")).alias("name"),
                        (F.col("k") * 10 + 5).cast(MONEY).alias("extra_price"),
                        F.when((F.col("id") + F.col("k")) % 3 == 0, 0).otherwise(1)
                         .alias("is_available")))

    # ---- orders ------------------------------------------------------------
    def _build_orders_base(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        open_status = (F.floor(key / 30).cast("bigint") % 3)
        status = (F.when(F.col("o_orderstatus") == "F", "completed")
                  .when(F.col("o_orderstatus") == "P", "pending")
                  .when(open_status == 0, "voided")
                  .when(open_status == 1, "refunded")
                  .otherwise("held"))
        return o.select(
            key.alias("id"),
            F.col("o_custkey").alias("cashier_id"),
            (F.col("o_custkey") * 4 + key % 4).alias("session_id"),
            status.alias("status"),
            F.col("o_totalprice").cast(MONEY).alias("subtotal"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "rush").alias("notes"),
            F.when(key % 2 == 0, "cash").otherwise("gcash").alias("payment_method"),
            add_seconds((key % 30) * 86400 + (key * 7919) % 86400, t0()).alias("created_at"),
        )

    def _build_orders(self) -> DataFrame:
        b = self.orders_base
        oid, sub, st = F.col("id"), F.col("subtotal"), F.col("status")
        done = st.isin("completed", "refunded")
        return b.select(
            "id", "cashier_id", "session_id", "status", "subtotal",
            F.round(sub * F.lit(0.12).cast("decimal(2,2)"), 2).cast(MONEY).alias("tax_amount"),
            F.when(oid % 4 == 0, F.round(sub * F.lit(0.05).cast("decimal(2,2)"), 2))
             .otherwise(0).cast(MONEY).alias("discount_amount"),
            F.when(oid % 4 == 0, F.round(sub * F.lit(1.07).cast("decimal(3,2)"), 2))
             .otherwise(F.round(sub * F.lit(1.12).cast("decimal(3,2)"), 2)).cast(MONEY).alias("total"),
            "payment_method", "notes", "created_at",
            F.when(done, add_seconds(oid % 1800 + 60, F.col("created_at"))).alias("completed_at"),
            F.when(done & (oid % 5 != 0), (oid % 6) * 25 + 1).alias("completed_by"),
            F.when(st == "voided", add_seconds(oid % 3600 + 120, F.col("created_at"))).alias("voided_at"),
            F.when(st == "refunded", add_seconds((oid * 31) % 90000 + 3600, F.col("created_at")))
             .alias("refunded_at"),
        )

    def _build_lines(self) -> DataFrame:
        # Dealt as the stored table is: numbered and written after one shuffle.
        li = self.raw("lineitem").repartition(self._buckets("lines"), "l_orderkey")
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_shipdate", "l_discount", "l_tax")
        return li.select(
            (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            "l_suppkey", "l_linenumber", "l_returnflag",
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("unit_price"),
        )

    def _size_of_line(self, lines: DataFrame) -> DataFrame:
        # The product is the only hash key, so lines that lie on it are not shuffled again.
        s = self.product_sizes
        cond = (s["product_id"] == lines["product_id"]) & \
               (s["id"] - lines["product_id"] * 3 == lines["l_linenumber"] % 4)
        return lines.join(s, cond, "left")

    def _build_order_items(self) -> DataFrame:
        lines = self.lines
        p = self.products.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
        j = self._size_of_line(lines.join(p, p["p_id"] == lines["product_id"]))
        s = self.product_sizes
        return j.select(
            lines["id"], lines["order_id"], lines["product_id"],
            F.col("p_name").alias("product_name"),
            s["id"].alias("product_size_id"), s["label"].alias("size_label"),
            lines["quantity"], lines["unit_price"],
            (lines["quantity"] * lines["unit_price"]).cast(MONEY).alias("line_subtotal"),
        )

    def _build_order_item_addons(self) -> DataFrame:
        lines = self.lines.filter(F.col("l_suppkey") % 2 == 0)
        a = self.product_addons
        j = lines.join(a, a["product_id"] == lines["product_id"])
        return j.select(
            (lines["id"] * 2 + a["id"] % 2).alias("id"),
            lines["id"].alias("order_item_id"),
            a["id"].alias("addon_id"),
            a["name"].alias("addon_name"),
            lines["quantity"],
            a["extra_price"].alias("addon_price"),
            (lines["quantity"] * a["extra_price"]).cast(MONEY).alias("addon_subtotal"),
        )

    def _build_payments(self) -> DataFrame:
        return self.orders.filter(F.col("status") != "held").select(
            "id", F.col("id").alias("order_id"), "payment_method",
            F.col("total").alias("amount_due"), F.col("total").alias("amount_received"),
            F.lit(0).cast(MONEY).alias("change_due"),
            F.lit(None).cast("string").alias("reference_no"),
            F.col("created_at").alias("paid_at"),
        )

    # ---- sessions and logins ----------------------------------------------
    def _build_user_sessions(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "signup")
        start = whole_second(F.col("ts"))
        return e.select(
            F.col("event_id").alias("id"), "user_id",
            start.alias("logged_in_at"),
            F.when(F.col("event_id") % 7 != 0,
                   add_seconds(F.floor(F.col("value") * 60).cast("bigint"), start))
             .alias("logged_out_at"),
        )

    def _build_login_events(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("signup", "error"))
        return e.select(
            F.col("event_id").alias("id"), "user_id", "ts",
            F.when(F.col("event_type") == "signup", "login").otherwise("logout").alias("event_type"),
        )

    # ---- registrations -----------------------------------------------------
    def _build_registrations(self) -> DataFrame:
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        ks = key.cast("string")
        return s.select(
            (key + 1).cast("bigint").alias("id"),
            F.when(key % 10 == 0, _cat("USER", ks)).otherwise(_cat("applicant", ks)).alias("username"),
            F.col("s_name").alias("name"),
            F.when(key % 10 == 1, _cat("user", ks, "@example.org"))
             .otherwise(_cat("applicant", ks, "@example.org")).alias("email"),
            F.lit("Cashier").alias("role"),
            F.when(key % 6 == 5, "Rejected").otherwise("Pending").alias("status"),
            add_seconds(key * 3600, t0()).alias("submitted_at"),
        )

    def _build_registration_requests(self) -> DataFrame:
        s = self.raw("supplier").filter(F.col("s_suppkey") % 3 != 2)
        known = s.select((F.col("s_suppkey") + 1).cast("bigint").alias("registration_id"))
        unknown = self.spark.range(1).select(F.lit(1000000).cast("bigint").alias("registration_id"))
        return known.unionByName(unknown)

    def _build_signups(self) -> DataFrame:
        # Emails clash in pairs and usernames in other pairs, so sign-ups of a
        # batch depend on each other in chains.
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        ks = key.cast("string")
        shared_mail = F.floor(key / 14).cast("bigint").cast("string")
        return s.select(
            key.cast("bigint").alias("id"),
            F.when(key % 4 == 0, _cat("user", ks)).when(key % 4 == 1, _cat("Applicant", ks))
             .when(key % 7 < 5, _cat("New", F.floor(key / 7).cast("bigint").cast("string")))
             .otherwise(_cat("new", ks, "x")).alias("username"),
            F.when(key % 14 < 6, _cat("pair", shared_mail, "@example.org"))
             .otherwise(_cat("new", ks, "@example.org")).alias("email"),
            add_seconds(F.pmod(key * 37, F.lit(1009)) * 60, t0()).alias("requested_at"),
        )

    # ---- request streams ----------------------------------------------------
    def _build_status_events(self) -> DataFrame:
        lines = self.lines.filter(F.col("l_suppkey") % 2 == 1)
        o = self.orders.select(F.col("id").alias("o_id"), "cashier_id", "created_at")
        j = lines.join(o, o["o_id"] == lines["order_id"])
        etype = (F.when(F.col("l_returnflag") == "A", "complete")
                 .when(F.col("l_returnflag") == "N", "voided").otherwise("refunded"))
        return j.select(
            "order_id", F.col("id").alias("seq"), etype.alias("event_type"),
            F.when(F.col("l_suppkey") % 5 == 0, F.lit(1).cast("bigint"))
             .otherwise(F.col("cashier_id")).alias("actor_id"),
            add_seconds((F.col("id") % 1000) * 60, F.col("created_at")).alias("event_time"),
        )

    def _build_staff_updates(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("error", "click", "view"))
        return e.select(
            F.col("event_id").alias("seq"), "user_id",
            F.when(F.col("event_type") == "error", "disabled")
             .when(F.col("event_type") == "click", "active").otherwise("paused").alias("is_active"),
            (F.col("user_id") + F.col("event_id") % 2).alias("manager_id"),
        )

    def _build_availability_updates(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "view")
        return e.select(F.col("event_id").alias("seq"),
                        (F.col("event_id") % 200).cast("bigint").alias("product_id"),
                        (F.col("event_id") % 3).cast("int").alias("is_available"))

    def _build_image_updates(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "purchase")
        return e.select(F.col("event_id").alias("seq"),
                        (F.col("event_id") % 200).cast("bigint").alias("product_id"),
                        _cat("/assets/products/product_", F.col("event_id").cast("string"), ".png")
                        .alias("image_url"))

    # ---- carts ----------------------------------------------------------------
    def _build_carts(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        return o.select(
            key.alias("cart_id"), F.col("o_custkey").alias("cashier_id"),
            (key % 4 == 0).alias("discount"),
            F.when(key % 3 == 0, "cash").when(key % 3 == 1, "gcash").otherwise("card")
             .alias("payment_method"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "\n rush\t").when(F.col("o_orderpriority") == "2-HIGH", "\n")
             .otherwise("").alias("notes"),
            add_seconds((key % 30) * 86400 + (key * 7919) % 86400, t0()).alias("created_at"),
        )

    def _build_cart_lines(self) -> DataFrame:
        lines = self.lines
        j = self._size_of_line(lines)
        s = self.product_sizes
        return j.select(
            lines["id"].alias("line_id"), lines["order_id"].alias("cart_id"),
            lines["product_id"], s["id"].alias("size_id"),
            F.when(lines["quantity"] % 10 == 0, 0).otherwise(lines["quantity"]).alias("quantity"),
            (lines["l_suppkey"] % 2 == 0).alias("with_addons"),
        )

    def _build_cart_adds(self) -> DataFrame:
        return self.lines.select(
            F.col("id").alias("seq"), F.col("order_id").alias("cart_id"),
            (F.col("product_id") % 7).alias("product_id"),
            F.lit(None).cast("int").alias("size_id"),
            (F.col("product_id") % 2).alias("addon_id"),
            F.when(F.col("id") % 11 == 0, 0).when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("change"),
        )

    # ---- held carts (B11) ----------------------------------------------------------
    def _build_held_carts(self) -> DataFrame:
        """Browser held-cart lists as stored text: per cashier and day, the
        JSON list of that day's carts, newest first, each line with the unit
        price it was held at. Some extra documents must be read strictly: an
        object, a cut-off text, trailing text and single quotes hold no carts;
        white space around a list, fractions and a missing price are valid."""
        names = self.products.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
        prices = self.lines.select(F.col("id").alias("l_id"), "unit_price")
        lines = self.cart_lines.join(prices, F.col("line_id") == F.col("l_id")).join(names, F.col("product_id") == F.col("p_id"))
        item = F.struct(F.col("product_id").alias("productId"), F.col("p_name").alias("productName"),
                        F.col("size_id").alias("sizeId"), F.col("unit_price").alias("unitPrice"), "quantity")
        per_cart = lines.groupBy(F.col("cart_id").alias("pc_cart")).agg(
            F.array_sort(F.collect_list(F.struct("line_id", item.alias("item")))).alias("its"))
        c = self.carts.join(per_cart, F.col("cart_id") == F.col("pc_cart"))
        held = F.struct(_cat("hold-", F.col("cart_id").cast("string")).alias("id"),
                        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"),
                        F.transform("its", lambda x: x["item"]).alias("items"),
                        F.col("discount").alias("isDiscountActive"), F.col("notes").alias("note"))
        holder = _cat(F.col("cashier_id").cast("string"), "-", F.date_format("created_at", "yyyyMMdd"))
        c = c.withColumn("holder_id", holder).repartition(self._buckets("held_carts"), "holder_id")
        docs = (c.groupBy("holder_id", F.col("cashier_id").alias("h_cashier"))
                .agg(F.sort_array(F.collect_list(F.struct("created_at", "cart_id", held.alias("held"))),
                                  asc=False).alias("hs"))
                .select("holder_id", "h_cashier",
                        F.to_json(F.transform("hs", lambda x: x["held"])).alias("held_json")))
        # Each document and its odd one, if any, come out of one pass over the carts.
        own = F.struct("holder_id", "held_json")
        both = F.array(own)
        for k, (name, text) in enumerate(ODD_DOCUMENTS):
            odd = F.struct(_cat(F.col("holder_id"), "-", name).alias("holder_id"), F.lit(text).alias("held_json"))
            both = F.when(F.col("h_cashier") % len(ODD_DOCUMENTS) == k, F.array(own, odd)).otherwise(both)
        return docs.select(F.explode(both).alias("d")).select("d.holder_id", "d.held_json")


# Held-cart documents next to the regular ones: name and text.
ODD_DOCUMENTS = (
    ("object", '{"not": "a list"}'),
    ("cut", '[{"id": "hold-'),
    ("trailing", '[{"id":"t","items":[{"unitPrice":5,"quantity":1}]}] xyz'),
    ("single", "[{'id':'s','items':[]}]"),
    ("two", '[{"id":"a","items":[]}],[{"id":"b","items":[]}]'),
    ("odd", '\n\t [{"id":"odd","items":[{"unitPrice":10.005,"quantity":2},{"unitPrice":4,"quantity":2.5},'
            '{"unitPrice":null,"quantity":1}],"isDiscountActive":false}]\r\n'),
    ("empty", " [] "),
)

TABLE_NAMES = ('users', 'categories', 'products', 'product_sizes', 'product_addons', 'orders_base', 'orders', 'lines', 'order_items', 'order_item_addons', 'payments', 'user_sessions', 'login_events', 'registrations', 'registration_requests', 'signups', 'status_events', 'staff_updates', 'availability_updates', 'image_updates', 'carts', 'cart_lines', 'cart_adds', 'held_carts')

for _name in TABLE_NAMES:
    setattr(PosTables, _name, property(lambda self, _n=_name: self.table(_n)))
