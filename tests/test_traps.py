"""Hand-made cases for the semantics traps and brute-force
replays of the order-dependent write paths on random request streams."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions import scalars
from tillroll.operators import audit, insights, reports, writes
from tillroll.plans.inspect import plan_text

TS = dt.datetime


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


USERS = "id int, username string, name string, email string, role string, is_active string, created_at timestamp_ntz"
ORDERS = ("id bigint, cashier_id bigint, session_id bigint, status string, subtotal decimal(10,2), "
          "tax_amount decimal(10,2), discount_amount decimal(10,2), total decimal(10,2), payment_method string, "
          "notes string, created_at timestamp_ntz, completed_at timestamp_ntz, completed_by bigint, "
          "voided_at timestamp_ntz, refunded_at timestamp_ntz")
ITEMS = ("id bigint, order_id bigint, product_id bigint, product_name string, product_size_id int, "
         "size_label string, quantity int, unit_price decimal(10,2), line_subtotal decimal(10,2)")
SESSIONS = "id bigint, user_id bigint, logged_in_at timestamp_ntz, logged_out_at timestamp_ntz"


def order(i, cashier, status, total="10.00", created=TS(2024, 1, 30, 9), **kw):
    t = Decimal(total) if total is not None else None
    base = dict(id=i, cashier_id=cashier, session_id=1, status=status, subtotal=t, tax_amount=t,
                discount_amount=Decimal("0"), total=t, payment_method="cash", notes=None, created_at=created,
                completed_at=None, completed_by=None, voided_at=None, refunded_at=None)
    base.update(kw)
    return tuple(base.values())


# ---- scalars (F05, F08, F10, F13, F17) -------------------------------------------------
def test_scalar_formats(spark):
    df = spark.createDataFrame(
        [(TS(2024, 1, 1, 0, 5), TS(2024, 1, 1, 13, 7), 3, 480, 9, "  ", "a  b   c", "émile zola x", "voided")],
        "a timestamp_ntz, b timestamp_ntz, m1 bigint, m2 bigint, m3 bigint, n1 string, n2 string, n3 string, "
        "s string")
    r = df.select(scalars.clock_time("a").alias("a"), scalars.clock_time("b").alias("b"),
                  scalars.hours_1dp_text("m1").alias("h1"), scalars.hours_1dp_text("m2").alias("h2"),
                  scalars.hours_1dp_text("m3").alias("h3"),
                  scalars.initials("n1").alias("i1"), scalars.initials("n2").alias("i2"),
                  scalars.initials("n3").alias("i3"), scalars.capitalize_first("s").alias("t"),
                  scalars.wait_text(F.lit(59)).alias("w1"), scalars.wait_text(F.lit(125)).alias("w2"),
                  scalars.duration_text(F.lit(3725)).alias("d1"), scalars.duration_text(F.lit(59)).alias("d2"),
                  scalars.tenths_text(F.lit(-180), 3600).alias("t1"), scalars.tenths_text(F.lit(5400), 3600)
                  .alias("t2")).first()
    assert (r.a, r.b) == ("12:05 AM", "1:07 PM")
    assert (r.h1, r.h2, r.h3) == ("0.1", "8.0", "0.2")        # 0.05 and 0.15 round half up
    assert (r.i1, r.i2, r.i3) == ("NA", "AB", "ÉZ")
    assert r.t == "Voided"
    assert (r.w1, r.w2, r.d1, r.d2) == ("59m", "2h 5m", "1h 2m", "0m")
    assert (r.t1, r.t2) == ("-0.1", "1.5")


def test_item_display_name(spark):
    df = spark.createDataFrame([("Latte", "Large", ["Oat", "Shot"]), ("Tea", None, [])],
                               "p string, s string, a array<string>")
    got = [r[0] for r in df.select(scalars.item_display_name("p", "s", "a")).collect()]
    assert got == ["Latte (Large) + Oat, Shot", "Tea"]


# ---- T12 / T14: audit log ----------------------------------------------------------------
def test_audit_null_total_gives_null_details_and_ties_break_by_kind_then_id(spark):
    users = spark.createDataFrame([(1, "u1", "One", "e1", "Cashier", "active", TS(2024, 1, 1))], USERS)
    t = TS(2024, 1, 30, 12)
    orders = spark.createDataFrame(
        [order(i, 1, "voided", created=t - dt.timedelta(hours=1), voided_at=t) for i in range(1, 80)]
        + [order(i, 1, "pending", created=t) for i in range(100, 160)]
        + [order(999, 1, "pending", total=None, created=TS(2024, 1, 1))], ORDERS)
    items = spark.createDataFrame([], ITEMS)
    sessions = spark.createDataFrame([], SESSIONS)
    log = audit.audit_log(orders, items, users, sessions).collect()
    # 139 events share one second: 'listed' sorts before 'voided', then ids ascending
    assert len(log) == 100
    kinds = [r.action_type for r in log]
    assert kinds[:60] == ["listed"] * 60 and kinds[60:] == ["voided"] * 40
    assert [r.details for r in log[60:62]] == ["Order #1 - Transaction cancelled", "Order #2 - Transaction cancelled"]
    listed = audit.audit_events(orders, items, users, sessions, kinds=("listed",))
    assert listed.filter("details is null").count() == 1      # CONCAT with a NULL part is NULL


# ---- T1: collation in registration checks ------------------------------------------------------
def test_accept_registration_conflict_is_case_and_accent_insensitive(spark):
    users = spark.createDataFrame([(1, "José", "J", "jose@x.org", "Cashier", "active", TS(2024, 1, 1))], USERS)
    regs = spark.createDataFrame(
        [(10, "JOSE", "a", "new@x.org", "Cashier", "Pending", TS(2024, 1, 2)),
         (11, "maria", "b", "JOSÉ@X.ORG", "Cashier", "Pending", TS(2024, 1, 2)),
         (12, "ana", "c", "ana@x.org", "Cashier", "Pending", TS(2024, 1, 2)),
         (13, "old", "d", "old@x.org", "Cashier", "Rejected", TS(2024, 1, 2))],
        "id int, username string, name string, email string, role string, status string, submitted_at timestamp_ntz")
    req = spark.createDataFrame([(10,), (11,), (12,), (13,), (14,), (12,)], "registration_id int")
    out = writes.accept_registrations(req, regs, users, TS(2024, 1, 30))
    assert rows(out["outcomes"], "registration_id", "outcome") == [
        (10, "conflict"), (11, "conflict"), (12, "accepted"), (13, "not_pending"), (14, "not_pending")]
    assert rows(out["new_users"], "id", "username") == [(13, "ana")]
    assert rows(out["users"], "id", "username") == [(1, "José"), (13, "ana")]
    assert sorted(r.id for r in out["remaining"].collect()) == [10, 11, 13]


# ---- B07: in-batch order ---------------------------------------------------------------------
SIGNUPS = "id int, username string, email string, requested_at timestamp_ntz"


def replay_signups(signups, user_keys, reg_keys):
    taken = set(reg_keys)
    out = {}
    for i, u, e, t in sorted(signups, key=lambda s: (s[3], s[0])):
        ku, ke = ("u", u.lower()), ("e", e.lower())
        if ku in user_keys or ke in user_keys:
            out[i] = "user_exists"
        elif ku in taken or ke in taken:
            out[i] = "request_exists"
        else:
            out[i] = "accepted"
            taken |= {ku, ke}
    return out


def test_signup_chain_earlier_accepted_wins(spark):
    t = TS(2024, 1, 1)
    s = spark.createDataFrame([(1, "u1", "e1", t), (2, "U1", "e2", t + dt.timedelta(seconds=1)),
                               (3, "u3", "E2", t + dt.timedelta(seconds=2))], SIGNUPS)
    users = spark.createDataFrame([], USERS)
    regs = spark.createDataFrame([], "username string, email string")
    got = dict(rows(writes.registration_conflicts(s, users, regs), "id", "outcome"))
    assert got == {1: "accepted", 2: "request_exists", 3: "accepted"}


def test_signups_match_sequential_replay(spark):
    rnd = random.Random(7)
    t = TS(2024, 1, 1)
    data = [(i, f"n{rnd.randrange(12)}", f"m{rnd.randrange(12)}", t + dt.timedelta(seconds=rnd.randrange(30)))
            for i in range(60)]
    users = [(1000 + k, f"N{k}", "x", f"zz{k}", "Cashier", "active", t) for k in range(2)]
    regs = [("n5", "M7")]
    got = dict(rows(writes.registration_conflicts(
        spark.createDataFrame(data, SIGNUPS), spark.createDataFrame(users, USERS),
        spark.createDataFrame(regs, "username string, email string")), "id", "outcome"))
    want = replay_signups(data, {("u", u[1].lower()) for u in users} | {("e", u[3].lower()) for u in users},
                          {("u", "n5"), ("e", "m7")})
    assert got == want


# ---- B02: merging adds --------------------------------------------------------------------
def test_merge_cart_lines_equals_replay_across_chunks(spark):
    rnd = random.Random(3)
    adds = [(seq, rnd.randrange(3), rnd.randrange(2), None, rnd.randrange(2), rnd.choice([1, 1, -1]))
            for seq in range(400)]
    df = spark.createDataFrame(adds, "seq bigint, cart_id bigint, product_id bigint, size_id int, "
                                     "addon_id bigint, change int")
    want = {}
    for seq, cart, prod, size, addon, ch in sorted(adds):
        key = (cart, f"{prod}|base|{addon}")
        q = want.get(key, 0)
        want[key] = max(0, q + ch) if (q > 0 or ch > 0) else 0
    want = {k: v for k, v in want.items() if v > 0}
    for bits in (1, 3, 16):                      # many ranges per key and level, and one
        got = {(r.cart_id, r.cart_key): r.quantity for r in writes.merge_cart_lines(df, range_bits=bits).collect()}
        assert got == want


def test_merge_cart_lines_spread_over_all_of_seq_and_removals(spark):
    rnd = random.Random(9)
    adds = [(rnd.randrange(-(2 ** 62), 2 ** 62), rnd.randrange(2), 1, None, None, rnd.choice([1, 1, 1, -1, -1, 0])) for _ in range(300)]
    df = spark.createDataFrame(adds, "seq bigint, cart_id bigint, product_id bigint, size_id int, addon_id bigint, change int")
    want = {}
    for _, cart, _, _, _, ch in sorted(adds, key=lambda a: a[0]):
        want[cart] = max(0, want.get(cart, 0) + ch) if ch else 0
    got = {r.cart_id: r.quantity for r in writes.merge_cart_lines(df).collect()}
    assert got == {k: v for k, v in want.items() if v > 0}
    assert writes.merge_cart_lines(df.limit(0)).count() == 0


# ---- T16-T19: totals and checkout ---------------------------------------------------------------
def test_half_cent_discount_and_total_round_up(spark):
    lines = spark.createDataFrame([(1, 1, Decimal("0.10"), 1), (2, 2, Decimal("0.50"), 0)],
                                  "line_id bigint, cart_id bigint, unit_price decimal(10,2), quantity int")
    carts = spark.createDataFrame([(1, True), (2, True)], "cart_id bigint, discount boolean")
    got = {r.cart_id: r for r in writes.cart_totals(lines, carts).collect()}
    assert got[1].discount_amount == Decimal("0.01")          # 0.005 → 0.01
    assert got[2].item_count == 1                             # quantity 0 → 1
    assert got[2].total == Decimal("0.54")                    # 0.50 * 1.07 = 0.535 → 0.54
    assert got[2].tax_amount == Decimal("0.06")


def test_checkout_defaults_and_rejections(spark, tables):
    carts = spark.createDataFrame(
        [(1, 5, False, "cash", "", TS(2024, 1, 1)), (2, 5, False, "card", "x", TS(2024, 1, 1)),
         (3, 5, False, "gcash", "note", TS(2024, 1, 1))],
        "cart_id bigint, cashier_id bigint, discount boolean, payment_method string, notes string, "
        "created_at timestamp_ntz")
    priced = spark.createDataFrame(
        [(10, 1, 7, "P", 0, "", 0, Decimal("2.50")), (20, 2, 7, "P", None, None, 2, Decimal("1.00"))],
        "line_id bigint, cart_id bigint, product_id bigint, product_name string, size_id int, "
        "size_label string, quantity int, unit_price decimal(10,2)")
    none = spark.createDataFrame([], SESSIONS)
    orders = writes.checkout_orders(carts, writes.cart_totals(priced, carts), none)
    got = {r.id: (r.status, r.reject_reason, r.notes) for r in orders.collect()}
    assert got == {1: ("pending", None, None), 2: (None, "invalid_payment_method", "x"),
                   3: (None, "no_items", "note")}
    item = writes.checkout_items(priced, carts).first()
    assert (item.quantity, item.product_size_id, item.size_label, item.line_subtotal) == (1, None, None,
                                                                                            Decimal("2.50"))


def test_checkout_rows_belong_exactly_to_accepted_orders(spark, tables):
    priced = writes.price_lines(tables.cart_lines, tables.products, tables.product_sizes, tables.product_addons)
    orders = writes.checkout_orders(tables.carts, writes.cart_totals(priced, tables.carts), tables.user_sessions)
    accepted = {r.id for r in orders.filter("reject_reason is null").collect()}
    item_orders = {r.order_id for r in writes.checkout_items(priced, tables.carts).select("order_id").collect()}
    assert item_orders == accepted
    addon_items = {r.order_item_id for r in writes.checkout_addons(tables.cart_lines, tables.product_addons,
                                                                  tables.carts).collect()}
    lines_of_accepted = {r.line_id for r in priced.collect() if r.cart_id in accepted}
    assert addon_items <= lines_of_accepted


def test_checkout_invariants(spark, tables):
    priced = writes.price_lines(tables.cart_lines, tables.products, tables.product_sizes, tables.product_addons)
    orders = writes.checkout_orders(tables.carts, writes.cart_totals(priced, tables.carts), tables.user_sessions)
    items = writes.checkout_items(priced, tables.carts)
    acc = orders.filter("reject_reason is null")
    sums = items.groupBy("order_id").agg(F.sum("line_subtotal").alias("s"))
    bad = acc.join(sums, acc.id == sums.order_id).filter(F.col("subtotal") != F.col("s")).count()
    assert bad == 0
    drift = acc.select(F.abs(F.col("total") - (F.col("subtotal") - F.col("discount_amount")
                                               + F.col("tax_amount"))).alias("d")).agg(F.max("d")).first()[0]
    assert drift <= Decimal("0.01")


def test_a_cart_of_lines_that_cancel_out_has_items(spark):
    carts = spark.createDataFrame([(1, 5, False, "cash", "\n", TS(2024, 1, 1))],
                                  "cart_id bigint, cashier_id bigint, discount boolean, payment_method string, notes string, "
                                  "created_at timestamp_ntz")
    priced = spark.createDataFrame([(10, 1, 2, Decimal("1.00")), (11, 1, -2, Decimal("1.00"))],
                                   "line_id bigint, cart_id bigint, quantity int, unit_price decimal(10,2)")
    got = writes.checkout_orders(carts, writes.cart_totals(priced, carts), spark.createDataFrame([], SESSIONS)).first()
    assert (got.reject_reason, got.notes, got.session_id) == (None, None, 1)


def test_checkout_sessions_equal_replay(spark):
    rnd = random.Random(12)
    t = TS(2024, 1, 1)
    at = lambda: t + dt.timedelta(minutes=rnd.randrange(600))
    logins = []
    for u in range(3):
        times = sorted({at() for _ in range(12)})
        for k, start in enumerate(times):
            nxt = times[k + 1] if k + 1 < len(times) else None
            end = rnd.choice([None, start + dt.timedelta(minutes=rnd.randrange(60)), nxt])
            logins.append((len(logins) + 1, u, start, min(end, nxt) if end and nxt else end))
    carts = [(100 + i, rnd.randrange(5), False, rnd.choice(["cash", "card"]), "", at()) for i in range(120)]
    cdf = spark.createDataFrame(carts, "cart_id bigint, cashier_id bigint, discount boolean, payment_method string, notes string, "
                                       "created_at timestamp_ntz")
    lines = spark.createDataFrame([(c[0], c[0], 1, Decimal("1.00")) for c in carts],
                                  "line_id bigint, cart_id bigint, quantity int, unit_price decimal(10,2)")
    sdf = spark.createDataFrame(logins, SESSIONS)
    want, opened, top = {}, {}, len(logins)
    for cid, u, _, pay, _, when in sorted(carts, key=lambda c: (c[5], c[0])):
        if pay == "card":
            want[cid] = None
            continue
        before = [x for x in logins if x[1] == u and x[2] <= when]
        last = max(before, key=lambda x: (x[2], x[0]), default=None)
        if last and (last[3] is None or last[3] > when):
            want[cid] = last[0]
        else:
            key = (u, last and last[0])
            opened.setdefault(key, (top + cid, when))
            want[cid] = opened[key][0]
    totals = writes.cart_totals(lines, cdf)
    assert {r.id: r.session_id for r in writes.checkout_orders(cdf, totals, sdf).collect()} == want
    got = rows(writes.checkout_sessions(cdf, totals, sdf), "id", "user_id", "logged_in_at")
    assert got == sorted((i, k[0], when) for k, (i, when) in opened.items())


# ---- B08: status requests ----------------------------------------------------------------
EVENTS = "order_id bigint, seq bigint, event_type string, actor_id bigint, event_time timestamp_ntz"


def replay_status(orders, events, roles):
    state = {o[0]: {"status": o[3], "cashier": o[1], "completed_at": o[11], "completed_by": o[12],
                    "voided_at": o[13], "refunded_at": o[14]} for o in orders}
    outcome = {}
    for oid, seq, kind, actor, t in sorted(events, key=lambda e: e[1]):
        o = state.get(oid)
        ok = False
        if o is not None:
            if kind in ("voided", "refunded") and actor == o["cashier"]:
                o["status"] = kind
                o["voided_at" if kind == "voided" else "refunded_at"] = t
                ok = True
            elif kind == "complete" and roles.get(actor) in ("Kitchen", "Manager") and o["status"] == "pending":
                o.update(status="completed", completed_at=t, completed_by=actor)
                ok = True
        outcome[seq] = "applied" if ok else "refused"
    return state, outcome


def test_order_status_fold_equals_replay(spark):
    rnd = random.Random(11)
    roles = {1: "Kitchen", 2: "Manager", 3: "Cashier", 4: "Cashier"}
    users = spark.createDataFrame([(k, f"u{k}", "n", f"e{k}", r, "active", TS(2024, 1, 1)) for k, r in roles.items()],
                                  USERS)
    statuses = ["pending", "pending", "held", "completed", "voided"]
    odata = [order(i, rnd.choice([3, 4]), rnd.choice(statuses)) for i in range(1, 40)]
    evs = [(rnd.randrange(1, 45), seq, rnd.choice(["complete", "voided", "refunded"]), rnd.choice([1, 2, 3, 4]),
            TS(2024, 1, 30, 10) + dt.timedelta(minutes=rnd.randrange(500))) for seq in range(300)]
    out = writes.apply_order_status(spark.createDataFrame(odata, ORDERS), spark.createDataFrame(evs, EVENTS), users)
    state, outcome = replay_status(odata, evs, roles)
    got = {r.id: r for r in out["orders"].collect()}
    for oid, s in state.items():
        r = got[oid]
        assert (r.status, r.completed_at, r.completed_by, r.voided_at, r.refunded_at) == (
            s["status"], s["completed_at"], s["completed_by"], s["voided_at"], s["refunded_at"]), oid
    assert {r.seq: r.outcome for r in out["outcomes"].collect()} == outcome
    # applying again with no new requests changes nothing
    empty = spark.createDataFrame([], EVENTS)
    again = writes.apply_order_status(out["orders"], empty, users)["orders"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out["orders"].collect()))


# ---- B10: sessions --------------------------------------------------------------------------
def test_sessionize_equals_replay_across_buckets(spark):
    rnd = random.Random(5)
    base = TS(2024, 1, 1)
    evs = [(i, rnd.randrange(4), base + dt.timedelta(seconds=rnd.randrange(4 * 3600)),
            rnd.choice(["login", "login", "logout"])) for i in range(300)]
    df = spark.createDataFrame(evs, "id bigint, user_id bigint, ts timestamp_ntz, event_type string")
    want = {}
    by_user = {}
    for e in sorted(evs, key=lambda e: (e[1], e[2], e[0])):
        by_user.setdefault(e[1], []).append(e)
    for es in by_user.values():
        for k, e in enumerate(es):
            if e[3] != "login":
                continue
            nxt = es[k + 1] if k + 1 < len(es) else None
            want[e[0]] = None if nxt is None else (nxt[2] if nxt[3] == "logout" else e[2])
    for partitions in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r.id: r.logged_out_at for r in writes.sessionize_logins(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want
    opens = writes.sessionize_logins(df).filter("logged_out_at is null").groupBy("user_id").count()
    assert opens.filter("count > 1").count() == 0


# ---- B11: held carts --------------------------------------------------------------------------
def test_held_carts_bad_documents_hold_nothing(spark):
    good = ('[{"id":"h2","items":[{"unitPrice":10.00,"quantity":2,"addons":[]}],"isDiscountActive":true},'
            '{"id":"h1","items":[{"unitPrice":0.50,"quantity":1}],"isDiscountActive":false}]')
    df = spark.createDataFrame([("a", good), ("b", '{"id": "h9", "items": []}'), ("c", "[{"), ("d", None),
                                ("e", "[]")], "holder_id string, held_json string")
    got = rows(writes.held_cart_totals(df), "holder_id", "position", "held_id", "item_count", "total")
    assert got == [("a", 1, "h1", 1, Decimal("0.56")), ("a", 2, "h2", 2, Decimal("21.40"))]


def test_held_carts_are_read_as_strictly_as_a_browser_does(spark):
    cart = '[{"id":"h","items":[{"unitPrice":10.005,"quantity":2},{"unitPrice":null,"quantity":3},{"unitPrice":2,"quantity":2.5}]}]'
    texts = {"ok": cart, "space": f"\n\t {cart} \r\n", "trailing": cart + " xyz", "two": cart + "," + cart, "close": cart + "], [",
             "member": cart + ', "x": 1', "single": "[{'id':'h','items':[]}]", "name": '[{id:"h"}]', "nan": '[{"id":"h","items":[{"unitPrice":NaN}]}]',
             "null": "null", "text": '"[]"', "number": "5", "blank": "", "comment": "/* a */ []"}
    df = spark.createDataFrame(list(texts.items()), "holder_id string, held_json string")
    got = rows(writes.held_cart_totals(df), "holder_id", "item_count", "subtotal", "total")
    assert got == [("ok", 7, Decimal("25.01"), Decimal("28.01")), ("space", 7, Decimal("25.01"), Decimal("28.01"))]


def test_held_carts_values_of_another_kind_count_as_missing(spark):
    item = '{"unitPrice":2.5,"quantity":2}'
    texts = {"twice": f'[{{"id":"x","id":"h","items":[{item}]}}]', "text": '[{"id":"h","items":[{"unitPrice":"2.5","quantity":2}]}]',
             "large": f'[{{"id":"h","items":[{{"unitPrice":1e400,"quantity":1}},{item}]}}]',
             "number": f'[3,{{"id":"h","items":[{item}]}},null]', "items": '[{"id":"h","items":5}]',
             "md5": '[], "d751713988987e9331980363e24189ce"], ['}
    df = spark.createDataFrame(list(texts.items()), "holder_id string, held_json string")
    got = rows(writes.held_cart_totals(df), "holder_id", "position", "held_id", "subtotal")
    assert got == [("items", 1, "h", Decimal("0.00")), ("large", 1, "h", Decimal("5.00")), ("number", 2, "h", Decimal("5.00")),
                   ("text", 1, "h", Decimal("5.00")), ("twice", 1, "h", Decimal("5.00"))]


def test_held_carts_are_parsed_once(spark):
    df = spark.createDataFrame([("a", "[]")], "holder_id string, held_json string")
    plan = plan_text(writes.held_cart_totals(df), "simple")
    assert plan.lower().count("parsejson") == 1


# ---- U01 / U04 / U05 / U06 ------------------------------------------------------------------
def test_category_counts_zero_and_all(spark):
    products = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 9, 1)], "id int, category_id int, is_available int")
    cats = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(insights.category_counts(products, cats), "category", "product_count") == [
        ("1", 2), ("2", 0), ("all", 3)]
    assert rows(insights.category_counts(products, cats, True), "category", "product_count") == [
        ("1", 1), ("2", 0), ("all", 2)]
    assert rows(insights.category_counts(products, cats, True), "category", "showing_text") == [
        ("1", "Showing 1 item"), ("2", "Showing 0 items"), ("all", "Showing 2 items")]


def test_category_counts_of_an_empty_table_and_of_products_without_category(spark):
    cats = spark.createDataFrame([(1,)], "id int")
    products = spark.createDataFrame([(1, 1, 1), (2, None, 1)], "id int, category_id int, is_available int")
    assert rows(insights.category_counts(products, cats), "category", "product_count") == [("1", 1), ("all", 2)]
    assert rows(insights.category_counts(products.limit(0), cats), "category", "product_count") == [("1", 0), ("all", 0)]


def test_daily_history_has_days_without_activity(spark):
    o = spark.createDataFrame([order(1, 1, "completed", completed_at=TS(2024, 1, 1, 9)),
                               order(2, 1, "completed", completed_at=TS(2024, 1, 3, 9))], ORDERS)
    none = spark.createDataFrame([], SESSIONS)
    got = rows(insights.daily_history(o, none, TS(2024, 1, 4, 12)), "day", "transactions_made", "transactions_made_yesterday")
    assert got == [(dt.date(2024, 1, d), a, b) for d, a, b in ((1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1))]
    got = rows(insights.daily_history(o.limit(0), none, TS(2024, 1, 4, 12)), "day", "transactions_made")
    assert got == [(dt.date(2024, 1, 4), 0)]


def test_cashiers_and_sessions_without_orders_count_zero(spark):
    o = spark.createDataFrame([order(1, 1, "completed", total="5.00"), order(2, None, "pending")], ORDERS)
    users = spark.createDataFrame([(1, "a", "A", "a@x", "Cashier", "active", TS(2024, 1, 1)),
                                   (2, "b", "B", "b@x", "Cashier", "active", TS(2024, 1, 1))], USERS)
    sessions = spark.createDataFrame([(1, 1, TS(2024, 1, 1), None), (7, 2, TS(2024, 1, 1), None)], SESSIONS)
    counts = {r.cashier_id: r.total_transactions for r in reports.cashier_order_count(o, users).collect()}
    assert counts == {1: 1, 2: 0, None: 1}
    got = {(r.cashier_id, r.session_id): r.session_revenue for r in reports.session_revenue(o, sessions).collect()}
    assert got == {(1, 1): Decimal("5.00"), (2, 7): Decimal("0.00"), (None, 1): Decimal("0.00")}


def test_notes_and_initials(spark):
    df = spark.createDataFrame([("\n",), (" a\n",), ("\u00a0\t",), ("a b",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.blank_to_null("x")).collect()] == [None, "a", None, "a b", None]
    df = spark.createDataFrame([(" juan  dela cruz ",), ("é",), ("",), (None,), (" \t",)], "x string")
    assert [r[0] for r in df.select(scalars.initials("x")).collect()] == ["JD", "É", "NA", "NA", "NA"]


def test_nesting_of_one_large_order(spark):
    n = 4000
    items = spark.createDataFrame([(i, 1, 5, "P", None, None, 1, Decimal("1"), Decimal("1")) for i in range(n)], ITEMS)
    addons = spark.createDataFrame([(i, i // 2, 9, f"A{i % 2}", 1, Decimal("1"), Decimal("1")) for i in range(n)],
                                   "id bigint, order_item_id bigint, addon_id bigint, addon_name string, quantity int, "
                                   "addon_price decimal(10,2), addon_subtotal decimal(10,2)")
    r = reports.order_lines_nested(items, addons).collect()
    assert len(r) == 1 and [x.id for x in r[0]["items"]] == list(range(n))
    assert [[a.id for a in x.addons] for x in r[0]["items"]] == [[2 * i, 2 * i + 1] if 2 * i < n else [] for i in range(n)]


def test_derived_times_and_ids_do_not_overflow(spark):
    from tillroll.sources.fixtures import add_seconds, t0
    df = spark.createDataFrame([(600_000 * 3600,), (36_000_000 * 61,), (86_399,), (-1,)], "n bigint")
    got = [r[0] for r in df.select(add_seconds(F.col("n"), t0())).collect()]
    assert got == [TS(2024, 1, 1) + dt.timedelta(seconds=n) for n in (600_000 * 3600, 36_000_000 * 61, 86_399, -1)]


def test_kitchen_status_empty_and_hours(spark):
    empty = spark.createDataFrame([], ORDERS)
    r = insights.kitchen_status(empty, TS(2024, 1, 30)).first()
    assert (r.active_orders, r.oldest_wait) == (0, "0m")
    o = spark.createDataFrame([order(1, 1, "pending", created=TS(2024, 1, 29, 22, 30))], ORDERS)
    assert insights.kitchen_status(o, TS(2024, 1, 30)).first().oldest_wait == "1h 30m"


def test_daily_history_matches_daily_and_hours_reports(tables):
    from tillroll.schema import AS_OF
    hist = insights.daily_history(tables.orders, tables.user_sessions, AS_OF)
    today = hist.filter(F.col("day") == F.lit(AS_OF.date())).first()
    d = reports.daily_report(tables.orders, AS_OF).first()
    h = reports.hours_report(tables.user_sessions, AS_OF).first()
    for m in ("transactions_made", "daily_revenue", "orders_refunded", "refunded_total", "orders_voided",
              "voided_total"):
        assert today[m] == d[m] and today[m + "_yesterday"] == d[m + "_yesterday"], m
    for m in ("seconds_clocked", "staff_count"):
        assert today[m] == h[m] and today[m + "_yesterday"] == h[m + "_yesterday"], m


def test_daily_comparison_texts(spark):
    daily = spark.createDataFrame([(5, 5, Decimal("1234.50"), Decimal("0.25"), 0, 2, 3, 1)],
                                  "transactions_made bigint, transactions_made_yesterday bigint, "
                                  "daily_revenue decimal(18,2), daily_revenue_yesterday decimal(18,2), "
                                  "orders_refunded bigint, orders_refunded_yesterday bigint, "
                                  "orders_voided bigint, orders_voided_yesterday bigint")
    hours = spark.createDataFrame([(5400, 7200, 3)], "seconds_clocked bigint, seconds_clocked_yesterday bigint, "
                                                     "staff_count bigint")
    got = {r.metric: (r.today, r.delta, r.comparison) for r in insights.daily_comparison(daily, hours).collect()}
    assert got["transactions"] == ("5", "0", "No change vs yesterday")
    assert got["revenue"] == ("₱1,235", "+₱1,234", "+₱1,234.25 vs yesterday")
    assert got["refunded"] == ("0", "-2", "-2 vs yesterday")
    assert got["voided"] == ("3", "+2", "+2 vs yesterday")
    assert got["hours"] == ("1.5h", "3 staff", "-0.5h vs yesterday")


# ---- R15: current session ------------------------------------------------------------------
def test_cashier_time_current_session_rules(spark):
    now = TS(2024, 1, 30, 12)
    s = spark.createDataFrame([(1, 7, TS(2024, 1, 30, 8), TS(2024, 1, 30, 9)),     # closed: 3600
                               (2, 7, TS(2024, 1, 30, 10), None),                   # open, not current: 0
                               (3, 7, TS(2024, 1, 30, 11), None)], SESSIONS)        # current, open: 3600
    r = reports.cashier_time_summary(s, now).first()
    assert (r.current_session_id, r.total_time_seconds, r.session_time_seconds) == (3, 7200, 3600)
    cur = spark.createDataFrame([(7, 1)], "user_id bigint, session_id bigint")
    r = reports.cashier_time_summary(s, now, cur).first()
    assert (r.total_time_seconds, r.session_time_seconds) == (3600, 4 * 3600)


# ---- T3 / T5 / T6 / T8: report semantics -----------------------------------------------------
def test_daily_report_counts_current_status_and_zero_when_empty(spark):
    as_of = TS(2024, 1, 30, 23, 0)
    done = TS(2024, 1, 30, 10)
    o = spark.createDataFrame([
        order(1, 1, "completed", "5.00", created=TS(2024, 1, 30, 9), completed_at=done),
        # completed today, then refunded yesterday-relative later: counts only as a refund
        order(2, 1, "refunded", "7.00", created=TS(2024, 1, 30, 9), completed_at=done,
              refunded_at=TS(2024, 1, 30, 11)),
        order(3, 1, "completed", "9.00", created=TS(2024, 1, 28, 9), completed_at=TS(2024, 1, 29, 8))],
        ORDERS)
    r = reports.daily_report(o, as_of).first()
    assert (r.transactions_made, r.daily_revenue) == (1, Decimal("5.00"))
    assert (r.transactions_made_yesterday, r.daily_revenue_yesterday) == (1, Decimal("9.00"))
    assert (r.orders_refunded, r.refunded_total) == (1, Decimal("7.00"))
    z = reports.daily_report(spark.createDataFrame([], ORDERS), as_of).first()
    assert all(v == 0 for v in z)                                       # T5: never NULL


def test_order_stats_average_over_completed_only(spark):
    o = spark.createDataFrame([order(1, 1, "completed", "10.00"), order(2, 1, "completed", "20.01"),
                               order(3, 1, "voided", "1000.00")], ORDERS)
    r = reports.order_stats(o).first()
    assert (r.total_transactions, r.total_revenue, r.avg_transaction) == (3, Decimal("30.01"), Decimal("15.005000"))
    e = reports.order_stats(spark.createDataFrame([], ORDERS)).first()
    assert (e.total_transactions, e.total_revenue, e.avg_transaction) == (0, 0, 0)


def test_hours_open_session_runs_to_as_of_on_its_login_day(spark):
    as_of = TS(2024, 1, 30, 2, 0)
    s = spark.createDataFrame([(1, 5, TS(2024, 1, 29, 20, 0), None),           # open since yesterday: 6 h
                               (2, 6, TS(2024, 1, 30, 1, 0), TS(2024, 1, 30, 1, 30))], SESSIONS)
    r = reports.hours_report(s, as_of).first()
    assert (r.seconds_clocked, r.staff_count) == (1800, 1)
    assert (r.seconds_clocked_yesterday, r.staff_count_yesterday) == (6 * 3600, 1)
    assert r.hours_clocked_yesterday == 6.0


# ---- T15 / T24: pricing ------------------------------------------------------------------------
def test_price_lines_size_replaces_base_and_addons_add(spark):
    products = spark.createDataFrame([(1, "Latte", Decimal("100.00"))], "id int, name string, base_price decimal(10,2)")
    sizes = spark.createDataFrame([(3, 1, "Large", Decimal("130.00"))],
                                  "id int, product_id int, label string, price decimal(10,2)")
    addons = spark.createDataFrame([(2, 1, "Oat", Decimal("15.00"), 1), (3, 1, "Old", Decimal("99.00"), 0)],
                                   "id int, product_id int, name string, extra_price decimal(10,2), is_available int")
    lines = spark.createDataFrame([(1, 1, 1, None, 1, False), (2, 1, 1, 3, 1, True), (3, 1, 1, 99, 1, True)],
                                  "line_id bigint, cart_id bigint, product_id bigint, size_id int, quantity int, "
                                  "with_addons boolean")
    got = {r.line_id: (r.unit_price, r.size_label, r.addon_count) for r in
           writes.price_lines(lines, products, sizes, addons).collect()}
    assert got == {1: (Decimal("100.00"), None, 0),                    # no size: base price
                   2: (Decimal("145.00"), "Large", 1),                 # size price + available addon only
                   3: (Decimal("115.00"), None, 1)}                    # unknown size: base price


# ---- R17 / R18 / U03: menu ---------------------------------------------------------------------
PRODUCTS = ("id int, category_id int, name string, description string, base_price decimal(10,2), "
            "image_url string, is_available int")
SIZES = "id int, product_id int, label string, price decimal(10,2)"
ADDONS = "id int, product_id int, name string, extra_price decimal(10,2), is_available int"


def test_menu_options_and_ordering(spark):
    p = spark.createDataFrame([(1, 1, "A", None, Decimal("1"), None, 1), (2, 1, "B", None, Decimal("1"), None, 1),
                               (3, 1, "C", None, Decimal("1"), None, 1), (4, 1, "D", None, Decimal("1"), None, 0)],
                              PRODUCTS)
    s = spark.createDataFrame([(10, 1, "L", Decimal("9")), (11, 1, "S", Decimal("5")), (12, 4, "X", Decimal("1"))],
                              SIZES)
    a = spark.createDataFrame([(20, 2, "zest", Decimal("1"), 1), (21, 2, "Éclair", Decimal("1"), 1),
                               (22, 2, "apple", Decimal("1"), 1), (23, 3, "gone", Decimal("1"), 0)], ADDONS)
    assert rows(reports.active_menu(p, s, a), "id", "has_options") == [(1, 1), (2, 1), (3, 0)]
    assert rows(reports.product_sizes_list(p, s), "id", "position") == [(10, 2), (11, 1)]   # 4 is unavailable
    got = sorted(reports.product_addons_list(p, a).collect(), key=lambda r: r.position)
    assert [r.name for r in got] == ["apple", "Éclair", "zest"]     # accent- and case-insensitive order


def test_products_grouped_does_not_depend_on_the_ranges(spark):
    menu = spark.createDataFrame([(i, c, f"p{i}", None, Decimal("1"), None, 0)
                                  for i, c in ((5, 1), (1023, 1), (1024, 1), (2050, 1), (2, 7), (4000, 7), (3, None))],
                                 "id bigint, category_id int, name string, description string, "
                                 "base_price decimal(10,2), image_url string, has_options int")
    want = {(1, "☕ Coffee", 0, 5), (1, "☕ Coffee", 1, 1023), (1, "☕ Coffee", 2, 1024), (1, "☕ Coffee", 3, 2050),
            (7, " Category 7", 0, 2), (7, " Category 7", 1, 4000), (None, None, 0, 3)}
    for ids in (2, 1024, 65_536):
        got = insights.products_grouped(menu, range_ids=ids).collect()
        assert {(r.category_id, r.header, r.pos, r.id) for r in got} == want


# ---- B06 / B09: rejections and latest-wins updates ----------------------------------------------
def test_reject_registrations_outcomes(spark):
    regs = spark.createDataFrame([(1, "Pending"), (2, "Rejected"), (3, "Pending")], "id int, status string")
    req = spark.createDataFrame([(1,), (2,), (9,)], "registration_id int")
    out = writes.reject_registrations(req, regs)
    assert rows(out["outcomes"], "registration_id", "outcome") == [(1, "deleted"), (2, "not_pending"),
                                                                   (9, "not_pending")]
    assert sorted(r.id for r in out["remaining"].collect()) == [2, 3]


def test_staff_status_refuses_self_disable_and_unknown_values(spark):
    users = spark.createDataFrame([(1, "m", "M", "m@x", "Manager", "active", TS(2024, 1, 1)),
                                   (2, "c", "C", "c@x", "Cashier", "active", TS(2024, 1, 1))], USERS)
    upd = spark.createDataFrame([(1, 1, "disabled", 1),      # manager disabling themself: refused
                                 (2, 2, "disabled", 1), (3, 2, "paused", 1),   # later invalid value: refused
                                 (4, 9, "disabled", 1)],     # unknown user: no effect
                                "seq bigint, user_id bigint, is_active string, manager_id bigint")
    got = rows(writes.apply_staff_status(users, upd), "id", "is_active")
    assert got == [(1, "active"), (2, "disabled")]
    prods = spark.createDataFrame([(5, 1, "P", None, Decimal("1"), None, 1)], PRODUCTS)
    av = spark.createDataFrame([(1, 5, 0), (2, 5, 2)], "seq bigint, product_id int, is_available int")
    assert rows(writes.apply_availability(prods, av), "id", "is_available") == [(5, 0)]


def test_update_outcomes(spark):
    users = spark.createDataFrame([(1, "m", "M", "m@x", "Manager", "active", TS(2024, 1, 1))], USERS)
    upd = spark.createDataFrame([(1, 1, "disabled", 1), (2, 1, "disabled", 2), (3, 1, "paused", 1), (4, 9, "active", 1), (5, 1, None, 1)],
                                "seq bigint, user_id bigint, is_active string, manager_id bigint")
    assert rows(writes.staff_status_outcomes(users, upd), "seq", "outcome") == [
        (1, "own_account"), (2, "updated"), (3, "invalid_status"), (4, "not_found"), (5, "invalid_status")]
    prods = spark.createDataFrame([(5, 1, "P", None, Decimal("1"), None, 1)], PRODUCTS)
    av = spark.createDataFrame([(1, 5, 0), (2, 5, 2), (3, 6, 1)], "seq bigint, product_id int, is_available int")
    assert rows(writes.availability_outcomes(prods, av), "seq", "outcome") == [(1, "updated"), (2, "invalid_value"), (3, "not_found")]
    im = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "seq bigint, product_id int, image_url string")
    assert rows(writes.image_outcomes(prods, im), "seq", "outcome") == [(1, "updated"), (2, "not_found")]


def test_signup_rounds_never_leave_outcomes_empty(spark):
    t = TS(2024, 1, 1)
    # a chain where each sign-up clashes with the next: decided one per round
    data = [(i, f"u{i // 2}", f"e{(i + 1) // 2}", t + dt.timedelta(seconds=i)) for i in range(8)]
    s = spark.createDataFrame(data, SIGNUPS)
    users = spark.createDataFrame([], USERS)
    regs = spark.createDataFrame([], "username string, email string")
    got = dict(rows(writes.registration_conflicts(s, users, regs), "id", "outcome"))
    assert got == replay_signups(data, set(), set())


def jobs_of(spark, action):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("fold_rows", [200_000, 40, 3, 0])
def test_signup_parts_match_sequential_replay(spark, fold_rows):
    """One pass over all, labelled parts, and parts too large for one task give the same outcomes."""
    rnd = random.Random(fold_rows)
    t = TS(2024, 1, 1)
    data = [(i, rnd.choice([f"N{rnd.randrange(60)}", f"n{rnd.randrange(60)}", "hot"]), f"m{rnd.randrange(70)}", t + dt.timedelta(seconds=rnd.randrange(30)))
            for i in range(150)] + [(200, None, "m1", t), (201, None, None, t), (202, None, "q", t)]
    users = spark.createDataFrame([], USERS)
    regs = spark.createDataFrame([], "username string, email string")
    got = dict(rows(writes.registration_conflicts(spark.createDataFrame(data, SIGNUPS), users, regs, fold_rows), "id", "outcome"))
    taken, want = set(), {}
    for i, u, e, _ in sorted(data, key=lambda d: (d[3], d[0])):
        keys = {k for k in (("u", u and u.lower()), ("e", e and e.lower())) if k[1] is not None}
        want[i] = "request_exists" if keys & taken else "accepted"
        taken |= keys if want[i] == "accepted" else set()
    assert got == want


@pytest.mark.parametrize("n, fold_rows, most", [(10_000, 200_000, 25), (2_000, 1_999, 200)])
def test_a_long_chain_of_clashes_takes_a_bounded_number_of_jobs(spark, n, fold_rows, most):
    t = TS(2024, 1, 1)
    chain = [(i, f"u{i // 2}", f"e{(i + 1) // 2}", t + dt.timedelta(seconds=i)) for i in range(n)]
    if fold_rows < n:  # two chains, each below the bound, both together above it
        chain = chain[: n // 2] + [(n + i, f"x{i // 2}", f"y{(i + 1) // 2}", t) for i in range(n // 2)]
    s = spark.createDataFrame(chain, SIGNUPS)
    users = spark.createDataFrame([], USERS)
    regs = spark.createDataFrame([], "username string, email string")
    got, jobs = jobs_of(spark, lambda: dict(rows(writes.registration_conflicts(s, users, regs, fold_rows), "id", "outcome")))
    assert got == replay_signups(chain, set(), set())
    assert jobs <= most


def test_one_checkout_gives_all_five_results(spark, tables, monkeypatch, tmp_path):
    from tillroll.operators import checkout
    t, priced = tables, []
    real = writes.price_lines
    monkeypatch.setattr(writes, "price_lines", lambda *a: priced.append(1) or real(*a))
    done = checkout.checkout(t.carts, t.cart_lines, t.products, t.product_sizes, t.product_addons, t.user_sessions)
    assert len(priced) == 1
    lines = real(t.cart_lines, t.products, t.product_sizes, t.product_addons)
    totals = writes.cart_totals(lines, t.carts)
    accepted = writes.accepted_carts(t.carts, t.cart_lines, t.products)
    same = {"orders": writes.checkout_orders(t.carts, totals, t.user_sessions), "items": writes.checkout_items(lines, t.carts),
            "addons": writes.checkout_addons(t.cart_lines, t.product_addons, t.carts), "payments": writes.checkout_payments(t.carts, totals),
            "sessions": writes.checkout_sessions(t.carts, None, t.user_sessions, accepted)}
    for name, want in same.items():
        got = getattr(done, name)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
    # the results read the stages: no menu table is joined again but for the addons
    read = {*done.items.inputFiles(), *done.orders.inputFiles()}
    assert not any("product" in f for f in read) and any("checkout-lines" in f for f in read)
    done.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/orders").count() == done.payments.count() == spark.read.parquet(f"{tmp_path}/payments").count()
    assert "reject_reason" not in spark.read.parquet(f"{tmp_path}/orders").columns


def test_audit_log_takes_two_passes_whoever_is_gone(spark, tables, monkeypatch):
    """All users of the newest events are gone: the second pass finds the rest, exactly."""
    t = tables
    full = audit.audit_log(t.orders, t.order_items, t.users, t.user_sessions, limit=60).collect()
    gone = {r["username"] for r in full}
    left = t.users.filter(~F.col("username").isin(*gone))
    stages = []
    real = audit.staged
    monkeypatch.setattr(audit, "staged", lambda df, name: stages.append(name) or real(df, name))
    got = audit.audit_log(t.orders, t.order_items, left, t.user_sessions, limit=60)
    assert len(stages) == 3
    every = audit.audit_events(t.orders, t.order_items, left, t.user_sessions, keep_source=True)
    want = every.orderBy(F.col("event_time").desc(), "action_type", "source_id").limit(60).drop("source_id")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
