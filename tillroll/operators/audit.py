"""Audit log (R03 and its six event kinds R03a-f).

The application has no event table: an order's history is its current
state plus one timestamp per state, and a session's history is its login and
logout times. Events are derived from that state:

* one scan of ``orders`` turns each order into up to four events
  (listed / completed / voided / refunded) with ``explode`` over an array of
  conditional structs; no union of four filtered scans;
* one scan of ``user_sessions`` gives clock-in and clock-out events;
* the actor must exist: one inner join to ``users`` over the union tests and
  names; completions are tested and named for their cashier the same way.

The log is state-based: an order voided and later refunded shows only the
refund, since only the current status is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.scalars import clock_time, grouped_2dp, hours_1dp_text, minutes_between
from tillroll.schema import AUDIT_LIMIT, PESO
from tillroll.sources.stage import staged

ORDER_KINDS = ("listed", "completed", "voided", "refunded")
SESSION_KINDS = ("clocked-in", "clocked-out")
ALL_KINDS = ORDER_KINDS + SESSION_KINDS

# The labels shown for each action.
ACTION_LABELS = {
    "listed": "Listed an order",
    "completed": "Completed an order",
    "voided": "Voided an order",
    "refunded": "Refunded an order",
    "clocked-in": "Clocked in",
    "clocked-out": "Clocked out",
}


def _events(df: DataFrame, keep: list[str], specs: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per (input row, kind) whose condition holds and whose time is
    not NULL. A single kind is a plain filter (pushed into the scan)."""
    if len(specs) == 1:
        kind, cond, ts = specs[0]
        return df.filter(cond & ts.isNotNull()).select(
            *keep, F.lit(kind).alias("action_type"), ts.alias("event_time"))
    candidates = F.array(*[F.when(cond & ts.isNotNull(), F.struct(F.lit(kind).alias("action_type"),
                                                                   ts.alias("event_time")))
                           for kind, cond, ts in specs])
    return (df.select(*keep, F.explode(F.filter(candidates, lambda e: e.isNotNull())).alias("ev"))
            .select(*keep, "ev.action_type", "ev.event_time"))


UNIT_KINDS = ("listed", "completed")          # kinds whose text names the order's units


def order_events(orders: DataFrame, kinds=ORDER_KINDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Order-derived events as narrow rows (no text yet)."""
    st = F.col("status")
    specs = {
        "listed": (F.lit(True), F.col("created_at")),
        "completed": (st == "completed", F.col("completed_at")),
        "voided": (st == "voided", F.col("voided_at")),
        "refunded": (st == "refunded", F.col("refunded_at")),
    }
    ev = _events(orders, ["id", "cashier_id", "completed_by", "total", *extra], [(k, *specs[k]) for k in kinds])
    actor = F.when(F.col("action_type") == "completed", F.coalesce("completed_by", "cashier_id")) \
             .otherwise(F.col("cashier_id"))
    return ev.select(F.col("id").alias("source_id"), actor.cast("bigint").alias("actor_id"),
                     F.when(F.col("action_type") == "completed", F.col("cashier_id")).cast("bigint").alias("cashier_id"),
                     "total", F.lit(None).cast("timestamp_ntz").alias("logged_in_at"),
                     F.lit(None).cast("timestamp_ntz").alias("logged_out_at"), "action_type", "event_time", *extra)


def session_events(user_sessions: DataFrame, kinds=SESSION_KINDS) -> DataFrame:
    """Clock-in / clock-out events as narrow rows (no text yet)."""
    start, end = F.col("logged_in_at"), F.col("logged_out_at")
    specs = {"clocked-in": (F.lit(True), start), "clocked-out": (end.isNotNull(), end)}
    ev = _events(user_sessions, ["id", "user_id", "logged_in_at", "logged_out_at"],
                 [(k, *specs[k]) for k in kinds])
    return ev.select(F.col("id").alias("source_id"), F.col("user_id").cast("bigint").alias("actor_id"),
                     F.lit(None).cast("bigint").alias("cashier_id"), F.lit(None).cast("decimal(10,2)").alias("total"),
                     "logged_in_at", "logged_out_at", "action_type", "event_time")


def _label(kind: Column) -> Column:
    out = None
    for k, label in ACTION_LABELS.items():
        out = (F.when(kind == k, label) if out is None else out.when(kind == k, label))
    return out


def _units(order_items: DataFrame) -> DataFrame:
    return order_items.groupBy(F.col("order_id").alias("ic_order_id")).agg(F.sum("quantity").alias("item_count"))


def _cashier_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").cast("bigint").alias("cashier_uid"), F.col("username").alias("cashier_username"))


def _actor_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").cast("bigint").alias("uid"), "username", "name")


def _named(ev: DataFrame, users: DataFrame) -> DataFrame:
    """The events of known users with the actor's names; one inner join tests and names."""
    names = _actor_names(users)
    return ev.join(names, ev["actor_id"] == names["uid"])


def _texts(d: DataFrame) -> DataFrame:
    """Label and details text of events that carry names and units."""
    order_no = F.concat(F.lit("Order #"), F.col("source_id").cast("string"), F.lit(" - "))
    units = F.coalesce(F.col("item_count"), F.lit(0)).cast("string")
    money = F.concat(F.lit(PESO), grouped_2dp("total"))
    start, end = F.col("logged_in_at"), F.col("logged_out_at")
    kind = F.col("action_type")
    details = (F.when(kind == "listed",
                      F.concat(order_no, units, F.lit(" item(s), "), money, F.lit(" sent to kitchen")))
               .when(kind == "completed",
                     F.concat(order_no, units, F.lit(" item(s), "), money, F.lit(" by cashier @"),
                              F.col("cashier_username")))
               .when(kind == "voided", F.concat(order_no, F.lit("Transaction cancelled")))
               .when(kind == "refunded", F.concat(order_no, money, F.lit(" refunded")))
               .when(kind == "clocked-in", F.concat(F.lit("Started shift at "), clock_time(start)))
               .otherwise(F.concat(F.lit("Ended shift at "), clock_time(end), F.lit(" - "),
                                   hours_1dp_text(minutes_between(start, end)), F.lit(" hours worked"))))
    return d.select("username", "name", "action_type", _label(kind).alias("action_label"),
                    details.alias("details"), "event_time", "source_id")


def audit_events(orders: DataFrame | None, order_items: DataFrame | None, users: DataFrame,
                 user_sessions: DataFrame | None, kinds=ALL_KINDS, keep_source: bool = False) -> DataFrame:
    """All audit events of the given kinds (R03a-f for one kind each), with
    the actor's username and name. Events whose actor (or, for a
    completion, whose cashier) is not a user drop out.

    Units are counted and joined first, while orders and lines still lie on
    the order id. Completions, and only they, then meet the cashiers, and all
    events the actors, each in one inner join. Session events take part in
    the actor join alone. A table that no kind of ``kinds`` reads may be None.
    """
    parts = []
    rest = [k for k in kinds if k in ORDER_KINDS and k != "completed"]
    counted = orders
    if any(k in UNIT_KINDS for k in kinds):
        ic = _units(order_items)
        counted = orders.join(ic, orders["id"] == ic["ic_order_id"], "left")
    if rest:
        with_units = "listed" in rest
        parts.append(order_events(counted if with_units else orders, rest, ("item_count",) if with_units else ()))
    if "completed" in kinds:
        done = order_events(counted, ("completed",), ("item_count",))
        cashier = _cashier_names(users)
        parts.append(done.join(cashier, done["cashier_id"] == cashier["cashier_uid"]).drop("cashier_uid"))
    if any(k in SESSION_KINDS for k in kinds):
        parts.append(session_events(user_sessions, [k for k in kinds if k in SESSION_KINDS]))
    ev = parts[0]
    for p in parts[1:]:
        ev = ev.unionByName(p, allowMissingColumns=True)
    for c, t in (("item_count", "bigint"), ("cashier_username", "string")):
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast(t))
    out = _texts(_named(ev, users))
    return out if keep_source else out.drop("source_id")


def newest_known(orders: DataFrame, users: DataFrame, user_sessions: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` events of known users, as narrow rows.

    First the newest ``limit`` events are taken (each partition keeps that
    many; nothing is fully sorted or shuffled), and only their users are
    looked up. If some of them are not users, a second pass keeps the events of
    known users, of all events, and takes the newest of these. So there are two passes
    at most, whatever share of the events belongs to users who are gone.
    """
    ev = order_events(orders).unionByName(session_events(user_sessions))
    newest = [F.col("event_time").desc(), F.col("action_type"), F.col("source_id")]
    ids = users.select(F.col("id").cast("bigint").alias("uid"))

    def known(events: DataFrame) -> DataFrame:
        mine = events.join(ids, F.col("actor_id") == F.col("uid"), "left_semi")
        cashiers = ids.withColumnRenamed("uid", "cashier_uid")
        done = mine.filter(F.col("action_type") == "completed").join(cashiers, F.col("cashier_id") == F.col("cashier_uid"), "left_semi")
        return mine.filter(F.col("action_type") != "completed").unionByName(done)

    top = staged(ev.orderBy(*newest).limit(limit), "audit-top")
    kept = staged(known(top), "audit-known")
    if kept.count() == limit or top.count() < limit:
        return kept
    return staged(known(ev).orderBy(*newest).limit(limit), "audit-known")


#: Up to this many rows the audit log's lookups are sent to every executor; beyond, the planner shuffles them.
SMALL_ROWS = 10_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= 2 * SMALL_ROWS else df


def _wanted(top: DataFrame) -> DataFrame:
    return top.select(F.explode(F.array("actor_id", "cashier_id")).alias("w_uid")).filter(F.col("w_uid").isNotNull()).distinct()


def audit_log(orders: DataFrame, order_items: DataFrame, users: DataFrame,
              user_sessions: DataFrame, limit: int = AUDIT_LIMIT) -> DataFrame:
    """The newest ``limit`` events of all six kinds.

    The newest events of known users are found from narrow rows
    (``newest_known``). Only then are texts built: the units of just those
    orders and the names of just those users. The largest table,
    ``order_items``, is never aggregated in full for a 100-row report.

    Ties on the whole-second event time are broken by action type and then
    the order or session id, so the rows that survive the limit are fixed.
    """
    top = newest_known(orders, users, user_sessions, limit)
    want_o = top.filter(F.col("action_type").isin(*UNIT_KINDS)).select(F.col("source_id").alias("w_id")).distinct()
    items = order_items.join(_small(want_o, limit), order_items["order_id"] == want_o["w_id"], "left_semi")
    ic, cashier, names = _units(items), _cashier_names(users), _actor_names(users)
    wanted = _small(_wanted(top), 2 * limit)
    cashier = cashier.join(wanted, cashier["cashier_uid"] == F.col("w_uid"), "left_semi")
    names = names.join(wanted, names["uid"] == F.col("w_uid"), "left_semi")
    d = (top.join(_small(ic, limit), (top["source_id"] == ic["ic_order_id"]) & F.col("action_type").isin(*UNIT_KINDS), "left")
         .join(_small(cashier, limit), F.col("cashier_id") == cashier["cashier_uid"], "left")
         .join(_small(names, 2 * limit), F.col("actor_id") == names["uid"]))
    # At most ``limit`` rows: sort them in one partition, no range shuffle.
    return (_texts(d).coalesce(1).sortWithinPartitions(F.col("event_time").desc(), F.col("action_type"), F.col("source_id"))
            .drop("source_id"))
