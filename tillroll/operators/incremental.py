"""Batch-to-batch forms of the write paths and the day history.

A till's day is one batch. Each form here keeps a small state between
batches and gives, after any cut of the input into batches, what the
operator of ``writes`` or ``insights`` gives for all of it at once:

* B02: a line's changes fold to one (reset, t, m) row per batch and line;
* B10: the sessions still open are carried into the next batch;
* U06: one row of sums per day, and bitmaps of the staff seen;
* B08: the order table lies in buckets, and only buckets with requests are written again.

A batch reads its own rows and the state they touch, never earlier batches' rows.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tillroll.functions.scalars import seconds_between
from tillroll.operators.insights import history_rows, order_days
from tillroll.operators.reports import ntz
from tillroll.operators.writes import apply_order_status, fold_parts, fold_sequence, lines_left, sessionize_logins, spread
from tillroll.sources.stage import staged


# ---- B02: changes of carts -----------------------------------------------------------------
def cart_summaries(cart_adds: DataFrame) -> DataFrame:
    """One batch of cart changes as (cart_id, cart_key, pos, reset, t, m), one row per line.

    ``pos`` is the batch's smallest ``seq``, the same in all its rows: it orders the batches, whenever they come in.
    """
    folded, first = fold_sequence(cart_adds)
    return folded.withColumn("pos", F.lit(first).cast("bigint"))


def fold_summaries(*batches: DataFrame) -> DataFrame:
    """Several batches' summaries as one, to keep in their place.

    The batches must be cut out of the changes at sequence numbers (no batch has changes between those of another) and
    be neighbours: a batch that lies between two folded ones can't be added any more. Their order of arrival does not matter.
    Summaries should be stored: their rows are counted first, so that no task sorts more than its share.
    """
    parts = batches[0]
    for b in batches[1:]:
        parts = parts.unionByName(b)
    parts = spread(parts, sum(b.count() for b in batches), "cart_id", "cart_key")  # both windows lie on the line's key
    return fold_parts(parts, F.min("pos").over(Window.partitionBy("cart_id", "cart_key")))


def summary_lines(*batches: DataFrame) -> DataFrame:
    """B02's lines after all batches, from their summaries alone."""
    return lines_left(fold_summaries(*batches))


# ---- B10: logins ---------------------------------------------------------------------------
def sessionize_batch(login_events: DataFrame, open_sessions: DataFrame) -> dict[str, DataFrame]:
    """B10 for the next batch of login events, given the sessions left open by the batches before.

    ``open_sessions`` has the columns of the result (its ``logged_out_at`` is not read). The batches are cut by time: no
    event may be earlier than one of a batch before, and equal times of a user go into one batch. A batch ends the carried
    session of each user whose first event it holds: at a logout's time, or with zero length at a login.

    Returns ``closed``, the sessions that this batch ended (final rows), and ``open``, the ones to carry on. Only carried
    sessions of users with events pass the sessionizing; the others are handed on as they are.
    """
    seen = login_events.select(F.col("user_id").alias("seen_user")).distinct()
    cols = ["id", "user_id", "logged_in_at", "logged_out_at"]
    carried = open_sessions.join(seen, F.col("user_id").eqNullSafe(F.col("seen_user")), "left_semi")
    idle = open_sessions.join(seen, F.col("user_id").eqNullSafe(F.col("seen_user")), "left_anti")
    as_logins = carried.select("id", "user_id", F.col("logged_in_at").alias("ts"), F.lit("login").alias("event_type"))
    now = staged(sessionize_logins(login_events.select("id", "user_id", "ts", "event_type").unionByName(as_logins)), "sessions")
    still = idle.select(*cols[:3], F.lit(None).cast(now.schema["logged_out_at"].dataType).alias("logged_out_at"))
    return {"closed": now.filter(F.col("logged_out_at").isNotNull()).select(*cols),
            "open": now.filter(F.col("logged_out_at").isNull()).select(*cols).unionByName(still)}


# ---- U06: day history ----------------------------------------------------------------------
@dataclasses.dataclass
class DayPartials:
    """What the day history needs of some rows, without the rows.

    ``orders``: sums per day. ``sessions``: per login day the seconds of ended sessions, and the number and summed login
    seconds of open ones, so that the report time is not fixed. ``staff``: per login day and range of 32 768 user ids, a
    bitmap of the users seen (4 kB; user ids are counted up by the application, so the ranges fill).
    """
    orders: DataFrame
    sessions: DataFrame
    staff: DataFrame

    def staged(self) -> "DayPartials":
        return DayPartials(staged(self.orders, "order-days"), staged(self.sessions, "session-days"), staged(self.staff, "staff-days"))

    def plus(self, other: "DayPartials") -> "DayPartials":
        """Both together, one row per day again (and per range of users)."""
        def summed(a: DataFrame, b: DataFrame) -> DataFrame:
            values = [c for c in a.columns if c != "day"]
            return a.unionByName(b).groupBy("day").agg(*[F.sum(c).cast(a.schema[c].dataType).alias(c) for c in values])
        staff = self.staff.unionByName(other.staff).groupBy("day", "users").agg(F.bitmap_or_agg("seen").alias("seen"))
        return DayPartials(summed(self.orders, other.orders), summed(self.sessions, other.sessions), staff)


_EPOCH = "1970-01-01 00:00:00"


def day_partials(orders: DataFrame, user_sessions: DataFrame) -> DayPartials:
    """The partials of some orders and sessions (each order and session in one batch only, see ``day_changes``)."""
    # Whole seconds, rounded up: a report's whole second less this is the time clocked, cut to whole seconds.
    start = F.ceil(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("logged_in_at")) / 1_000_000)
    is_open = F.col("logged_out_at").isNull()
    s = user_sessions.withColumn("day", F.to_date("logged_in_at"))
    sums = s.groupBy("day").agg(
        F.sum(F.when(is_open, 0).otherwise(seconds_between(F.col("logged_in_at"), F.col("logged_out_at")))).cast("bigint").alias("ended_seconds"),
        F.sum(F.when(is_open & F.col("logged_in_at").isNotNull(), 1).otherwise(0)).cast("bigint").alias("open_sessions"),
        F.sum(F.when(is_open, start).otherwise(0)).cast("bigint").alias("open_starts"))
    user = F.col("user_id").cast("bigint")
    staff = s.filter(user.isNotNull()).groupBy("day", F.bitmap_bucket_number(user).alias("users")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("seen"))
    return DayPartials(order_days(orders), sums, staff)


def day_changes(orders_before: DataFrame, orders_after: DataFrame, sessions_before: DataFrame, sessions_after: DataFrame) -> DayPartials:
    """The partials of a batch of changes: new rows are in the tables ``after`` only, changed ones in both, as they were
    and as they are. Sums of the old state are taken off again; days keep the staff they have seen, since a session
    never changes its user or login time.
    """
    old, new = day_partials(orders_before, sessions_before), day_partials(orders_after, sessions_after)

    def less(df: DataFrame) -> DataFrame:
        return df.select("day", *[(-F.col(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != "day"])
    return DayPartials(less(old.orders), less(old.sessions), old.staff).plus(new)


def orders_as_of(orders: DataFrame, cut: dt.datetime) -> DataFrame:
    """The orders as they stood before ``cut``, for history kept from then on: those made by then, with the status they had."""
    st, before = F.col("status"), ntz(cut)
    since = (F.when(st == "completed", F.col("completed_at")).when(st == "refunded", F.col("refunded_at"))
             .when(st == "voided", F.col("voided_at")))
    then = F.when(since < before, st).when(since.isNull(), st).when(F.col("completed_at") < before, "completed").otherwise("pending")
    return orders.filter(F.col("created_at") < before).withColumn("status", then)


def orders_changed_since(orders: DataFrame, cut: dt.datetime) -> DataFrame:
    """The orders that got a status at or after ``cut`` (a range filter the scan can skip files by)."""
    return orders.filter((F.col("completed_at") >= ntz(cut)) | (F.col("refunded_at") >= ntz(cut)) | (F.col("voided_at") >= ntz(cut)))


def sessions_as_of(user_sessions: DataFrame, cut: dt.datetime) -> DataFrame:
    """The sessions begun before ``cut``, open where they ended later."""
    out = F.col("logged_out_at")
    return user_sessions.filter(F.col("logged_in_at") < ntz(cut)).withColumn("logged_out_at", F.when(out < ntz(cut), out))


def sessions_changed_since(user_sessions: DataFrame, cut: dt.datetime) -> DataFrame:
    """The sessions begun or ended at or after ``cut``."""
    return user_sessions.filter((F.col("logged_in_at") >= ntz(cut)) | (F.col("logged_out_at") >= ntz(cut)))


def partials_history(partials: DayPartials, as_of: dt.datetime) -> DataFrame:
    """U06's rows from the partials alone.

    A day whose orders have all moved on to other days again counts as one without activity. ``as_of`` must not be
    before the login of an open session.
    """
    kept = [c for c in partials.orders.columns if c != "day"]
    active = F.lit(False)
    for c in kept:
        active = active | (F.col(c) != 0)
    now = seconds_between(F.lit(_EPOCH).cast("timestamp_ntz"), ntz(as_of))
    clocked = (F.col("ended_seconds") + F.col("open_sessions") * now - F.col("open_starts")).cast("bigint")
    staff = partials.staff.groupBy("day", "users").agg(F.bitmap_or_agg("seen").alias("seen")) \
        .groupBy(F.col("day").alias("u_day")).agg(F.sum(F.bitmap_count("seen")).cast("bigint").alias("staff_count"))
    sessions = partials.sessions.select(F.col("day").alias("c_day"), clocked.alias("seconds_clocked"))
    sd = sessions.join(staff, F.col("c_day").eqNullSafe(F.col("u_day")), "left").select(
        F.col("c_day").alias("s_day"), "seconds_clocked", F.coalesce("staff_count", F.lit(0)).cast("bigint").alias("staff_count"))
    return history_rows(partials.orders.filter(active), sd, as_of)


# ---- B08: order table in buckets --------------------------------------------------------------
def write_orders(orders: DataFrame, path: str, buckets: int) -> None:
    """Store an order table in ``buckets`` folders by the hash of the id, one file each (split by Spark's
    ``maxRecordsPerFile`` where that is set). One row beside them keeps the number of buckets and the schema."""
    _placed(orders, buckets).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    orders.sparkSession.createDataFrame([(buckets, orders.schema.json())], "buckets int, schema string") \
        .write.parquet(f"{path}/layout")


def _placed(orders: DataFrame, buckets: int) -> DataFrame:
    return orders.withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(buckets)).cast("int"))


def stored_orders(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The number of buckets, and the orders with their ``bucket`` (a filter on it opens those folders only)."""
    layout = spark.read.parquet(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(layout.schema)).add("bucket", IntegerType())
    return layout.buckets, spark.read.schema(schema).parquet(f"{path}/rows")


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return stored_orders(spark, path)[1].drop("bucket")


def apply_status_stored(spark: SparkSession, path: str, status_events: DataFrame, users: DataFrame) -> DataFrame:
    """B08 on a stored order table: returns the outcomes, and writes again only the buckets that hold requested orders.

    The touched bucket numbers (at most as many as there are buckets) pass the driver, so the scan opens their folders
    only. The outcomes and the new rows are staged before any bucket is replaced. A run that is lost while buckets are being
    replaced is mended by running it again: B08 leaves an order alone that already has its requests applied.
    """
    buckets, stored = stored_orders(spark, path)
    requested = _placed(status_events.select(F.col("order_id").alias("id")).filter(F.col("id").isNotNull()), buckets)
    touched = [r.bucket for r in requested.select("bucket").distinct().collect()]
    result = apply_order_status(stored.filter(F.col("bucket").isin(touched)).drop("bucket"), status_events, users)
    outcomes = staged(result["outcomes"], "outcomes")
    changed = staged(result["orders"], "orders")
    _placed(changed, buckets).repartition(max(1, len(touched)), "bucket").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    return outcomes
