"""Stored point-of-sale tables: written once, laid out for their joins.

A point-of-sale application keeps its tables stored; only the tests derive
them. Each derived table is written once per Spark application to the
session's checkpoint folder (the cluster's shared folder) and read back.

Layout, per table (``LAYOUT``):

* ``bucket``: bucketed on a key whose groups are bounded by what one till
  can ring up -- the order id for orders, their lines, payments and status
  requests; the cart id for carts and cart lines; the product id for the
  menu tables. ``order_items`` grouped by ``order_id`` and joined to
  ``orders.id`` then plans with no Exchange. All bucketed tables of one
  store share one bucket count, so any two of them co-locate.
* ``files``: hashed into evenly sized files on the row's own unique id.
  Used for everything keyed by a user, a cashier or a request sequence:
  one busy user may own a third of all sessions, and bucketing on the user
  would pin that third to one task and hide it from AQE's skew handling.
  These tables shuffle on their real keys, after map-side aggregation, and
  the operators split hot groups themselves (time buckets, seq ranges).

The bucket / file count of a table follows the bytes of the source files it
is derived from (``SOURCES``; about 16 MB each, some hundred MB as sorted
rows, at least the default parallelism up to 32, at most Spark's bucket
limit), so a task that writes or joins one bucket needs the same memory
at every size. The menu tables follow the lines, which are dealt into their
buckets to meet them. Tables that join on a bucket key have the
same sources' count. Each bucket is one file, sorted on its natural order.
Stored tables live under ``<checkpoint dir>/tillroll-tables/<app>/<files>/``:
one application never reads another's half-written files, and a folder
whose files change (names, sizes or times) gets new stored tables.
``drop_tables`` deletes all of an application's stored tables.
"""

from __future__ import annotations

import hashlib
import math
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir
from tillroll.sources.parquet import table_path

# table -> (layout, key column, sort columns)
LAYOUT: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "users": ("files", "id", ("id",)),
    "categories": ("files", "id", ("id",)),
    "products": ("bucket", "id", ("id",)),
    "product_sizes": ("bucket", "product_id", ("product_id", "id")),
    "product_addons": ("bucket", "product_id", ("product_id", "id")),
    "orders": ("bucket", "id", ("id",)),
    "lines": ("bucket", "order_id", ("order_id", "id")),
    "order_items": ("bucket", "order_id", ("order_id", "id")),
    "order_item_addons": ("files", "id", ("order_item_id", "id")),
    "payments": ("bucket", "order_id", ("order_id",)),
    "status_events": ("bucket", "order_id", ("order_id", "seq")),
    "user_sessions": ("files", "id", ("logged_in_at", "id")),
    "login_events": ("files", "id", ("ts", "id")),
    "registrations": ("files", "id", ("id",)),
    "registration_requests": ("files", "registration_id", ("registration_id",)),
    "signups": ("files", "id", ("id",)),
    "staff_updates": ("files", "seq", ("seq",)),
    "availability_updates": ("files", "seq", ("seq",)),
    "image_updates": ("files", "seq", ("seq",)),
    "carts": ("bucket", "cart_id", ("cart_id",)),
    "cart_lines": ("bucket", "cart_id", ("cart_id", "line_id")),
    "cart_adds": ("files", "seq", ("seq",)),
    "held_carts": ("files", "holder_id", ("holder_id",)),
}
TRANSIENT = {"orders_base"}          # only an intermediate of ``orders``

# table -> the source table whose size it follows
SOURCES: dict[str, str] = {
    "users": "customer", "categories": "part", "products": "lineitem", "product_sizes": "lineitem", "product_addons": "lineitem",
    "orders": "lineitem", "lines": "lineitem", "order_items": "lineitem", "order_item_addons": "lineitem",
    "payments": "lineitem", "status_events": "lineitem", "carts": "lineitem", "cart_lines": "lineitem",
    "cart_adds": "lineitem", "held_carts": "lineitem", "user_sessions": "events", "login_events": "events",
    "staff_updates": "events", "availability_updates": "events", "image_updates": "events",
    "registrations": "supplier", "registration_requests": "supplier", "signups": "supplier",
}

BYTES_PER_BUCKET = 16 << 20
MAX_BUCKETS = 100_000
_WRITTEN: set[tuple[str, str]] = set()
_FRAMES: dict[tuple[str, str], DataFrame] = {}   # read once per application
# First use writes the table; queries built from several threads must not
# write the same path at once. Re-entrant: building one table may store another.
_LOCK = threading.RLock()


def _source_files(spark: SparkSession, sf_dir: str, source: str) -> tuple[int, str]:
    """Bytes of a source table and a digest of its files' names, sizes and times (one listing, no data read)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, source))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0, "none"
    summary = fs.getContentSummary(path)
    times, it = [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        times.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return summary.getLength(), hashlib.sha1("\n".join(sorted(times)).encode()).hexdigest()


def _store_key(spark: SparkSession, sf_dir: str) -> str:
    app = spark.sparkContext.applicationId
    state = [_source_files(spark, sf_dir, source)[1] for source in sorted(set(SOURCES.values()) | {"orders"})]
    return hashlib.sha1("|".join([app, sf_dir, *state]).encode()).hexdigest()[:12]


def bucket_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One bucket per ~16 MB of the table's source, floored at the default
    parallelism (capped to 32) so small inputs still scan in parallel."""
    total = _source_files(spark, sf_dir, SOURCES[name])[0]
    floor = max(1, min(spark.sparkContext.defaultParallelism, 32))
    return int(min(MAX_BUCKETS, max(floor, math.ceil(total / BYTES_PER_BUCKET))))


def drop_tables(spark: SparkSession) -> None:
    """Delete the stored tables of this application and their catalog entries."""
    with _LOCK:
        for t in spark.catalog.listTables():
            if t.name.startswith("tillroll_"):
                spark.sql(f"DROP TABLE IF EXISTS {t.name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _FRAMES.clear()
        _WRITTEN.clear()


def _root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-tables/{spark.sparkContext.applicationId}"


def stored_table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored copy of table ``name`` (written on first use)."""
    if name in TRANSIENT:
        return build()
    key = _store_key(spark, sf_dir)
    with _LOCK:
        if (key, name) not in _FRAMES:
            _FRAMES[(key, name)] = _stored(spark, sf_dir, key, name, build)
        return _FRAMES[(key, name)]


def _stored(spark: SparkSession, sf_dir: str, key: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = f"{_root(spark)}/{key}/{name}"
    mode, col, sort = LAYOUT[name]
    n = bucket_count(spark, sf_dir, name)
    if mode == "files":
        if (key, name) not in _WRITTEN:
            (build().repartition(n, F.col(col)).sortWithinPartitions(*sort)
             .write.mode("overwrite").parquet(path))
            _WRITTEN.add((key, name))
        return spark.read.parquet(path)
    table = f"tillroll_{key}_{name}"
    if not spark.catalog.tableExists(table):
        (build().repartition(n, F.col(col)).write.mode("overwrite").format("parquet")
         .option("path", path).bucketBy(n, col).sortBy(*sort).saveAsTable(table))
    return spark.table(table)
