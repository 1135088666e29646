"""Derived timestamps do not move with the session time zone (all NTZ)."""

from pyspark.sql import functions as F

from tillroll.sources.fixtures import PosTables

SMALL = "/root/testdata/sf0.001"


def _stamps(spark):
    t = PosTables(spark, SMALL, store=False)
    o = t.orders.agg(F.min("created_at"), F.max("refunded_at")).first()
    s = t.user_sessions.agg(F.min("logged_in_at"), F.max("logged_out_at")).first()
    u = t.users.agg(F.max("created_at")).first()
    return tuple(o) + tuple(s) + tuple(u)


def test_fixture_timestamps_ignore_session_time_zone(spark):
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "UTC")
        utc = _stamps(spark)
        spark.conf.set(key, "America/New_York")
        ny = _stamps(spark)
    finally:
        spark.conf.set(key, old)
    assert utc == ny
    assert utc[0].isoformat() == "2024-01-01T00:00:00" or utc[0].year == 2024
