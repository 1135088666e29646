"""The table store: bucket specs follow the layout, and a table is written once per application."""

from tillroll.sources import store


def test_bucketed_and_hashed_layouts(spark, tables):
    tables.orders, tables.order_items, tables.user_sessions          # make sure they are stored
    key = store._store_key(spark, tables.sf_dir)
    n = store.bucket_count(spark, tables.sf_dir, "order_items")
    detail = {r.col_name: r.data_type for r in
              spark.sql(f"DESCRIBE TABLE EXTENDED tillroll_{key}_order_items").collect()}
    assert detail.get("Num Buckets") == str(n)
    assert detail.get("Bucket Columns") == "[`order_id`]"
    # keyed by a user: hashed files, not a bucketed catalog table
    assert not spark.catalog.tableExists(f"tillroll_{key}_user_sessions")
    assert len(tables.user_sessions.inputFiles()) >= 1


def test_store_reuses_the_written_table(spark, tables):
    from tillroll.sources.fixtures import PosTables
    again = PosTables(spark, tables.sf_dir)
    assert again.orders is tables.orders            # same DataFrame: no second write, no second listing
