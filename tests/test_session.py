"""Session helpers: cluster sizing and the checkpoint folder."""

from tillroll.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_sizes_partitions_from_input_and_cores():
    big = cluster_conf(100 * 2**40, executors=1000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    small = cluster_conf(10 << 20, executors=2, cores_per_executor=4)
    assert small["spark.sql.shuffle.partitions"] == "16"          # two per core when the input is small
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_checkpoint_dir_is_read_from_the_session(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and ensure_checkpoint_dir(spark) == path          # set once, then reused
