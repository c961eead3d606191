from pairlab.session import checkpoint_dir, scale_conf


def test_scale_conf_bounds():
    c = scale_conf(100 * 2**40, 8000)
    assert c["spark.sql.shuffle.partitions"] == str(100 * 2**40 // (256 << 20))
    assert int(scale_conf(1 << 20, 64)["spark.sql.shuffle.partitions"]) == 192


def test_checkpoint_dir_is_read_from_session(spark):
    path = checkpoint_dir(spark)
    assert path == spark.conf.get("spark.checkpoint.dir")
