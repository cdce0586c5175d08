from tessera.session import checkpoint_dir, materialize, scale_conf, scratch_job


def test_scale_conf_bounds():
    big = scale_conf(100 * 10**12)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(scale_conf(10**9)["spark.sql.shuffle.partitions"]) == 200


def test_scratch_job_removes_what_it_wrote(spark):
    with scratch_job(spark):
        written = materialize(spark.range(3))
        path = written.inputFiles()[0]
        assert written.count() == 3
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    assert materialize(spark.range(2)).count() == 2


def test_checkpoint_dir_is_read_from_session(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
