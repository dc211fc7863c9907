from spanforge.session import spread


def test_only_a_table_in_few_partitions_is_spread(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(one, "id").rdd.getNumPartitions() > cores and spread(one, "id").count() == 100
    wide = spark.range(0, 100, 1, 8 * cores)
    assert spread(wide, "id") is wide
    shuffled = one.groupBy("id").count()
    assert spread(shuffled, "id") is shuffled
