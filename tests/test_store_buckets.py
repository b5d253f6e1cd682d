import glob

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import SnapshotStore


@pytest.fixture
def small_parts(spark):
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "64KB")
    yield
    spark.conf.unset(conf)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, small_parts):
    s = SnapshotStore(spark, str(tmp_path), 2)
    rows = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("value"))
    s.commit("t", rows)
    assert all(len(glob.glob(f"{b}/*.parquet")) > 1 for b in glob.glob(f"{tmp_path}/t/data/0/__bucket=*"))
    assert sorted(s.read("t").collect()) == sorted(rows.collect())


def test_a_rebuilt_large_bucket_is_written_by_several_tasks(spark, tmp_path, small_parts):
    s = SnapshotStore(spark, str(tmp_path), 2)
    rows = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("value"))
    s.commit("t", rows)
    s.replace("t", rows.where("id % 1000 = 0").withColumn("value", F.lit("new")))
    assert all(len(glob.glob(f"{b}/*.parquet")) > 1 for b in glob.glob(f"{tmp_path}/t/data/1/__bucket=*"))
    want = {r.id: "new" if int(r.id) % 1000 == 0 else r.value for r in rows.collect()}
    assert {r.id: r.value for r in s.read("t").collect()} == want


def test_a_large_bucket_of_one_task_is_written_by_several(spark, tmp_path, small_parts):
    s = SnapshotStore(spark, str(tmp_path), 2)
    rows = spark.range(0, 8000, 1, 1).select(F.col("id").cast("string").alias("id"), F.concat(*(F.sha2(F.concat("id", F.lit(f" {k}")), 512) for k in range(10))).alias("value"))
    s.commit("t", rows)
    assert all(len(glob.glob(f"{b}/*.parquet")) > 1 for b in glob.glob(f"{tmp_path}/t/data/0/__bucket=*"))
    assert sorted(s.read("t").collect()) == sorted(rows.collect())
