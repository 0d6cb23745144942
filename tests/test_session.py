"""Sizing, scratch paths and lineage cuts."""

import os
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from ledger_spark import session as S
from ledger_spark.sources import sinks


def test_sizes():
    small, huge = S.sized_for(20 * 2**20, 8), S.sized_for(100 * 2**40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "24"
    assert int(huge["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (128 * 2**20)
    assert huge["spark.sql.files.maxPartitionBytes"] == str(128 * 2**20)


def test_written_table_cuts_lineage(spark):
    df = S.written(spark.range(10).withColumn("x", F.col("id") * 2), "cut")
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_fact_and_key_lookup(spark, tmp_path):
    path = str(tmp_path / "fact")
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("period_label"))
    sinks.write_fact(df, path, "period_label")
    incoming = df.where("period_label = '1'")
    held = sinks.held_keys(spark, path, df.schema, incoming, ["id", "period_label"], "period_label")
    assert held.count() == incoming.count()
    everything = sinks.held_keys(spark, path, df.schema, df, ["id"], "period_label")
    assert everything.count() == 1000


def test_scratch_needs_a_shared_folder_off_local_mode():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.scratch_path(Session(), "x")


def test_written_tables_leave_no_shuffle_files_and_can_be_dropped(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = shuffles()
    table = S.written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "a b")
    assert not shuffles() - before
    assert spark.conf.get(S._CLEANUP) == "false" and table.count() == 10
    folder = os.path.dirname(unquote(urlparse(table.inputFiles()[0]).path))
    S.dropped(table.select("k"))
    assert not os.path.exists(folder) and os.path.exists(os.path.dirname(folder))
