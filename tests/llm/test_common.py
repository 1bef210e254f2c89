"""Steps that have run leave no shuffle files for the rest of a query."""

from __future__ import annotations

import gc

from pyspark.sql import functions as F

from calendra.llm import brown
from calendra.llm.common import cut

SF = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "/shuffle_" in name}


def test_cut_removes_its_shuffles(spark):
    before = shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    read = cut(rows)
    assert not shuffle_files(spark) - before
    assert read.count() == 700 and read.agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_training_of_classes_removes_its_shuffles(spark):
    gc.collect()
    before = shuffle_files(spark)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    counts, _, model = brown.train(texts, classes=8, core=60, head=100, rounds=2)
    assert not shuffle_files(spark) - before
    assert counts.agg(F.sum("c")).first()[0] == model.n
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
