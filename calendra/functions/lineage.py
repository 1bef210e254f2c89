"""Cutting lineage for tables that several branches of one query read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _LOCAL[app]
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recompute."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as a shuffle has, before each of them becomes many.

    A small file is read in one task, which would do all the work of what is made of its rows.
    Grouping by these keys, and by more columns, needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
