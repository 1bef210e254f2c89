"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside remove their shuffle files as soon as they have run.

    Otherwise these files stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared folder and read again.

    Unlike a checkpoint this computes the rows once, and small tables come back in few files.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ddl(df: DataFrame, without: Iterable[str] = ()) -> str:
    """The frame's columns as a schema string."""
    drop = set(without)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input that an operator is about to write."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def lower_bytes(text) -> bytes:
    """UTF-8 with A-Z in lower case; null: empty. ``split()`` of it cuts at 0x20, 0x09-0x0D."""
    return text.encode().lower() if isinstance(text, str) else b""


def word_count(text: Column) -> Column:
    """Number of words of ``WORD``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def has_repeats(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether a key stands in more than one row; only the keys are read."""
    return not docs.groupBy(key).count().filter("count > 1").isEmpty()
