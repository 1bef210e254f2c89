"""Change logs that stay short: a folded base, a pointer to it, and the batches after it.

A log has a folder ``batch=N`` for each micro-batch. Folding writes what batches up to N say
into ``base/batch=N`` and then, as the last step, creates the empty file ``pointer=N``;
readers take the base of the highest pointer and the batches after it. A crash before the
pointer leaves the old base and all batches in force. Folders that no reader needs any more
are removed one folding later, so a listing meets a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Batches after the base from which a log is folded.
FOLD_FROM = 48


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers N of the entries ``kind=N`` of a folder, ascending; none if it is missing."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    names = [str(entry.getPath().getName()) for entry in fs.listStatus(at)]
    return sorted(int(name.removeprefix(f"{kind}=")) for name in names if name.startswith(f"{kind}="))


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def pointers(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, path, "pointer")


def folders(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, list[int]]:
    """The base to read and the batches after it, as of the start of batch ``before`` (now)."""
    known = [n for n in pointers(spark, path) if before is None or n < before]
    base = known[-1] if known else None
    tail = [n for n in _numbers(spark, path, "batch") if (base is None or n > base) and (before is None or n < before)]
    return base, tail


def read_log(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of the base and the later batches, with the number of their ``batch``; empty before the first."""
    full = f"{schema}, batch bigint"
    base, tail = folders(spark, path, before)
    parts = [(f"{path}/base", [base])] if base is not None else []
    parts += [(path, tail)] if tail else []
    out = None
    for root, numbers in parts:
        rows = spark.read.option("basePath", root).schema(full).parquet(*[f"{root}/batch={n}" for n in numbers])
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], full) if out is None else out


def fold(spark: SparkSession, path: str, schema: str, folded: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Fold the batches up to ``upto``: ``folded`` maps the log's rows to those that say the same."""
    write_base(read_log(spark, path, schema, before=upto + 1), path, schema, folded, upto)
    point_to(spark, path, upto)
    clean(spark, path)


def write_base(rows: DataFrame, path: str, schema: str, folded: Callable[[DataFrame], DataFrame], upto: int) -> None:
    names = [part.split()[0] for part in schema.split(", ")]
    folded(rows).select(*names).write.mode("overwrite").parquet(f"{path}/base/batch={upto}")


def point_to(spark: SparkSession, path: str, upto: int) -> None:
    """The switch: from now on readers take this base."""
    fs, at = _path(spark, f"{path}/pointer={upto}")
    fs.create(at, True).close()


def clean(spark: SparkSession, path: str) -> None:
    """Remove what lies before the last but one base, which running readers may still use."""
    known = pointers(spark, path)
    if len(known) < 2:
        return
    oldest = known[-2]
    for number in _numbers(spark, path, "batch"):
        if number <= oldest:
            _remove(spark, f"{path}/batch={number}")
    for number in _numbers(spark, f"{path}/base", "batch"):
        if number < oldest:
            _remove(spark, f"{path}/base/batch={number}")
    for number in known[:-2]:
        _remove(spark, f"{path}/pointer={number}")


def fold_if_long(
    spark: SparkSession, path: str, schema: str, folded: Callable[[DataFrame], DataFrame], before: int, fold_from: int = FOLD_FROM,
) -> None:
    """Fold the batches before ``before`` where many have come since the base."""
    tail = folders(spark, path, before)[1]
    if len(tail) >= fold_from:
        fold(spark, path, schema, folded, tail[-1])
