"""A corpus pipeline out of the package's operators, stage by stage.

Every stage takes tables with repeated rows, null or equal ids, null, empty and very long
texts, and columns beyond ``COLUMNS``, which it leaves out; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions.lineage import shared_folder
from calendra.llm import byte_bpe, jaccard_join, mixing, quality, secret_scan
from calendra.llm.common import cut, documents, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without a text or with too few words go."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id.

    Rows of equal id and text are copies; documents without words are linked with nothing.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mask in place of each secret; null texts stay null.

    ``n_chars`` is counted anew where something was masked.
    """
    found = secret_scan.scan(docs.select(*COLUMNS), secret_scan.train(secret_scan.samples(docs)))
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    masked = found.withColumn("text", text)
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is a source, rows of one id go together."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(docs.select(*COLUMNS), sized)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = cut(byte_bpe.encode(docs.select(*COLUMNS), path, public_tokenizers.PATTERN, keep=["doc_id", "source"]))
    return byte_bpe.decode(encoded, path).select(
        "doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Several stages train on the corpus; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
