"""The registered queries of this package: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.llm import (
    brown, byte_bpe, chat, chunk_dedup, importance, jaccard_join, license_scan, mixing, quality, secret_scan, spotsigs, turn_repair,
    word_bpe,
)
from calendra.llm.common import cut, documents, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _joined_labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


@_register("op1_license_scan")
def license_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = license_scan.scan(documents(spark, sf).select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["phrase"].isin(*license_scan.BASE) & (m["edits"] == 0))
    sizes = [(F.lit(p), len(p)) for p in license_scan.NOTICES]
    length = F.create_map(*[x for p, n in sizes for x in (p, F.lit(n))])
    likeness = F.transform("matches", lambda m: 1 - m["edits"] / F.element_at(length, m["phrase"]))
    return docs.withColumn("base", base).select(
        "doc_id", "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda m: m["word"])).alias("last_word"),
        _joined_labels(F.col("base")).alias("base_labels"),
        _joined_labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"])), ","
        ).alias("spans"),
    )


@_register("op2_quality_rules")
def quality_query(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf).select("doc_id", "lang", "text"))
    return judged.select("doc_id", *quality.MEASURES, "class_distance", "word_distance", "base_failed", "kept")


def _bpe(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.decode(cut(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])), path)


@_register("op10_byte_bpe")
def bpe_query(spark: SparkSession, sf: str) -> DataFrame:
    return _bpe(documents(spark, sf).select("doc_id", "text")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_register("op4_mix_sources", mixing.ORACLE)
def mix_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix(sized, sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
    )


@_register("op5_spotsigs")
def spotsigs_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = spotsigs.with_next(docs).withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    prints = pairs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *[spotsigs.fingerprint(F.col(c)).alias(f) for c, f in (("text", "own"), ("edited", "other"), ("next_text", "next"))],
    )
    return prints.select(
        "doc_id", "n_chars", "edited_sha256",
        spotsigs.as_text(F.col("own")).alias("fingerprint"), spotsigs.as_text(F.col("other")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        spotsigs.likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


@_register("op7_secret_scan")
def secret_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.samples(docs)))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@_register("op8_jaccard_join")
def jaccard_query(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf).select("doc_id", "text"))


@_register("op9_chunk_dedup")
def chunk_query(spark: SparkSession, sf: str) -> DataFrame:
    spans = chunk_dedup.repeated_spans(documents(spark, sf).select("doc_id", "text"))
    return spans.select("doc_id", "start", "end", "words", "chunks", "copies", "first_doc_id", "kept")


@_register("op3_brown_classes")
def brown_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    counts, words, model = brown.train(docs.filter(brown.is_training(F.col("doc_id"))).select("text"))
    return brown.score(docs, counts, words, model).select(
        "doc_id", (~brown.is_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


@_register("op6_chat_parts")
def chat_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return chat.read_back(chat.format_turns(chat.text_parts(turns.unionByName(more))))


@_register("op12_word_bpe")
def word_bpe_query(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = word_bpe.encode(documents(spark, sf).select("doc_id", "text"), path)
    return word_bpe.decode(encoded.select("doc_id", "ids", "n_tokens"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_register("op13_importance", importance.ORACLE)
def importance_query(spark: SparkSession, sf: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf).select("doc_id", "text"), documents(spark, sf, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@_register("op11_turn_repair", turn_repair.ORACLE)
def repair_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = turn_repair.ordered(turn_repair.damaged(turns))
    marked = cut(turn_repair.faults(rows))
    return turn_repair.report(turns, rows, marked, turn_repair.plan(marked))
