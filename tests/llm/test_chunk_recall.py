"""How much of what stands in two documents the chunk operator finds, by brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from calendra.llm import chunk_dedup
from calendra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WINDOW = 50


def test_common_windows_are_covered(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    windows = defaultdict(set)
    places = defaultdict(list)
    for doc_id, text in texts.items():
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for i in range(len(spans) - WINDOW + 1):
            start, end = spans[i][0], spans[i + WINDOW - 1][1]
            windows[text[start:end]].add(doc_id)
            places[doc_id].append((start, end))
    found = defaultdict(list)
    for r in QUERIES["op9_chunk_dedup"](spark, SF).collect():
        found[r.doc_id].append((r.start, r.end))

    def covered(doc_id, start, end):
        at = start
        for a, b in sorted(found[doc_id]):
            if a <= at < b:
                at = b
        return at >= end

    common = [(d, a, b) for d, own in places.items() for a, b in own if len(windows[texts[d][a:b]]) > 1]
    hit = sum(covered(*c) for c in common)
    assert len(common) > 1000
    assert hit >= 0.99 * len(common), (hit, len(common))


def test_chunks_are_shuffled_once_and_frequent_ones_spread(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(0).cast("bigint").alias("version"))
    plain = chunk_dedup.repeated_chunks(docs, np.empty(0, np.int64))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    often = chunk_dedup.frequent_chunks(docs, often=3)
    assert len(often) > 10 and (np.diff(often) > 0).all()
    salted = chunk_dedup.chunks(docs, often).filter("salt > 0")
    assert salted.select("salt").distinct().count() > 10
    spread = chunk_dedup.repeated_chunks(docs, often)
    assert plain.count() == spread.count() > 100
    assert plain.exceptAll(spread).count() == 0
