"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from calendra.llm import importance
from calendra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def features(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, targets, buckets=10_000, longest=1, seed=2024, share=(10, 100), least=20):
    """(doc_id, n_words, n_features, weight, score, rank) of each of ``docs``, (doc_id, text) pairs."""
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, text in docs for g in features(text, longest)[1])
    t = Counter(bucket(g) for text in targets for g in features(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, grams = features(text, longest)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, grams)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:len(able) * share[0] // share[1]], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=repr)


def as_tuples(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_query_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    want = plain(docs, [r.text for r in read(spark, "benchmark").collect()])
    got = QUERIES["op13_importance"](spark, SF)
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in got.schema] == [
        "doc_id:bigint", "n_features:bigint", "weight:bigint", "score:bigint", "rank:bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in want), key=repr)


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_runs_in_small_blocks(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "BLOCK", 7)
    texts = ["A b, a-B a", "x", "", None, "é É 1 2\x001 2", "b a b a " * 20, "_", "a"]
    words = importance.Words(texts)
    got = Counter()
    for starts, ends, text in words.grams(longest):
        table = importance.GramTable(words.buffer, starts, ends, 97)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            gram = words.buffer[a:b].tobytes()
            assert table.bucket[table.slots[i]] == zlib.crc32(gram) % 97
            got[int(text[i]), gram.decode()] += 1
    assert got == Counter((i, g) for i, text in enumerate(texts) for g in features(text, longest)[1])
    docs = [(i, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    aims = spark.createDataFrame([("a b a",), (None,)], "text string")
    out = importance.resample(df, aims, buckets=97, longest=longest, share=(1, 2), least=1, seed=7)
    assert as_tuples(out) == plain(docs, ["a b a", None], 97, longest, 7, (1, 2), 1)


def test_equal_keys_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda raw: 2**64 - 1 if len(raw) < 4 else 5)
    draw = random.Random(3)
    text = " ".join(draw.choice(["ab", "ba", "abc", "abd", "wxyz", "wxyy", "longer"]) for _ in range(500))
    words = importance.Words([text])
    (starts, ends, _), = words.grams(1)
    table = importance.GramTable(words.buffer, starts, ends, 1 << 32)
    want = Counter(text.split())
    assert Counter(table.count[table.count > 0].tolist()) == Counter(want.values())
    assert [table.bucket[s] for s in table.slots] == [zlib.crc32(w.encode()) for w in text.split()]


def test_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "BYTES", 100)
    rows = [(None, "one two three"), (None, "one two three"), (1, None), (2, ""), (2, "one two"), (3, "word " * 300_000), (4, "!?"), (5, "a b c")]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string").select("*", *[F.lit("x").alias(c) for c in ("rank", "n_words", "_row", "score")])
    aims = spark.createDataFrame([(1, "one word")], "item_id bigint, text string")
    out = importance.resample(df, aims, share=(60, 100), least=1)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = as_tuples(out)
    want = plain(rows * 3, ["one word"], share=(60, 100), least=1)
    assert got == want
    ranks = [r[5] for r in got if r[5] is not None]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    assert as_tuples(importance.resample(df.filter("doc_id is null"), aims, least=0)) == plain([(None, "one two three")] * 6, ["one word"], least=0)
    assert importance.resample(df.filter("false"), aims).count() == 0
    assert as_tuples(importance.resample(df, aims.filter("false"))) == plain(rows * 3, [])


def test_draw_leans_towards_targets(spark):
    draw = random.Random(1)
    near = [(i, " ".join(draw.choices("alpha beta gamma delta".split(), k=40))) for i in range(50)]
    far = [(100 + i, " ".join(draw.choices("one two three four five".split(), k=40))) for i in range(450)]
    df = spark.createDataFrame(near + far, "doc_id bigint, text string")
    aims = spark.createDataFrame([("alpha beta gamma delta " * 5,)], "text string")
    drawn = {r.doc_id for r in importance.resample(df, aims).filter("rank is not null").collect()}
    assert drawn == {i for i, _ in near}


def test_gains_and_noise():
    assert importance.gains(np.array([0, 9]), np.array([9, 0])).tolist() == [math.floor(1000 * math.log(10 * 11 / 11)), math.floor(1000 * math.log(11 / (10 * 11)))]
    assert importance.noise(None, 2024) == importance.noise("", 2024)
