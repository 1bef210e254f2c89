"""BPE with word ends against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calendra.llm import word_bpe
from calendra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary(open(PATH).read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_word_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids, decoded = expected(library, texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_random_texts_equal_library(vocabulary, library):
    draw = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|end", *"aAbBéÉǺ̧ \n\t\x0b\x0c\x1c\x85\xa0　ΑΣςİi'.s1٣中\U0001F600ᲉꟋ՘"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(5000)]
    texts += [f"a{chr(c)}b {chr(c)}1'{chr(c)}{chr(c)}'ll{chr(c)} Σ{chr(c)}" for c in range(0x80, 0x3000, 7)]
    for text in texts:
        ids, decoded = expected(library, text)
        packed = vocabulary.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert vocabulary.decode(packed) == decoded


def test_very_long_words(vocabulary, library):
    draw = random.Random(6)
    for text in ("ab" * 300_000, "".join(draw.choice("etaoinshrdlu") for _ in range(1_000_000)), "é" * 100_000, "?!" * 100_000):
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == expected(library, text)[0]


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    small = word_bpe.Vocabulary(open(PATH).read())
    text = "one two three four five six one two, (three) four! seven" * 3
    for _ in range(2):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == expected(library, text)[0]


def test_linked_merges_equal_plain_loop():
    draw = random.Random(7)
    for _ in range(300):
        merges, symbols = {}, draw.choices(range(4), k=draw.randrange(20))
        for rank in range(12):
            pair = draw.randrange(4 + rank) << 32 | draw.randrange(4 + rank)
            merges.setdefault(pair, (rank, 4 + rank))
        plain = [*symbols]
        while True:
            found = [(merges[p][0], i) for i in range(len(plain) - 1) if (p := plain[i] << 32 | plain[i + 1]) in merges]
            if not found:
                break
            rank, at = min(found)
            plain[at:at + 2] = [4 + rank]
        assert word_bpe.linked_merges(symbols, merges) == plain


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (3, "x" * 50_000), (4, " \t\n "), (5, "é ☂ \U0001F600 <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("x").alias("ids"), F.lit(1).alias("decoded"), F.lit("k").alias("a b"))
    out = word_bpe.decode(word_bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "a b", "ids", "n_tokens", "decoded"]
    for row in out.collect():
        ids, decoded = expected(library, row.text)
        assert (np.frombuffer(row.ids, "<u4").tolist(), row.n_tokens, row.decoded) == (ids, len(ids), decoded)
        assert row["a b"] == "k"
    assert out.count() == len(rows)
    assert word_bpe.decode(word_bpe.encode(df.filter("false"), PATH), PATH).count() == 0
    assert word_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().decoded == ""


def test_unusual_files_are_refused():
    spec = json.loads(open(PATH).read())
    for change in ({"dropout": 0.1}, {"byte_fallback": True}):
        with pytest.raises(ValueError):
            word_bpe.Vocabulary(json.dumps({**spec, "model": {**spec["model"], **change}}))
