"""Containment by rare pieces and token overlap by frequency, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from calendra.operators import containment as C
from calendra.operators import overlap as O


def names(rng, count, alphabet="AB É", most=12):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(count)})


@pytest.mark.parametrize("alphabet", ["AB", "ABCDEFGH ", "VIAROM É𝕏"])
def test_holding_pairs_equal_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    left, right = names(rng, 150, alphabet), names(rng, 150, alphabet, 7)
    holders = spark.createDataFrame([(n,) for n in left * 2] + [(None,)], "holder string")
    needles = spark.createDataFrame([(n, i) for i, n in enumerate(right + right[:9])] + [(None, 0)], "needle string, x int")
    got = sorted(map(tuple, C.holding_pairs(holders, needles).collect()))
    assert got == sorted((a, b) for a in left for b in right if b and b in a)
    payloads = {n: i * 7 % 150 for i, n in enumerate(left)}
    held = spark.createDataFrame([(n, p) for n, p in payloads.items()] + [("ABABAB", None)], "holder string, key int")
    low = {r.needle: r.key for r in C.lowest_holder(needles, held, "needle", "holder", "key").collect()}
    want = {b: min(payloads[a] for a in left if b in a) for b in right if b and any(b in a for a in left)}
    assert low == want


def test_a_name_lists_a_row_a_place(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("ABCDEFGHIJKLMNOP ") for _ in range(40)) for _ in range(50)]
    rows = C.postings(spark.createDataFrame([(n,) for n in long], "n string"), "n").groupBy("n").count()
    assert rows.agg(F.max("count")).first()[0] <= 40


def test_a_needle_asks_for_its_rarest_piece(spark):
    holders = [f"VIALE {i}" for i in range(500)] + ["VIALE ROMA"]
    counts = C.postings(spark.createDataFrame([(n,) for n in holders], "n string"), "n").groupBy("_piece").agg(F.count("*").alias("_n"))
    asked = C.anchors(spark.createDataFrame([("VIALE ROMA",), ("VIALE TORINO",)], "n string"), "n", counts).collect()
    assert [r.n for r in asked] == ["VIALE ROMA"]
    assert counts.where(F.col("_piece") == asked[0]["_piece"]).first()["_n"] == 1


def score(common):
    return F.size(common) * 10 + F.when(F.exists(common, lambda t: F.length(t) >= 5), 5).otherwise(0)


def frame(spark, rows):
    data = [(n, n.split()[0], sorted(set(n.split())), k) for n, k in rows]
    return spark.createDataFrame(data, "n string, first string, tokens array<string>, key bigint")


def brute(left, right, min_common):
    out = {}
    for n, _ in left:
        best = None
        for r, key in right:
            common = set(n.split()) & set(r.split())
            if len(common) < min_common or n in r or r in n:
                continue
            points = 10 * len(common) + 5 * any(len(t) >= 5 for t in common) + 3 * (n.split()[0] == r.split()[0])
            best = max(best or (0, 0), (points, -key)) if best else (points, -key)
        if best:
            out[n] = (best[0], -best[1])
    return out


@pytest.mark.parametrize("frequent_from, held", [(1, 10), (5, 3), (5, 10), (40, 2), (10**6, 10)])
def test_overlap_equals_all_pairs(spark, frequent_from, held):
    rng = random.Random(frequent_from + held)
    common = ["ROMA", "PO", "NUOVA", "ALTA", "XX", "MARCONI", "SOPRA", "BASSA"]
    rare = [f"R{i}" for i in range(60)]

    def drawn(side):
        out = set()
        for i in range(70):
            size = rng.randrange(1, 16)
            tokens = [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(size)]
            out.add(" ".join([*tokens, f"{side}{i}"]))  # no name contains another
        return [(n, i) for i, n in enumerate(sorted(out))]

    left, right = drawn("L"), drawn("Q")
    for least in (1, 2):
        got = O.overlap_best(frame(spark, left).drop("key"), frame(spark, right), score, least, 3, held=held, frequent_from=frequent_from)
        assert {r.n: (r.score, r.key) for r in got.collect()} == brute(left, right, least)


def test_contained_pairs_never_win_by_overlap(spark):
    right = [("A B C D E F G H", 1), ("A B C D E F G Z", 2), ("A Y", 3)]
    left = [("A B C D E F G H I", 0)]
    many = [(f"{' '.join(n.split())} V{i}", 10 + i) for i in range(70) for n in ("Q R",)]
    got = O.overlap_best(frame(spark, left).drop("key"), frame(spark, right + many), lambda c: F.size(c) * 10, 2, held=6, frequent_from=2)
    assert [(r.score, r.key) for r in got.collect()] == [(70, 2)]


def test_a_token_in_all_names_makes_no_pairs(spark):
    def side(letter):
        ids = spark.range(20_000)
        own = F.concat(F.lit(letter), "id")
        return ids.select(
            F.concat(F.lit("VIA "), own).alias("n"), F.lit("VIA").alias("first"), F.array(F.lit("VIA"), own).alias("tokens"), F.col("id").alias("key"),
        )

    left, right = side("A").drop("key"), side("B")
    frequent = O.token_counts(right)
    lefts, rights = O.split_tokens(left, frequent), O.split_tokens(right, frequent)
    assert [r.t for r in frequent.collect()] == ["VIA"]
    assert O.listed_pairs(lefts, rights).count() == 0
    best = O.overlap_best(left, right, score, 1, 3)
    assert best.count() == 20_000
    assert best.select("score", "key").distinct().collect() == [(13, 0)]
