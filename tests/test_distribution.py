from __future__ import annotations

import math
import random
import statistics

from pyspark.sql import functions as F

from calendra.operators import distribution as D
from calendra.operators import kpi as K


def frame(spark, values, group="g"):
    return spark.createDataFrame([(group, float(v)) for v in values], "grp string, v double")


def test_index_quantile_is_floor_of_n_minus_one(spark):
    dist = D.distribution(frame(spark, range(1, 13)), ["grp"], "v")
    row = D.summary(dist, ["grp"]).first()
    assert (row.n, row.p90, row.p10, row.median, row["mean"]) == (12, 10.0, 2.0, 6.5, 6.5)


def test_all_rules_against_sorted_lists(spark):
    rng = random.Random(7)
    data = {g: [round(rng.uniform(-50, 5000), 2) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 997))}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "grp string, v double")
    picks = [D.at_index(D.half_even_index(p / 100)).alias(f"p{p}") for p in (5, 25, 75)]
    breaks = [D.at_index(D.break_index(i, 4)).alias(f"b{i}") for i in (1, 2, 3)]
    out = D.distribution(df, ["grp"], "v").groupBy("grp").agg(*picks, *breaks, D.median_agg().alias("m"))
    for row in out.collect():
        s = sorted(data[row.grp])
        n = len(s)
        for p in (5, 25, 75):
            assert row[f"p{p}"] == s[round(p / 100 * (n - 1))]
        for i in (1, 2, 3):
            assert row[f"b{i}"] == s[min(math.floor(n * i / 4), n - 1)]
        assert math.isclose(row.m, statistics.median(s))


def test_one_hot_group_and_value_stay_whole(spark):
    hot = spark.range(30_000).select(F.lit("hot").alias("grp"), (F.col("id") % 3 * 1.0).alias("v"))
    rest = spark.range(10).select(F.lit("cold").alias("grp"), F.col("id").cast("double").alias("v"))
    out = {r.grp: r for r in D.summary(D.distribution(hot.union(rest), ["grp"], "v"), ["grp"]).collect()}
    assert out["hot"].n == 30_000 and out["hot"].median == 1.0
    assert out["cold"].n == 10 and out["cold"].median == 4.5


def test_percentile_rank_counts_strictly_below_in_another_set(spark):
    ref = frame(spark, [1, 2, 2, 3])
    rec = frame(spark, [0, 2, 2.5, 9])
    out = {r.v: r.p for r in D.percentile_rank(rec, ref, ["grp"], "v", "p").collect()}
    assert out == {0.0: 0.0, 2.0: 25.0, 2.5: 75.0, 9.0: 100.0}
    better = {r.v: r.p for r in D.percentile_rank(rec, ref, ["grp"], "v", "p", lower_is_better=True).collect()}
    assert better == {0.0: 100.0, 2.0: 25.0, 2.5: 25.0, 9.0: 0.0}


def test_empty_reference_ranks_as_zero(spark):
    out = D.percentile_rank(frame(spark, [5]), frame(spark, []), ["grp"], "v", "p").first()
    assert out.p == 0.0


def test_repeated_edges_are_bumped(spark):
    dist = D.distribution(frame(spark, [100] * 9 + [200]), ["grp"], "v", digits=0)
    assert D.quantile_edges(dist, ["grp"], 4).first().edges == [100, 101, 102]


def test_population_bands_are_disjoint_and_cover(spark):
    units = spark.range(1, 400).select(
        F.lit(2024).alias("year"), F.col("id"), (F.col("id") * F.col("id")).alias("pop"),
        (F.col("id") % 100 * 1.0).alias("rd_pct"), F.lit(1.5).alias("cost"),
    )
    bands = sorted(K.population_clusters(units, ["year"]).collect(), key=lambda r: r.ordinal)
    assert [b.cluster for b in bands] == ["p0", "p1", "p2", "p3"]
    assert bands[0].lo == 0 and bands[-1].hi is None
    assert all(a.hi + 1 == b.lo for a, b in zip(bands, bands[1:]))
    assert sum(b.rd_n for b in bands) == 399


def test_no_bands_with_fewer_units_than_clusters(spark):
    units = spark.createDataFrame([(2024, 1, 10, 50.0, 1.0)], "year int, id int, pop bigint, rd_pct double, cost double")
    assert K.population_clusters(units, ["year"]).count() == 0


def test_headline_and_bands(spark):
    df = spark.createDataFrame([(70.0, 95.0), (60.0, 40.0), (66.5, 50.0)], "rd double, p double")
    keys = [r.k for r in df.select(D.headline(F.col("rd"), F.col("p"))["key"].alias("k")).collect()]
    assert keys == ["top_pctile", "below_target", "target_met"]
    bands = [r.b for r in df.select(D.rank_band(F.col("p"), F.lit(7000)).alias("b")).collect()]
    assert bands == ["top-500", "lower-half", "upper-half"]
