from __future__ import annotations

import random

from pyspark.sql import functions as F

from calendra.operators import geo as G
from calendra.operators import layout as L
from calendra.operators import scans as S


def sequence(spark, n=500, seed=3):
    """One hot key with most rows and two small ones."""
    rng = random.Random(seed)
    rows = []
    for key, size in (("hot", n), ("b", 7), ("c", 1)):
        pos = 0
        for _ in range(size):
            pos += rng.choice([1, 1, 2, 40])
            rows.append((key, pos, rng.choice([None, rng.randint(0, 9)]), rng.randint(-5, 5)))
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v int, d int")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


def test_scans_across_buckets_match_a_plain_loop(spark):
    rows, df = sequence(spark)
    bucket = F.floor(F.col("pos") / 16)
    carried = {(r.k, r.pos): r.last for r in S.carry_last(df, ["k"], ["pos"], "v", bucket, "last").collect()}
    before = {(r.k, r.pos): r.prev for r in S.previous_row(df, ["k"], ["pos"], ["d"], bucket).collect()}
    sums = {(r.k, r.pos): r.total for r in S.running_sum(df, ["k"], ["pos"], {"d": "total"}, bucket).collect()}
    runs = {(r.k, r.pos): r.run for r in S.gap_runs(df, ["k"], ["pos"], "pos", 10, bucket).collect()}
    assert len(carried) == len(before) == len(sums) == len(runs) == len(rows)
    for key, seq in by_key(rows).items():
        last, total, run, prev = None, 0, 0, None
        for _, pos, v, d in seq:
            last = v if v is not None else last
            total += d
            run += prev is None or pos - prev[1] > 10
            assert carried[key, pos] == last
            assert sums[key, pos] == total
            assert runs[key, pos] == run
            assert (before[key, pos].d if before[key, pos] else None) == (prev[3] if prev else None)
            prev = (key, pos, v, d)


def test_nearest_matches_brute_force_with_ties_and_hot_page(spark):
    rng = random.Random(5)
    marks = [("p", i, float(rng.randint(0, 400))) for i in range(300)]
    anchors = [("p", i, float(rng.randint(0, 400))) for i in range(40)]
    m = spark.createDataFrame(marks, "page string, id bigint, x double")
    a = spark.createDataFrame(anchors, "page string, val bigint, x double")
    got = {r.id: r.anchor for r in L.nearest(m, a, ["page"], "x", "val", "id", 6.0, 10.0).collect()}
    for _, i, x in marks:
        best = min(anchors, key=lambda t: (abs(t[2] - x), t[2], t[1]))
        assert got.get(i) == (best[1] if abs(best[2] - x) <= 6.0 else None)


def test_ring_is_assembled_without_joint_points(spark):
    arcs = spark.createDataFrame(
        [(0, 0, 0, 0), (0, 1, 10, 0), (0, 2, 0, 10), (1, 0, 0, 0), (1, 1, 0, 10), (1, 2, 10, 0)],
        "arc_id int, pos int, dx int, dy int",
    )
    points = G.decode_arcs(arcs, (1.0, 1.0), (0.0, 0.0))
    rings = spark.createDataFrame([("f", 0, 0, 0), ("f", 0, 1, -2)], "feature_id string, ring int, ring_pos int, arc_id int")
    ring = G.assemble_rings(rings, points).orderBy("ring_pos", "point_pos").collect()
    assert [(r.lon, r.lat) for r in ring] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_area_of_a_small_square_and_its_label(spark):
    corners = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0)]
    pts = spark.createDataFrame(
        [("f", 0, i, x, y) for i, (x, y) in enumerate(corners)], "feature string, ring int, pos int, lon double, lat double"
    )
    bucket = F.floor(F.col("pos") / 2)
    km2 = G.ring_areas(pts, ["feature", "ring"], ["pos"], bucket).first().km2
    assert abs(km2 - 11.132 * 11.132) < 0.5
    label = G.label_points(pts, "feature", "ring", ["pos"], bucket).first()
    assert (round(label.lon, 6), round(label.lat, 6)) == (0.05, 0.05)


def test_country_equals_weighted_base(spark):
    base = spark.createDataFrame(
        [("n", "r1", "p1", 100, 50.0), ("n", "r1", "p2", 300, 70.0), ("s", "r2", "p3", 0, 90.0), ("s", "r2", "p4", 50, None)],
        "macro string, region string, province string, pop bigint, rd_pct double",
    )
    out = G.roll_up(base, ["macro", "region", "province"], ["rd_pct"]).collect()
    country = [r for r in out if r.level == 0][0]
    assert (country.pop, country.municipalities, country.with_rd, country.rd_pct) == (450, 4, 3, 65.0)
    south = [r for r in out if r.level == 1 and r.macro == "s"][0]
    assert south.rd_pct is None


def test_numbered_over_many_ranges(spark):
    from calendra.operators.scans import numbered

    rows = [("hot", (i * 7919) % 30_000) for i in range(30_000)] + [(None, 5), (None, None), ("b", 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, v int").repartition(5)
        got = numbered(df, ["k"], ["v"])
        assert got.columns == ["k", "v", "number"]
        by_key = {}
        for r in got.collect():
            by_key.setdefault(r.k, []).append((r.number, r.v))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(by_key["hot"]) == [(i + 1, i) for i in range(30_000)]
    assert sorted(by_key[None]) == [(1, None), (2, 5)] and by_key["b"] == [(1, 1)]


def test_digest_of_a_hot_calendar_is_many_rows(spark):
    from calendra.operators import calendars as C

    ids = spark.range(100_000)
    errors = ids.select(
        F.lit("c").alias("calendar_id"), F.format_string("M%06d", "id").alias("comune"), F.lit("via").alias("street"), F.col("id").alias("street_id"),
        F.lit("e").alias("error"),
    )
    rows = C.failure_digest(errors).select("part", "streets", F.size(F.split("places", ", ")).alias("n"), F.split("places", ", ")[0].alias("first")).collect()
    assert len(rows) == 1000 and {r.n for r in rows} == {100} and {r.streets for r in rows} == {100_000}
    assert all(r.first == f"M{r.part * 100:06d}" for r in rows)


def test_a_long_row_of_lines_is_cut_into_parts(spark):
    from calendra.sources import html as H

    lines = spark.range(10_000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.col("id").cast("string").alias("line"))
    out = H.tagged_rows(lines, "doc", "pos", "line", F.when(F.col("pos") == 0, "Z"), F.col("pos") == 5, bucket=100).collect()
    assert sorted(r.part for r in out) == list(range(100)) and {r.zone for r in out} == {"Z"} and {r.row_no for r in out} == {1}
    texts = {r.part: r.text.split(", ") for r in out}
    assert [int(x) for p in range(100) for x in texts[p]] == list(range(5, 10_000))


def around(marks, anchors):
    """Brute force: the anchor at or before and the one at or after, the lowest payload of equal ones."""
    out = {}
    for _, i, x in marks:
        below = max(((a, -v) for _, v, a in anchors if a <= x), default=None)
        above = min(((a, v) for _, v, a in anchors if a > x), default=None)
        out[i] = (below and (below[0], -below[1]), above)
    return out


def test_neighbours_in_both_directions_over_many_buckets(spark):
    rng = random.Random(9)
    marks = [("p", i, float(rng.randint(0, 900))) for i in range(200)] + [("q", 900, 5.0)]
    anchors = [("p", i, float(rng.choice([10, 10, 300, 301, 650, rng.randint(0, 900)]))) for i in range(60)]
    m = spark.createDataFrame(marks, "page string, id bigint, x double")
    a = spark.createDataFrame(anchors, "page string, val bigint, x double")
    got = {r.id: (tuple(r.before) if r.before else None, tuple(r.after) if r.after else None)
           for r in L.neighbours(m, a, ["page"], "x", "val", 7.0, "id").collect()}
    want = around([t for t in marks if t[0] == "p"], anchors)
    assert {i: v for i, v in got.items() if i != 900} == want and got[900] == (None, None)


def test_nearest_of_few_and_in_reach_agree(spark):
    rng = random.Random(10)
    marks = spark.createDataFrame([(f"p{i % 3}", i, rng.uniform(-50, 500)) for i in range(400)] + [("p0", 1000, None)], "page string, id bigint, x double")
    anchors = spark.createDataFrame([(f"p{i % 3}", i, float(rng.randint(-40, 480))) for i in range(30)] + [("p0", 77, None)], "page string, val bigint, x double")
    few = L.nearest_of_few(marks, anchors, ["page"], "x", "val", 9.0)
    reach = L.nearest_in_reach(marks, anchors, ["page"], "x", "val", 9.0)
    rows = sorted((r.id, r.anchor, round(r.dist, 9)) for r in few.collect())
    assert rows and rows == sorted((r.id, r.anchor, round(r.dist, 9)) for r in reach.collect())
    everywhere = {r.id: r.anchor for r in L.nearest_of_few(marks, anchors, ["page"], "x", "val").collect()}
    unlimited = {r.id: r.anchor for r in L.nearest(marks.where("x IS NOT NULL"), anchors.where("x IS NOT NULL"), ["page"], "x", "val", "id", None, 20.0).collect()}
    assert everywhere == unlimited


def plain_clusters(positions, gap):
    out, start = {}, None
    for p in sorted(set(positions)):
        start = p if start is None or p - start > gap else start
        out[p] = start
    return out


def test_clusters_of_a_very_long_run(spark):
    rng = random.Random(3)
    at, positions = 0.0, []
    for _ in range(100_000):
        at += rng.choice([0.0, 0.25, 0.5, 1.0, 2.75])
        positions.append(at)
    df = spark.createDataFrame([("p", i, y) for i, y in enumerate(positions)], "page string, id bigint, y double")
    got = L.token_clusters(df, ["page"], "y", "id", 20.0)
    want = plain_clusters(positions, 3.0)
    assert {r.y: r.cluster_y for r in got.select("y", "cluster_y").distinct().collect()} == want


def test_clusters_equal_the_fold_for_every_chain_length(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for page in range(6):
        at = float(rng.randint(-50, 50))
        for i in range(300):
            at += rng.choice([0.0, 0.5, 1.0, 2.5, 3.0, 3.5, 30.0])
            rows.append((None if page == 0 else page, i, at))
    df = spark.createDataFrame([*rows, (1, 999, None)], "page int, id bigint, y double")
    want = {}
    for page in {r[0] for r in rows}:
        for y, s in plain_clusters([r[2] for r in rows if r[0] == page], 3.0).items():
            want[page, y] = s
    for chained, width in ((2, 1.0), (3, 6.0), (256, 40.0)):
        monkeypatch.setattr(L, "CHAINED", chained)
        got = {(r.page, r.y): r.cluster_y for r in L.token_clusters(df.where("page IS NOT NULL"), ["page"], "y", "id", width).collect()}
        assert got.pop((1, None)) is None
        assert got == {k: v for k, v in want.items() if k[0] is not None}
