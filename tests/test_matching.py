from __future__ import annotations

import random

from pyspark.sql import functions as F

from calendra.functions import numbers as N
from calendra.functions import text as T
from calendra.operators import kpi as K
from calendra.operators import matching as M


def test_search_ranks_exact_first(spark):
    names = ["Airasca", "Baldissero Torinese", "Torino", "Settimo Torinese", "Roma"]
    items = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [r.name for r in M.ranked_search(items, "name", "id", "torino").collect()]
    assert got == ["Torino"]
    got = [r.name for r in M.ranked_search(items, "name", "id", "Tòrin").collect()]
    assert got == ["Torino", "Baldissero Torinese", "Settimo Torinese"]
    assert M.ranked_search(items, "name", "id", "").count() == 5


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_folds(spark):
    assert one(spark, T.match_key(F.lit(" Sant'Ambrogio-di  Torìno. "))) == "SANTAMBROGIODITORINO"
    assert one(spark, T.slug_unicode(F.lit("Cuorgne' È/Ü"))) == "cuorgne-eu"
    assert one(spark, T.slug_ascii(F.lit("Valle d'Aosta/Vallée d'Aoste"))) == "valle-d-aosta"
    assert one(spark, T.slug_ascii(F.lit("!!"))) == "na"
    assert one(spark, T.fold_street(F.lit("Via  dell’Orto (pari)"))) == "DELLORTO"
    assert one(spark, T.title_name(F.lit("SAN MAURO DI VAL D'OSSOLA"))) == "San Mauro di Val D'Ossola"
    assert one(spark, T.index_letter(F.lit("1 è"))) == "E" and one(spark, T.index_letter(F.lit("12"))) == "#"


def test_number_texts(spark):
    assert one(spark, N.parse_italian_number(F.lit("1.234,5 %"))) == 1234.5
    assert one(spark, N.parse_italian_number(F.lit(" - "))) is None
    assert [one(spark, N.population_bound(F.lit(n))) for n in (480, 775, 1030, 2335, 23456)] == ["480", "800", "1.000", "2.300", "23.000"]
    assert [one(spark, N.compact_number(F.lit(n))) for n in (1234, 12345, 4567890)] == ["1.234", "12 mila", "4,6 M"]


def brute(left, right, max_common=99):
    out = {}
    for n in left:
        hit = [(k, r) for r, k in right.items() if r in n or n in r]
        if hit:
            out[n] = (None, min(hit)[0])
            continue
        best = None
        tl = set(w for w in n.split() if w not in M.STOP_WORDS and len(w) > 1)
        for r, k in right.items():
            common = tl & set(w for w in r.split() if w not in M.STOP_WORDS and len(w) > 1)
            if not common:
                continue
            score = 10 * len(common) + 5 * any(len(w) >= 5 for w in common) + 3 * (n.split()[0] == r.split()[0])
            if best is None or (score, -k) > (best[0], -best[1]):
                best = (score, k)
        if best:
            out[n] = best
    return out


def test_street_match_equals_brute_force_for_short_and_long_names(spark):
    rng = random.Random(11)
    words = ["VIA", "ROMA", "PO", "MARCONI", "DI", "SOPRA", "NUOVA", "XX", "SETTEMBRE", "VECCHIA", "CORSO", "GALILEO", "ALTA", "BASSA"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 13, 16])))
    left = sorted({name() for _ in range(80)})
    right = {n: i for i, n in enumerate(sorted({name() for _ in range(80)}))}
    got = M.best_street_match(
        spark.createDataFrame([(n,) for n in left], "n string"), spark.createDataFrame(list(right.items()), "n string, key bigint")
    )
    assert {r.n: (r.score, r.key) for r in got.collect()} == brute(left, right)


def test_zone_keys_of_a_multi_part_text(spark):
    options = spark.createDataFrame([(1, "Centro storico, Borgo nuovo est , boh")], "option_id int, zone string")
    schedules = spark.createDataFrame([("CENTRO STORICO", 7), ("BORGO EST NUOVO", 8), ("CENTRO", 9)], "n string, key bigint")
    got = sorted((r.pos, r.key, r.score) for r in M.resolve_zone_keys(options, schedules).collect())
    assert got == [(0, 7, 100), (1, 8, 30)]


def test_second_code_needs_four_fifths_and_two_votes(spark):
    counts = spark.createDataFrame([("a", 1, 10), ("a", 2, 8), ("b", 1, 10), ("b", 2, 7), ("c", 1, 1), ("c", 2, 1)], "grp string, code int, n bigint")
    got = sorted((r.grp, r.code) for r in M.top_codes(counts).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_shared_data_goes_to_every_member(spark):
    rows = spark.createDataFrame(
        [("1", 100, "Aggregazione: Valle Alta", 60.0, 50.0, 30.0, 20.0), ("2", 300, "Vedi aggregazione: valle-alta", None, None, None, None),
         ("3", 50, "Comune", 70.0, 10.0, 7.0, None), ("4", 10, "Vedi aggregazione: Persa", None, None, None, None), ("5", 10, "n.d.", 1.0, 1.0, 1.0, 1.0)],
        "id string, pop bigint, dato string, rd_pct double, ru_t double, rd_t double, ind_t double",
    )
    got = {r.id: (r.rd_pct, r.kg_ru, r.kg_ind, r.group_n, r.group_pop) for r in K.shared_metrics(rows).collect()}
    assert got == {"1": (60.0, 125.0, 50.0, 2, 400), "2": (60.0, 125.0, 50.0, 2, 400), "3": (70.0, 200.0, None, None, None)}
    assert [(r.any_label, r.reason) for r in K.group_warnings(K.group_facts(rows)).collect()] == [("Persa", "no head row")]
    units = {r.unit_key: r.pop for r in K.statistical_units(K.shared_metrics(rows)).collect()}
    assert units == {"g:VALLEALTA": 400, "m:3": 50}


def test_ids_for_shared_and_taken_slugs(spark):
    metrics = spark.createDataFrame(
        [("001001", "Samone", "Torino"), ("002002", "Samone", "Trento"), ("003003", "Rho", "Milano"), ("004004", "Roma", "Roma"),
         ("005005", "Samone", "Trento"), ("006006", "Rho Nuovo", "X")], "id string, name string, province string")
    known = spark.createDataFrame([("004004", "rho")], "id string, public_id string")
    got = {r.id: r.public_id for r in K.assign_ids(metrics, known).collect()}
    assert got == {"001001": "samone-torino", "002002": "samone-trento", "005005": "samone-trento-5005", "003003": "rho-3003",
                   "004004": "rho", "006006": "rho-nuovo"}
