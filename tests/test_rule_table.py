"""The table function of SQL against the column expressions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from calendra.functions import rule_table as T
from calendra.operators import recurrence as E

DAYS = ("lunedì", "martedì", "Mercoledi'", "GIOVEDÌ", "venerdi", "sabato", "domenica")
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
WORDS = ("I", "II", "III", "IV", "V", "e", "1°", "2", "primo", "quarto", "del mese", "mesi di", "attivo nei mesi di", "servizio interrotto nei mesi di",
         "interruzione nel mese di", "(", ")", "-", "offerta", "mattino", "l'", *DAYS, *MONTHS)


def test_table_function_equals_columns(spark):
    rng = random.Random(17)
    rows = [(None, None), ("", ""), ("lunedì", None), (None, "V venerdì del mese (febbraio)"), ("sabato", "I e III sabato del mese (marzo aprile) II lunedì del mese (maggio)")]
    rows += [(rng.choice([*DAYS, "", None]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))) for _ in range(150)]
    rows += [(None, f"{rng.choice(['I', 'V', 'II e IV'])} {rng.choice(DAYS)} del mese ({rng.choice(MONTHS)} {rng.choice(MONTHS)})") for _ in range(40)]
    df = spark.createDataFrame([(i, w, r) for i, (w, r) in enumerate(rows)], "id int, weekday string, rule string")
    want = sorted(map(tuple, E.expand_rules(df, "weekday", "rule", F.lit(2026)).select("id", "date").collect()))
    T.register(spark)
    got = spark.sql("SELECT id, date FROM {df}, LATERAL expand_rule(weekday, rule, 2026)", df=df)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    assert spark.sql("SELECT count(*) FROM expand_rule('lunedì', '', 2026)").first()[0] == 52
