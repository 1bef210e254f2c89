"""Normalisation, matching and voting queries over names, texts and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.functions import numbers as N
from calendra.functions import text as T
from calendra.functions.lineage import cut
from calendra.operators import matching as M
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.views import UNIT, VOTE, r


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", "text")


@query(
    "g01_match_key",
    r"""WITH k AS (SELECT doc_id, regexp_replace(strip_accents(upper(trim(replace(text, 'ß', 'SS')))), '[''`’\-. ]', '', 'g') AS k FROM documents)
    SELECT doc_id, length(k) AS key_len, md5(k) AS key_md5 FROM k""",
)
def g01(spark: SparkSession, sf: str) -> DataFrame:
    k = T.match_key(F.col("text"))
    return docs(spark, sf).select("doc_id", F.length(k).cast("bigint").alias("key_len"), F.md5(k).alias("key_md5"))


# Part labels with accents, quotes and brackets, so that every fold has something to do.
LABEL_SQL = "(CASE p_size % 4 WHEN 0 THEN 'Via dell''' WHEN 1 THEN 'CORSO È ' WHEN 2 THEN 'Città-' ELSE 'strada ' END || p_name || ' (' || p_brand || ') ' || p_type)"


def label() -> Column:
    k = F.col("p_size") % 4
    head = (
        F.when(k == 0, F.lit("Via dell'")).when(k == 1, F.lit("CORSO È "))
        .when(k == 2, F.lit("Città-")).otherwise(F.lit("strada "))
    )
    return F.concat(head, "p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")


@query(
    "g02_slug_unicode",
    f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim({LABEL_SQL}))), '[ ''.-]', '-', 'g'),
      '[^a-z0-9-]', '', 'g'), '-+', '-', 'g') AS slug FROM part""",
)
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", T.slug_unicode(label()).alias("slug"))


@query(
    "g03_slug_ascii",
    f"""SELECT p_partkey, trim(regexp_replace(strip_accents(lower({LABEL_SQL})), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
)
def g03(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", T.slug_ascii(label()).alias("slug"))


@query(
    "g04_slug_compact",
    f"""SELECT p_partkey, left(regexp_replace(strip_accents(lower({LABEL_SQL})), '[^a-z0-9]+', '', 'g'), 24) AS slug FROM part""",
)
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", T.slug_compact(label(), 24).alias("slug"))


STREET_FOLD_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(upper({x})), '[''’.°]', '', 'g'),
  '[^\x00-\x7F]+|[\-–—]', ' ', 'g')), '^(VIA|VIALE|CORSO|PIAZZA|PIAZZALE|STRADA|LARGO|VICOLO|CASCINA|AREA)\s+', ''), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(
    "g05_fold_street",
    f"""SELECT p_partkey AS id, 'part' AS src, md5({STREET_FOLD_SQL.format(x=LABEL_SQL)}) AS folded FROM part
    UNION ALL SELECT doc_id, 'doc', md5({STREET_FOLD_SQL.format(x="replace(text, 'ß', 'SS')")}) FROM documents""",
)
def g05(spark: SparkSession, sf: str) -> DataFrame:
    parts = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit("part").alias("src"), F.md5(T.fold_street(label())).alias("folded")
    )
    texts = docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("doc").alias("src"), F.md5(T.fold_street(F.col("text"))).alias("folded")
    )
    return parts.unionByName(texts)


@query(
    "g06_title_name",
    """SELECT p_partkey, upper(p_name[1]) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')[2:]
      || ' della D''' || upper(p_type[1]) || lower(p_type[2:]) AS title FROM part""",
)
def g06(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.upper("p_name"), F.lit("  DELLA D'"), F.col("p_type"))
    return V.table(spark, sf, "part").select("p_partkey", T.title_name(name).alias("title"))


@query(
    "g07_index_letter",
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(strip_accents(upper(text)), '\p{L}'), ''), '#') AS letter FROM documents""",
)
def g07(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.index_letter(F.col("text")).alias("letter"))


@query(
    "g08_parse_number",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS value FROM orders""",
)
def g08(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    swapped = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    text = (
        F.when(k % 10 == 3, F.lit(" - "))
        .when(k % 10 == 5, F.concat(swapped, F.lit(" %")))
        .otherwise(F.concat(F.lit(" "), swapped))
    )
    return V.table(spark, sf, "orders").select(
        "o_orderkey", N.parse_italian_number(text).alias("value")
    )


def pop_bound_sql(x: str) -> str:
    unit = f"(CASE WHEN {x} < 500 THEN 1e0 WHEN {x} < 1000 THEN 50e0 WHEN {x} < 10000 THEN 100e0 ELSE 1000e0 END)"
    return f"replace(format('{{:,}}', CAST(round_even({x} / {unit}, 0) * {unit} AS BIGINT)), ',', '.')"


@query("g09_population_bound", f"SELECT o_orderkey, {pop_bound_sql('o_orderkey * 7')} AS bound FROM orders")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").select(
        "o_orderkey", N.population_bound(F.col("o_orderkey") * 7).alias("bound")
    )


@query(
    "g10_compact_number",
    f"""WITH x AS (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 1000000 THEN replace(printf('%.1f', {r('n / 1e6', 1)}), '.', ',') || ' M'
      WHEN n >= 10000 THEN CAST(floor(n / 1e3 + 0.5e0) AS BIGINT) || ' mila' ELSE replace(format('{{:,}}', n), ',', '.') END AS txt FROM x""",
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").select(
        "o_orderkey", N.compact_number(F.col("o_orderkey") * F.col("o_orderkey")).alias("txt")
    )


SCOPE = "Brand#1"
SEEK = f"""seek AS (SELECT p_partkey AS seeker_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(upper(p_name), ' ', '-')
    WHEN 2 THEN string_split(p_name, ' ')[1] ELSE p_name || p_size END AS name FROM part),
sk AS (SELECT seeker_id, upper(regexp_replace(name, '[ -]', '', 'g')) AS k FROM seek),
al AS (SELECT p_partkey AS seeker_id, upper(replace(p_type, ' ', '')) || CASE WHEN p_size > 25 THEN 'RING' ELSE '' END AS k FROM part WHERE p_size % 10 = 0),
rc AS (SELECT p_partkey AS record_id, p_brand AS province, upper(replace(p_name, ' ', '')) AS k FROM part),
s1 AS (SELECT k, min(record_id) AS record_id FROM rc WHERE province = '{SCOPE}' GROUP BY 1),
a1 AS (SELECT k, min(record_id) AS record_id FROM rc GROUP BY 1),
pt AS (SELECT x.k, min(record_id) AS record_id FROM (SELECT DISTINCT k FROM sk) x JOIN s1 ON contains(s1.k, x.k) OR contains(x.k, s1.k) GROUP BY 1),
hit AS (SELECT seeker_id, CAST(1 AS INTEGER) AS tier, record_id FROM al JOIN s1 USING (k) UNION ALL SELECT seeker_id, 2, record_id FROM al JOIN a1 USING (k)
  UNION ALL SELECT seeker_id, 3, record_id FROM sk JOIN s1 USING (k) UNION ALL SELECT seeker_id, 4, record_id FROM sk JOIN a1 USING (k)
  UNION ALL SELECT seeker_id, 5, record_id FROM sk JOIN pt USING (k)),
res AS (SELECT seeker_id, arg_min(tier, (tier, record_id)) AS tier, arg_min(record_id, (tier, record_id)) AS record_id FROM hit GROUP BY 1)"""


def seekers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.col("p_name"))
        .when(k % 4 == 1, F.replace(F.upper("p_name"), F.lit(" "), F.lit("-")))
        .when(k % 4 == 2, F.substring_index("p_name", " ", 1))
        .otherwise(F.concat("p_name", "p_size"))
    )
    return V.table(spark, sf, "part").select(k.alias("seeker_id"), name.alias("name"))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    records = part.select(
        F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("province")
    )
    tail = F.when(F.col("p_size") > 25, F.lit(" ring")).otherwise(F.lit(""))
    aliases = part.where("p_size % 10 = 0").select(
        F.col("p_partkey").alias("seeker_id"), F.concat("p_type", tail).alias("alias")
    )
    return M.match_records(seekers(spark, sf), records, aliases, SCOPE)


@query("g11_match_records", f"WITH {SEEK} SELECT seeker_id, tier, record_id FROM res")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


@query("g11_unmatched", f"WITH {SEEK} SELECT seeker_id, name FROM seek WHERE seeker_id NOT IN (SELECT seeker_id FROM res)")
def g11_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return M.unmatched(seekers(spark, sf), matched(spark, sf))


LOOK = """st AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(string_split(p_name, ' ')[2])
    WHEN 2 THEN upper(p_name) || ' NORD' ELSE upper(p_type) || ' ' || upper(string_split(p_name, ' ')[2]) END AS n FROM part),
zn AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE upper(p_name) || ' SUD' END AS n, p_brand AS code FROM part)"""


def lookups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = V.table(spark, sf, "part")
    k, name = F.col("p_partkey"), F.upper("p_name")
    noun = F.upper(F.substring_index("p_name", " ", -1))
    n = (
        F.when(k % 4 == 0, name).when(k % 4 == 1, noun)
        .when(k % 4 == 2, F.concat(name, F.lit(" NORD")))
        .otherwise(F.concat(F.upper("p_type"), F.lit(" "), noun))
    )
    zone = F.when(F.col("p_size") % 2 == 0, name).otherwise(F.concat(name, F.lit(" SUD")))
    return part.select(n.alias("n")), part.select(
        zone.alias("n"), F.col("p_brand").alias("code")
    )


@query(
    "g12_codes_by_containment",
    f"""WITH {LOOK} SELECT n, code, 'exact' AS how FROM st JOIN zn USING (n)
    UNION ALL SELECT DISTINCT st.n, code, 'contained' FROM st JOIN zn ON contains(st.n, zn.n) OR contains(zn.n, st.n)
    WHERE length(st.n) >= 6 AND st.n NOT IN (SELECT n FROM zn)""",
)
def g12(spark: SparkSession, sf: str) -> DataFrame:
    return M.codes_by_containment(*lookups(spark, sf))


@query(
    "g13_codes_by_last_token",
    f"""WITH {LOOK}, rest AS (SELECT n, string_split(n, ' ')[-1] AS t FROM st WHERE n NOT IN (SELECT n FROM zn)),
    k AS (SELECT rest.n, arg_min(z.n, (length(z.n), z.n)) AS key FROM rest JOIN (SELECT DISTINCT n FROM zn) z ON ends_with(z.n, t) WHERE length(t) > 3 GROUP BY 1)
    SELECT n, code, 'exact' AS how FROM st JOIN zn USING (n) UNION ALL SELECT k.n, code, 'last-token' FROM k JOIN zn ON zn.n = key""",
)
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return M.codes_by_last_token(*lookups(spark, sf))


STOPS = "[" + ", ".join(f"'{w}'" for w in M.STOP_WORDS) + "]"


def toks(n: str) -> str:
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda w: length(w) > 1 AND NOT list_contains({STOPS}, w)))"


@query(
    "g14_best_street_match",
    f"""WITH l AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN upper(string_split(p_name, ' ')[2]) || ' ' || p_type
        ELSE p_type || ' ' || upper(string_split(p_name, ' ')[2]) || ' DI SOPRA ' || p_brand END AS n FROM part),
    rr AS (SELECT upper(p_name) || ' ' || p_type || ' ' || p_brand AS n, min(p_partkey) AS key FROM part GROUP BY 1),
    d AS (SELECT l.n, min(key) AS key FROM l JOIN rr ON contains(rr.n, l.n) OR contains(l.n, rr.n) GROUP BY 1),
    lt AS (SELECT n, {toks('n')} AS t FROM l WHERE n NOT IN (SELECT n FROM d)), rt AS (SELECT n, key, {toks('n')} AS t FROM rr),
    p AS (SELECT lt.n, key, list_intersect(lt.t, rt.t) AS c, string_split(lt.n, ' ')[1] = string_split(rt.n, ' ')[1] AS same FROM lt, rt WHERE len(list_intersect(lt.t, rt.t)) > 0),
    s AS (SELECT n, key, len(c) * 10 + CASE WHEN len(list_filter(c, lambda x: length(x) >= 5)) > 0 THEN 5 ELSE 0 END + CASE WHEN same THEN 3 ELSE 0 END AS score FROM p)
    SELECT n, CAST(NULL AS DOUBLE) AS score, key FROM d UNION ALL
    SELECT n, CAST(max(score) AS DOUBLE), arg_max(key, (score, -key)) FROM s GROUP BY 1""",
)
def g14(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    noun = F.upper(F.substring_index("p_name", " ", -1))
    n = F.when(F.col("p_size") % 3 == 0, F.concat(noun, F.lit(" "), "p_type")).otherwise(
        F.concat("p_type", F.lit(" "), noun, F.lit(" DI SOPRA "), "p_brand")
    )
    rows = part.select(
        F.concat_ws(" ", F.upper("p_name"), "p_type", "p_brand").alias("n"), F.col("p_partkey").alias("key")
    )
    best = M.best_street_match(part.select(n.alias("n")), rows)
    return best.withColumn("score", F.col("score").cast("double"))


@query(
    "g15_resolve_zone_keys",
    f"""WITH o AS (SELECT p_partkey AS option_id, upper(p_name) || ', ' || upper(string_split(p_name, ' ')[1]) || ' ' || p_type || ' nord' AS zone FROM part),
    pr AS (SELECT option_id, unnest(range(2)) AS pos, unnest(list_transform(string_split(zone, ','), lambda x: upper(trim(x)))) AS n FROM o),
    sc AS (SELECT upper(p_name) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS n, min(p_partkey) AS key FROM part GROUP BY 1),
    nn AS (SELECT DISTINCT n FROM pr),
    c AS (SELECT nn.n, key, CASE WHEN nn.n = sc.n THEN 100 WHEN contains(nn.n, sc.n) OR contains(sc.n, nn.n) THEN CASE WHEN nn.n IN (SELECT n FROM sc) THEN 0 ELSE 50 + least(length(nn.n), length(sc.n)) END
      WHEN nn.n IN (SELECT n FROM sc) THEN 0
      WHEN len(list_intersect(list_distinct(string_split(nn.n, ' ')), list_distinct(string_split(sc.n, ' ')))) >= 2
        THEN 10 * len(list_intersect(list_distinct(string_split(nn.n, ' ')), list_distinct(string_split(sc.n, ' ')))) ELSE 0 END AS score FROM nn, sc),
    b AS (SELECT n, arg_max(key, (score, -key)) AS key, max(score) AS score FROM c GROUP BY 1 HAVING max(score) >= 10)
    SELECT option_id, key, CAST(min(pos) AS INTEGER) AS pos, CAST(max(score) AS INTEGER) AS score FROM pr JOIN b USING (n) GROUP BY 1, 2""",
)
def g15(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    zone = F.concat(
        F.upper("p_name"), F.lit(", "), F.upper(F.substring_index("p_name", " ", 1)), F.lit(" "), "p_type", F.lit(" nord")
    )
    tail = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "p_type"))
    schedules = part.select(
        F.concat(F.upper("p_name"), tail).alias("n"), F.col("p_partkey").alias("key")
    )
    options = part.select(F.col("p_partkey").alias("option_id"), zone.alias("zone"))
    return M.resolve_zone_keys(options, schedules)


@query(
    "g15_week_side_keys",
    """WITH o AS (SELECT p_partkey AS option_id, CASE p_size % 3 WHEN 0 THEN 'NORD' WHEN 1 THEN 'SUD' END AS side,
      CASE WHEN p_size % 2 = 0 THEN 'MERCOLEDI' END AS weekday, CASE WHEN p_size % 5 > 0 THEN p_size % 7 END AS week FROM part),
    s AS (SELECT n, min(k) AS key FROM (SELECT 'SETTIMANA ' || s_suppkey % 5 || CASE WHEN s_nationkey % 2 = 0 THEN ' NORD' ELSE ' SUD' END
      || CASE s_suppkey % 3 WHEN 0 THEN ' MERCOLEDI' WHEN 1 THEN ' LUNEDI' ELSE '' END AS n, s_suppkey AS k FROM supplier) GROUP BY 1),
    e AS (SELECT option_id, key FROM o JOIN s ON n = 'SETTIMANA ' || week || ' ' || side)
    SELECT option_id, key, CAST(0 AS INTEGER) AS pos FROM e
    UNION ALL SELECT option_id, key, 0 FROM o JOIN s ON contains(n, side) AND (weekday IS NULL OR contains(n, weekday))
      WHERE option_id NOT IN (SELECT option_id FROM e)""",
)
def g15_week_sides(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    side = F.when(size % 3 == 0, F.lit("Nord")).when(size % 3 == 1, F.lit("sud"))
    day = F.when(size % 2 == 0, F.lit(" - mercoledì pomeriggio")).otherwise(F.lit(" (centro)"))
    options = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("option_id"), F.coalesce(F.concat(side, day), F.lit("est")).alias("zone"),
        F.when(size % 5 > 0, F.concat(F.lit("Settimana "), size % 7)).alias("week"),
    )
    key = F.col("s_suppkey")
    name = F.concat(
        F.lit("SETTIMANA "), key % 5, F.when(F.col("s_nationkey") % 2 == 0, F.lit(" NORD")).otherwise(F.lit(" SUD")),
        F.when(key % 3 == 0, F.lit(" MERCOLEDI")).when(key % 3 == 1, F.lit(" LUNEDI")).otherwise(F.lit("")),
    )
    return M.week_side_keys(options, V.table(spark, sf, "supplier").select(name.alias("n"), key.alias("key")))


@query(
    "g15_timed_zone_keys",
    """WITH o AS (SELECT p_partkey AS option_id, 'SETT ' || (p_size % 9) AS n FROM part),
    s AS (SELECT n, min(k) AS key FROM (SELECT 'SETT ' || (s_suppkey % 12) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' LUNEDI' END AS n, s_suppkey AS k FROM supplier) GROUP BY 1)
    SELECT option_id, key, CAST(0 AS INTEGER) AS pos FROM o JOIN s ON o.n = s.n
    UNION ALL SELECT option_id, key, 0 FROM o JOIN s ON contains(o.n, s.n) OR contains(s.n, o.n) WHERE o.n NOT IN (SELECT n FROM s)""",
)
def g15_timed_zones(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("s_suppkey")
    options = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("option_id"),
        F.concat(F.lit("Sett "), size % 9, F.when(size % 2 == 0, F.lit(" mattina")).otherwise(F.lit(" Pomeriggio"))).alias("zone"),
    )
    name = F.concat(F.lit("SETT "), key % 12, F.when(key % 2 == 0, F.lit("")).otherwise(F.lit(" LUNEDI")))
    return M.timed_zone_keys(options, V.table(spark, sf, "supplier").select(name.alias("n"), key.alias("key")))


NEEDLES = (("hot gear", "hot-gear"), ("hot", "hot"), ("gear", "gear"), ("small", "small"), ("bolt", "bolt"))


@query(
    "g16_ordered_needles",
    f"""SELECT p_partkey, CASE {' '.join(f"WHEN contains(p_name, '{n}') THEN '{t}'" for n, t in NEEDLES)} END AS target FROM part""",
)
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select(
        "p_partkey", M.ordered_needles(F.col("p_name"), NEEDLES).alias("target")
    )


TOKENS = ("a", "b", "centro", "1", "unica", "est", "q")
LABELS = ("Zona A SMART 5", "Zona B", "Zona Centro", "Z1A solo RSU", "Zona East", "PORTA NORD", "ZB distretto")


def pick(words: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))


def sql_pick(words: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][{i} + 1]"


def zone_score_sql() -> str:
    named = " + ".join(
        f"CASE WHEN starts_with(token, '{k}') AND regexp_matches(zf, '{'|'.join(ws)}') THEN 4 ELSE 0 END"
        for k, ws in M.NAMED_ZONES.items()
    )
    return rf"""(CASE WHEN contains(zf, 'SMART 5') THEN -1 ELSE 0 END + CASE WHEN contains(zf, 'SOLO RSU') OR contains(zf, 'PORTA') THEN 1 ELSE 0 END
    + CASE WHEN token = '' THEN 0 ELSE
      CASE WHEN regexp_matches(zf, '\bZONA\s*' || token || '\b') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(zf, '\bZ\s*' || token || '[A-Z]?\b') THEN 5 ELSE 0 END
      + CASE WHEN regexp_full_match(token, '[A-Z]{{1,2}}') AND regexp_matches(zf, '\bZONA\s+' || token || '\b') THEN 5 ELSE 0 END
      + CASE WHEN regexp_full_match(token, '[A-Z]{{1,2}}') AND regexp_matches(zf, '\bZ' || token || '\b') THEN 4 ELSE 0 END
      + {named} + CASE WHEN contains(replace(zf, ' ', ''), token) THEN 1 ELSE 0 END END)"""


@query(
    "g17_map_zones",
    rf"""WITH c AS (SELECT c_nationkey AS comune, c_custkey AS calendar, upper({sql_pick(TOKENS, 'c_custkey % 7')}) AS token FROM customer),
    z AS (SELECT s_nationkey AS comune, {sql_pick(LABELS, 's_suppkey % 7')} || ' ' || s_suppkey AS zone FROM supplier),
    zf AS (SELECT *, upper(zone) AS zf FROM z),
    s AS (SELECT calendar, zone, token, {zone_score_sql()} AS score FROM c JOIN zf USING (comune)),
    b AS (SELECT *, max(score) OVER (PARTITION BY calendar) AS best FROM s)
    SELECT calendar, zone, CAST(CASE WHEN token <> 'UNICA' THEN score END AS DOUBLE) AS score FROM b WHERE token = 'UNICA' OR (score = best AND score > 0)""",
)
def g17(spark: SparkSession, sf: str) -> DataFrame:
    cals = V.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("comune"), F.col("c_custkey").alias("calendar"),
        F.concat(F.lit("comune-z"), pick(TOKENS, F.col("c_custkey") % 7)).alias("slug"),
    )
    zones = V.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("comune"),
        F.concat_ws(" ", pick(LABELS, F.col("s_suppkey") % 7), "s_suppkey").alias("zone"),
    )
    return M.map_zones(cals, zones).withColumn("score", F.col("score").cast("double"))


CNT = f"{VOTE}, cnt AS (SELECT grp, code, count(*) AS n FROM vote GROUP BY 1, 2)"


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.count_votes(V.vote(spark, sf))


@query("g18_count_votes", f"WITH {CNT} SELECT * FROM cnt")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf)


@query(
    "g18_coverage",
    f"""WITH {VOTE} SELECT grp, count(*) FILTER (code % 3 = 0) AS matched, count(*) AS total FROM vote GROUP BY 1
    HAVING count(*) FILTER (code % 3 = 0) >= 12""",
)
def g18_coverage(spark: SparkSession, sf: str) -> DataFrame:
    flagged = V.vote(spark, sf).withColumn("matched", F.col("code") % 3 == 0)
    return M.coverage(flagged, 12)


@query(
    "g19_dominant",
    f"""WITH {CNT} SELECT grp, arg_max(code, (n, -code)) AS code, {r("100e0 * max(n) / sum(n)", 2)} AS share, CAST(sum(n) AS BIGINT) AS votes FROM cnt GROUP BY 1""",
)
def g19(spark: SparkSession, sf: str) -> DataFrame:
    return M.dominant(counts(spark, sf))


@query(
    "g19_with_fallback",
    f"""WITH {CNT}, d AS (SELECT grp, arg_max(code, (n, -code)) AS code FROM cnt WHERE n >= 3 GROUP BY 1),
    m AS (SELECT arg_max(code, (n, -code)) AS mode FROM (SELECT code, sum(n) AS n FROM cnt GROUP BY 1))
    SELECT c_custkey AS grp, coalesce(code, (SELECT mode FROM m)) AS code, code IS NULL AS fallback FROM customer LEFT JOIN d ON grp = c_custkey""",
)
def g19_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = cut(counts(spark, sf))
    groups = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"))
    return M.with_fallback(groups, M.dominant(c.where("n >= 3")), c)


@query(
    "g20_top_codes",
    f"""WITH {CNT}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, code) AS rank, max(n) OVER (PARTITION BY grp) AS top FROM cnt)
    SELECT grp, code, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank = 1 OR (rank = 2 AND n >= greatest(2, floor(0.8e0 * top)))""",
)
def g20(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_codes(counts(spark, sf))


# Rule texts per supplier: mechanised with ordinals and months, weekly manual, blank.
SPEC = """spec AS (SELECT s_suppkey AS code, CAST(CASE s_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS spec FROM supplier)"""


def specs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rules = V.table(spark, sf, "supplier").select(
        k.alias("code"),
        F.when(k % 4 == 0, F.lit("Meccanizzato")).otherwise(F.lit("Manuale")).alias("type"),
        F.when(k % 4 == 0, F.lit("I e III lunedì del mese mesi di aprile maggio"))
        .when(k % 4 == 1, F.lit("II martedì"))
        .when(k % 4 == 2, F.lit("mattino"))
        .otherwise(F.lit(""))
        .alias("rule"),
    )
    return M.rule_specificity(rules)


@query("g21_rule_specificity", f"WITH {SPEC} SELECT * FROM spec")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    return specs(spark, sf)


@query(
    "g22_select_codes",
    f"""WITH {CNT}, {SPEC}, u AS (SELECT cnt.*, spec FROM cnt JOIN spec USING (code)),
    h AS (SELECT grp, max(n) AS top, arg_max(spec, (n, -code)) AS ls, count(*) FILTER (spec >= 7 AND n >= 2) AS sp FROM u GROUP BY 1),
    c AS (SELECT u.* FROM u JOIN h USING (grp) WHERE CASE WHEN ls <= 1 AND sp > 0 THEN spec >= 7 AND n >= 2 WHEN top >= 2 THEN n >= greatest(2, floor(0.5e0 * top)) ELSE true END),
    o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY spec DESC, n DESC, code) AS rn FROM c),
    f AS (SELECT * FROM o WHERE rn = 1),
    s AS (SELECT o.grp, arg_min(o.code, o.rn) AS code FROM o JOIN f ON o.grp = f.grp WHERE o.rn > 1 AND o.n >= greatest(2, floor(0.8e0 * f.n))
      AND abs(o.spec - f.spec) <= 2 AND NOT (o.spec <= 1 AND f.spec <= 1) GROUP BY 1)
    SELECT grp, code, CAST(1 AS INTEGER) AS rank FROM f UNION ALL SELECT grp, code, 2 FROM s""",
)
def g22(spark: SparkSession, sf: str) -> DataFrame:
    return M.select_codes(cut(counts(spark, sf)), specs(spark, sf))


@query(
    "g23_select_code",
    f"""WITH {CNT}, s AS (SELECT s_suppkey AS code, (s_suppkey * 37) % 260 AS days, s_suppkey % 3 = 0 AS mech FROM supplier),
    k AS (SELECT grp, cnt.code, n, days, mech, days BETWEEN 4 AND 180 AS ok FROM cnt JOIN s USING (code)),
    o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ok DESC, mech DESC, n DESC, days, code DESC) AS rn FROM k WHERE ok OR days BETWEEN 1 AND 180)
    SELECT grp, code, days FROM o WHERE rn = 1""",
)
def g23(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    schedules = V.table(spark, sf, "supplier").select(
        k.alias("code"), ((k * 37) % 260).alias("days"), (k % 3 == 0).alias("mechanised")
    )
    return M.select_code(counts(spark, sf), schedules)


@query(
    "g24_ranked_search",
    """SELECT p_partkey, p_name, CAST(CASE WHEN p_name = 'hot' THEN 0 WHEN starts_with(p_name, 'hot') THEN 1 ELSE 2 END AS INTEGER) AS rank
    FROM part WHERE contains(p_name, 'hot') ORDER BY rank, p_name, p_partkey LIMIT 80""",
)
def g24(spark: SparkSession, sf: str) -> DataFrame:
    items = V.table(spark, sf, "part").select("p_partkey", "p_name")
    return M.ranked_search(items, "p_name", "p_partkey", " HÓT ")


@query(
    "g25_resolve_by_prefix",
    """WITH op AS (SELECT p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' ' || lower(p_type) ELSE '' END AS k, min(p_partkey) AS option_id FROM part GROUP BY 1),
    sk AS (SELECT p_partkey AS seeker_id, CASE WHEN p_brand = 'Brand#2' THEN 'hot gear' ELSE p_name END AS k FROM part),
    h AS (SELECT seeker_id, CAST(1 AS INTEGER) AS tier, option_id FROM sk JOIN op USING (k)
      UNION ALL SELECT seeker_id, 2, min(option_id) FROM sk JOIN op ON starts_with(op.k, sk.k) OR starts_with(sk.k, op.k) GROUP BY 1)
    SELECT seeker_id, min(tier) AS tier, arg_min(option_id, tier) AS option_id FROM h GROUP BY 1""",
)
def g25(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    tail = F.when(F.length("p_name") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.lit(""))
    options = part.select(
        F.concat("p_name", tail).alias("name"), F.col("p_partkey").alias("option_id")
    )
    own = F.when(F.col("p_brand") == "Brand#2", F.concat("p_name", F.lit(" due"))).otherwise(F.col("p_name"))
    who = part.select(F.col("p_partkey").alias("seeker_id"), own.alias("name"))
    aliases = part.where("p_brand = 'Brand#2'").select(
        F.concat("p_name", F.lit(" due")).alias("name"), F.lit("Hot Gear").alias("alias")
    ).distinct()
    return M.resolve_by_prefix(who, options, aliases)


TIERS = """nm AS (SELECT p_type AS comune, p_type || '-' || p_size AS calendar, CASE WHEN p_size % 2 = 1 AND p_partkey % 20 <> 0 THEN 'Zona ' || p_brand ELSE p_name END AS name FROM part),
    mp AS (SELECT p_type || '-' || p_size AS calendar, 'via ' || p_name AS name FROM part WHERE p_size % 6 = 1),
    ev AS (SELECT DISTINCT p_type AS comune, 'all ' || p_name AS name FROM part),
    t AS (SELECT comune, calendar, count(*) FILTER (NOT starts_with(name, 'Zona')) AS k FROM nm GROUP BY 1, 2),
    u AS (SELECT *, CAST(CASE WHEN k >= 2 THEN 1 WHEN calendar IN (SELECT calendar FROM mp) THEN 2 WHEN k >= 1 THEN 3 ELSE 4 END AS INTEGER) AS tier FROM t),
    gr AS (SELECT u.calendar, tier, u.comune, name FROM u JOIN nm ON u.calendar = nm.calendar WHERE tier IN (1, 3) AND NOT starts_with(name, 'Zona')
      UNION ALL SELECT u.calendar, tier, u.comune, name FROM u JOIN mp USING (calendar) WHERE tier = 2
      UNION ALL SELECT calendar, tier, comune, NULL FROM u WHERE tier = 4)"""


def tiered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = V.table(spark, sf, "part")
    cal = F.concat_ws("-", "p_type", "p_size")
    zoned = (F.col("p_size") % 2 == 1) & (F.col("p_partkey") % 20 != 0)
    names = part.select(
        F.col("p_type").alias("comune"), cal.alias("calendar"),
        F.when(zoned, F.concat(F.lit("Zona "), "p_brand")).otherwise(F.col("p_name")).alias("name"),
    )
    mapped = part.where("p_size % 6 = 1").select(
        cal.alias("calendar"), F.concat(F.lit("via "), "p_name").alias("name")
    )
    everything = part.select(
        F.col("p_type").alias("comune"), F.concat(F.lit("all "), "p_name").alias("name")
    ).distinct()
    return M.street_groups(names, mapped), everything


@query("g26_street_groups", f"WITH {TIERS} SELECT calendar, tier, comune, name FROM gr")
def g26_groups(spark: SparkSession, sf: str) -> DataFrame:
    return tiered(spark, sf)[0]


@query(
    "g26_streets_of_calendars",
    f"""WITH {TIERS} SELECT calendar, tier, name FROM gr WHERE tier < 4
    UNION ALL SELECT calendar, tier, ev.name FROM gr JOIN ev USING (comune) WHERE tier = 4""",
)
def g26(spark: SparkSession, sf: str) -> DataFrame:
    return M.expanded_streets(*tiered(spark, sf))


@query(
    "g27_directory_labels",
    f"""WITH {UNIT} SELECT id, name || CASE WHEN region = 'ASIA' THEN '' ELSE ' (' || province || ')' END AS label FROM unit WHERE year = 2000""",
)
def g27(spark: SparkSession, sf: str) -> DataFrame:
    u = V.latest(V.unit(spark, sf))
    province = F.when(F.col("region") == "ASIA", F.lit(" ")).otherwise(F.col("province"))
    labelled = u.select("id", "name", M.directory_label(F.col("name"), province).alias("label"))
    return labelled.orderBy("name").select("id", "label")
