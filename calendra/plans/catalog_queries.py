"""Source catalog queries over orders, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.operators import catalog as C
from calendra.plans import views as V
from calendra.plans.registry import query
from calendra.plans.source_queries import LINKS, page_links
from calendra.plans.views import STREET


def items(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.lit("p").alias("provider"), F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("url"),
    )


@query(
    "i01_manifest_heads",
    """SELECT o_custkey AS id, 'p' AS provider, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years, count(*) AS documents FROM orders GROUP BY 1""",
)
def i01(spark: SparkSession, sf: str) -> DataFrame:
    heads, _ = C.group_manifest(items(spark, sf))
    return heads.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query(
    "i01_manifest_documents",
    """SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS label, o_orderkey AS url FROM orders""",
)
def i01_docs(spark: SparkSession, sf: str) -> DataFrame:
    return C.group_manifest(items(spark, sf))[1]


@query(
    "i01_replace_provider",
    """SELECT o_orderkey AS id, left(o_orderpriority, 1) AS provider, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE left(o_orderpriority, 1) <> '1'
    UNION ALL SELECT p_partkey, '1', CAST(2000 + p_size AS INTEGER) FROM part""",
)
def i01_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Provider 1 delivers its whole list anew."""
    catalog = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.left("o_orderpriority", F.lit(1)).alias("provider"), F.year("o_orderdate").alias("year")
    )
    fresh = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit("1").alias("provider"), (F.col("p_size") + 2000).cast("int").alias("year")
    )
    return C.replace_provider(catalog, fresh, "1")


# Existing catalog: per street name; found: per street name with a suffix for some.
UPS = """ex AS (SELECT p_name AS id, CASE WHEN length(p_name) % 3 = 0 THEN 'q' ELSE 'p' END AS provider, list_sort(list(DISTINCT p_size % 5)) AS years, ['n' || p_name] AS notes FROM part GROUP BY p_name),
fo AS (SELECT p_name || CASE WHEN p_type = 'PROMO' THEN ' promo' ELSE '' END AS id, 'p' AS provider, list_sort(list(DISTINCT p_size % 7)) AS years, ['found'] AS notes FROM part WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1),
j AS (SELECT coalesce(ex.id, fo.id) AS id, coalesce(ex.provider, fo.provider) AS provider,
  CASE WHEN ex.id IS NULL THEN fo.years WHEN ex.provider = fo.provider THEN list_sort(list_distinct(list_concat(ex.years, fo.years))) ELSE ex.years END AS years,
  CASE WHEN ex.id IS NULL THEN fo.notes WHEN ex.provider = fo.provider THEN list_sort(list_distinct(list_concat(ex.notes, fo.notes))) ELSE ex.notes END AS notes,
  CASE WHEN ex.id IS NULL THEN 'inserted' WHEN fo.id IS NULL THEN 'kept' WHEN ex.provider = fo.provider THEN 'updated' ELSE 'other provider' END AS status
  FROM ex FULL JOIN fo ON ex.id = fo.id)"""


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    existing = part.groupBy(F.col("p_name").alias("id")).agg(
        F.array_sort(F.collect_set(F.col("p_size") % 5)).alias("years")
    ).select(
        "id", F.when(F.length("id") % 3 == 0, F.lit("q")).otherwise(F.lit("p")).alias("provider"), "years",
        F.array(F.concat(F.lit("n"), "id")).alias("notes"),
    )
    tail = F.when(F.col("p_type") == "PROMO", F.lit(" promo")).otherwise(F.lit(""))
    found = part.where("p_type IN ('PROMO', 'SMALL')").groupBy(F.concat("p_name", tail).alias("id")).agg(
        F.array_sort(F.collect_set(F.col("p_size") % 7)).alias("years")
    ).select("id", F.lit("p").alias("provider"), "years", F.array(F.lit("found")).alias("notes"))
    return C.upsert_heads(existing, found)


@query(
    "i02_upsert_heads",
    f"WITH {UPS} SELECT id, provider, array_to_string(years, ',') AS years, array_to_string(notes, ',') AS notes, status FROM j",
)
def i02(spark: SparkSession, sf: str) -> DataFrame:
    return upsert(spark, sf).withColumns({
        "years": F.array_join(F.col("years").cast("array<string>"), ","), "notes": F.array_join("notes", ","),
    })


@query(
    "i02_upsert_documents",
    f"""WITH {UPS}, ed AS (SELECT DISTINCT p_name AS id, p_size AS url, 'old' AS label FROM part WHERE p_size <= 25),
    fd AS (SELECT DISTINCT p_name || CASE WHEN p_type = 'PROMO' THEN ' promo' ELSE '' END AS id, p_size AS url, 'new' AS label FROM part WHERE p_type IN ('PROMO', 'SMALL'))
    SELECT * FROM ed UNION ALL SELECT fd.* FROM fd SEMI JOIN (SELECT id FROM j WHERE status IN ('inserted', 'updated')) a ON a.id = fd.id ANTI JOIN ed ON ed.id = fd.id AND ed.url = fd.url""",
)
def i02_docs(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    tail = F.when(F.col("p_type") == "PROMO", F.lit(" promo")).otherwise(F.lit(""))
    existing = part.where("p_size <= 25").select(
        F.col("p_name").alias("id"), F.col("p_size").alias("url"), F.lit("old").alias("label"), F.lit(2026).alias("year")
    ).distinct()
    found = part.where("p_type IN ('PROMO', 'SMALL')").select(
        F.concat("p_name", tail).alias("id"), F.col("p_size").alias("url"), F.lit("new").alias("label"), F.lit(2026).alias("year")
    )
    return C.upsert_documents(upsert(spark, sf), existing, found).drop("year")


CLEAN = rf"""{LINKS},
d AS (SELECT regexp_extract(link, '^https?://([^/?#]*)', 1) AS id0, link AS url, label, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 2024 + page_id % 4 END AS year FROM lk),
k AS (SELECT CASE WHEN starts_with(id0, 'm.') THEN id0[3:] ELSE id0 END AS id, url, label, year FROM d
  WHERE NOT starts_with(id0, 'spam') AND NOT regexp_matches(lower(label || ' ' || url), 'que|and') AND (year IS NULL OR year IN (2025, 2026)))"""


@query(
    "i03_clean_documents",
    f"WITH {CLEAN} SELECT id, url, min(label) AS label, CAST(max(year) AS DOUBLE) AS year FROM k GROUP BY 1, 2",
)
def i03(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id")
    docs = page_links(spark, sf).select(
        F.regexp_extract("link", r"^https?://([^/?#]*)", 1).alias("id"), F.col("link").alias("url"), "label",
        F.when(page % 3 != 0, (2024 + page % 4).cast("int")).alias("year"),
    )
    hosts = V.table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("id")).distinct()
    blocked = hosts.where("startswith(id, 'spam')")
    renames = hosts.where("startswith(id, 'm.')").select("id", F.substring("id", 3, 1000).alias("new_id"))
    return C.clean(docs, blocked, renames, "que|and", (2025, 2026)).withColumn("year", F.col("year").cast("double"))


POINTS = (("the", 5), ("in", 3), ("an", -2), ("er", 1))


@query(
    "i04_best_document",
    f"""WITH {LINKS}, s AS (SELECT page_id AS id, pos, link AS url, label, {' + '.join(f"CASE WHEN contains(lower(label || ' ' || link), '{p}') THEN {w} ELSE 0 END" for p, w in POINTS)} AS score FROM lk)
    SELECT id, arg_max(url, (score, -pos)) AS url, arg_max(label, (score, -pos)) AS label, CAST(max(score) AS INTEGER) AS score FROM s GROUP BY 1""",
)
def i04(spark: SparkSession, sf: str) -> DataFrame:
    docs = page_links(spark, sf).select(F.col("page_id").alias("id"), "pos", F.col("link").alias("url"), "label")
    return C.best_documents(docs, POINTS)


@query(
    "i05_dedup_candidates",
    """WITH f AS (SELECT source || '-' || lang || '-' || n_chars % 50 AS id, n_chars > 500 AS has_docs, doc_id AS pos FROM documents WHERE source <> 'src2'),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY has_docs DESC, pos) AS rn FROM f) SELECT id, has_docs, pos FROM r WHERE rn = 1""",
)
def i05(spark: SparkSession, sf: str) -> DataFrame:
    found = V.table(spark, sf, "documents").select(
        F.concat_ws("-", "source", "lang", (F.col("n_chars") % 50).cast("string")).alias("id"),
        (F.col("n_chars") > 500).alias("has_docs"), F.col("doc_id").alias("pos"),
    )
    known = found.where("startswith(id, 'src2-')").select("id")
    return C.dedup_candidates(found, known)


@query(
    "i06_group_by_provider",
    """WITH s AS (SELECT CASE WHEN source IN ('src1', 'src3') THEN 'Altro' ELSE source END AS provider, CASE WHEN source = 'src4' THEN 'one' ELSE lang END AS page FROM documents)
    SELECT provider, count(*) AS sources, CASE WHEN count(DISTINCT page) = 1 THEN max(page) END AS page FROM s GROUP BY 1""",
)
def i06(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source")
    rows = V.table(spark, sf, "documents").select(
        F.when(s == "src1", F.lit(" ")).when(s != "src3", s).alias("provider"),
        F.when(s == "src4", F.lit("one")).otherwise(F.col("lang")).alias("page"),
    )
    return C.group_by_provider(rows)


@query(
    "i07_source_lookup",
    "SELECT c_custkey, c_nationkey AS id, n_name AS provider FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2",
)
def i07(spark: SparkSession, sf: str) -> DataFrame:
    requests = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    catalog = V.table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("provider")
    )
    return C.source_of(requests, F.broadcast(catalog))


@query(
    "i08_resolve_choices",
    f"""WITH {STREET}, idx AS (SELECT DISTINCT comune, street, code AS calendar FROM street WHERE comune <> 'PROMO'),
    st AS (SELECT street_id, comune, street, CASE WHEN street_id % 5 = 0 THEN NULL WHEN street_id % 5 = 1 THEN 'gone' ELSE code END AS calendar FROM street)
    SELECT street_id, CASE WHEN st.calendar IS NULL AND st.comune IN (SELECT comune FROM idx) THEN 'statistics' WHEN idx.calendar IS NOT NULL THEN 'calendar' END AS mode
    FROM st LEFT JOIN idx ON st.comune = idx.comune AND st.street = idx.street AND st.calendar = idx.calendar""",
)
def i08(spark: SparkSession, sf: str) -> DataFrame:
    s = V.street(spark, sf)
    k = F.col("street_id") % 5
    stored = s.select(
        "street_id", "comune", "street", F.when(k == 1, F.lit("gone")).when(k != 0, F.col("code")).alias("calendar")
    )
    index = s.where("comune <> 'PROMO'").select("comune", "street", F.col("code").alias("calendar"))
    return C.resolve_choices(stored, index).select("street_id", "mode")


RULES = (("th", "short"), ("thther.example.org", "long"), ("blog.", "blog"), ("m.", "mobile"))
FIXES = {"the": "Torino", "der": "Ivrea"}

CAND = rf"""{LINKS},
p AS (SELECT link, label, regexp_replace(link, '^[a-zA-Z]+://(www\.)?', '') AS bare FROM lk),
q AS (SELECT link, label, CASE WHEN starts_with(bare, 'thther.example.org') THEN 'long' WHEN starts_with(bare, 'blog.') THEN 'blog' WHEN starts_with(bare, 'm.') THEN 'mobile' WHEN starts_with(bare, 'th') THEN 'short' END AS provider,
  trim(regexp_replace(regexp_replace(label, '(?i)\b(comune|calendario|pdf)\b( di)?', ' ', 'g'), '[^\p{{L}}'' -]+|\s+', ' ', 'g')) AS raw FROM p),
n AS (SELECT link, label, provider, CASE lower(raw) WHEN 'the' THEN 'Torino' WHEN 'der' THEN 'Ivrea' ELSE raw END AS name FROM q WHERE provider IS NOT NULL),
m AS (SELECT *, coalesce(nullif(trim(regexp_replace(strip_accents(lower(replace(name, 'ß', ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'na') AS id FROM n WHERE name <> ''),
dd AS (SELECT id, link AS url, min(label) AS label, min(name) AS name, min(provider) AS provider FROM m WHERE id NOT IN ('la', 'torino') GROUP BY 1, 2)"""


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = V.table(spark, sf, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, F.lit("la")).otherwise(F.lit("torino")).alias("id")
    )
    return C.candidates(page_links(spark, sf), RULES, FIXES, known)


@query("i09_candidate_heads", f"WITH {CAND} SELECT id, min(provider) AS provider, count(*) AS documents FROM dd GROUP BY 1")
def i09(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf)[0].select("id", "provider", "documents")


@query("i09_candidate_documents", f"WITH {CAND} SELECT id, label, url FROM dd")
def i09_docs(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf)[1]


@query(
    "i10_calendar_documents",
    rf"""WITH {LINKS} SELECT page_id, pos FROM lk WHERE ends_with(regexp_replace(lower(link), '[?#].*$', ''), 'n') AND contains(lower(link), 'example') AND contains(lower(link), '/') AND regexp_matches(lower(label || ' ' || link), 'the|ión|en')""",
)
def i10(spark: SparkSession, sf: str) -> DataFrame:
    docs = page_links(spark, sf).withColumnRenamed("link", "url")
    return C.calendar_documents(docs, ("example", "/"), ("the", "ión", "en"), "n").select("page_id", "pos")
