"""Source catalog: grouping, upsert, cleaning, choosing and checking of documents.

A municipality's documents stay rows; only its few years and notes become arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.text import slug_ascii, title_name

# The group of sources without provider.
UNNAMED = "Altro"


def _years(c: str = "year") -> Column:
    return F.array_sort(F.collect_set(c))


def group_manifest(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows (id, provider, year, label, url) to heads and label-ordered documents."""
    heads = items.groupBy("id").agg(
        F.max("provider").alias("provider"), _years().alias("years"), F.count(F.lit(1)).alias("documents")
    )
    docs = items.select("id", "year", "label", "url").distinct().orderBy("id", "label", "url")
    return heads, docs


def replace_provider(catalog: DataFrame, fresh: DataFrame, provider: str) -> DataFrame:
    """The catalog with ``fresh`` in place of the provider's rows; rows without one stay."""
    return catalog.where(~F.col("provider").eqNullSafe(provider)).unionByName(fresh)


def upsert_heads(existing: DataFrame, found: DataFrame) -> DataFrame:
    """New ids are inserted; of existing ids only notes and years grow, same provider only."""
    f = found.select(
        "id", *[F.col(c).alias(f"_{c}") for c in ("provider", "years", "notes")]
    )
    same = F.col("provider") == F.col("_provider")
    new = F.col("provider").isNull()

    def grown(c: str) -> Column:
        return (
            F.when(new, F.col(f"_{c}"))
            .when(same, F.array_sort(F.array_union(c, f"_{c}")))
            .otherwise(F.col(c))
        )

    status = (
        F.when(new, F.lit("inserted")).when(F.col("_provider").isNull(), F.lit("kept"))
        .when(same, F.lit("updated")).otherwise(F.lit("other provider"))
    )
    return existing.join(f, "id", "full").select(
        "id", F.coalesce("provider", "_provider").alias("provider"),
        grown("years").alias("years"), grown("notes").alias("notes"), status.alias("status"),
    )


def upsert_documents(heads: DataFrame, existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing documents and the unseen urls of inserted or updated ids."""
    allowed = heads.where("status IN ('inserted', 'updated')").select("id")
    unseen = found.join(allowed, "id", "left_semi").join(existing.select("id", "url"), ["id", "url"], "left_anti")
    first = unseen.groupBy("id", "url").agg(F.min("label").alias("label"), F.min("year").alias("year"))
    return existing.select("id", "url", "label", "year").unionByName(first)


def clean(
    docs: DataFrame, blocked: DataFrame, renames: DataFrame, exclude: str, years: Sequence[int]
) -> DataFrame:
    """Blocked ids out, ids renamed, excluded words and other years out, one row per (id, url).

    ``docs`` has id, url, label and year (nullable years stay).
    """
    blob = F.lower(F.concat_ws(" ", "label", "url"))
    kept = (
        docs.join(blocked.select("id").distinct(), "id", "left_anti")
        .where(~blob.rlike(exclude) & (F.col("year").isNull() | F.col("year").isin(*years)))
        .join(renames.select("id", "new_id"), "id", "left")
        .withColumn("id", F.coalesce("new_id", "id"))
    )
    return kept.groupBy("id", "url").agg(F.min("label").alias("label"), F.max("year").alias("year"))


def document_score(blob: Column, points: Sequence[tuple[str, int]]) -> Column:
    """Additive score of the patterns found in a text."""
    total = F.lit(0)
    for pattern, weight in points:
        total = total + F.when(blob.rlike(pattern), weight).otherwise(0)
    return total


def best_documents(docs: DataFrame, points: Sequence[tuple[str, int]], pos: str = "pos") -> DataFrame:
    """Highest scoring document per id; the earlier one wins a tie."""
    blob = F.lower(F.concat_ws(" ", "label", "url"))
    scored = docs.withColumn("score", document_score(blob, points))
    best = F.max(F.struct("score", (-F.col(pos)).alias("neg"), "url", "label"))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.url", "b.label", "b.score")


def dedup_candidates(found: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per new id, preferring rows with documents, then the earliest."""
    fresh = found.join(existing.select("id").distinct(), "id", "left_anti")
    rest = [c for c in found.columns if c not in ("id", "has_docs", "pos")]
    order = F.struct((~F.col("has_docs")).alias("none"), F.col("pos").alias("pos"), *rest)
    return fresh.groupBy("id").agg(F.min(order).alias("b")).select(
        "id", (~F.col("b.none")).alias("has_docs"), "b.pos", *[f"b.{c}" for c in rest]
    )


def group_by_provider(sources: DataFrame) -> DataFrame:
    """Sources per provider and its page if all its sources share one.

    Counts come from (provider, page) rows, so a large provider is combined map-side.
    """
    provider = F.coalesce(F.nullif(F.trim("provider"), F.lit("")), F.lit(UNNAMED))
    per_page = sources.groupBy(provider.alias("provider"), "page").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("provider").agg(
        F.sum("n").alias("sources"),
        F.when(F.count("page") == 1, F.max("page")).alias("page"),
    )


def source_of(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    return requests.join(catalog, "id", "left")


def resolve_choices(stored: DataFrame, index: DataFrame) -> DataFrame:
    """Stored (comune, street, calendar) choices that still exist; others have no mode.

    A choice without calendar only needs its municipality and gives statistics.
    """
    whole = index.select("comune", "street", "calendar").distinct().withColumn("_full", F.lit(True))
    towns = index.select("comune").distinct().withColumn("_town", F.lit(True))
    mode = (
        F.when(F.col("calendar").isNull() & F.col("_town"), F.lit("statistics"))
        .when(F.col("_full"), F.lit("calendar"))
    )
    return (
        stored.join(whole, ["comune", "street", "calendar"], "left")
        .join(towns, "comune", "left")
        .withColumn("mode", mode)
        .drop("_full", "_town")
    )


def provider_of(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Provider of the longest rule prefix the url (without scheme) starts with."""
    bare = F.regexp_replace(url, r"^[a-zA-Z]+://(www\.)?", "")
    out = F.lit(None).cast("string")
    for prefix, provider in sorted(rules, key=lambda rule: len(rule[0])):
        out = F.when(bare.startswith(prefix), F.lit(provider)).otherwise(out)
    return out


def candidates(
    links: DataFrame, rules: Sequence[tuple[str, str]], fixes: dict[str, str], known: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New sources from page links: provider by url, cleaned name, id, unknown ids only.

    Returns (heads id, name, provider, documents; documents id, label, url).
    """
    raw = F.trim(F.regexp_replace(F.regexp_replace("label", r"(?i)\b(comune|calendario|pdf)\b( di)?", " "), r"[^\p{L}' -]+|\s+", " "))
    fixed = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
    named = (
        links.withColumn("provider", provider_of(F.col("link"), rules))
        .where("provider IS NOT NULL")
        .withColumn("name", F.coalesce(F.try_element_at(fixed, F.lower(raw)), raw))
        .where("name <> ''")
        .withColumn("id", slug_ascii(F.col("name")))
    )
    fresh = named.join(known.select("id").distinct(), "id", "left_anti")
    docs = fresh.groupBy("id", "link").agg(F.min("label").alias("label"), F.min("name").alias("name"), F.min("provider").alias("provider"))
    heads = docs.groupBy("id").agg(
        title_name(F.min("name")).alias("name"), F.min("provider").alias("provider"), F.count(F.lit(1)).alias("documents")
    )
    return heads, docs.select("id", "label", F.col("link").alias("url"))


def calendar_documents(docs: DataFrame, path_words: Sequence[str], words: Sequence[str], extension: str) -> DataFrame:
    """Documents by url path and extension that also carry one of the keywords."""
    url, blob = F.lower("url"), F.lower(F.concat_ws(" ", "label", "url"))
    keep = F.regexp_replace(url, r"[?#].*$", "").endswith(extension)
    for w in path_words:
        keep = keep & F.contains(url, F.lit(w))
    return docs.where(keep & blob.rlike("|".join(words)))
