"""Municipal waste measures: row classes, shared data, units, clusters, ids, yearly build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.functions.numbers import per_head_kg, population_bound, round_to, share_pct
from calendra.functions.text import match_key, slug_unicode, title_name
from calendra.operators import distribution as D

# Row classes, cluster number, label texts and the smallest peer group shown.
OWN, HEAD, MEMBER = "comune", "aggregazione:", "vedi aggregazione:"
CLUSTERS = 4
LABEL_FIRST, LABEL_MIDDLE, LABEL_LAST = "fino a ~%s ab.", "~%s-%s ab.", "oltre ~%s ab."
MIN_PEERS = 30


def row_class(text: Column) -> Column:
    """Struct (kind, name): own data, group head, group member, or skip."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    after = F.trim(F.substring(t, F.instr(t, ":") + 1, F.length(t)))

    def kind(k: str, name: Column) -> Column:
        return F.struct(F.lit(k).alias("kind"), name.alias("name"))

    none = F.lit(None).cast("string")
    return (
        F.when(low == OWN, kind("own", none))
        .when(low.startswith(HEAD), kind("head", after))
        .when(low.startswith(MEMBER), kind("member", after))
        .otherwise(kind("skip", F.nullif(t, F.lit(""))))
    )


def identity(rows: DataFrame) -> DataFrame:
    """Trimmed identity columns; rows without population, key or name are dropped."""

    def clean(name: str) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"^\t+", ""))

    return rows.select(
        clean("id").alias("id"),
        clean("name").alias("name"),
        clean("region").alias("region"),
        clean("province").alias("province"),
        F.col("pop").cast("bigint").alias("pop"),
    ).where("pop > 0 AND id <> '' AND name <> ''")


def waste(rows: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Waste columns with mix shares of the sorted total; rows without RD % or total dropped."""
    return rows.where("rd_pct IS NOT NULL AND ru_t IS NOT NULL").withColumn(
        "rd_pct", round_to("rd_pct", 2)
    ).withColumns({f"mix_{p}": share_pct(p, "rd_t") for p in parts})


def per_capita(pop: Column | str) -> list[Column]:
    return [
        per_head_kg("ru_t", pop).alias("kg_ru"),
        per_head_kg("ind_t", pop).alias("kg_ind"),
        per_head_kg("rd_t", pop).alias("kg_rd"),
    ]


SHARED = ["id", "pop", "rd_pct", "kg_ru", "kg_ind", "kg_rd", "group_name", "group_n", "group_pop"]


def classified(rows: DataFrame) -> DataFrame:
    c = row_class(F.col("dato"))
    return rows.withColumn("kind", c["kind"]).withColumn("key", match_key(c["name"])).withColumn(
        "group_label", c["name"]
    )


def group_facts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` (a year) and group key: head's waste, distinct members and their
    summed population.

    Rows are reduced to (key, id) and then to one row per key, both combined map-side, so
    a group that holds a third of the rows never meets in one task.
    """
    is_head = F.col("kind") == "head"
    head = F.struct("group_label", "rd_pct", "ru_t", "rd_t", "ind_t")
    return (
        classified(rows)
        .where(F.col("kind").isin("head", "member") & (F.col("key") != ""))
        .groupBy(*by, "key", "id")
        .agg(
            F.max(F.when(F.col("pop") > 0, F.col("pop"))).alias("pop"),
            F.min("group_label").alias("any_label"),
            F.max(F.when(is_head, head)).alias("head"),
        )
        .groupBy(*by, "key")
        .agg(
            F.min("any_label").alias("any_label"),
            F.max_by("head", F.when(F.col("head").isNotNull(), F.col("id"))).alias("head"),
            F.count("pop").alias("group_n"),
            F.sum("pop").alias("group_pop"),
        )
        .select(*by, "key", "any_label", "head.*", "group_n", "group_pop")
    )


def usable_groups(facts: DataFrame) -> DataFrame:
    return facts.where("rd_pct IS NOT NULL AND ru_t IS NOT NULL AND group_n > 0")


def group_warnings(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups that cannot be used, with the reason."""
    reason = (
        F.when(F.col("group_label").isNull(), F.lit("no head row"))
        .when(F.col("rd_pct").isNull() | F.col("ru_t").isNull(), F.lit("no waste"))
        .when(F.col("group_n") == 0, F.lit("no valid members"))
    )
    return facts.select(*by, "key", "any_label", reason.alias("reason")).where("reason IS NOT NULL")


def shared_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Own rows keep their data; group members get the head's data over the group's people.

    Group rows win over own rows of the same id. ``by`` keeps years apart.
    """
    c = classified(rows)
    own = (
        c.where("kind = 'own' AND pop > 0 AND rd_pct IS NOT NULL AND ru_t IS NOT NULL")
        .select(
            *by, "id", "pop", round_to("rd_pct", 2).alias("rd_pct"), *per_capita("pop"),
            F.lit(None).cast("string").alias("group_name"),
            F.lit(None).cast("bigint").alias("group_n"),
            F.lit(None).cast("bigint").alias("group_pop"),
            F.lit(0).alias("prio"),
        )
    )
    members = c.where("kind IN ('head', 'member') AND pop > 0").select(*by, "key", "id", "pop").distinct()
    facts = usable_groups(group_facts(rows, by)).drop("any_label")
    shared = members.join(facts, [*by, "key"]).select(
        *by, "id", "pop", round_to("rd_pct", 2).alias("rd_pct"), *per_capita("group_pop"),
        F.col("group_label").alias("group_name"), "group_n", "group_pop", F.lit(1).alias("prio"),
    )
    best = F.max_by(F.struct(*SHARED[1:]), F.struct("prio", "group_name"))
    return own.unionByName(shared).groupBy(*by, "id").agg(best.alias("m")).select(*by, "id", "m.*")


def attach_costs(metrics: DataFrame, costs: DataFrame) -> DataFrame:
    return metrics.join(costs.select("id", "cost"), "id", "left")


def statistical_units(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per own municipality and one per multi-member group, with the group's people."""
    grouped = F.col("group_n") >= 2
    unit_key = F.when(grouped, F.concat(F.lit("g:"), match_key(F.col("group_name")))).otherwise(
        F.concat(F.lit("m:"), F.col("id").cast("string"))
    )
    cols = [c for c in metrics.columns if c not in by]
    return (
        metrics.groupBy(*by, unit_key.alias("unit_key"))
        .agg(F.min_by(F.struct(*cols), F.col("id")).alias("u"))
        .select(*by, "unit_key", "u.*")
        .withColumn("pop", F.when(grouped, F.col("group_pop")).otherwise(F.col("pop")))
    )


def cluster_pop() -> Column:
    return F.when(F.col("group_n") >= 2, F.col("group_pop")).otherwise(F.col("pop"))


def cluster_edges(units: DataFrame, by: Sequence[str], k: int = CLUSTERS) -> DataFrame:
    """Population edges per year; none where there are fewer units than clusters."""
    usable = units.where("pop IS NOT NULL AND rd_pct IS NOT NULL")
    edges = D.quantile_edges(D.distribution(usable, by, "pop", digits=0), by, k)
    return edges.where(F.col("total") >= k).drop("total")


def band(pop: Column, edges: Column) -> Column:
    """Cluster number 0..k-1: how many edges lie strictly below the population."""
    return F.size(F.filter(edges, lambda e: pop > e))


def population_clusters(units: DataFrame, by: Sequence[str], k: int = CLUSTERS) -> DataFrame:
    """Closed population ranges with label, medians and counts of RD and cost."""
    by = list(by)
    edges = cluster_edges(units, by, k)
    i = F.col("ordinal") - 1

    def edge(n: Column) -> Column:
        return F.try_element_at("edges", n.cast("int"))

    lo = F.when(i == 0, F.lit(0)).otherwise(edge(F.greatest(i, F.lit(1))) + 1)
    hi = F.when(i < k - 1, edge(i + 1))
    label = (
        F.when(i == 0, F.format_string(LABEL_FIRST, population_bound(edge(i + 1))))
        .when(i == k - 1, F.format_string(LABEL_LAST, population_bound(edge(F.greatest(i, F.lit(1))))))
        .otherwise(
            F.format_string(
                LABEL_MIDDLE, population_bound(edge(F.greatest(i, F.lit(1)))), population_bound(edge(i + 1))
            )
        )
    )
    bands = edges.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(
        *by, F.concat(F.lit("p"), i).alias("cluster"), "ordinal",
        lo.cast("bigint").alias("lo"), hi.alias("hi"), label.alias("label"),
    )
    banded = units.where("pop IS NOT NULL AND rd_pct IS NOT NULL").join(edges, by).withColumn(
        "cluster", F.concat(F.lit("p"), band(F.col("pop"), F.col("edges")))
    )
    long = D.unpivot_measures(banded, [*by, "cluster"], ["rd_pct", "cost"])
    groups = [*by, "cluster", "measure"]
    med = (
        D.distribution(long, groups, "value")
        .groupBy(*groups)
        .agg(round_to(D.median_agg(), 2).alias("median"), F.sum("n").alias("n"))
        .groupBy(*by, "cluster")
        .agg(
            F.max(F.when(F.col("measure") == "rd_pct", F.col("median"))).alias("rd_median"),
            F.max(F.when(F.col("measure") == "rd_pct", F.col("n"))).alias("rd_n"),
            F.max(F.when(F.col("measure") == "cost", F.col("median"))).alias("cost_median"),
            F.max(F.when(F.col("measure") == "cost", F.col("n"))).alias("cost_n"),
        )
    )
    return bands.join(med, [*by, "cluster"], "left").fillna(0, ["rd_n", "cost_n"])


def assign_clusters(records: DataFrame, units: DataFrame, by: Sequence[str], k: int = CLUSTERS) -> DataFrame:
    """Cluster of each record on its (group) population and its deltas to the peer medians.

    The peer deltas stay; ``peer_shown`` tells whether the peer group is large enough.
    """
    by = list(by)
    edges = cluster_edges(units, by, k)
    clusters = population_clusters(units, by, k).select(
        *by, "cluster", "rd_median", "rd_n", "cost_median"
    )
    return (
        records.join(edges, by, "left")
        .withColumn("cluster", F.concat(F.lit("p"), band(cluster_pop(), F.col("edges"))))
        .drop("edges")
        .join(clusters, [*by, "cluster"], "left")
        .withColumn("rd_vs_peers", round_to(F.col("rd_pct") - F.col("rd_median"), 2))
        .withColumn("cost_vs_peers", round_to(F.col("cost") - F.col("cost_median"), 1))
        .withColumn("peer_shown", F.coalesce(F.col("rd_n") >= MIN_PEERS, F.lit(False)))
        .drop("rd_median", "cost_median", "rd_n")
    )


def assign_ids(metrics: DataFrame, known: DataFrame) -> DataFrame:
    """Public ids: known ids first, then slug, slug-province if shared, key suffix if taken.

    ``metrics`` has id, name, province; ``known`` has id, public_id. The first key (in key
    order) keeps a contested id; it is found by a combined minimum, not by ordering a group.
    """
    base = slug_unicode(F.col("name"))
    pending = metrics.join(known.select("id"), "id", "left_anti").withColumn("base", base)
    shared = pending.groupBy("base").agg((F.count(F.lit(1)) > 1).alias("is_shared"))
    candidates = pending.join(shared, "base").withColumn(
        "cid",
        F.when(F.col("is_shared"), F.concat_ws("-", "base", slug_unicode(F.col("province"))))
        .otherwise(F.col("base")),
    )
    owners = candidates.groupBy("cid").agg(F.min("id").alias("owner"))
    taken = known.select(F.col("public_id").alias("cid")).distinct().withColumn("taken", F.lit(True))
    clash = F.coalesce(F.col("taken"), F.lit(False)) | (F.col("owner") != F.col("id"))
    fresh = candidates.join(owners, "cid").join(taken, "cid", "left").select(
        "id",
        F.when(clash, F.concat_ws("-", "cid", F.right(F.col("id").cast("string"), F.lit(4))))
        .otherwise(F.col("cid"))
        .alias("public_id"),
        title_name(F.col("name")).alias("display"),
        F.lit(False).alias("has_calendar"),
    )
    kept = metrics.join(known, "id").select(
        "id", "public_id", F.col("name").alias("display"), F.lit(True).alias("has_calendar")
    )
    return kept.unionByName(fresh)


def directory(records: DataFrame, calendars: DataFrame) -> DataFrame:
    """All records with a calendar flag, ordered by name and id."""
    flagged = calendars.select("id").distinct().withColumn("has_calendar", F.lit(True))
    return (
        records.join(flagged, "id", "left")
        .withColumn("has_calendar", F.coalesce("has_calendar", F.lit(False)))
        .orderBy("name", "id")
    )


def with_calendar_only(records: DataFrame, calendars: DataFrame) -> DataFrame:
    return records.join(calendars.select("id").distinct(), "id", "left_semi").orderBy("name", "id")


YEARLY_MEASURES = {"rd_pct": 2, "kg_ru": 1, "kg_ind": 1, "kg_rd": 1, "cost": 1}
LEVELS = ("region", "province", "cluster")


def with_cluster(rows: DataFrame, edges: DataFrame, by: Sequence[str], pop: Column) -> DataFrame:
    return rows.join(edges, list(by), "left").withColumn(
        "cluster", F.concat(F.lit("p"), band(pop, F.col("edges")))
    ).drop("edges")


def yearly_frame(met: DataFrame, units: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Population edges, and the distribution frame of all measures over all areas and clusters.

    The frame is the only one of a build: summaries, medians and ranks read it.
    """
    edges = cluster_edges(units, by)
    clustered = with_cluster(units, edges, by, F.col("pop"))
    # clusters count units with a population and a rate only
    clustered = clustered.withColumn("cluster", F.when(F.col("pop").isNotNull() & F.col("rd_pct").isNotNull(), F.col("cluster")))
    return edges, D.area_frame(clustered, by, LEVELS, list(YEARLY_MEASURES), lookups=met)


def baselines(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summary of every measure and area, with the share that reaches the target rate."""
    groups = [*by, "level", "area", "measure"]
    reached = F.sum(F.when(F.col("value") >= D.TARGET_PCT, F.col("n")).otherwise(0))
    share = F.when(F.col("measure") == "rd_pct", round_to(F.lit(100.0) * reached / F.sum("n"), 1))
    return frame.groupBy(*groups).agg(
        F.sum("n").alias("n"), round_to(D.mean_agg(), 2).alias("mean"), round_to(D.median_agg(), 2).alias("median"),
        D.at_index(D.floor_index(0.10)).alias("p10"), D.at_index(D.floor_index(0.90)).alias("p90"), share.alias("share_ok"),
    )


def yearly_records(
    met: DataFrame, edges: DataFrame, frame: DataFrame, ids: DataFrame, by: str, first: int, last: int,
) -> DataFrame:
    """Served record of every municipality and year.

    Ranks and deltas against units of the country, region, province and population cluster,
    headline, national rank band, series of years with its change, and public id. ``met`` and
    ``frame`` are read by several branches, so callers pass tables or checkpoints. ``ids`` has
    id and public_id, ``by`` is the year.
    """
    keys, measures = [by], list(YEARLY_MEASURES)
    medians = frame.groupBy(by, "level", "area", "measure").agg(round_to(D.median_agg(), 2).alias("median"), F.sum("n").alias("n"))
    areas = D.medians_by_key(medians, keys, measures)
    peers = medians.where("level = 'cluster' AND measure = 'rd_pct'").select(by, F.col("area").alias("cluster"), F.col("n").alias("rd_n"))
    ranked = ("rd_pct", "kg_ru", "kg_ind")
    found = D.unpivot_measures(met, [by, "id"], ranked).join(D.ranks_by_value(frame, keys), [by, "measure", "value"])

    def rank(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    ranks = found.groupBy(by, "id").agg(
        rank("rd_pct", "below").alias("rd_pctile"), rank("rd_pct", "total").alias("ranked"),
        rank("kg_ru", "below").alias("kg_pctile"), rank("kg_ind", "above").alias("ind_better_pctile"),
    )
    series = D.year_series(met, "id", "rd_pct").withColumn("delta_pp", D.series_delta(F.col("series"), first, last))
    text = F.transform(F.map_entries("series"), lambda e: F.format_string("%s:%.2f", e["key"], e["value"]))
    out = (
        with_cluster(met, edges, keys, cluster_pop())
        .join(areas, by, "left").join(peers, [by, "cluster"], "left")
        .join(ranks, [by, "id"], "left").join(series, "id", "left").join(ids, "id", "left")
    )
    area_of = {"country": F.lit("*"), "region": F.col("region"), "province": F.col("province"), "cluster": F.col("cluster")}

    def delta(measure: str, level: str) -> Column:
        return round_to(F.col(measure) - D.median_of(level, area_of[level], measure), YEARLY_MEASURES[measure])

    hook = D.headline(F.col("rd_pct"), F.col("rd_pctile"))
    return out.select(
        "id", "public_id", "name", "province", "region", by, "pop", *measures, "rd_pctile", "kg_pctile", "ind_better_pctile",
        D.rank_band(F.col("rd_pctile"), F.col("ranked")).alias("rank_band"),
        round_to(F.col("rd_pct") - D.TARGET_PCT, 2).alias("gap_target"),
        *[delta(m, level).alias(f"{m}_vs_{level}") for m in measures for level in ("country", "region", "province")],
        "cluster", delta("rd_pct", "cluster").alias("rd_vs_peers"), delta("cost", "cluster").alias("cost_vs_peers"),
        F.coalesce(F.col("rd_n") >= MIN_PEERS, F.lit(False)).alias("peer_shown"),
        hook["key"].alias("hook_key"), hook["text"].alias("hook_text"), F.array_join(text, ",").alias("series"), "delta_pp",
    )
