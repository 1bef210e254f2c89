"""Matching names and streets across sources, and choosing codes by votes.

Containment and overlap are turned into equality joins: containment through a rare piece of
the name that is looked for, overlap through a token index split by frequency, the others
through prefixes and suffixes of which one side keeps one best row each. No step compares
all pairs, and a popular name or token costs one row per row that has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.functions import rules as R
from calendra.functions.grams import prefixes, substrings, suffixes
from calendra.functions.lineage import cut, spread
from calendra.functions.numbers import round_to
from calendra.functions.text import collapse, last_token, match_key, strip_accents
from calendra.operators.containment import holding_pairs, lowest_holder
from calendra.operators.overlap import overlap_best
from calendra.operators.recurrence import SCOPED

# Limits and weights of the matching rules.
MIN_CONTAINED = 6
MIN_LAST_TOKEN = 4
COMMON_POINTS, LONG_POINTS, TYPE_POINTS, LONG_TOKEN = 10, 5, 3, 5
ACCEPT_FROM = 10
CONTAIN_POINTS = 50
SEARCH_LIMIT = 80
STOP_WORDS = (
    "VIA", "VIALE", "CORSO", "PIAZZA", "PIAZZALE", "STRADA", "DI", "DEL", "DELLA", "DEI",
    "E", "DA", "A", "AL", "LA", "IL", "PER", "CIVICO",
)
# Up to six common tokens the overlap of a pair can never beat its containment score.
BELOW_CONTAINED = 6


def first_hit(tiers: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Best row per key over tiered candidate frames: lowest tier, then lowest ``order``."""
    tagged = None
    for tier, frame in enumerate(tiers, 1):
        part = frame.select(key, F.lit(tier).alias("tier"), order)
        tagged = part if tagged is None else tagged.unionByName(part)
    best = F.min(F.struct("tier", order))
    return tagged.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def contained(left: DataFrame, right: DataFrame, name: str, payload: str) -> DataFrame:
    """Lowest right payload whose name contains, or is contained in, the left name.

    Both sides have a ``name`` column; the result has the left name and ``payload``.
    """
    names = left.select(name).distinct()
    inside = holding_pairs(names, right.withColumnRenamed(name, "needle"), name).join(
        right.select(F.col(name).alias("needle"), payload), "needle"
    )
    around = lowest_holder(names, right.withColumnRenamed(name, "holder"), name, "holder", payload)
    return inside.select(name, payload).unionByName(around).groupBy(name).agg(F.min(payload).alias(payload))


def match_records(
    seekers: DataFrame, records: DataFrame, aliases: DataFrame, scope: str
) -> DataFrame:
    """Seeker id to record id: alias, exact in the scope, exact anywhere, contained in the scope.

    ``seekers`` has seeker_id and name, ``records`` record_id, name and province,
    ``aliases`` seeker_id and alias. Ties follow the record key.
    """
    rec = records.select("record_id", "province", match_key(F.col("name")).alias("k"))
    any_exact = rec.groupBy("k").agg(F.min("record_id").alias("record_id"))
    scoped = rec.where(F.col("province") == scope)
    in_scope = scoped.groupBy("k").agg(F.min("record_id").alias("record_id"))
    named = seekers.select("seeker_id", match_key(F.col("name")).alias("k"))
    aliased = seekers.join(aliases, "seeker_id").select(
        "seeker_id", match_key(F.col("alias")).alias("k")
    )
    # an exact name anywhere comes before a contained one, so only the others are looked for
    rest = named.select("k").distinct().join(any_exact, "k", "left_anti")
    partial = named.join(contained(rest, in_scope, "k", "record_id"), "k")
    tiers = [
        aliased.join(in_scope, "k"), aliased.join(any_exact, "k"),
        named.join(in_scope, "k"), named.join(any_exact, "k"), partial,
    ]
    return first_hit(tiers, "seeker_id", "record_id")


def unmatched(seekers: DataFrame, matched: DataFrame) -> DataFrame:
    return seekers.join(matched, "seeker_id", "left_anti")


def codes_by_containment(streets: DataFrame, zones: DataFrame) -> DataFrame:
    """Codes of each street name: exact name, else all names containing it or inside it.

    ``streets`` has n and ``zones`` has n and code, both already folded.
    """
    names = streets.where("n <> ''").select("n").distinct()
    codes = zones.where("n <> ''").select("n", "code").distinct()
    exact = names.join(codes, "n")
    rest = names.join(codes.select("n").distinct(), "n", "left_anti").where(
        F.length("n") >= MIN_CONTAINED
    )
    other = codes.withColumnRenamed("n", "other")
    inside = holding_pairs(rest, other, "n", "other")
    around = holding_pairs(other, rest, "other", "n")
    partial = inside.unionByName(around).join(other, "other").select("n", "code").distinct()
    return exact.withColumn("how", F.lit("exact")).unionByName(
        partial.withColumn("how", F.lit("contained"))
    )


def codes_by_last_token(streets: DataFrame, zones: DataFrame) -> DataFrame:
    """Codes of each street name: exact name, else the shortest name ending in its last token."""
    names = streets.where("n <> ''").select("n").distinct()
    codes = zones.where("n <> ''").select("n", "code").distinct()
    keys = codes.select("n").distinct()
    exact = names.join(codes, "n").withColumn("how", F.lit("exact"))
    rest = names.join(keys, "n", "left_anti").withColumn("_t", last_token(F.col("n"))).where(
        F.length("_t") >= MIN_LAST_TOKEN
    )
    index = (
        keys.select(
            F.explode(suffixes(last_token(F.col("n")), MIN_LAST_TOKEN)).alias("_t"),
            F.struct(F.length("n").alias("size"), F.col("n").alias("key")).alias("cand"),
        )
        .groupBy("_t")
        .agg(F.min("cand")["key"].alias("key"))
    )
    near = rest.join(index, "_t").join(codes.withColumnRenamed("n", "key"), "key")
    return exact.unionByName(near.select("n", "code", F.lit("last-token").alias("how")))


def name_tokens(n: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(F.split(n, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(words))


def _token_score(common: Column) -> Column:
    long = F.exists(common, lambda t: F.length(t) >= LONG_TOKEN)
    return F.size(common) * COMMON_POINTS + F.when(long, LONG_POINTS).otherwise(0)


def _named(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "n", name_tokens(F.col("n")).alias("tokens"), F.substring_index("n", " ", 1).alias("first"), *extra
    )


def best_street_match(streets: DataFrame, rows: DataFrame) -> DataFrame:
    """Best row per street: equal or contained name first, else most common tokens.

    ``streets`` has n, ``rows`` has n and a numeric key; lower keys win ties.
    """
    names = streets.where("n <> ''").select("n").distinct()
    keyed = rows.where("n <> ''").groupBy("n").agg(F.min("key").alias("key"))
    direct = contained(names, keyed, "n", "key").select("n", F.lit(None).cast("int").alias("score"), "key")
    rest = names.join(direct, "n", "left_anti")
    scored = overlap_best(_named(rest), _named(keyed, "key"), _token_score, 1, TYPE_POINTS)
    return direct.unionByName(scored.where(F.col("score") >= ACCEPT_FROM))


def resolve_zone_keys(options: DataFrame, schedules: DataFrame) -> DataFrame:
    """Schedule keys of multi-part zone texts, each key once, in the order of the parts.

    ``options`` has option_id and zone; ``schedules`` has n and a numeric key. Per part: equal
    name, else best of containment (50 + shorter length) and overlap (10 per token from two).
    """
    parts = options.select(
        "option_id", F.posexplode(F.split("zone", r"\s*,\s*")).alias("pos", "part")
    ).withColumn("n", fold_zone(F.col("part"))).where("n <> ''")
    names = parts.select("n").distinct()
    keyed = schedules.where("n <> ''").groupBy("n").agg(F.min("key").alias("key"))
    exact = names.join(keyed, "n").select("n", F.lit(100).alias("score"), "key")
    rest = names.join(exact, "n", "left_anti")
    other = keyed.withColumnRenamed("n", "other")
    inside = holding_pairs(rest, other, "n", "other").join(other, "other").select(
        "n", (F.lit(CONTAIN_POINTS) + F.length("other")).alias("score"), "key"
    )
    around = lowest_holder(rest, other, "n", "other", "key").select(
        "n", (F.lit(CONTAIN_POINTS) + F.length("n")).alias("score"), "key"
    )

    def all_words(df: DataFrame, *extra: str) -> DataFrame:
        return df.select(
            "n", F.array_sort(F.array_distinct(F.split("n", " "))).alias("tokens"),
            F.lit("").alias("first"), *extra,
        )

    overlap = overlap_best(
        all_words(rest), all_words(keyed, "key"), lambda c: F.size(c) * COMMON_POINTS, 2, held=BELOW_CONTAINED
    )
    cands = exact.unionByName(inside).unionByName(around).unionByName(overlap)
    best = (
        cands.groupBy("n")
        .agg(F.max(F.struct(F.col("score"), (-F.col("key")).alias("neg"))).alias("b"))
        .where(F.col("b.score") >= ACCEPT_FROM)
        .select("n", (-F.col("b.neg")).alias("key"), F.col("b.score").alias("score"))
    )
    return parts.join(best, "n").groupBy("option_id", "key").agg(
        F.min("pos").alias("pos"), F.max("score").alias("score")
    )


# Sides of a town, weekdays of zone names, times of day at their end.
SIDES = ("NORD", "SUD")
ZONE_WEEKDAYS = ("LUNEDI", "MARTEDI", "MERCOLEDI", "GIOVEDI", "VENERDI", "SABATO", "DOMENICA")
TIME_OF_DAY = r"\s+(MATTINA|POMERIGGIO)\s*$"


def _zone_parts(options: DataFrame, *extra: str) -> DataFrame:
    return options.select(
        "option_id", *extra, F.posexplode(F.split("zone", r"\s*,\s*")).alias("pos", "part")
    ).withColumn("n", fold_zone(F.col("part"))).where("n <> ''")


def _first_places(found: DataFrame) -> DataFrame:
    return found.groupBy("option_id", "key").agg(F.min("pos").alias("pos"))


def week_side_keys(options: DataFrame, schedules: DataFrame) -> DataFrame:
    """Keys of zones that name a side: that of the side's week, else all of side and weekday.

    ``options`` has option_id, zone and week (text with a number, or null); ``schedules`` has n
    and key. Schedules are looked up by side and weekday, of which there are few.
    """

    def first_in(text: Column, words: Sequence[str]) -> Column:
        return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])

    keyed = schedules.where("n <> ''").groupBy("n").agg(F.min("key").alias("key"))
    parts = _zone_parts(options, "week").withColumn("side", first_in(F.col("n"), SIDES)).where("side IS NOT NULL")
    number = F.nullif(F.regexp_extract("week", r"(\d+)", 1), F.lit(""))
    parts = parts.withColumn("week_name", F.concat(F.lit("SETTIMANA "), number, F.lit(" "), F.col("side")))
    exact = parts.join(keyed.withColumnRenamed("n", "week_name"), "week_name")
    rest = parts.join(keyed.select(F.col("n").alias("week_name")), "week_name", "left_anti").select(
        "option_id", "pos", "side", first_in(F.col("n"), ZONE_WEEKDAYS).alias("weekday")
    )

    def named(words: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains("n", F.lit(w)), F.lit(w)) for w in words]))

    sides = keyed.select("key", "n", F.explode(named(SIDES)).alias("side"))
    days = sides.select("key", "side", F.explode(named(ZONE_WEEKDAYS)).alias("weekday"))
    by_day = rest.where("weekday IS NOT NULL").join(days, ["side", "weekday"])
    by_side = rest.where("weekday IS NULL").join(sides.select("key", "side"), "side")
    cols = ("option_id", "key", "pos")
    return _first_places(exact.select(*cols).unionByName(by_day.select(*cols)).unionByName(by_side.select(*cols)))


def timed_zone_keys(options: DataFrame, schedules: DataFrame) -> DataFrame:
    """Keys of zones without their time of day: the equal name, else all contained either way."""
    keyed = schedules.where("n <> ''").groupBy("n").agg(F.min("key").alias("key"))
    parts = _zone_parts(options).withColumn("n", F.trim(F.regexp_replace("n", TIME_OF_DAY, ""))).where("n <> ''")
    names = parts.select("n").distinct()
    exact = names.join(keyed, "n")
    rest = names.join(keyed, "n", "left_anti")
    other = keyed.withColumnRenamed("n", "other")
    pairs = holding_pairs(rest, other, "n", "other").unionByName(holding_pairs(other, rest, "other", "n"))
    found = exact.unionByName(pairs.join(other, "other").select("n", "key")).distinct()
    return _first_places(parts.join(found, "n"))


def fold_zone(c: Column) -> Column:
    s = F.regexp_replace(strip_accents(F.upper(c)), r"['’]", "")
    return collapse(F.regexp_replace(s, r"[–—\-./,()]", " "))


def ordered_needles(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Target of the first needle, in rule order, that the text contains."""
    out = F.lit(None).cast("string")
    for needle, target in reversed(list(rules)):
        out = F.when(F.contains(text, F.lit(needle)), F.lit(target)).otherwise(out)
    return out


# Named zones with the words that stand for them, and the label weights.
NAMED_ZONES = {
    "CENTRO": ("CENTRO", "CENTER"),
    "EST": ("EST", "EAST"),
    "OVEST": ("OVEST", "WEST"),
    "NORD": ("NORD", "NORTH"),
    "SUD": ("SUD", "SOUTH"),
    "CAPOLUOGO": ("CAPOLUOGO",),
    "OLTREPO": ("OLTREPO", "OLTRE PO", "PESCARITO"),
}
ZONE_WEIGHTS = {"zona": 5, "z": 5, "letter": 5, "zletter": 4, "named": 4, "inside": 1}
# Tasks over which the calendars of one municipality and token are dealt.
ZONE_SHARES = 16


def zone_scores(tokens: DataFrame, zones: DataFrame) -> DataFrame:
    """Points of the zones that a token of their municipality has a feature in common with.

    ``tokens`` has comune and token, ``zones`` comune, zone, zf (folded) and own. Every way a
    token can score is a feature listed by both sides and joined by equality. A zone has
    hundreds of features, which Spark takes for one row: zones are spread before they are
    listed, and both sides are sorted.
    """

    def found(pattern: str) -> Column:
        return F.regexp_extract_all("zf", F.lit(pattern), F.lit(1))

    def feature(kind: str, keys: Column) -> Column:
        return F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(
                F.lit(kind).alias("kind"), k.alias("k"), F.lit(ZONE_WEIGHTS[kind]).alias("w")
            ),
        )

    after_z = found(r"\bZ\s*([A-Z0-9]+)\b")
    shorter = F.transform(
        F.filter(after_z, lambda w: w.rlike("[A-Z]$")), lambda w: F.left(w, F.length(w) - 1)
    )
    named = F.array_compact(
        F.array(*[
            F.when(F.col("zf").rlike("|".join(words)), F.lit(key))
            for key, words in NAMED_ZONES.items()
        ])
    )
    zone_features = F.concat(
        feature("zona", found(r"\bZONA\s*([A-Z0-9]+)\b")),
        feature("z", F.concat(after_z, shorter)),
        feature("letter", found(r"\bZONA\s+([A-Z]{1,2})\b")),
        feature("zletter", found(r"\bZ([A-Z]{1,2})\b")),
        feature("named", named),
        feature("inside", substrings(F.replace("zf", F.lit(" "), F.lit("")))),
    )
    zrows = spread(zones, "comune", "zone").distinct().select("comune", "zone", "own", F.inline(zone_features))
    asked = F.concat(
        F.transform(
            F.array(*[F.lit(k) for k in ("zona", "z", "letter", "zletter", "inside")]),
            lambda kind: F.struct(kind.alias("kind"), F.col("token").alias("k")),
        ),
        F.array_compact(
            F.array(*[
                F.when(
                    F.col("token").startswith(key),
                    F.struct(F.lit("named").alias("kind"), F.lit(key).alias("k")),
                )
                for key in NAMED_ZONES
            ])
        ),
    )
    return (
        tokens.where("token <> ''").select("comune", "token", F.inline(asked))
        .join(zrows.hint("merge"), ["comune", "kind", "k"])
        .groupBy("comune", "token", "zone")
        .agg((F.sum("w") + F.max("own")).alias("score"))
    )


def map_zones(calendars: DataFrame, zones: DataFrame) -> DataFrame:
    """Best-scoring zones of each calendar within its municipality.

    ``calendars`` has comune, calendar and slug (ending ``-z<token>``), ``zones`` comune and
    zone. Calendars of one municipality and token have the same zones, so each pair of these
    is scored once and only the result meets the calendars. A zone's own points come on top
    of its ``zone_scores``, and zones without any common feature only count where their own
    points are the best on offer. ``UNICA`` takes every zone.

    No side is broadcast, as all of them grow with calendars or zones. The calendars of a pair
    are dealt over ``ZONE_SHARES`` tasks, each with the zones of the pair.
    """
    token = F.upper(F.regexp_extract("slug", r"-z([a-z0-9]+)$", 1))
    cals = calendars.select("comune", "calendar", token.alias("token"))
    zf = R.fold_rule(F.col("zone"))
    own = F.when(F.contains("zf", F.lit("SMART 5")), -1).otherwise(0) + F.when(
        F.contains("zf", F.lit("SOLO RSU")) | F.contains("zf", F.lit("PORTA")), 1
    ).otherwise(0)
    zns = zones.select("comune", "zone", zf.alias("zf")).withColumn("own", own)
    pair = ["comune", "token"]
    tokens = cals.where("token <> 'UNICA'").select(*pair).distinct()
    hits = cut(zone_scores(tokens, zns))
    base = zns.groupBy("comune").agg(F.max("own").alias("base"))
    best = (
        tokens.join(base.hint("merge"), "comune")
        .join(hits.groupBy(*pair).agg(F.max("score").alias("hit")).hint("merge"), pair, "left")
        .select(*pair, F.greatest("base", F.coalesce("hit", "base")).alias("best"))
        .where("best > 0")
    )
    by_hit = hits.join(best.hint("merge"), pair).where("score = best").select(*pair, "zone", "score")
    # Own points alone: all zones of the municipality that reach the best without a feature.
    by_own = (
        best.where("best = 1")
        .join(zns.where("own = 1").hint("merge"), "comune")
        .select(*pair, "zone", F.col("own").alias("score"))
        .join(hits.select(*pair, "zone").hint("merge"), [*pair, "zone"], "left_anti")
    )
    cast = F.col("score").cast("int").alias("score")
    everything = zns.select("comune", F.lit("UNICA").alias("token"), "zone", F.lit(None).cast("int").alias("score"))
    taken = by_hit.unionByName(by_own).select(*pair, "zone", cast).unionByName(everything)
    shares = F.explode(F.sequence(F.lit(0), F.lit(ZONE_SHARES - 1)))
    share = F.pmod(F.xxhash64("calendar"), F.lit(ZONE_SHARES)).cast("int")
    asking = spread(cals.withColumn("_share", share), *pair, "_share")
    given = spread(taken.withColumn("_share", shares), *pair, "_share")
    return asking.join(given.hint("merge"), [*pair, "_share"]).select("calendar", "zone", "score")


# --- votes --------------------------------------------------------------------------


def count_votes(votes: DataFrame) -> DataFrame:
    return votes.where("code IS NOT NULL").groupBy("grp", "code").agg(F.count(F.lit(1)).alias("n"))


def coverage(streets: DataFrame, min_matched: int) -> DataFrame:
    """Matched and total streets per group that reaches the minimum; matched is a flag."""
    return (
        streets.groupBy("grp")
        .agg(F.count_if("matched").alias("matched"), F.count(F.lit(1)).alias("total"))
        .where(F.col("matched") >= min_matched)
    )


def dominant(counts: DataFrame) -> DataFrame:
    """Most voted code per group with its share and votes; ties go to the lower code."""
    return counts.groupBy("grp").agg(
        F.max_by("code", F.struct(F.col("n"), -F.col("code"))).alias("code"),
        round_to(F.lit(100.0) * F.max("n") / F.sum("n"), 2).alias("share"),
        F.sum("n").alias("votes"),
    )


def with_fallback(groups: DataFrame, chosen: DataFrame, counts: DataFrame) -> DataFrame:
    """Chosen code per group, or the overall most voted code where a group has none."""
    overall = counts.groupBy("code").agg(F.sum("n").alias("n")).agg(
        F.max_by("code", F.struct(F.col("n"), -F.col("code"))).alias("mode")
    )
    return groups.join(chosen.select("grp", "code"), "grp", "left").select(
        "grp", F.coalesce("code", overall.scalar()).alias("code"), F.col("code").isNull().alias("fallback")
    )


def top_codes(counts: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Top code, and the second if it has at least max(2, floor(ratio × top)) votes."""
    ranked = counts.withColumn(
        "rank", F.row_number().over(W.partitionBy("grp").orderBy(F.col("n").desc(), "code"))
    ).where("rank <= 2")
    tops = ranked.where("rank = 1").select("grp", F.col("n").alias("top"))
    need = F.greatest(F.lit(2), F.floor(F.lit(ratio) * F.col("top")))
    return ranked.join(tops, "grp").where((F.col("rank") == 1) | (F.col("n") >= need)).drop("top")


def rule_specificity(rules: DataFrame, zone: str = "code") -> DataFrame:
    """Highest usefulness score of a zone's rules, never below zero."""
    rules = rules.withColumns(
        {"_t": R.fold_rule(F.col("rule")), "_k": R.fold_rule(F.concat_ws(" ", "type", "rule"))}
    )
    text, kind = F.col("_t"), F.col("_k")
    filled = F.trim("rule") != ""
    dated = (F.size(R.active_months_of(text)) > 0) | text.rlike(SCOPED)
    score = (
        F.when(kind.rlike("MECCANIZZATO|MISTO"), 3).otherwise(0)
        + F.when(F.size(R.ordinals_of(text)) > 0, 3).otherwise(0)
        + F.when(dated, 3).otherwise(0)
        + F.when(filled, 1).otherwise(0)
        - F.when(F.contains(kind, F.lit("MANUALE")) & ~filled, 1).otherwise(0)
    )
    return rules.groupBy(zone).agg(F.greatest(F.lit(0), F.max(score)).alias("spec"))


def select_codes(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """One or two codes per group by votes and specificity.

    Candidates have at least half the top votes (and two). A vague leader gives way to
    specific codes. The best by (specificity, votes) is taken, and the next one with enough
    votes, close specificity and not both vague. All picks are combined aggregates.
    """
    usable = counts.join(specs, "code")
    order = F.struct(F.col("n"), -F.col("code"))
    heads = usable.groupBy("grp").agg(
        F.max("n").alias("top"),
        F.max_by("spec", order).alias("leader_spec"),
        F.count_if((F.col("spec") >= 7) & (F.col("n") >= 2)).alias("specific"),
    )
    half = F.greatest(F.lit(2), F.floor(F.lit(0.5) * F.col("top")))
    vague = (F.col("leader_spec") <= 1) & (F.col("specific") > 0)
    keep = (
        F.when(vague, (F.col("spec") >= 7) & (F.col("n") >= 2))
        .when(F.col("top") >= 2, F.col("n") >= half)
        .otherwise(True)
    )
    cands = usable.join(heads, "grp").where(keep).select("grp", "code", "n", "spec")
    pick = F.max(F.struct("spec", "n", (-F.col("code")).alias("neg")))
    first = cands.groupBy("grp").agg(pick.alias("b")).select(
        "grp", F.col("b.spec").alias("spec1"), F.col("b.n").alias("n1"), (-F.col("b.neg")).alias("code1")
    )
    second = (
        cands.join(first, "grp")
        .where(
            (F.col("code") != F.col("code1"))
            & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.lit(0.8) * F.col("n1"))))
            & (F.abs(F.col("spec") - F.col("spec1")) <= 2)
            & ~((F.col("spec") <= 1) & (F.col("spec1") <= 1))
        )
        .groupBy("grp")
        .agg(pick.alias("b"))
        .select("grp", (-F.col("b.neg")).alias("code"), F.lit(2).alias("rank"))
    )
    return first.select("grp", F.col("code1").alias("code"), F.lit(1).alias("rank")).unionByName(second)


# Accepted days per year.
MIN_DAYS, MAX_DAYS = 4, 180


def select_code(counts: DataFrame, schedules: DataFrame) -> DataFrame:
    """One code per group by (density ok, mechanised, votes, fewer days, code).

    ``schedules`` has code, days and mechanised. Without an acceptable density the best
    code that still has days, up to the maximum, is taken.
    """
    ok = F.col("days").between(MIN_DAYS, MAX_DAYS)
    order = F.struct(
        ok.alias("ok"), F.col("mechanised"), F.col("n"), (-F.col("days")).alias("neg_days"), F.col("code")
    )
    picks = (
        counts.join(schedules, "code")
        .groupBy("grp")
        .agg(
            F.max(order).alias("best"),
            F.max(F.when(F.col("days").between(1, MAX_DAYS), order)).alias("spare"),
        )
    )
    chosen = F.when(F.col("best.ok"), F.col("best")).otherwise(F.col("spare"))
    return picks.select("grp", chosen.alias("c")).where("c IS NOT NULL").select(
        "grp", "c.code", (-F.col("c.neg_days")).alias("days")
    )


# --- search and labels --------------------------------------------------------------


def search_key(c: Column) -> Column:
    return F.trim(F.lower(strip_accents(F.coalesce(c, F.lit("")))))


def ranked_search(items: DataFrame, name: str, key: str, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Accent-insensitive search on the name: exact, prefix, then substring; top ``limit``."""
    q = search_key(F.lit(text))
    n = search_key(F.col(name))
    rank = F.when(n == q, 0).when(n.startswith(q), 1).otherwise(2)
    hits = items.where(F.contains(n, q)).withColumn("rank", F.when(q == "", 0).otherwise(rank))
    return hits.orderBy("rank", name, key).limit(limit)


def resolve_by_prefix(seekers: DataFrame, options: DataFrame, aliases: DataFrame) -> DataFrame:
    """Option id of a name: alias or own name exactly, then a prefix in either direction.

    ``seekers`` and ``options`` have name; options also option_id; aliases name and alias.
    """
    norm = F.lower(F.trim("name"))
    opts = options.select(norm.alias("k"), "option_id").groupBy("k").agg(
        F.min("option_id").alias("option_id")
    )
    renamed = aliases.select(F.col("name").alias("k0"), F.lower(F.trim("alias")).alias("alias"))
    keys = (
        seekers.select("seeker_id", norm.alias("k0"))
        .join(renamed, "k0", "left")
        .select("seeker_id", F.coalesce("alias", "k0").alias("k"))
    )
    exact = keys.join(opts, "k")
    names = keys.select("k").distinct()
    shorter = names.withColumn("p", F.explode(prefixes(F.col("k")))).join(
        opts.withColumnRenamed("k", "p"), "p"
    ).select("k", "option_id")
    index = opts.withColumn("p", F.explode(prefixes(F.col("k")))).groupBy("p").agg(
        F.min("option_id").alias("option_id")
    )
    longer = names.join(index, F.col("k") == F.col("p")).select("k", "option_id")
    near = shorter.unionByName(longer).groupBy("k").agg(F.min("option_id").alias("option_id"))
    return first_hit([exact, keys.join(near, "k")], "seeker_id", "option_id")


def is_zone_label(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^zona\b")


def street_groups(names: DataFrame, mapped: DataFrame) -> DataFrame:
    """Streets per calendar: two or more real names, else mapped zone streets, else any real
    name, else the municipality as a whole.

    ``names`` has comune, calendar and name; ``mapped`` calendar and name. A calendar of the
    fourth tier is one row with its comune and no name; ``expanded_streets`` lists its names.
    """
    real = names.where(~is_zone_label(F.col("name")))
    cals = names.groupBy("comune", "calendar").agg(
        F.count_if(~is_zone_label(F.col("name"))).alias("n_real")
    )
    has_map = mapped.select("calendar").distinct().withColumn("has_map", F.lit(True))
    tier = (
        F.when(F.col("n_real") >= 2, 1)
        .when(F.col("has_map"), 2)
        .when(F.col("n_real") >= 1, 3)
        .otherwise(4)
    )
    tiers = cals.join(has_map, "calendar", "left").select("comune", "calendar", tier.alias("tier"))
    own = tiers.where("tier IN (1, 3)").join(real.drop("comune"), "calendar")
    by_map = tiers.where("tier = 2").join(mapped, "calendar")
    rest = tiers.where("tier = 4").withColumn("name", F.lit(None).cast("string"))
    cols = ["calendar", "tier", "comune", "name"]
    return own.select(*cols).unionByName(by_map.select(*cols)).unionByName(rest.select(*cols))


def expanded_streets(groups: DataFrame, everything: DataFrame) -> DataFrame:
    """Calendar, tier and name, with all of ``everything`` (comune and name) for whole municipalities."""
    whole = F.col("tier") == 4
    named = groups.where(~whole).select("calendar", "tier", "name")
    return named.unionByName(groups.where(whole).drop("name").join(everything, "comune").select("calendar", "tier", "name"))


def directory_label(name: Column, province: Column) -> Column:
    known = F.nullif(F.trim(F.coalesce(province, F.lit(""))), F.lit(""))
    return F.when(known.isNotNull(), F.concat(name, F.lit(" ("), known, F.lit(")"))).otherwise(name)
