"""Nearest, as-of and interval matching of marks to anchors, and grids built from them.

Marks are never paired with every anchor of a page: both are merged into one ordered
sequence per key and each mark takes the anchor before and the anchor after it, with
bucketed scans so that a crowded page is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.operators.scans import gap_runs, previous_row, rejoin

# Colour limits, row overlap, strip and bucket sizes, yields and grid presets.
COLOUR_LIMITS = {"loose": 0.12, "tight": 0.08}
ROW_OVERLAP = 5.0
STRIP_BUCKET = 5
TOKEN_BUCKET = 20.0
TOKEN_GAP = 3.0
GOOD_YIELD, FAIR_YIELD = 20, 12
SPLIT_SPREAD = 120.0
LETTER_BUCKET, LETTER_BAND = 6.0, 14.0
LABEL_BAND, LABEL_REACH, LABEL_SLACK = 10.0, 80.0, 5.0
ICON_COLUMN, ICON_ROW = 48.0, 40.0
MARK_REACH = 20.0


def neighbours(
    marks: DataFrame, anchors: DataFrame, keys: Sequence[str], axis: str, payload: str,
    bucket_width: float, mark_id: str,
) -> DataFrame:
    """Marks with structs ``before`` and ``after``: the anchors around them on one axis.

    An anchor at the mark's own position counts as before; of equal anchors the lowest
    payload is met. ``mark_id`` orders equal marks. Both directions are windows over one sort
    of the buckets, and one pass over their first and last anchors carries across buckets.
    """
    keys = list(keys)
    anchor = F.struct(F.col(axis).cast("double").alias("at"), F.col(payload).alias("value"))
    a = anchors.select(
        *keys, F.col(axis).cast("double").alias("_x"), F.lit(0).alias("_kind"),
        (-F.col(payload).cast("bigint")).alias("_tie"), anchor.alias("_anchor"),
        F.lit(None).cast(marks.select(F.struct("*")).schema[0].dataType).alias("_mark"),
    )
    m = marks.select(
        *keys, F.col(axis).cast("double").alias("_x"), F.lit(1).alias("_kind"),
        F.col(mark_id).cast("bigint").alias("_tie"),
        F.lit(None).cast(a.schema["_anchor"].dataType).alias("_anchor"), F.struct("*").alias("_mark"),
    )
    merged = a.unionByName(m).withColumn("_b", F.floor(F.col("_x") / bucket_width))
    by_key = W.partitionBy(*keys).orderBy("_b")
    is_anchor = F.col("_kind") == 0
    last_at = F.when(is_anchor, F.struct("_x", "_tie"))
    first_at = F.when(is_anchor, F.struct("_x", -F.col("_tie")))
    carried = merged.groupBy(*keys, "_b").agg(
        F.max_by("_anchor", last_at).alias("_last"), F.min_by("_anchor", first_at).alias("_first")
    ).select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(by_key.rowsBetween(W.unboundedPreceding, -1)).alias("_below"),
        F.first("_first", ignorenulls=True).over(by_key.rowsBetween(1, W.unboundedFollowing)).alias("_above"),
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_x", "_kind", "_tie")
    # the last of equal anchors has the lowest payload
    follows = F.struct(F.lead("_kind").over(inside).alias("kind"), F.lead("_x").over(inside).alias("x"))
    lowest = is_anchor & ~F.coalesce((follows["kind"] == 0) & (follows["x"] == F.col("_x")), F.lit(False))
    both = rejoin(merged.withColumn("_lowest", F.when(lowest, F.col("_anchor"))), carried, keys, "_below", "_above").withColumns({
        "before": F.coalesce(F.last("_anchor", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_below")),
        "after": F.coalesce(F.first("_lowest", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing)), F.col("_above")),
    })
    return both.where("_kind = 1").select("_mark.*", "before", "after")


def nearest_in_reach(
    marks: DataFrame, anchors: DataFrame, keys: Sequence[str], axis: str, payload: str, reach: float, out: str = "anchor",
    carried: Sequence[str] = (),
) -> DataFrame:
    """Each mark's closest anchor on one axis within ``reach``; the lower one wins a tie.

    The mark gets the anchor's payload, and its columns ``carried`` under their own names.

    Anchors go to every bucket of the reach's width that they reach into, so that a mark finds
    them in its own bucket: one exchange, and nothing is carried across buckets.
    """
    keys = list(keys)
    at, value = F.col(axis).cast("double"), F.col(payload)
    low, high = (F.floor((at + d) / reach) for d in (-reach, reach))
    # keys stay out of the struct, so that marks which are dealt by them are not dealt again
    mark = F.struct(*[c for c in marks.columns if c not in keys])
    a = anchors.where(at.isNotNull()).select(
        *keys, F.struct(at.alias("at"), value.alias("value"), *carried).alias("_anchor"), F.explode(F.sequence(low, high)).alias("_b"), F.lit(0).alias("_kind"), at.alias("_x"),
        (-value.cast("bigint")).alias("_tie"), F.lit(None).cast(marks.select(mark).schema[0].dataType).alias("_mark"),
    )
    m = marks.where(at.isNotNull()).select(
        *keys, F.lit(None).cast(a.schema["_anchor"].dataType).alias("_anchor"), F.floor(at / reach).alias("_b"), F.lit(1).alias("_kind"), at.alias("_x"),
        F.lit(None).cast("bigint").alias("_tie"), mark.alias("_mark"),
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_x", "_kind", "_tie")
    follows = F.struct(F.lead("_kind").over(inside).alias("kind"), F.lead("_x").over(inside).alias("x"))
    lowest = (F.col("_kind") == 0) & ~F.coalesce((follows["kind"] == 0) & (follows["x"] == F.col("_x")), F.lit(False))
    around = a.unionByName(m).withColumn("_lowest", F.when(lowest, F.col("_anchor"))).withColumns({
        "_below": F.last("_anchor", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)),
        "_above": F.first("_lowest", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing)),
    })
    down, up = F.col("_x") - F.col("_below.at"), F.col("_above.at") - F.col("_x")
    best = F.when(F.col("_below").isNotNull() & (F.col("_above").isNull() | (down <= up)), F.col("_below")).otherwise(F.col("_above"))
    return around.where("_kind = 1").withColumn("_best", best).select(
        *[c if c in keys else f"_mark.{c}" for c in marks.columns],
        F.col("_best.value").alias(out), F.abs(F.col("_x") - F.col("_best.at")).alias("dist"), *[F.col(f"_best.{c}") for c in carried]
    ).where(F.col("dist") <= reach)


def nearest_of_few(
    marks: DataFrame, anchors: DataFrame, keys: Sequence[str], axis: str, payload: str, reach: float | None = None, out: str = "anchor",
) -> DataFrame:
    """Each mark's closest anchor where a key has a handful of them (columns or rows of a page).

    They become one small array a key, so marks are read once and joined by key alone; the
    lower anchor wins a tie, then the lowest payload. Keys are as many as pages, and Spark
    takes exploded anchors for smaller than they are, so both sides are sorted.
    """
    keys = list(keys)
    few = anchors.where(F.col(axis).isNotNull()).groupBy(*keys).agg(
        F.collect_set(F.struct(F.col(axis).cast("double").alias("at"), F.col(payload).alias("value"))).alias("_few")
    )
    ways = F.transform("_few", lambda x: F.struct(F.abs(F.col(axis) - x["at"]).alias("d"), x["at"].alias("at"), x["value"].alias("value")))
    met = marks.where(F.col(axis).isNotNull()).join(few.hint("merge"), keys).withColumn("_best", F.array_min(ways)).drop("_few")
    met = met.withColumns({out: F.col("_best.value"), "dist": F.col("_best.d")}).drop("_best")
    return met if reach is None else met.where(F.col("dist") <= reach)


def nearest(
    marks: DataFrame, anchors: DataFrame, keys: Sequence[str], axis: str, payload: str,
    mark_id: str, max_dist: float | None, bucket_width: float, out: str = "anchor",
) -> DataFrame:
    """Each mark's closest anchor on one axis; the lower one wins a tie.

    With ``max_dist`` marks without an anchor in reach are dropped.
    """
    if max_dist is not None:
        return nearest_in_reach(marks, anchors, keys, axis, payload, max_dist, out)
    around = neighbours(marks, anchors, keys, axis, payload, bucket_width, mark_id)
    down = F.col(axis) - F.col("before.at")
    up = F.col("after.at") - F.col(axis)
    take_down = F.col("after").isNull() | (down <= up)
    best = F.when(F.col("before").isNotNull() & take_down, F.col("before")).otherwise(F.col("after"))
    matched = around.withColumn("_b", best).where("_b IS NOT NULL").withColumns(
        {out: F.col("_b.value"), "dist": F.abs(F.col(axis) - F.col("_b.at"))}
    )
    return matched.drop("_b", "before", "after")


def last_above(
    marks: DataFrame, headers: DataFrame, keys: Sequence[str], axis: str, payload: str,
    mark_id: str, bucket_width: float, out: str = "header",
) -> DataFrame:
    """As-of match: the last header at or before the mark, else the nearest one after it."""
    around = neighbours(marks, headers, keys, axis, payload, bucket_width, mark_id)
    return around.withColumn(
        out, F.coalesce(F.col("before.value"), F.col("after.value"))
    ).drop("before", "after")


def row_intervals(headers: DataFrame, keys: Sequence[str], axis: str, bucket_width: float) -> DataFrame:
    """Header rows as intervals ``[y0, y1)`` reaching to shortly before the next header."""
    down = headers.withColumn("_neg", -F.col(axis))
    cut = -F.floor(F.col(axis) / bucket_width)
    following = previous_row(down, list(keys), ["_neg"], [axis], cut, "_next")
    return following.withColumn("y0", F.col(axis)).withColumn(
        "y1", F.col(f"_next.{axis}") - ROW_OVERLAP
    ).drop("_neg", "_next")


def in_rows(
    marks: DataFrame, headers: DataFrame, keys: Sequence[str], axis: str, payload: str,
    mark_id: str, bucket_width: float,
) -> DataFrame:
    """Marks inside a header's interval, found as-of and then checked against the next header."""
    around = neighbours(marks, headers, keys, axis, payload, bucket_width, mark_id)
    inside = F.col("after").isNull() | (F.col("before.at") == F.col(axis)) | (
        F.col(axis) < F.col("after.at") - ROW_OVERLAP
    )
    return around.where(F.col("before").isNotNull() & inside).withColumn(
        "row", F.col("before.value")
    ).drop("before", "after")


def keep_leftmost(marks: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    rest = [c for c in marks.columns if c not in keys and c != x]
    return marks.groupBy(*keys).agg(F.min(F.struct(x, *rest)).alias("m")).select(*keys, "m.*")


def token_rows(tokens: DataFrame, y: str, out: str = "row") -> DataFrame:
    """Tokens with the number of their line of about 20 units."""
    return tokens.withColumn(out, F.bround(F.col(y) / TOKEN_BUCKET).cast("bigint"))


def token_runs(
    tokens: DataFrame, keys: Sequence[str], y: str, tie: str, bucket_width: float | None,
    gap: Column | float = TOKEN_GAP, out: str = "run",
) -> DataFrame:
    """Tokens with the number of their run; a gap above the limit starts a new one."""
    bucket = None if bucket_width is None else F.floor(F.col(y) / bucket_width)
    return gap_runs(tokens, list(keys), [y, tie], y, gap, bucket, out)


#: Before the first position of a run, and buckets that are chained at once.
NOWHERE = -1e300
CHAINED = 256


def token_clusters(
    tokens: DataFrame, keys: Sequence[str], y: str, tie: str, bucket_width: float | None,
    gap: float = TOKEN_GAP, out: str = "cluster_y",
) -> DataFrame:
    """Tokens with the position of their cluster's first token, all within ``gap`` of it.

    A gap above the limit always starts a cluster, so only the inside of a run needs an
    ordered fold. A bucket of positions is a function from the last start before it to its own
    last start; as a run has no wider gap, its first start lies within two gaps of its first
    position, so a short list of (first start, last start) is the whole function. The lists of
    ``CHAINED`` buckets make one list, those of a run give the start that each comes after,
    and this goes back down to the buckets, which list their starts. A run of any length is
    many rows; what one row holds is a bucket's positions or ``CHAINED`` short lists.

    Without ``bucket_width`` a key is a page or less, and so is a run: its tokens are gathered
    and folded. Where tokens are dealt by keys, or by some of them, this moves none of them.
    """
    keys = list(keys)
    run = [*keys, "_run"]
    if bucket_width is None:
        spot = F.col(y).cast("double")
        rest = [c for c in tokens.columns if c not in keys]
        runs = token_runs(tokens, keys, y, tie, None, gap, "_run").groupBy(*run).agg(
            F.collect_list(F.struct(*rest, spot.alias("_spot"))).alias("_rows"), F.array_sort(F.collect_set(spot)).alias("_ps")
        )
        begun = F.aggregate(
            "_ps", F.array().cast("array<double>"),
            lambda done, p: F.when((F.size(done) == 0) | (p > F.try_element_at(done, F.lit(-1)) + gap), F.concat(done, F.array(p))).otherwise(done),
        )

        def placed(row: Column) -> Column:
            return F.struct(*[row[c].alias(c) for c in rest], F.array_max(F.filter("_begun", lambda s: s <= row["_spot"])).alias(out))

        found = runs.withColumn("_begun", begun).select(*keys, F.inline(F.transform("_rows", placed)))
        return found.select(*tokens.columns, out)
    width = max(bucket_width, 2 * gap)
    inside = token_runs(tokens, keys, y, tie, bucket_width, gap, "_run").withColumn("_b", F.floor(F.col(y).cast("double") / width))
    spots = inside.where(F.col(y).isNotNull()).groupBy(*run, "_b").agg(F.array_sort(F.collect_set(F.col(y).cast("double"))).alias("_ps"))

    def last_start(positions: Column, before: Column) -> Column:
        return F.aggregate(positions, before, lambda last, p: F.when(p > last + gap, p).otherwise(last))

    def applied(ways: Column, last: Column) -> Column:
        return F.coalesce(F.get(F.filter(ways, lambda way: way["first"] > last + gap), 0)["last"], last)

    def entering(rows: Column, number: str, before: Column) -> Column:
        """Each row's number with the last start before it; ``rows`` are (number, ways), in order."""
        state = F.struct(before.alias("last"), F.array().cast(f"array<struct<{number}: bigint, came: double>>").alias("done"))

        def step(acc: Column, row: Column) -> Column:
            came = F.struct(row[number].alias(number), acc["last"].alias("came"))
            return F.struct(applied(row["ways"], acc["last"]).alias("last"), F.concat(acc["done"], F.array(came)).alias("done"))

        return F.aggregate(rows, state, step)["done"]

    def ways_from(starts: Column) -> Column:
        """The ways that the first start may be: those within two gaps of the first position."""
        return F.filter(starts, lambda way: way["first"] < F.get(starts, 0)["first"] + 2 * gap)

    own = F.transform("_ps", lambda p: F.struct(p.alias("first"), last_start(F.col("_ps"), p).alias("last"), F.col("_b").alias("at")))
    buckets = spots.select(*run, "_b", F.floor(F.col("_b") / CHAINED).alias("_s"), ways_from(own).alias("ways"))
    supers = buckets.groupBy(*run, "_s").agg(F.array_sort(F.collect_list(F.struct("_b", "ways"))).alias("_subs"))
    firsts = F.flatten(F.transform(F.slice("_subs", 1, 2), lambda sub: sub["ways"]))

    def chained(way: Column) -> Column:
        later = F.filter("_subs", lambda sub: sub["_b"] > way["at"])
        return F.struct(way["first"].alias("first"), F.aggregate(later, way["last"], lambda last, sub: applied(sub["ways"], last)).alias("last"))

    linked = supers.select(*run, "_s", F.transform(ways_from(firsts), chained).alias("ways"))
    heads = linked.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("_s", "ways"))).alias("_rows"))
    came = heads.select(*run, F.inline(entering(F.col("_rows"), "_s", F.lit(NOWHERE))))
    after = supers.join(came, [*run, "_s"]).select(*run, F.inline(entering(F.col("_subs"), "_b", F.col("came"))))
    starts = F.aggregate(
        "_ps", F.struct(F.col("came").alias("last"), F.array().cast("array<double>").alias("done")),
        lambda acc, p: F.when(p > acc["last"] + gap, F.struct(p.alias("last"), F.concat(acc["done"], F.array(p)).alias("done"))).otherwise(acc),
    )["done"]
    found = spots.join(after, [*run, "_b"]).select(*run, "_b", "came", starts.alias("_starts"))
    first = F.coalesce(F.array_max(F.filter("_starts", lambda s: s <= F.col(y))), F.col("came"))
    return inside.join(found, [*run, "_b"], "left").withColumn(out, first).drop("_run", "_b", "_starts", "came")


def group_extents(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, text: str) -> DataFrame:
    """Per line or run its top, number of tokens, and first and last text."""
    at = F.struct(*order)
    return tokens.groupBy(*keys).agg(
        F.min(y).alias("y0"), F.count(F.lit(1)).alias("tokens"),
        F.min_by(text, at).alias("first_text"), F.max_by(text, at).alias("last_text"),
    )


def group_bins(tokens: DataFrame, keys: Sequence[str], bins: Column) -> DataFrame:
    """Bins named by the tokens of a line or run: at most one value per bin is gathered."""
    return (
        tokens.select(*keys, F.explode(bins).alias("bin"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    )


def nearest_colour(r: Column, g: Column, b: Column, palette: Sequence[tuple[int, float, float, float]], limit: float) -> Column:
    """Bin of the closest palette colour by squared distance, null beyond the limit."""
    shades = F.array(*[
        F.struct(
            ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)).alias("d"), F.lit(bin_no).alias("bin")
        )
        for bin_no, pr, pg, pb in palette
    ])
    best = F.array_min(shades)
    return F.when(best["d"] <= limit, best["bin"])


def header_strip(headers: DataFrame, page: str, axis: str, along: str) -> DataFrame:
    """Month headers of the page's best strip: most months, then nearest the start.

    ``headers`` has month; ``axis`` is the strip's own coordinate and ``along`` runs on it.
    The first header of each month is kept.
    """
    strip = F.bround(F.col(axis) / STRIP_BUCKET) * STRIP_BUCKET
    tagged = headers.withColumn("strip", strip)
    # Months of a strip are at most twelve, so the set is small.
    scored = tagged.groupBy(page, "strip").agg(
        F.size(F.collect_set("month")).alias("months"), F.min(axis).alias("start")
    )
    best = scored.groupBy(page).agg(
        F.max(F.struct("months", (-F.col("start")).alias("neg"), (-F.col("strip")).alias("neg_strip"))).alias("b")
    ).select(page, (-F.col("b.neg_strip")).alias("strip"))
    return (
        tagged.join(best, [page, "strip"])
        .groupBy(page, "month")
        .agg(F.min(F.struct(along, axis)).alias("h"))
        .select(page, "month", "h.*")
    )


def valid_days(df: DataFrame, year: Column, month: Column, day: Column) -> DataFrame:
    """Adds ``date`` and drops impossible days."""
    first = F.make_date(year, month, F.lit(1))
    ok = (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    return df.where(ok).withColumn("date", F.date_add(first, (day - 1).cast("int")))


def month_grid(
    marks: DataFrame, months: DataFrame, days: DataFrame, keys: Sequence[str], year: int,
    reach: float = MARK_REACH,
) -> DataFrame:
    """Coloured marks to dated bins: nearest month column, nearest day row, largest mark.

    Marks have x, y, bin and area; months x and month; days month, y and day. Splitting the
    columns at the midpoints of neighbours is the same as taking the nearest month.
    """
    keys = list(keys)
    columned = nearest_of_few(marks, months, keys, "x", "month", None, "month").drop("dist")
    rowed = nearest_of_few(columned, days, [*keys, "month"], "y", "day", reach, "day").drop("dist")
    best = rowed.groupBy(*keys, "month", "day", "bin").agg(F.max("area").alias("area"))
    return valid_days(best, F.lit(year), F.col("month"), F.col("day")).select(*keys, "date", "bin", "area")


def label_then_day(
    labels: DataFrame, days: DataFrame, keys: Sequence[str], label_id: str
) -> DataFrame:
    """Weekday labels paired with the leftmost day number of their window.

    Both have x and y. The window reaches ten units up and down, five to the left and eighty
    to the right. Days are cut into cells of the window's size, and a label looks into the
    cells that its window can touch, so both sides are read and shuffled once. Both sides are
    sorted: Spark takes exploded rows for fewer than they are and would broadcast them.
    """
    keys = list(keys)

    def cells(at: str, low: float, high: float, size: float) -> Column:
        return F.sequence(F.floor((F.col(at) + low) / size), F.floor((F.col(at) + high) / size))

    across = LABEL_REACH + LABEL_SLACK
    wide = labels.select(*keys, F.col(label_id).alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    wide = wide.withColumn("_row", F.explode(cells("ly", -LABEL_BAND, LABEL_BAND, LABEL_BAND)))
    wide = wide.withColumn("_col", F.explode(cells("lx", -LABEL_SLACK, LABEL_REACH, across)))
    found = wide.join(
        days.select(
            *keys, "x", "y", "day", F.floor(F.col("y") / LABEL_BAND).alias("_row"), F.floor(F.col("x") / across).alias("_col")
        ).hint("merge"),
        [*keys, "_row", "_col"],
    )
    dx = F.col("x") - F.col("lx")
    inside = (F.abs(F.col("y") - F.col("ly")) <= LABEL_BAND) & (dx >= -LABEL_SLACK) & (dx <= LABEL_REACH)
    return found.where(inside).groupBy(*keys, "label").agg(F.min_by("day", F.struct(dx, F.col("y"), F.col("day"))).alias("day"))


def split_columns(letters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Letters in one column, or two split at the middle when they spread widely."""
    keys = list(keys)
    span = letters.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo") > SPLIT_SPREAD
    right = wide & (F.col("x") >= (F.col("_lo") + F.col("_hi")) / 2.0)
    return letters.join(span, keys).withColumn(
        "column", F.when(right, F.lit("c2")).otherwise(F.lit("c1"))
    ).drop("_lo", "_hi")


def letters_of_days(letters: DataFrame, days: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    """Letters in six-unit buckets given to every day of the month within fourteen units.

    Letters are first reduced to one row per (bucket, bin). Only the distinct heights of a
    page's days look at their fixed handful of buckets by equality; the days then take the
    bins of their height, gathered as sets, since bins are few. All sides are sorted: Spark
    takes exploded days for fewer than they are and would broadcast them.
    """
    keys = list(keys)
    marks = letters.select(*keys, F.bround(F.col("y") / LETTER_BUCKET).cast("bigint").alias("_k"), "bin").distinct()
    lo = F.floor((F.col("y") - LETTER_BAND) / LETTER_BUCKET).cast("bigint")
    hi = F.ceil((F.col("y") + LETTER_BAND) / LETTER_BUCKET).cast("bigint")
    heights = days.select(*keys, "y").distinct().withColumn("_k", F.explode(F.sequence(lo, hi)))
    close = F.abs(F.col("_k") * LETTER_BUCKET - F.col("y")) <= LETTER_BAND
    found = heights.join(marks.hint("merge"), [*keys, "_k"]).where(close)
    bins = found.groupBy(*keys, "y").agg(F.collect_set(F.struct("bin")).alias("_bins"))
    dated = valid_days(days.join(bins.hint("merge"), [*keys, "y"]), F.lit(year), F.col("month"), F.col("day"))
    every = dated.groupBy(*keys, "date").agg(F.array_distinct(F.flatten(F.collect_list("_bins"))).alias("_bins"))
    return every.select(*keys, "date", F.inline("_bins"))


def icon_grid(icons: DataFrame, columns: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Icons to (weekday, bin): nearest weekday column and nearest bin row within reach."""
    keys = list(keys)
    c = nearest_of_few(icons, columns, keys, "x", "weekday", ICON_COLUMN, "weekday").drop("dist")
    r = nearest_of_few(c, rows, keys, "y", "bin", ICON_ROW, "bin").drop("dist")
    return r.select(*keys, "weekday", "bin").distinct()


def carry_to_next_page(pages: DataFrame, doc: str, page: str, own: str, bucket: Column) -> DataFrame:
    """A page's own title, else the title of the page before it."""
    before = previous_row(pages, [doc], [page], [own], bucket, "_p")
    return before.withColumn("title", F.coalesce(F.col(own), F.col(f"_p.{own}"))).drop("_p")


def choose_by_yield(results: DataFrame, page: str, first: str, second: str) -> DataFrame:
    """Strategy per page: the first if it gives enough, else the longer one."""
    def n(s: str) -> Column:
        return F.count_if(F.col("strategy") == s)

    counts = results.groupBy(page).agg(n(first).alias("a"), n(second).alias("b"))
    use_first = (F.col("a") >= GOOD_YIELD) | (F.col("b") <= F.col("a"))
    return counts.select(
        page, F.when(use_first, F.lit(first)).otherwise(F.lit(second)).alias("strategy"),
        F.when(use_first, F.col("a")).otherwise(F.col("b")).alias("n"),
    )


def keep_pages(yields: DataFrame, doc: str) -> DataFrame:
    """Pages with a good yield; if a document has none, those with a fair one, else all."""
    best = yields.groupBy(doc).agg(F.max("n").alias("_max"))
    need = (
        F.when(F.col("_max") >= GOOD_YIELD, GOOD_YIELD).when(F.col("_max") >= FAIR_YIELD, FAIR_YIELD).otherwise(0)
    )
    return yields.join(best, doc).where(F.col("n") >= need).drop("_max")
