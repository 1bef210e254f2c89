"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Two chains of first order over ASCII characters are trained from labelled samples, one from
random strings and one from ordinary identifiers. A run of ``MIN_RUN`` or more characters
that may stand in a secret is a span of kind ``markov`` when the log-likelihood ratio of the
chains is ``MIN_TOTAL`` or more in all and ``MIN_MEAN`` or more a character, and it does not
overlap a span of the patterns: assignments of passwords and the like, access keys, hex.

Only DataFrame functions are used. Offsets come from the lengths of the pieces between a
pattern's matches, in code points.

Cases: null and empty texts have no spans; samples without a label or of under two
characters train nothing, and without samples both chains are even, so no run is a span;
rows are scanned one by one, so repeated rows are equal and an empty table gives an empty
one; columns of the input that are written anew are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendra.llm.common import cut, without

#: Patterns by kind, with the least length of the group that decides.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_TOTAL = 12.0
MIN_MEAN = 0.5
#: Bounds of the samples that the query's models are trained on.
SAMPLE_DOCS = 2000
SAMPLE_STRINGS = 4096
SAMPLE_VALUES = 1024
SPAN = "array<struct<start: int, place: int, `end`: int, kind: string>>"
MASK = "[secret]"


def _spans(text: Column, pattern: str, kind: str, keep: Column | None, *, scan: Column | None = None) -> Column:
    """Spans of a pattern's matches, leftmost first; ``keep``: array<boolean> by match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    at = F.sequence(F.lit(0), F.size(matches) - 1)
    state = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("found"))

    def step(s: Column, i: Column) -> Column:
        start = s["pos"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind"))
        found = F.concat(s["found"], F.array(span))
        if keep is not None:
            found = F.when(F.get(keep, i), found).otherwise(s["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    folded = F.aggregate(at, state, step, lambda s: s["found"])
    return F.when(F.size(matches) > 0, folded).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    keys = F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, "assign", F.transform(values, lambda v: F.length(v) >= 12)),
        _spans(text, ACCESS, "access", F.transform(keys, lambda v: F.length(v) >= 18)),
        _spans(text, HEX, "hex", None),
    ))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio by pair of ASCII characters, at 128 * first + second.

    ``samples``: text, secret (boolean). At most 2 x 128 x 128 sums reach the driver.
    """
    codes = F.transform(F.split("text", ""), F.ascii)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(codes) - 1), lambda i: F.get(codes, i - 1) * 128 + F.get(codes, i)
    )
    usable = samples.filter(F.col("secret").isNotNull() & (F.length("text") > 1)).filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    rows = usable.select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count().collect()
    used = sorted({c for r in rows for c in divmod(r["pair"], 128)})
    chains = {}
    for secret in (True, False):
        n = {r["pair"]: r["count"] for r in rows if r["secret"] == secret}
        after = [sum(n.get(a * 128 + b, 0) for b in used) for a in range(128)]
        chains[secret] = [math.log((n.get(p, 0) + 0.5) / (after[p // 128] + 0.5 * max(1, len(used)))) for p in range(128 * 128)]
    return [a - b for a, b in zip(chains[True], chains[False], strict=True)]


def run_scores(runs: Column, ratios: list[float]) -> Column:
    """array<double>: the log-likelihood ratio of each run."""
    table = F.from_json(F.lit(json.dumps([round(r, 6) for r in ratios])), "array<double>")

    def score(codes: Column, ratio: Column) -> Column:
        pairs = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.coalesce(F.get(ratio, a * 128 + b), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    return F.flatten(F.transform(
        F.array(table),
        lambda ratio: F.transform(runs, lambda r: F.get(F.transform(F.array(F.transform(F.split(r, ""), F.ascii)), lambda c: score(c, ratio)), 0)),
    ))


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, place, end, kind), ends exclusive."""
    docs = without(docs, "base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    likely = F.zip_with(
        run_scores(runs, ratios), runs, lambda s, r: (s >= MIN_TOTAL) & (s >= MIN_MEAN * F.length(r))
    )
    found = docs.withColumn("base", base_spans(text)).withColumn("_likely", likely)
    # offsets are worked out only for texts with a likely run
    markov = F.when(F.exists("_likely", lambda x: x), _spans(text, RUN, "markov", F.col("_likely"))).otherwise(F.array().cast(SPAN))
    own = F.filter(
        markov, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    return found.withColumn("spans", F.array_sort(F.concat("base", own))).drop("_likely")


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings: ``SAMPLE_STRINGS`` generated random strings of two alphabets and
    ``SAMPLE_VALUES`` values of the patterns against the other words of ``SAMPLE_DOCS`` documents.

    The values are distinct ones, chosen by hash and repeated as often as fits when the table
    has fewer, so their share of the sample depends neither on its size nor on copies.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spark: SparkSession = docs.sparkSession
    values = F.concat(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    chosen = cut(
        docs.select(F.explode(values).alias("text")).filter(F.length("text") >= 16).distinct()
        .orderBy(F.xxhash64("text"), "text").limit(SAMPLE_VALUES)
    )
    times = SAMPLE_VALUES // max(1, chosen.count())
    known = chosen.select("text", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("text", F.lit(True).alias("secret"))
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    plain = F.translate(F.base64(digest), "+/=", "09")
    kind = F.col("id") % 4
    made = spark.range(SAMPLE_STRINGS, numPartitions=1).select(
        F.substring(F.when(kind < 2, F.base64(digest)).otherwise(F.upper(plain)), 1, 40).alias("text"),
        F.lit(True).alias("secret"),
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # only hashes are ordered; rows of one id are taken together
    edge = docs.select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    some = docs.filter(order <= F.lit(edge))
    words = F.regexp_extract_all(F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    ordinary = some.select(F.explode(words).alias("text")).withColumn("secret", F.lit(False))
    return known.unionByName(made).unionByName(ordinary)


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mask in place of every span; overlapping spans get one mask."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["pos"] + 1, span["start"] - s["pos"])
        out = F.when(span["start"] >= s["pos"], F.concat(s["out"], gap, F.lit(MASK))).otherwise(s["out"])
        return F.struct(F.greatest(s["pos"], span["end"]).alias("pos"), out.alias("out"))

    filled = F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["pos"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, filled).otherwise(text)
