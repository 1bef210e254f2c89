"""Quality rules: divergence of a document's histograms from its language's references.

Two histograms describe a text: its character classes (``CLASSES``) and its common words
(the ``COMMON_WORDS`` most frequent words of its language, and one bin for all others). The
references are the sums of these histograms over all documents of the language that pass
the base rules, so they are statistics of the whole corpus. A document is rejected when the
Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1) of one of its
histograms from the reference is above its limit; a histogram is only compared when the
text has ``MIN_BYTES`` bytes in UTF-8 (classes) or ``MIN_WORDS`` words (words).

The base rules reject texts of under ``BASE_WORDS`` words, and texts in which more than 30 %
of the words stand in an 8-word window that occurs twice or more in the text.

Every language has its reference, however many there are: those of the ``LANGUAGES`` with the
most words are broadcast, documents of the others meet theirs in a join. This bounds what is
broadcast and changes no verdict.

Cases: a null text is an empty one (no words: rejected by the base rules); a null language
and a language with under ``REFERENCE_WORDS`` words are compared with the reference of all
languages together; ties among common words go by code point; repeated rows get equal
verdicts; an empty table gives an empty one; columns of the input that are written anew are
replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, ddl, without

BASE_WORDS = 20
WINDOW = 8
COMMON_WORDS = 64
#: Languages whose references are broadcast; a plan limit only.
LANGUAGES = 1024
#: Parts of a language's words that are limited before they meet.
PARTS = 64
REFERENCE_WORDS = 1000
MIN_WORDS = 50
MIN_BYTES = 300
CLASS_LIMIT = 0.32
WORD_LIMIT = 0.48
SYMBOLS = b"#*$%&|<>"
#: Character classes, by the first byte of a character in UTF-8.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "quote", "symbol", "other", "latin", "letter", "wide", "rest")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte < 0x80:
        name = (
            "lower" if char.islower() else "upper" if char.isupper() else "digit" if char.isdigit()
            else "line" if char in "\n\r" else "blank" if char in " \t\v\f" else "stop" if char in ".,;:!?"
            else "quote" if char in "'\"()-" else "symbol" if byte in SYMBOLS else "other"
        )
    else:
        name = "rest" if byte < 0xC2 else "latin" if byte < 0xC6 else "letter" if byte < 0xE0 else "wide"
    return CLASSES.index(name)


_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)


def classes(raw: bytes) -> np.ndarray:
    """Counts of character classes; the following bytes of a character ("rest") count nothing."""
    out = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES))
    out[-1] = 0
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that stand twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words))
    mixed = np.zeros(n, np.int64)
    for i in range(WINDOW):  # equal windows have equal sums, so distinct sums mean no repeat
        mixed = mixed * np.int64(1_000_003) + own[i:i + n]
    if len(np.unique(mixed)) == n:
        return 0
    windows = list(zip(*(islice(words, i, None) for i in range(WINDOW))))
    times = Counter(windows)
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


def measures(text: str | None) -> tuple[tuple[int, ...], bytes, list[bytes]]:
    """The five measures, the text as bytes, its words."""
    raw = text.encode() if isinstance(text, str) else b""
    words = raw.split()
    chars = len(b"".join(words).decode())
    symbols = sum(raw.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)), raw, words


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < BASE_WORDS or 100 * n_repeat_words > 30 * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def histograms(docs: DataFrame) -> DataFrame:
    """Rows (lang, kind, key, n): classes and words of all documents that pass the base rules."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str | None, Counter] = defaultdict(Counter)
            shapes: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
            for lang, text in zip(batch["lang"], batch["text"]):
                raw = text.encode() if isinstance(text, str) else b""
                own = raw.split()
                if failed(len(own), 0) or failed(len(own), repeated_words(own)):
                    continue
                lang = lang if isinstance(lang, str) else None
                shapes[lang] += classes(raw)
                words[lang].update(raw.lower().split())
            rows = [(lang, 0, CLASSES[i], int(n)) for lang, h in shapes.items() for i, n in enumerate(h) if n]
            rows += [(lang, 1, w.decode(), n) for lang, c in words.items() for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    rows = docs.select("lang", "text").mapInPandas(count, "lang string, kind int, key string, n bigint")
    return rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


class References:
    """Class counts, common words and their counts by language; None: all languages."""

    def __init__(self, rows: list[dict]):
        self.shapes: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        self.words: dict[str | None, dict[str, int]] = defaultdict(dict)
        self.totals: Counter = Counter()
        for row in rows:
            lang = row["lang"]
            if row["kind"] == 0:
                self.shapes[lang][CLASSES.index(row["key"])] += row["n"]
            else:
                self.words[lang][row["key"]] = row["n"]
                self.totals[lang] = row["total"]
        self.bins = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in self.words.items()}
        self.counts = {
            lang: np.array([*words.values(), self.totals[lang] - sum(words.values())], np.int64)
            for lang, words in self.words.items()
        }

    def of(self, lang: str | None) -> str | None:
        return lang if self.totals.get(lang, 0) >= REFERENCE_WORDS else None

    def distances(self, lang: str | None, raw: bytes, n_words: int) -> tuple[float | None, float | None]:
        """Class and word distance; None where the text is too short or no reference exists."""
        lang = self.of(lang)
        if lang not in self.bins:
            return None, None
        by_class = by_word = None
        if len(raw) >= MIN_BYTES:
            by_class = distance(classes(raw), self.shapes[lang])
        if n_words >= MIN_WORDS:
            bins, other = self.bins[lang], len(self.bins[lang])
            found = np.bincount([bins.get(w, other) for w in raw.lower().split()], minlength=other + 1)
            by_word = distance(found, self.counts[lang])
        return by_class, by_word


def references(docs: DataFrame) -> DataFrame:
    """One row a language (null: all together): ``lang``, its ``total`` words and ``rows``.

    ``rows`` has (kind, key, n) of the classes and of the common words, most frequent first.
    """
    by_lang = cut(histograms(docs))
    langs = by_lang.filter("kind = 1 AND lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= REFERENCE_WORDS)
    named = by_lang.join(langs.select("lang"), "lang").select("lang", "kind", "key", "n")
    pooled = by_lang.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "key", "n")
    both = named.unionByName(pooled)
    totals = both.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    order = [F.desc("n"), F.asc("key")]
    parts = both.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    few = parts.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "kind", "_part").orderBy(*order))).filter(F.col("_rank") <= COMMON_WORDS)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang", "kind").orderBy(*order)))
    top = ranked.filter(F.col("rank") <= COMMON_WORDS).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "key", "n"))).alias("rows"))
    return cut(top.alias("t").join(totals.alias("s"), F.col("t.lang").eqNullSafe(F.col("s.lang")), "left").select("t.lang", "s.total", "t.rows"))


def _as_rows(refs: list[dict]) -> list[dict]:
    """Rows for ``References``."""
    return [{"lang": r["lang"], "kind": x["kind"], "key": x["key"], "n": x["n"], "total": r["total"]} for r in refs for x in r["rows"]]


def judge(
    docs: DataFrame, *, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, languages: int = LANGUAGES,
) -> DataFrame:
    """Adds the measures, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    added = (*MEASURES, "class_distance", "word_distance", "base_failed", "kept")
    docs = without(docs, *added, "_total", "_rows")
    refs = references(docs)
    named = refs.filter("lang IS NOT NULL").orderBy(F.desc("total"), "lang")
    first = [r.asDict(recursive=True) for r in named.limit(languages).collect()]
    all_together = [r.asDict(recursive=True) for r in refs.filter("lang IS NULL").collect()]
    known = docs.sparkSession.sparkContext.broadcast(_as_rows(first + all_together))
    kinds = ", ".join(f"{m} bigint" for m in MEASURES)
    schema = f"{ddl(docs)}, {kinds}, class_distance double, word_distance double, base_failed boolean, kept boolean"

    def verdict(refs: References, lang, text) -> tuple:
        found, raw, _ = measures(text)
        bad = failed(found[0], found[4])
        by_class, by_word = refs.distances(lang if isinstance(lang, str) else None, raw, found[0])
        return (*found, by_class, by_word, bad, not bad and (by_class or 0) <= class_limit and (by_word or 0) <= word_limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = References(known.value)
        for batch in batches:
            rows = [verdict(refs, lang, text) for lang, text in zip(batch["lang"], batch["text"])]
            yield pd.concat([batch, pd.DataFrame(rows, columns=added, index=batch.index)], axis=1)

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, of = None, None
        for batch in batches:
            rows = []
            for lang, text, total, own in zip(batch["lang"], batch["text"], batch["_total"], batch["_rows"]):
                if refs is None or of != lang:
                    refs, of = References(_as_rows([{"lang": lang, "total": int(total), "rows": own}])), lang
                rows.append(verdict(refs, lang, text))
            new = pd.DataFrame(rows, columns=added, index=batch.index)
            yield pd.concat([batch.drop(columns=["_total", "_rows"]), new], axis=1)

    if len(first) < languages:
        return docs.mapInPandas(run, schema)
    others = refs.filter("lang IS NOT NULL").select(F.col("lang").alias("_lang"), F.col("total").alias("_total"), F.col("rows").alias("_rows")).filter(
        ~F.col("_lang").isin([r["lang"] for r in first])
    )
    beyond = docs.join(others, F.col("lang") == F.col("_lang")).drop("_lang").mapInPandas(run_joined, schema)
    usual = docs.join(others.select("_lang"), F.col("lang") == F.col("_lang"), "left_anti").mapInPandas(run, schema)
    return usual.unionByName(beyond)
