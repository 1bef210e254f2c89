"""Substring dedup: content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 16 bytes is the least of any ``SPREAD``
places in a row, and not within ``MIN_CHUNK`` bytes of such a place before it. So cuts depend
on the neighbouring bytes only, come back after an insertion and are about 37 bytes apart.
Chunks are deduplicated by a 128-bit digest: each is shuffled once to its digest, as two
numbers with its packed place, and only repeated ones go back to their document. Chunks that
stand often in a sample of the texts (lines of all documents) are dealt to ``SALTS`` tasks
each, which changes no result. Neighbouring chunks that also stand elsewhere
form a run. A run of ``SEED_WORDS`` words or more is extended to both sides as far as the text
equals the one around the first place of its outer chunk (or the last place, where the run
itself is the first) and reported if it then has ``MIN_WORDS`` words or more. So a passage of
over 50 words is found by any whole chunk in it and reported from end to end.

A chunk's first place (smallest doc_id, then offset) is kept, the others are repeats. A run
of which some chunks stand here first and others do not is reported in parts, each with its
own ``kept``; the limit of words holds for the joint run. Every repeat that is taken out
stands at a smaller place too, so one copy of each text stays. A chunk behind a repeat may
be new only by what follows the passage: the repeat is extended into it, and its rest is
reported from ``MIN_CHUNK`` code points on.

Cases: null and empty texts have no chunks; a run without a cut is cut every ``MAX_CHUNK``
bytes; rows of equal doc_id are told apart by a hash of the text, equal rows are one
document; a null doc_id comes first; an empty table gives an empty one. Offsets are
code points.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, has_repeats

WINDOW = 16
#: The hash's lowest bits, which the last 16 bytes decide.
MASK = np.uint64((1 << WINDOW) - 1)
SPREAD = 48
MIN_CHUNK = 12
MAX_CHUNK = 4096
SEED_WORDS = 4
#: Code points around a run that are compared: more than a chunk and what decides a cut.
AROUND = 160
MIN_WORDS = 25
#: Texts of the sample, and places in it from which a chunk is dealt to several tasks, and to how many.
SAMPLE = 4096
OFTEN = 40
SALTS = 64


def _gear() -> np.ndarray:
    """256 random-looking numbers by a fixed rule (the splitmix generator from 1 on)."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks in bytes, the last being the text's end."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    rolled = GEAR[data]
    width = 1
    while width < WINDOW:  # the hash over twice as many bytes
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint64(width)
        rolled, width = longer, width * 2
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # a character starts behind the byte
    # the place stands behind its hash: of equal hashes the first is the least
    least = np.where(starts, rolled & MASK, MASK + np.uint64(1)) << np.uint64(40) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPREAD and width < n:
        more = min(width, SPREAD - width, n - width)
        least, width = np.minimum(least[:-more], least[more:]), width + more
    found = np.unique(least & np.uint64((1 << 40) - 1)).astype(np.int64)
    ends = found[starts[found]] + 1 if n >= SPREAD else np.empty(0, np.int64)
    ends = ends[np.diff(ends, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    ends = np.unique(np.append(ends, n))
    wide = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    if len(wide):
        forced = [np.arange(ends[i - 1] if i else 0, ends[i], MAX_CHUNK)[1:] for i in wide]
        borders = np.flatnonzero(starts) + 1
        ends = np.unique(np.concatenate([ends, *[borders[np.searchsorted(borders, f)] for f in forced]]))
    return ends


def chunks(docs: DataFrame, often: np.ndarray | None = None) -> DataFrame:
    """Rows (doc_id, version, seq, at, words, h1, h2, salt) of all chunks of ``docs`` (doc_id, version, text).

    ``at`` holds start and end, 32 bits each; ``h1``, ``h2``: the digest; ``salt``: 1 to ``SALTS`` if
    ``often`` (ascending) has ``h1``, else 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                ids, versions, counts, seqs, places, words, digests = [], [], [], [], [], [], []
                for doc_id, version, text in zip(part["doc_id"], part["version"], part["text"]):
                    raw = text.encode() if isinstance(text, str) else b""
                    if not raw:
                        continue
                    ends = cuts(raw)
                    begins = np.concatenate([[0], ends[:-1]])
                    data = np.frombuffer(raw, np.uint8)
                    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    blank = (data == 32) | ((data >= 9) & (data <= 13))
                    heads = np.append(0, np.cumsum(~blank & np.append(True, blank[:-1])))
                    ids.append(doc_id)
                    versions.append(version)
                    counts.append(len(ends))
                    seqs.append(np.arange(len(ends), dtype=np.int32))
                    places.append(chars[begins] << 32 | chars[ends])
                    words.append(heads[ends] - heads[begins])
                    digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                if counts:
                    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    h1, salt = halves[:, 0], np.zeros(len(halves), np.int32)
                    if often is not None and len(often):
                        known = often[np.minimum(np.searchsorted(often, h1), len(often) - 1)] == h1
                        salt[known] = np.flatnonzero(known) % SALTS + 1
                    yield pd.DataFrame({
                        "doc_id": pd.Series(ids, dtype=part["doc_id"].dtype).repeat(counts).to_numpy(),
                        "version": np.repeat(np.array(versions, np.int64), counts), "seq": np.concatenate(seqs),
                        "at": np.concatenate(places), "words": np.concatenate(words).astype(np.int32), "h1": h1, "h2": halves[:, 1], "salt": salt,
                    })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "version", "text").mapInPandas(
        run, f"doc_id {kind}, version bigint, seq int, at bigint, words int, h1 bigint, h2 bigint, salt int"
    )


def frequent_chunks(docs: DataFrame, sample: int = SAMPLE, often: int = OFTEN) -> np.ndarray:
    """First halves, ascending, of the digests with ``often`` places or more in ``sample`` texts."""
    total = docs.count()
    sampled = docs.sample(False, min(1.0, sample / total), seed=1) if total > sample else docs
    found = chunks(sampled).groupBy("h1").agg(F.count("*").alias("n")).filter(F.col("n") >= often)
    return np.sort(found.select("h1").toArrow()["h1"].to_numpy())


def repeated_chunks(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """The chunks with several places: (doc_id, version, seq, at, words, copies, here, other_id, other_version, other_at).

    ``here``: this is the first place; ``other``: the first place, or the last one where this is the first.
    """
    place = F.struct("doc_id", "version", "at")
    alike = W.partitionBy("h1", "h2", "salt")
    measures = {"copies": F.count("*"), "first": F.min(place), "last": F.max(place)}
    found = chunks(docs, often)
    for name, measure in measures.items():
        found = found.withColumn(name, measure.over(alike))
    if len(often):
        # the tasks of a frequent chunk know their part of its places
        totals = chunks(docs, often).filter("salt > 0").groupBy("h1", "h2").agg(*[m.alias(f"all_{name}") for name, m in measures.items()])
        found = found.join(F.broadcast(totals), ["h1", "h2"], "left")
        for name in measures:
            found = found.withColumn(name, F.coalesce(f"all_{name}", name))
    here = F.col("first") == place
    other = F.when(here, F.col("last")).otherwise(F.col("first"))
    return found.filter("copies > 1").withColumn("other", other).select(
        "doc_id", "version", "seq", "at", "words", "copies", here.alias("here"),
        F.col("other.doc_id").alias("other_id"), F.col("other.version").alias("other_version"), F.col("other.at").alias("other_at"),
    )


def versioned(docs: DataFrame) -> DataFrame:
    """Adds ``version``, a hash of the text."""
    return docs.withColumn("version", F.xxhash64("text"))


def _runs(docs: DataFrame) -> DataFrame:
    """(doc_id, version, run, words, parts, low, high) of all runs of repeated chunks.

    ``low`` and ``high``: the outer chunks that first stand elsewhere, or else the outer ones, with
    the place to compare.
    """
    document = ["doc_id", "version"]

    def start(at: str) -> Column:
        return F.shiftright(at, 32).cast("int")

    def end(at: str) -> Column:
        return F.col(at).bitwiseAND(2**32 - 1).cast("int")

    # neighbours have the same difference from their number, among all and among their kind
    runs = (
        repeated_chunks(docs, frequent_chunks(docs))
        .withColumn("run", F.col("seq") - F.row_number().over(W.partitionBy(*document).orderBy("seq")))
        .withColumn("part", F.col("seq") - F.row_number().over(W.partitionBy(*document, "here").orderBy("seq")))
        .withColumn("start", start("at")).withColumn("end", end("at"))
        .withColumn("first_id", F.when(F.col("here"), F.col("doc_id")).otherwise(F.col("other_id")))
    )
    other = F.struct(F.col("other_id").alias("doc_id"), F.col("other_version").alias("version"), start("other_at").alias("start"), end("other_at").alias("end"))
    outer = F.struct("seq", "start", "end", other.alias("other"))
    parts = runs.groupBy(*document, "run", "here", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("chunks"),
        F.max("copies").alias("copies"), F.min("first_id").alias("first_doc_id"), F.min(outer).alias("low"), F.max(outer).alias("high"),
    )
    return parts.groupBy(*document, "run").agg(
        F.sum("words").alias("words"),
        F.coalesce(F.min(F.when(~F.col("here"), F.col("low"))), F.min("low")).alias("low"),
        F.coalesce(F.max(F.when(~F.col("here"), F.col("high"))), F.max("high")).alias("high"),
        # as many as the document's length allows
        F.array_sort(F.collect_list(F.struct("start", "end", "words", "chunks", "copies", "first_doc_id", F.col("here").alias("kept")))).alias("parts"),
    )


def _extensions(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, version, run, side, hash, chars, more): how far each run goes on to each side.

    ``hash`` is that of the text; ``version`` may be 0 where ids are told apart without it.
    """
    def edge(side: int, chunk: str, at: str):
        return runs.select(
            "doc_id", "version", "run", F.lit(side).alias("side"), F.col(f"{chunk}.{at}").alias("at"),
            F.col(f"{chunk}.other.doc_id").alias("other_id"), F.col(f"{chunk}.other.version").alias("other_version"),
            F.col(f"{chunk}.other.{at}").alias("other_at"),
        )

    edges = edge(0, "low", "start").union(edge(1, "high", "end"))
    needed = edges.select("doc_id", "version", "at", "side").union(edges.select("other_id", "other_version", "other_at", "side")).distinct()
    lists = needed.groupBy(F.col("doc_id").alias("_of"), F.col("version").alias("_version")).agg(F.collect_list(F.struct("at", "side")).alias("places"))
    own = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("version") == F.col("_version"))
    p = F.col("p")
    begin = F.greatest(p["at"] - AROUND, F.lit(0))
    around = F.when(p["side"] == 0, F.reverse(F.substring("text", begin + 1, p["at"] - begin))).otherwise(F.substring("text", p["at"] + 1, F.lit(AROUND)))
    # the blank or other character in front tells whether a word begins with the first one
    near = cut(
        docs.join(lists, own).select("doc_id", "version", "text", F.xxhash64("text").alias("hash"), F.explode("places").alias("p"))
        .select("doc_id", "version", "hash", p["at"].alias("at"), p["side"].alias("side"), around.alias("near"),
                F.when(p["side"] == 1, F.substring("text", p["at"], F.lit(1))).alias("front"))
    )
    other = near.select(F.col("doc_id").alias("o_id"), F.col("version").alias("other_version"), F.col("at").alias("other_at"), "side", F.col("near").alias("other_near"))
    mine = near.select(F.col("doc_id").alias("m_id"), "version", "hash", "at", "side", "near", "front")
    both = (
        edges.join(mine, ["version", "at", "side"]).filter(F.col("doc_id").eqNullSafe(F.col("m_id")))
        .join(other, ["other_version", "other_at", "side"]).filter(F.col("other_id").eqNullSafe(F.col("o_id")))
        .select("doc_id", "version", "run", "side", "hash", "near", "other_near", F.when(F.col("at") > 0, F.col("front")).alias("front"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = " \t\n\v\f\r"
        for batch in batches:
            chars, words = [], []
            for side, a, b, front in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6, 7)), strict=True):
                n = len(os.path.commonprefix([a, b]))
                # in the text's order, with the character in front of it
                whole = a[:n + 1][::-1] if side == 0 else (front or "") + a[:n]
                if len(whole) == n:
                    whole = " " + whole
                chars.append(n)
                words.append(sum(x in blank and y not in blank for x, y in zip(whole, whole[1:])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(chars, pa.int32()), pa.array(words, pa.int32())], ["doc_id", "version", "run", "side", "hash", "chars", "more"]
            )

    return both.mapInArrow(run, f"doc_id {kind}, version bigint, run int, side int, hash bigint, chars int, more int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, start, end, words, chunks, copies, first_doc_id, kept) of each span.

    ``copies`` is the most places of one of its chunks; ``kept``: all its chunks stand here
    first. Equal rows of ``docs`` are one document. Spans of a document may overlap where
    they were extended.
    """
    docs = docs.select("doc_id", "text")
    # the hash need not be moved with each chunk where ids tell the rows apart
    docs = versioned(docs.dropDuplicates()) if has_repeats(docs) else docs.withColumn("version", F.lit(0).cast("bigint"))
    runs = cut(_runs(docs).filter(F.col("words") >= min(SEED_WORDS, min_words)))

    def of_side(name: str, side: int):
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(name))), F.lit(0))

    more = _extensions(runs, docs).groupBy(F.col("doc_id").alias("_of"), "version", "run").agg(
        F.max("hash").alias("hash"), of_side("chars", 0).alias("left"), of_side("chars", 1).alias("right"),
        of_side("more", 0).alias("left_words"), of_side("more", 1).alias("right_words"),
    )
    whole = runs.join(more, ["version", "run"]).filter(F.col("doc_id").eqNullSafe(F.col("_of")))
    # repeats of a run stand between at most one kept part on each side
    repeat = F.filter("parts", lambda x: ~x["kept"])
    n = F.size("parts")
    lo = F.when(F.get("parts", 0)["kept"] & (F.size(repeat) > 0), 1).otherwise(0)
    hi = F.when(F.get("parts", n - 1)["kept"] & (F.size(repeat) > 0), n - 2).otherwise(n - 1)
    whole = whole.withColumn("lo", lo).withColumn("hi", hi)
    head = F.when(F.col("lo") > 0, F.get("parts", 0)["words"]).otherwise(0)
    foot = F.when(F.col("hi") < n - 1, F.get("parts", n - 1)["words"]).otherwise(0)
    joint = F.col("words") + F.greatest(F.col("left_words") - head, F.lit(0)) + F.greatest(F.col("right_words") - foot, F.lit(0))
    rows = whole.filter(joint >= min_words).select(
        "doc_id", F.col("hash").alias("version"), "lo", "hi", "left_words", "right_words",
        (F.get("parts", F.col("lo"))["start"] - F.col("left")).alias("from"), (F.get("parts", F.col("hi"))["end"] + F.col("right")).alias("to"),
        F.posexplode("parts").alias("i", "p"),
    )
    i, lo, hi, p = F.col("i"), F.col("lo"), F.col("hi"), F.col("p")
    start = F.when(i == lo, F.col("from")).when(i > hi, F.greatest(p["start"], F.col("to"))).otherwise(p["start"])
    end = F.when(i == hi, F.col("to")).when(i < lo, F.least(p["end"], F.col("from"))).otherwise(p["end"])

    def sign(at, beyond):
        return F.when(i == at, 1).when(beyond, -1).otherwise(0)

    words = p["words"] + sign(lo, i < lo) * F.col("left_words") + sign(hi, i > hi) * F.col("right_words")
    return rows.filter(i.between(lo, hi) | (end - start >= MIN_CHUNK)).select(
        "doc_id", "version", start.alias("start"), end.alias("end"), F.greatest(words, F.lit(0)).alias("words"),
        p["chunks"].alias("chunks"), p["copies"].alias("copies"), p["first_doc_id"].alias("first_doc_id"), p["kept"].alias("kept"),
    )


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans that are kept elsewhere taken out of the texts."""
    gone = spans.filter("NOT kept").groupBy(F.col("doc_id").alias("_of"), F.col("version").alias("_version")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_gone")
    )
    # a document has as many spans as its length allows
    rest = F.aggregate(
        "_gone", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda s, g: F.struct(
            F.greatest(s["pos"], g["end"]).alias("pos"),
            F.concat(s["out"], F.substring("text", s["pos"] + 1, F.greatest(g["start"] - s["pos"], F.lit(0)))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring("text", s["pos"] + 1, F.length("text"))),
    )
    own = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.xxhash64("text") == F.col("_version"))
    return docs.join(gone, own, "left").withColumn("text", F.coalesce(rest, "text")).drop("_of", "_version", "_gone")
