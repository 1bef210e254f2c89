"""Importance resampling towards a target distribution by hashed n-gram counts.

Features are the runs of 1 to ``longest`` consecutive words of a text, in hash buckets. A
bucket's gain is the logarithm of its share in the target texts over its share in the
documents; a document's weight is the sum of its features' gains, and Gumbel noise of its id
turns the highest scores into a draw without replacement in proportion to the weights.

Texts are read as bytes in Arrow batches. In each block of occurrences an open-addressed
NumPy table interns the n-grams: an occurrence probes from its xxhash64 key, an empty slot is
taken by the first to write it, and an occurrence stays at a slot whose n-gram has the same
key and, compared byte by byte, the same bytes. A slot has the bucket and the count of its
n-gram, so buckets are hashed once for each distinct n-gram; the first pass adds up counts by
bucket, the second gathers gains through the slot of each occurrence.

One row a bucket and partition is shuffled in the first pass; the sums (one row for each of
``buckets``, a parameter) come to the driver and go back as an array of gains. Documents go
on as numbers only, are sorted by ranges of scores, and get ranks from the running counts of
the ranges (one row each).

Cases: a null or empty text has no words, weight 0 and is never drawn where ``least`` is
positive; a null id draws noise like an empty one and comes after others in ties; rows of one
id have the same noise and are drawn one by one; empty documents give an empty table, empty
targets count as none in every bucket; a text of any length is worked on in blocks; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut

#: Bytes of text read at once, and occurrences interned at once.
BYTES = 1 << 22
BLOCK = 1 << 18
#: Bytes of words: digits, a-z, and those of code points from U+0080 on.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BLANK, STOP = 0x20, 0x00


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Words:
    """The words of a batch of texts in one buffer, joined by one blank."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(text or "").encode().lower() for text in texts]
        own = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
        inside = IN_WORD[own].view(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        limits = np.cumsum([len(r) + 1 for r in raw])
        self.texts = len(raw)
        self.text = np.searchsorted(limits, starts, "right")
        self.counts = np.bincount(self.text, minlength=len(raw))
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.buffer = np.full(len(starts) + int(sizes.sum()), BLANK, np.uint8)
        self.buffer[_ranges(self.starts, sizes)] = own[_ranges(starts, sizes)]

    def grams(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, end and text of every run of 1 to ``longest`` words, in blocks."""
        for n in range(1, longest + 1):
            size = len(self.starts) - n + 1
            for at in range(0, size, BLOCK):
                upto = min(at + BLOCK, size)
                text, last = self.text[at:upto], self.text[at + n - 1:upto + n - 1]
                one = text == last
                yield self.starts[at:upto][one], self.ends[at + n - 1:upto + n - 1][one], text[one]


class GramTable:
    """The distinct n-grams of a block: ``slots`` of the occurrences, ``bucket`` and ``count`` of the slots."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> None:
        from xxhash import xxh64_intdigest

        raw, total = buffer.tobytes(), len(starts)
        keys = np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, total)
        self.capacity = 1 << max(4, (2 * total).bit_length())
        owner = np.full(self.capacity, -1, np.int64)
        sizes = ends - starts
        self.slots = (keys & np.uint64(self.capacity - 1)).astype(np.int64)
        waiting = np.arange(total)
        while len(waiting):
            place = self.slots[waiting]
            free = owner[place] < 0
            owner[place[free]] = waiting[free]
            other = owner[place]
            same = (keys[waiting] == keys[other]) & (sizes[waiting] == sizes[other])
            same[same] = self._equal(buffer, starts, sizes, waiting[same], other[same])
            waiting = waiting[~same]
            self.slots[waiting] = (self.slots[waiting] + 1) & (self.capacity - 1)
        used = np.flatnonzero(owner >= 0)
        first = owner[used]
        self.bucket = np.zeros(self.capacity, np.int64)
        self.bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.count = np.bincount(self.slots, minlength=self.capacity)

    @staticmethod
    def _equal(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether n-grams of one size have the same bytes."""
        out = left == right
        rest = np.flatnonzero(~out)
        if len(rest):
            size = sizes[left[rest]]
            equal = buffer[_ranges(starts[left[rest]], size)] == buffer[_ranges(starts[right[rest]], size)]
            out[rest] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``BYTES`` together, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at, room = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and room + size > BYTES:
            yield batch.slice(at, i - at)
            at, room = i, 0
        room += size
    if batch.num_rows > at:
        yield batch.slice(at)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts (column ``text``) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _slices(batch):
                words = Words(part.column("text").to_pylist())
                for starts, ends, _ in words.grams(longest):
                    table = GramTable(words.buffer, starts, ends, buckets)
                    np.add.at(sums, table.bucket, table.count)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, targets: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of each bucket."""
    size = len(documents)
    all_documents, all_targets = float(documents.sum() + size), float(targets.sum() + size)
    ratios = ((t + 1) * all_documents / ((s + 1) * all_targets) for s, t in zip(documents.tolist(), targets.tolist(), strict=True))
    return np.asarray([math.floor(scale * math.log(ratio)) for ratio in ratios], np.int64)


def noise(key: object, seed: int, scale: int = 1000) -> int:
    """Gumbel noise of a key, scaled and rounded down."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-scale * math.log(-math.log((int(digest[:8], 16) + 0.5) / 2**32)))


def score(docs: DataFrame, by_bucket: np.ndarray, *, longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in _slices(batch):
                words = Words(part.column("text").to_pylist())
                features, weight = np.zeros(words.texts, np.int64), np.zeros(words.texts, np.int64)
                for starts, ends, text in words.grams(longest):
                    table = GramTable(words.buffer, starts, ends, len(gain))
                    np.add.at(weight, text, gain[table.bucket][table.slots])
                    features += np.bincount(text, minlength=words.texts)
                ids = part.column("doc_id")
                drawn = np.asarray([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words.counts, features, weight, weight + drawn))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(scored: DataFrame, *, share: tuple[int, int], least: int) -> DataFrame:
    """Adds ``rank`` to scored rows: 1, 2, ... of the drawn ones, else null.

    Drawn are ``share[0]`` / ``share[1]`` (rounded down) of the rows with ``least`` words or
    more, by descending score, then ascending id.
    """
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = cut(
        scored.filter(able).repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    )
    wanted = F.sum("n").over(W.partitionBy()) * share[0]
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"),
        ((wanted - wanted % share[1]) / share[1]).alias("_drawn"),
    )
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.join(F.broadcast(parts), "_part").withColumn("rank", F.when(rank <= F.col("_drawn"), rank))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [c for c in scored.columns if c != "_row"]
    return drawn.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample(
    docs: DataFrame, targets: DataFrame, *, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
    share: tuple[int, int] = (10, 100), least: int = 20,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    ``targets`` has a column ``text``. Rows with a rank are the sample.
    """
    by_bucket = gains(bucket_counts(docs, buckets, longest), bucket_counts(targets, buckets, longest))
    return ranked(score(docs, by_bucket, longest=longest, seed=seed), share=share, least=least)


#: CRC-32 of the UTF-8 bytes of ``words.word``, in SQL: its table by rule, then a fold over the bytes.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) t(i)),
crcs AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT],
         list_transform(range(length(h) // 2), lambda p: ('0x' || substr(h, 2 * p + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT word, hex(encode(word)) AS h FROM words), crc_table)"""

#: The query's result in SQL.
ORACLE = rf"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(own, []) AS own FROM found),
aims AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
places AS (SELECT r, unnest(own) AS word FROM docs),
words AS (SELECT word FROM places UNION SELECT word FROM aims),
{CRC_SQL.strip()},
hashed AS (SELECT word, crc % 10000 AS bucket FROM crcs),
s AS (SELECT bucket, count(*) AS s FROM places JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM places) + 10000)::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM places JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(own) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
         / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         sum((n_features >= 20)::INT) OVER () * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN place <= drawn THEN place END::BIGINT AS rank
FROM placed
"""
