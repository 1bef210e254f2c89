"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes (64 bits) of its distinct shingles of five words; with
fewer words, that of the whole sequence. Two sets link when their Jaccard coefficient is
75 % or more. Equal sets are one: only different sets are compared.

1. Every set is ordered by one global order, hash by hash with the hashes that many sets
   share last, and its prefix (n - ceil(0.75 n) + 1 hashes) is dealt out by hash. Partners
   have a hash of both prefixes in common. Hashes of one set only are dropped.
2. Groups: each set is compared with one centre, the one that it shares most prefix
   hashes with; the components of these links are the groups.
3. The token-group matrix has a row for each hash and group: the union of the prefixes of
   the group's sets. A set's number of hashes in a group's row, with what the sizes leave
   for the hashes behind the prefixes, bounds its overlap with any set of the group. Only
   groups whose bound allows a link are opened, and only pairs of different groups compared.
4. Links of both steps give the components.

Comparisons are exact, from the texts. Groups of many near copies cost one comparison a
member in step 2 and one matrix row a hash in step 3. No list of partners is cut off.

Cases: null and empty texts and texts without words have no shingles and link with
nothing; a null id counts in no minimum; repeated rows are equal sets; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, has_repeats, lower_bytes
from calendra.llm.components import components, maybe_in

SHINGLE = 5
PERCENT = 75
#: Hashes that many sets share and that stand last in the order: at most so many (1 MB).
SHARED_HASHES = 1 << 17
#: Sets that have a hash in common within one block of texts, to count it as shared.
SHARED_IN_BLOCK = 2
BLOCK_HASHES = 1_500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = lower_bytes(text).split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(own))
    n = len(own) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = total * _P + own[i:i + n]
    return np.unique(_mix(total))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def prefix_size(n):
    return n - (PERCENT * n + 99) // 100 + 1


def profiles(docs: DataFrame) -> DataFrame:
    """Rows (kind 0: doc_id, n, set), and (kind 1: n times hash ``set``) shared in a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        block: dict[int, np.ndarray] = {}
        held = 0

        def shared() -> pd.DataFrame:
            found, times = np.unique(np.concatenate([*block.values(), np.empty(0, np.uint64)]), return_counts=True)
            often = times >= SHARED_IN_BLOCK
            return pd.DataFrame({"kind": 1, "doc_id": None, "n": times[often], "set": found[often].view(np.int64)})

        for batch in batches:
            ns, sets = [], []
            for text in batch["text"]:
                own = shingles(text, hashes)
                ns.append(len(own))
                sets.append(set_id(own))
                if len(own) and sets[-1] not in block:
                    block[sets[-1]] = own
                    held += len(own)
                if held >= BLOCK_HASHES:
                    yield shared()
                    block.clear()
                    held = 0
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"], "n": ns, "set": sets})
        yield shared()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"kind int, doc_id {kind}, n bigint, `set` bigint")


def prefixes(docs: DataFrame, shared: np.ndarray) -> DataFrame:
    """Rows (hash, set, n, place) of every set's prefix; ``shared``: the hashes that stand last."""
    last = docs.sparkSession.sparkContext.broadcast(np.sort(shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, late = _WordHashes(), last.value
        for batch in batches:
            seen: set[int] = set()
            parts, owners, sizes, held = [], [], [], 0
            for text in batch["text"]:
                own = shingles(text, hashes)
                ident = set_id(own)
                if not len(own) or ident in seen:
                    continue
                seen.add(ident)
                is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own if len(late) else np.zeros(len(own), bool)
                own = np.concatenate([own[~is_late], own[is_late]])[:prefix_size(len(own)) if len(own) else 0]
                parts.append(own)
                owners.append(ident)
                sizes.append(len(is_late))
                held += len(own)
                if held >= BLOCK_HASHES // 8:
                    yield _rows(parts, owners, sizes)
                    parts, owners, sizes, held = [], [], [], 0
            if parts:
                yield _rows(parts, owners, sizes)

    return docs.select("text").mapInPandas(run, "hash bigint, `set` bigint, n int, place int")


def _rows(parts: list[np.ndarray], owners: list[int], sizes: list[int]) -> pd.DataFrame:
    counts = [len(p) for p in parts]
    return pd.DataFrame({
        "hash": np.concatenate(parts).view(np.int64),
        "set": np.repeat(np.array(owners, np.int64), counts),
        "n": np.repeat(np.array(sizes, np.int32), counts),
        "place": np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
    })


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def linked(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: sets) that link, compared from the texts of one owner each."""
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    wanted = cut(owners.join(ends, "set").select("set", "key"))
    texts = docs.select(_key("doc_id").alias("key"), "text").filter(maybe_in(wanted.select("key"), _key("doc_id")))
    known = wanted.join(texts, "key").select("set", "text")
    rows = (
        pairs.join(known.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
        .join(known.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            found, last, left = [], None, None
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if text_b is not last or left is None:
                    left, last = shingles(text_b, hashes), text_b
                right = shingles(text_a, hashes)
                common = len(np.intersect1d(left, right, assume_unique=True))
                union = len(left) + len(right) - common
                # an id that several texts share may bring another text's set
                if 100 * common >= PERCENT * union and set_id(right) == a and set_id(left) == b:
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select("a", "b", "text_a", "text_b").mapInPandas(run, "a bigint, b bigint")


def _sizes_fit(n: str, other: str) -> Column:
    return (100 * F.least(n, other) >= PERCENT * F.greatest(n, other))


def centre_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each set and the centre with which it shares most prefix hashes.

    The centre of a hash is the set of it with most shared hashes: among near copies that is
    one with few words of its own, which links with most of the others.
    """
    n_b = F.col("centre.n").alias("n_b")
    degrees = shared.groupBy("set").agg(F.count("*").alias("degree"))
    ranked = shared.select("hash", "set", "n").join(degrees, "set")
    centres = ranked.groupBy("hash").agg(F.max(F.struct("degree", "set", "n")).alias("centre"))
    counts = (
        ranked.join(centres, "hash").filter(F.col("set") != F.col("centre.set")).select("set", "n", F.col("centre.set").alias("b"), n_b)
        .filter(_sizes_fit("n", "n_b")).groupBy("set", "n", "b").agg(F.count("*").alias("c"))
    )
    best = counts.groupBy("set", "n").agg(F.max(F.struct("c", F.col("b"))).alias("best"))
    # fewer common hashes than this never link sets of one size
    enough = F.col("best.c") >= 0.3 * (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    return best.filter(enough).select(F.col("set").alias("a"), F.col("best.b").alias("b"))


def _room(n: str, place: str) -> Column:
    """A hash at this place (from 0) is common to partners first if 3 times the partner's size
    is no more: place <= n - ceil(3 (n + partner) / 7)."""
    return 4 * F.col(n) - 7 * F.col(place)


def opened_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): sets, and the members of the groups that their bound opens."""
    own = cut(
        shared.select("hash", "set", "n", "place").join(labels.withColumnRenamed("id", "set"), "set", "left")
        .withColumn("label", F.coalesce("label", "set")).withColumn("room", _room("n", "place"))
    )
    matrix = own.groupBy("hash", "label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("widest"))
    several = matrix.groupBy("hash").agg(F.count("*").alias("groups")).filter("groups > 1").select("hash")
    matrix = cut(matrix.join(several, "hash").withColumnRenamed("label", "group"))
    rows = own.join(several, "hash", "left_semi")
    smallest = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
    met = (
        rows.filter("room >= 0").join(matrix.filter("widest >= 0"), "hash").filter(F.col("label") < F.col("group"))
        .filter((100 * F.col("most") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("least")))
        .filter((F.col("widest") >= 3 * F.col("n")) & (F.col("room") >= 3 * smallest))
        .select("set", "group").distinct()
    )
    members = own.select(F.col("label").alias("group"), F.col("set").alias("b"), F.col("n").alias("n_b")).distinct()
    alone = (
        members.groupBy("group").agg(F.count("*").alias("sets"), F.min("b").alias("only"))
        .filter((F.col("sets") == 1) & (F.col("only") == F.col("group"))).select("group")
    )
    met = cut(met.join(alone.withColumn("alone", F.lit(True)), "group", "left"))
    overlap = (
        met.filter("alone IS NULL").join(rows.select("hash", "set", "n"), "set").join(matrix, ["hash", "group"]).groupBy("set", "n", "group")
        .agg(F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most"))
    )
    # groups of several sets, hash by hash
    low = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
    high = F.least("most", F.floor(F.col("n") * 100 / PERCENT))

    def behind(size: Column) -> Column:
        """Common hashes that a partner of this size needs within the prefixes of one side."""
        return F.ceil((F.col("n") + size) * PERCENT / (100 + PERCENT)) - 1

    def rest(size: Column) -> Column:
        return F.ceil(size * PERCENT / 100) - 1

    need = F.least(behind(low) - rest(F.col("n")), behind(high) - rest(high))
    opened = overlap.filter((low <= high) & (F.col("common") >= need)).select("set", "n", "group")
    several_sets = opened.join(members, "group").filter(_sizes_fit("n", "n_b")).select(F.col("set").alias("a"), "b")
    # groups of one set, whose row of the matrix is the set's own prefix
    own_rows = rows.groupBy("set", "n").agg(F.collect_list("hash").alias("hashes"))
    partners = own_rows.select(F.col("set").alias("group"), F.col("n").alias("n_b"), F.col("hashes").alias("theirs"))
    n_b = F.col("n_b")
    enough = F.size(F.array_intersect("hashes", "theirs")) >= F.least(behind(n_b) - rest(F.col("n")), behind(n_b) - rest(n_b))
    single_sets = (
        met.filter("alone").select("set", "group").join(own_rows, "set").join(partners, "group")
        .filter(_sizes_fit("n", "n_b") & enough).select(F.col("set").alias("a"), F.col("group").alias("b"))
    )
    return several_sets.union(single_sets).distinct()


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    found = cut(profiles(docs))
    sets = found.filter("kind = 0").select("doc_id", "n", "set")
    often = (
        found.filter("kind = 1").groupBy("set").agg(F.sum("n").alias("times"))
        .orderBy(F.desc("times"), "set").limit(SHARED_HASHES).select("set").toArrow()
    )
    shared_hashes = np.array(often["set"].to_numpy(), np.int64).view(np.uint64)
    by_hash = W.partitionBy("hash")
    shared = cut(
        prefixes(docs, shared_hashes)
        .withColumn("low", F.min("set").over(by_hash)).withColumn("high", F.max("set").over(by_hash))
        .filter("low <> high").drop("low", "high")
    )
    owners = sets.filter("n > 0").groupBy("set").agg(F.min(_key("doc_id")).alias("key"))
    first = cut(linked(centre_pairs(shared), docs, owners))
    labels = components(first)
    second = linked(opened_pairs(shared, labels), docs, owners)
    labels = components(first.union(second))
    placed = sets.join(labels.withColumnRenamed("id", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = placed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return placed.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; equal rows once."""
    kept = join(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if has_repeats(docs) else rows
