"""LM scoring: Brown class-based n-grams.

log P(text) = sum of log P(class | class before) + log P(word | class). Every word seen twice
or more has one of ``CLASSES`` classes. Exchange clustering starts with the ``CORE`` most
frequent words: in each round Spark sums, for every word, the classes of its neighbours, and
half of the words move to the class that raises the likelihood of the class bigrams most.
The other words are then placed by their contexts among the core's classes, and, with ``TURNS``,
moved again by halves against a table of class bigrams that is counted anew before each
turn; their contexts and best classes are rows of Spark.
Three more classes hold the words that were left out by a limit (``clustered``), the words
seen once or never, and the end of a text, which is also what stands before its first word.

Transitions are smoothed with the classes' frequencies, words seen once or never by adding
one, with one unseen word. The probabilities of all words after any class sum to 1.

What reaches the driver is bounded: the ``HEAD`` most frequent words and their classes, a row
for each core word and class, and the table of class bigrams. Words outside the head are
rows that meet their classes and counts in joins, as 64-bit hashes in the bigrams; frequent
words are in the head and never joined, so no key is hot.

Cases: a null text is an empty one, whose only token is the end; without training texts all
probabilities are 1 / 1 for the base and even for the model; ties in frequency go by code
point; repeated rows are scored each; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, lower_bytes, shuffles_removed

CORE = 2048
CLASSES = 64
HEAD = 180_000
ROUNDS = 6
#: Turns of the words outside the core after they were placed; each moves half of them. On 25 MB
#: of text two turns lower the held-out perplexity from 11,750 to 11,745 (base 15,515) and take
#: twice the time, so none is the default.
TURNS = 0
SMOOTH = 5.0
#: Symbols behind the clustered words, and their classes behind the classes.
MID, TAIL, STOP = range(3)
#: The end of a text among the counted words.
END_WORD = ""


def is_training(doc_id: Column) -> Column:
    """The remainder of the id's CRC by 7 is not 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; ``END_WORD`` counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    found.update(lower_bytes(text).split())
            found[END_WORD.encode()] = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "c"]
            )

    return texts.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class _Dictionary(dict):
    """Place of a word by its bytes; ``missing`` for others."""

    def __init__(self, words: bytes):
        with pa.ipc.open_stream(words) as rows:
            column = rows.read_all()["word"].cast(pa.binary()).to_pylist()
        super().__init__(zip(column, range(len(column))))
        self.missing = len(column)

    def __missing__(self, word: bytes) -> int:
        return self.missing

    def places(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = lower_bytes(text).split()
        return words, np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _symbols(places: np.ndarray, size: int, clustered: int) -> np.ndarray:
    return np.where(places >= size, clustered + TAIL, np.minimum(places, clustered + MID))


def word_key(word: Column) -> Column:
    """A negative number for a word outside the head."""
    return F.xxhash64(word).bitwiseOR(F.lit(-(2**63)))


def bigrams(texts: DataFrame, words, size: int) -> DataFrame:
    """(a, b, n) of neighbouring words, text ends included; a pair may have several rows.

    Words are places in the head or ``word_key``, text ends are ``size``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _Dictionary(words.value)
        stop = np.array([size], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                parts = [stop]
                for text in batch.column(0).slice(at, 2500).to_pylist():
                    found, places = known.places(text)
                    others = np.flatnonzero(places == size)
                    keys = [xxhash.xxh64_intdigest(found[i], 42) | 1 << 63 for i in others.tolist()]
                    places[others] = np.array(keys, np.uint64).view(np.int64)
                    parts += (places, stop)
                used, row = np.unique(np.concatenate(parts), return_inverse=True)
                pairs, n = np.unique(row[:-1] * len(used) + row[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used[pairs // len(used)]), pa.array(used[pairs % len(used)]), pa.array(n, pa.int64())], ["a", "b", "n"]
                )

    # most pairs stand once: adding them up would move more rows than it saves
    return texts.select("text").mapInArrow(run, "a bigint, b bigint, n bigint")


def _symbol_pairs(pairs: DataFrame, size: int, clustered: int) -> DataFrame:
    def symbol(c: str) -> Column:
        return (
            F.when(F.col(c) < 0, clustered + TAIL).when(F.col(c) == size, clustered + STOP)
            .otherwise(F.least(F.col(c), F.lit(clustered + MID))).cast("int").alias(c)
        )

    return pairs.select(symbol("a"), symbol("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contexts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol: counts of the classes after and before it, and of itself after itself."""
    of = F.from_json(F.lit(json.dumps(classes.tolist())), "array<int>")
    rows = (
        pairs.select(F.col("a").alias("w"), F.get(of, "b").alias("c"), F.lit(0).alias("side"), "n")
        .union(pairs.select(F.col("b"), F.get(of, "a"), F.lit(1), "n"))
        .union(pairs.filter("a = b").select("a", F.lit(0), F.lit(2), "n"))
        .groupBy("w", "c", "side").agg(F.sum("n").alias("n")).toArrow()
    )
    w, c, side, n = (rows[k].to_numpy() for k in ("w", "c", "side", "n"))
    out = np.zeros((3, len(classes), n_classes))
    out[side, w, c] = n
    return out[0], out[1], out[2][:, 0]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, n_open: int, moving: np.ndarray) -> np.ndarray:
    """The classes after each word of ``moving`` went to its best of the first ``n_open``."""
    classes, k = classes.copy(), after.shape[1]
    table = np.zeros((k, k))
    np.add.at(table, classes, after)
    f = _xlogx
    for w in moving.tolist():
        at, r, l, s = classes[w], after[w].copy(), before[w].copy(), own[w]
        if not r.sum():
            continue
        table[at] -= r
        table[:, at] -= l
        table[at, at] += s
        np.maximum(table, 0, out=table)  # neighbours that moved in this round are counted where they were
        r[at] -= s
        l[at] -= s
        t = table[:n_open]
        u = table[:, :n_open]
        d = np.arange(n_open)
        x, rd, ld = table[d, d], r[d], l[d]
        gain = (f(t + r) - f(t)).sum(1) + (f(u + l[:, None]) - f(u)).sum(0)
        gain += f(x + rd + ld + s) + f(x) - f(x + rd) - f(x + ld)
        rows, cols = table.sum(1)[:n_open], table.sum(0)[:n_open]
        gain -= f(rows + r.sum() + s) - f(rows) + f(cols + l.sum() + s) - f(cols)
        to = int(gain.argmax())
        classes[w] = to
        table[to] += r
        table[:, to] += l
        table[to, to] += s
    return classes


def _array(values: np.ndarray, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values.tolist())), f"array<{kind}>")


def _classed(rows: DataFrame, word: str, name: str, head: np.ndarray, rest: DataFrame | None, tail: int) -> DataFrame:
    """Adds the class of the column ``word``; ``rest``: (w, k) of the words outside the head."""
    inside = rows.filter(F.col(word) >= 0).withColumn(name, F.get(_array(head, "int"), F.col(word).cast("int")))
    outside = rows.filter(F.col(word) < 0)
    if rest is None:
        outside = outside.withColumn(name, F.lit(tail))
    else:
        own = rest.select(F.col("w").alias(word), F.col("k").alias(name))
        outside = outside.join(own, word, "left").withColumn(name, F.coalesce(name, F.lit(tail)))
    return inside.unionByName(outside)


def _table(pairs: DataFrame, head: np.ndarray, rest: DataFrame | None, n_classes: int, tail: int) -> np.ndarray:
    """Counts of the class bigrams."""
    rows = _classed(_classed(pairs, "a", "ca", head, rest, tail), "b", "cb", head, rest, tail)
    found = rows.groupBy("ca", "cb").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((n_classes, n_classes))
    table[found["ca"].to_numpy(), found["cb"].to_numpy()] = found["n"].to_numpy()
    return table


def best_classes(at: np.ndarray, of: np.ndarray, side: np.ndarray, c: np.ndarray, n: np.ndarray, table: np.ndarray, n_open: int) -> np.ndarray:
    """The class of the first ``n_open`` that raises the likelihood most, for each word.

    ``at``: the words' classes; of each context: word (ascending), side, class, count.
    """
    f, opened = _xlogx, np.arange(n_open)
    n = n.astype(float)[:, None]
    t = np.where(side[:, None] == 0, table[:n_open].T[c], table[c, :n_open])
    t = np.maximum(t - n * (at[of][:, None] == opened), 0)
    gain = np.add.reduceat(f(t + n) - f(t), np.flatnonzero(np.diff(of, prepend=-1)))
    for k, sums in enumerate((table.sum(1), table.sum(0))):
        own = np.bincount(of, n[:, 0] * (side == k), len(at))[:, None]
        t = np.maximum(sums[:n_open] - own * (at[:, None] == opened), 0)
        gain -= f(t + own) - f(t)
    return gain.argmax(1)


def _moved(pairs: DataFrame, core: int, size: int, head: np.ndarray, rest: DataFrame | None, vocabulary: DataFrame, table: np.ndarray, n_open: int, half: int | None) -> DataFrame:
    """(w, k): the best class of every word of ``vocabulary`` (w, k) in this half."""
    tail = n_open + TAIL
    sides = []
    for side, (word, other) in enumerate((("a", "b"), ("b", "a"))):
        mine = pairs.filter((F.col(word) < 0) | F.col(word).between(core, size - 1))
        if half is not None:
            mine = mine.filter(F.pmod(F.col(word), F.lit(2)) == half)
        sides.append(_classed(mine, other, "c", head, rest, tail).select(F.col(word).alias("w"), F.lit(side).alias("side"), "c", "n"))
    lists = (
        sides[0].union(sides[1]).groupBy("w", "side", "c").agg(F.sum("n").alias("n"))
        .groupBy("w").agg(F.collect_list(F.struct("side", "c", "n")).alias("near"))  # at most two for each class
        .join(vocabulary, "w").select("w", F.col("k").cast("int"), "near")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                near = part.column(2)
                flat = near.flatten()
                side, c, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                of = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy(zero_copy_only=False))
                k = best_classes(part.column(1).to_numpy(zero_copy_only=False), of, side, c, n, table, n_open)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k, pa.int32())], ["w", "k"])

    return lists.mapInArrow(run, "w bigint, k int")


def place_others(pairs: DataFrame, counts: DataFrame, own: np.ndarray, size: int, n_open: int) -> tuple[np.ndarray, DataFrame]:
    """Classes of all words of the head and, as rows (w, k), of those outside it.

    ``own``: the classes of the core and of the three symbols behind it; ``counts``: (w) of
    the words outside the head.
    """
    spark, core, k = pairs.sparkSession, len(own) - 3, n_open + 3
    head = np.concatenate([own[:core], np.full(size - core, n_open + MID), [n_open + STOP]]).astype(np.int32)
    rest = None
    for turn in range(TURNS + 1):
        table = _table(pairs, head, rest, k, n_open + TAIL)
        inside = spark.range(core, size).select(F.col("id").alias("w"), F.get(_array(head, "int"), F.col("id").cast("int")).alias("k"))
        outside = counts.select("w", F.lit(n_open + TAIL).alias("k")) if rest is None else rest
        half = None if turn == 0 else turn % 2
        moved = cut(_moved(pairs, core, size, head, rest, inside.union(outside), table, n_open, half))
        new = moved.filter("w >= 0").toArrow()
        head[new["w"].to_numpy()] = new["k"].to_numpy()
        changed = moved.filter("w < 0")
        if half is not None:
            changed = cut(changed.union(rest.filter(F.pmod("w", F.lit(2)) != half)))
        rest = changed
    return head, rest


class Model:
    """Everything that scoring needs: the head, classes, logarithms to base 10.

    ``rest``: by class, the counts of the words outside the head; ``n_rest``: how many these are.
    """

    def __init__(self, words: pa.Table, classes: np.ndarray, transitions: np.ndarray, n: int, v: int, texts: int, rest: np.ndarray | None = None, n_rest: int = 0):
        counts = words["c"].to_numpy().astype(float)
        self.size, self.clustered = len(counts), len(classes) - 3
        self.classes, k = classes, len(transitions)
        rest = np.zeros(k) if rest is None else rest
        total = transitions.sum()
        share = (transitions.sum(0) + 1) / (total + k)
        self.transitions = np.log10((transitions + SMOOTH * share) / (transitions.sum(1, keepdims=True) + SMOOTH))
        own = classes[_symbols(np.arange(self.size), self.size, self.clustered)]
        self.mass = np.bincount(own, counts, minlength=k) + rest
        self.emissions = np.log10(counts / self.mass[own]) if self.size else np.empty(0)
        self.n, self.v = n, v
        self.bottom = float(n + v + 1)
        self.base = np.log10((counts + 1) / self.bottom)
        self.base_end = float(np.log10((texts + 1) / self.bottom))
        self.end_known = int(texts > 0)
        self.tail = float(n - counts.sum() - rest.sum() - texts + max(0, v - self.size - n_rest - (texts > 0)) + 1)


def train(texts: DataFrame, *, clustered: int | None = None, classes: int = CLASSES, dictionary: int | None = None, rounds: int = ROUNDS, core: int = CORE, head: int = HEAD):
    """(counts, broadcast words, model) of the training ``texts`` (text).

    ``counts``: (word, c, k), with the class of the words outside the head. ``dictionary`` and
    ``clustered`` limit the words of the model and those with classes; without them all words
    seen twice or more have classes.
    """
    with shuffles_removed(texts.sparkSession):
        return _train(texts, clustered, classes, dictionary, rounds, core, head)


def _train(texts: DataFrame, clustered: int | None, classes: int, dictionary: int | None, rounds: int, core: int, head: int):
    spark = texts.sparkSession
    whole = clustered is None and dictionary is None
    counts = cut(word_counts(texts))
    n, v, more = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if((F.col("word") != END_WORD) & (F.col("c") > 1))
    ).first()
    ends = counts.filter(F.col("word") == END_WORD).first()
    several = counts.filter((F.col("word") != END_WORD) & (F.col("c") > 1))
    top = several.orderBy(F.desc("c"), "word").limit(head if dictionary is None else dictionary).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.select(["word"]).schema) as writer:
        writer.write_table(top.select(["word"]))
    words = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    size, texts_seen = top.num_rows, ends["c"] if ends else 0
    core = min(core if clustered is None else clustered, size)
    pairs = cut(bigrams(texts, words, size))
    symbols = cut(_symbol_pairs(pairs, size, core))
    own = np.append(np.arange(core) % classes, classes + np.arange(3))
    for turn in range(rounds):
        sides = contexts(symbols, own, classes + 3)
        own = exchange(own, *sides, classes, np.arange(turn % 2, core, 2))
    if not whole or more == core:
        after = contexts(symbols, own, classes + 3)[0]
        transitions = np.zeros((classes + 3, classes + 3))
        np.add.at(transitions, own, after)
        return counts.withColumn("k", F.lit(None).cast("int")), words, Model(top, own, transitions, n, v, texts_seen)
    # the head's last word and those after it in frequency, then code point
    last_c, last_word = top["c"][size - 1].as_py(), top["word"][size - 1].as_py()
    behind = several.filter((F.col("c") < last_c) | ((F.col("c") == last_c) & (F.col("word") > last_word)))
    keyed = behind.select("word", "c", word_key(F.col("word")).alias("w"))
    inside, rest = place_others(pairs, keyed.select("w").distinct(), own, size, classes)
    transitions = _table(pairs, inside, rest, classes + 3, classes + TAIL)
    placed = keyed.join(rest, "w").select("word", "k", "c")
    sums = placed.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = np.zeros(classes + 3)
    for r in sums:
        mass[r["k"]] = r["c"]
    model = Model(top, np.append(inside[:size], classes + np.arange(3)), transitions, n, v, texts_seen, mass, sum(r["n"] for r in sums))
    return cut(counts.join(placed.select("word", "k"), "word", "left")), words, model


def score(docs: DataFrame, counts: DataFrame, words, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text).

    One row a text goes on with its sums over words of the head, and one for each place of
    another word, which meets its count and class in a join; ``before`` and ``after`` are the
    classes next to it, as far as these words are in the head.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "word", "place", "before", "after", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, _Dictionary(words.value)
        row = TaskContext.get().partitionId() << 33
        stop = m.classes[m.clustered + STOP]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found, places = known.places(text)
                    inside = places < m.size
                    chain = np.concatenate([[stop], np.where(inside, m.classes[_symbols(places, m.size, m.clustered)], -1), [stop]])
                    sure = (chain[:-1] >= 0) & (chain[1:] >= 0)
                    logs = m.transitions[chain[:-1][sure], chain[1:][sure]].sum() + m.emissions[places[inside]].sum()
                    base = m.base[places[inside]].sum() + m.base_end
                    others = np.flatnonzero(~inside)
                    # a word with a blank stands nowhere: it carries the text's own row
                    first = (row, doc_id, f" {row}".encode(), -2, 0, 0, len(found) + 1, int(inside.sum()) + m.end_known, float(base), float(logs))
                    for column, value in zip(out, first, strict=True):
                        column.append(value)
                    more = len(others)
                    sides = chain[others].tolist(), chain[others + 2].tolist()
                    listed = others.tolist()
                    for column, values in zip(out, ([row] * more, [None] * more, [found[i] for i in listed], listed, *sides, [0] * more, [0] * more, [0.0] * more, [0.0] * more), strict=True):
                        column.extend(values)
                    row += 1
                types = [pa.int64(), part.schema.field("doc_id").type, pa.binary(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, word string, place int, before int, after int, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    width = len(model.transitions)
    logs = _array(np.append(model.transitions.ravel(), 0.0), "double")
    mass = _array(model.mass, "double")
    c = F.coalesce("c", F.lit(0))
    order = W.partitionBy("row").orderBy("place")
    near = (
        rows.join(counts, "word", "left").withColumn("c", c).withColumn("own", F.coalesce("k", F.lit(width - 3 + TAIL)))
        .withColumn("before", F.when(F.lag("place").over(order) == F.col("place") - 1, F.lag("own").over(order)).otherwise(F.col("before")))
        .withColumn("joined", F.coalesce(F.lead("place").over(order) == F.col("place") + 1, F.lit(False)))
    )
    other = F.col("place") >= 0

    def log(a: Column, b: Column) -> Column:
        return F.get(logs, (a * width + b).cast("int"))

    steps = log(F.col("before"), F.col("own")) + F.when(F.col("joined"), 0.0).otherwise(log(F.col("own"), F.col("after")))
    word = F.when(F.col("k").isNull(), F.log10((F.col("c") + 1) / F.lit(model.tail))).otherwise(F.log10(F.col("c") / F.get(mass, F.col("own"))))
    joined = near.select(
        "row", "doc_id", "n_tokens",
        (F.col("n_known") + F.when(other & (F.col("c") > 0), 1).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.when(other, F.log10((F.col("c") + 1) / F.lit(model.bottom))).otherwise(0.0)).alias("base_score"),
        (F.col("score") + F.when(other, steps + word).otherwise(0.0)).alias("score"),
    )
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    ).drop("row")
