"""Byte-level BPE encoding and decoding.

Distinct words (matches of the split pattern) are encoded by Spark's higher-order functions:
an ``aggregate`` folds the merges over the array of a word's byte tokens, one merge a step,
always the lowest rank and the leftmost of equals, looking ranks up in a literal map (hash
buckets of token pairs). The words that stand in several texts of a bounded sample are
folded first and become a dictionary that every Python worker holds. It cuts a text before
each run of blanks, where a word always begins, looks the pieces up in a bounded memory,
splits those it has forgotten, and writes the words it knows; the others of a text are folded
once each where the text is, by the same expression, and put into the gaps. No row of a word
is shuffled but for the sample's counts. Decoding concatenates the tokens' bytes.

The dictionary only saves work: its size and sample change no result.

Cases: a null text counts as empty and has no tokens; words of over ``LONG_WORD`` bytes, whose
fold would copy long arrays at each step, are merged with a heap; pieces
outside ASCII are split by a tokenizer library, whose tables say what a letter is; equal texts
give equal ids; an empty table gives an empty table; all columns of the input except ``ids``
and ``n_tokens`` are kept as they are. The split pattern must begin a word at each run of
blanks that follows another character, as those of public byte-level tokenizers do.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendra.llm.common import cut, ddl, without

#: Words of the dictionary (about 250 bytes each in a worker), and texts of the sample they are taken from.
DICTIONARY_SIZE = 1 << 17
SAMPLE = 1 << 16
#: Bytes of a word from which it is merged with a heap; offsets of the fold have 12 bits.
LONG_WORD = 500
#: Texts that a worker takes out of a batch at once, pieces that it remembers, and the longest of them.
SLICE = 128
REMEMBERED = 1 << 15
LONGEST = 48
#: A run of blanks (those of Unicode) and what follows up to the next one.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
BUCKETS = 1 << 16
NO_RANK = 2**31 - 1
ID_MASK = (1 << 20) - 1
OFFSET_MASK = (1 << 32) - (1 << 20)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank by line, as in public rank files."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _rank_map(path: str) -> tuple[str, str]:
    """JSON of the byte tokens, and of the pairs' keys and ranks by bucket."""
    ranks = read_ranks(path)
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                bucket = (left * 40_503 + right) % BUCKETS
                keys[bucket].append(left << 32 | right)
                values[bucket].append(rank)
    return json.dumps([ranks[bytes([b])] for b in range(256)]), json.dumps({"k": keys, "v": values})


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fold_merges(word: Column, path: str) -> Column:
    """array<int> of the word's token ids: the fold of ranked merges over its bytes."""
    byte_json, pair_json = _rank_map(path)
    byte_ids = F.from_json(F.lit(byte_json), "array<bigint>")
    pairs = F.from_json(F.lit(pair_json), "struct<k: array<array<bigint>>, v: array<array<bigint>>>")
    return _let(F.struct(byte_ids.alias("b"), pairs["k"].alias("k"), pairs["v"].alias("v")), lambda table: _fold(word, table))


def _fold(word: Column, table: Column) -> Column:
    """The state is one bigint a token: rank of the pair it starts, byte offset, token id.

    Its smallest element is the pair to merge: lowest rank, then leftmost.
    """

    def ident(state: Column) -> Column:
        return state.bitwiseAND(ID_MASK)

    def rank(left: Column, right: Column) -> Column:
        bucket = ((left * 40_503 + right) % BUCKETS).cast("int")
        found = F.array_position(F.get(table["k"], bucket), F.shiftleft(left, 32) + right).cast("int")
        return F.shiftleft(F.coalesce(F.get(F.get(table["v"], bucket), found - 1), F.lit(NO_RANK)), 32)

    def merged(state: Column, pair: Column, at: Column) -> Column:
        token = F.shiftright(pair, 32)
        own = rank(token, ident(F.get(state, at + 1))) + pair.bitwiseAND(OFFSET_MASK) + token
        left = F.get(state, at - 2)
        new = F.when(at == 1, F.array(own)).otherwise(
            F.array(rank(ident(left), token) + left.bitwiseAND(OFFSET_MASK | ID_MASK), own)
        )
        return F.concat(
            F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))), new, F.slice(state, at + 2, F.size(state)),
        )

    def step(state: Column, _: Column) -> Column:
        return _let(
            F.array_min(state),
            lambda pair: F.when(pair >= NO_RANK << 32, state).otherwise(
                _let(F.array_position(state, pair).cast("int"), lambda at: merged(state, pair, at))
            ),
        )

    def fold(ids: Column) -> Column:
        start = F.transform(
            ids,
            lambda t, i: rank(t, F.get(ids, i + 1)) + F.shiftleft(i.cast("bigint"), 20) + t,
        )
        steps = F.sequence(F.lit(1), F.size(ids) - 1)
        state = F.when(F.size(ids) < 2, start).otherwise(F.aggregate(steps, start, step))
        return F.transform(state, lambda e: ident(e).cast("int"))

    raw = F.decode(word.cast("binary"), "ISO-8859-1")  # a character for each byte
    return _let(F.transform(F.split(raw, ""), lambda c: F.get(table["b"], F.ascii(c))), fold)


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps, for very long words."""
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    live = [True] * len(word)

    def offer(at: int) -> None:
        if (after := ends[at]) < len(word):
            rank = ranks.get(word[at:ends[after]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[at], ends[after]))

    heap: list[tuple[int, int, int, int]] = []
    for at in range(len(word)):
        offer(at)
    while heap:
        _, at, middle, end = heapq.heappop(heap)
        if not live[at] or ends[at] != middle or ends[middle] != end:
            continue
        live[middle] = False
        ends[at] = end
        if end < len(word):
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return out


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _hex_ids(word: Column, path: str) -> Column:
    """The ids of a word as hex digits, little-endian, eight to an id."""

    def digits(i: Column) -> Column:
        low, high = i.bitwiseAND(255), F.shiftright(i, 8).bitwiseAND(255)
        turned = F.shiftleft(low.cast("bigint"), 24) + F.shiftleft(high.cast("bigint"), 16) + F.shiftleft(F.shiftright(i, 16).cast("bigint"), 8)
        return F.lpad(F.hex(turned), 8, "0")

    return F.array_join(F.transform(fold_merges(word, path), digits), "")


def _is_long(word: str) -> bool:
    return len(word) * 4 > LONG_WORD and len(word.encode()) > LONG_WORD


def frequent_words(docs: DataFrame, path: str, pattern: str, size: int) -> pa.Table:
    """word and hex ids of at most ``size`` words, those that stand in most texts of a sample."""
    total = docs.count()
    texts = docs.select("text")
    sampled = texts.sample(False, min(1.0, SAMPLE / total), seed=1) if total > SAMPLE else texts
    found = F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))
    words = sampled.select(F.explode(F.array_distinct(found)).alias("word")).where(F.octet_length("word") <= LONG_WORD)
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    # the least number of texts that leaves no more words than wanted, from a histogram of these numbers
    least, room = 2, size
    for n, many in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        room -= many
        if room < 0:
            least = n + 1
            break
    frequent = counts.where(F.col("n") >= least).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "word")
    return frequent.select("word", _hex_ids(F.col("word"), path).alias("ids")).toArrow()


class Encoder:
    """A worker's dictionary of words (hex ids), and its memory of pieces that it knows whole."""

    def __init__(self, words: pa.Table, pattern: str, ranks: dict[bytes, int]) -> None:
        import regex
        from tokenizers import Regex, pre_tokenizers

        self.words = dict(zip(words["word"].to_pylist(), words["ids"].to_pylist(), strict=True))
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.careful = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.pieces: dict[str, str] = {}

    def split(self, piece: str) -> list[str]:
        return self.find(piece) if piece.isascii() else [word for word, _ in self.careful.pre_tokenize_str(piece)]

    def encode(self, text: str | None) -> tuple[list[str], list[int | None], list[str]]:
        """Hex ids between the gaps, the unknown word in each gap (none after the last), and the unknown words."""
        gaps: dict[str, int] = {}
        runs: list[str] = []
        order: list[int | None] = []
        run: list[str] = []
        known, words = self.pieces.get, self.words
        for piece in PIECE.findall(text or ""):
            ids = known(piece)
            if ids is not None:
                run.append(ids)
                continue
            whole, before = True, len(run)
            for word in self.split(piece):
                ids = words.get(word)
                if ids is None and _is_long(word):
                    ids = _pack(heap_merges(word.encode(), self.ranks)).hex()
                if ids is None:
                    runs.append("".join(run))
                    run = []
                    order.append(gaps.setdefault(word, len(gaps)))
                    whole = False
                else:
                    run.append(ids)
            if whole and len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = "".join(run[before:])
        runs.append("".join(run))
        order.append(None)
        return runs, order, list(gaps)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(sent, pattern: str, ranks) -> Encoder:
    """A worker's encoder of broadcast words and ranks, kept between tasks."""
    key = hash((sent.value, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pa.ipc.open_stream(sent.value).read_all(), pattern, ranks.value)
    return _ENCODERS[key]


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def encode(
    docs: DataFrame, path: str, pattern: str, *, keep: list[str] | None = None, dictionary_size: int = DICTIONARY_SIZE,
) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to ``keep``.

    ``path`` is a rank file, ``pattern`` the split pattern of the tokenizer, ``keep`` the
    columns to keep (all).
    """
    docs = without(docs, "ids", "n_tokens", "_parts", "_places", "_missed")
    kept = [c for c in docs.columns if keep is None or c in keep]
    context = docs.sparkSession.sparkContext
    known = context.broadcast(_stream(frequent_words(docs, path, pattern, dictionary_size)))
    ranks = context.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(known, pattern, ranks)
        strings, numbers = pa.list_(pa.string()), pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [encoder.encode(text) for text in part.column("text").to_pylist()]
                parts, places, missed = zip(*texts, strict=True)
                yield _with(
                    part.select(kept), _parts=pa.array(parts, strings), _places=pa.array(places, numbers), _missed=pa.array(missed, strings),
                )

    schema = ddl(docs.select(*[F.col(f"`{c}`") for c in kept]))
    gapped = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])]).mapInArrow(
        run, f"{schema + ', ' if schema else ''}_parts array<string>, _places array<int>, _missed array<string>"
    )
    folded = F.transform("_missed", lambda word: _hex_ids(word, path))

    def filled(gaps: Column) -> Column:
        return F.array_join(F.zip_with("_parts", "_places", lambda part, place: F.concat(part, F.coalesce(F.get(gaps, place), F.lit("")))), "")

    ids = F.coalesce(F.unhex(_let(folded, filled)), F.lit(b""))
    coded = gapped.select(*[F.col(f"`{c}`") for c in kept], ids.alias("ids"))
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the concatenated bytes of ``ids``; null ids count as none.

    Encoding and decoding in one stage keep two Python workers a core alive; write the
    encoded rows first where memory is short.
    """
    table = {rank: token for token, rank in read_ranks(path).items()}
    pieces = encoded.sparkSession.sparkContext.broadcast([table.get(i, b"") for i in range(max(table) + 1)])
    encoded = without(encoded, "decoded")

    def concat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(piece, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            yield _with(batch, decoded=pa.array(texts, pa.binary()))

    return encoded.mapInArrow(concat, f"{ddl(encoded)}, decoded binary")
