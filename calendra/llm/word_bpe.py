"""BPE with word ends: encoding by a queue of merges over a linked list, and decoding.

A text is cut at ASCII blanks, which no token crosses and no normal form composes. Each
piece is normalized and split as its tokenizer file says; a word's symbols form a doubly
linked list (arrays of the next and the previous symbol), and a priority queue holds the
possible merges by rank, then place. An entry whose symbols have merged since is stale and
is skipped when it comes up. Pieces seen before are looked up in a bounded memory of the
worker, so a worker mostly merges distinct words; what it forgets is only merged again.
Decoding concatenates the vocabulary's strings with a blank between them, as for any file
that names no decoder.

Nothing is shuffled: a text is encoded where it is read. The tokenizer file is read on the
driver and broadcast (its size does not grow with the data).

Cases: a null text counts as empty and has no tokens; strings of added tokens in a text
become their ids, as the file has them; a text of one long word takes n log n steps; symbols
outside the vocabulary have no token where the file has no unknown token; equal texts give
equal ids; an empty table gives an empty table; ids outside the vocabulary decode to
nothing; all columns of the input other than ``ids``, ``n_tokens`` and ``decoded`` are kept.
Files with dropout, prefixes of continued words, byte fallback, a decoder or unusual added
tokens are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendra.llm.common import ddl, without

#: Pieces, and words, that a worker remembers (about 200 bytes each), and the longest of them.
REMEMBERED = 1 << 19
LONGEST = 64
#: Texts encoded between two outputs of a worker.
SLICE = 256


def linked_merges(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols after all merges, lowest rank first and leftmost of equals.

    ``merges`` maps a pair of symbols, ``left << 32 | right``, to its rank and the symbol
    that it becomes. ``pairs`` has the pair that starts at each place now; a queue entry of
    another pair is stale.
    """
    size = len(symbols)
    symbols = [*symbols]
    after = [*range(1, size), -1]
    before = [*range(-1, size - 1)]
    pairs = [-1] * size
    queue: list[tuple[int, int, int, int]] = []
    for at in range(size - 1):
        pairs[at] = pair = symbols[at] << 32 | symbols[at + 1]
        if pair in merges:
            rank, merged = merges[pair]
            queue.append((rank, at, pair, merged))
    heapq.heapify(queue)
    while queue:
        _, at, pair, merged = heapq.heappop(queue)
        if pairs[at] != pair:
            continue
        gone = after[at]
        symbols[at], pairs[gone] = merged, -1
        after[at] = right = after[gone]
        if right >= 0:
            before[right] = at
            pairs[at] = pair = merged << 32 | symbols[right]
            if pair in merges:
                rank, new = merges[pair]
                heapq.heappush(queue, (rank, at, pair, new))
        else:
            pairs[at] = -1
        left = before[at]
        if left >= 0:
            pairs[left] = pair = symbols[left] << 32 | merged
            if pair in merges:
                rank, new = merges[pair]
                heapq.heappush(queue, (rank, left, pair, new))
    out, at = [], 0 if size else -1
    while at >= 0:
        out.append(symbols[at])
        at = after[at]
    return out


class Vocabulary:
    """What encoding and decoding need of a tokenizer file."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        added = spec["added_tokens"]
        odd = [t for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or spec["decoder"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or odd:
            raise ValueError("only plain BPE files with plain added tokens and no decoder are read")
        whole = Tokenizer.from_str(source)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.ids: dict[str, int] = model["vocab"]
        self.unknown = self.ids.get(model["unk_token"]) if model["unk_token"] is not None else None
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left] << 32 | self.ids[right]] = rank, self.ids[left + right]
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        strings = {i: s for s, i in (self.ids | self.added).items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def merged(self, word: str) -> list[int]:
        """Ids of a word as the splitter gives it."""
        if (known := self.words.get(word)) is not None:
            return known
        symbols = []
        for at, char in enumerate(word):
            found = self.ids.get(char + self.suffix if at == len(word) - 1 else char, self.unknown)
            if found is not None:
                symbols.append(found)
        ids = linked_merges(symbols, self.merges)
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [word for word, _ in self.splitter.pre_tokenize_str(normal)]

    def piece(self, raw: bytes) -> bytes:
        """Packed ids of a text without ASCII blanks."""
        text, ids, at = raw.decode(), [], 0
        for found in self.special.finditer(text) if self.added else ():
            for word in self.split(text[at:found.start()]):
                ids += self.merged(word)
            ids.append(self.added[found[0]])
            at = found.end()
        for word in self.split(text[at:]):
            ids += self.merged(word)
        packed = array("I", ids).tobytes()
        if len(raw) <= LONGEST:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[raw] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        known = self.pieces.get
        packed = []
        for raw in (text or "").encode().split():
            found = known(raw)
            packed.append(self.piece(raw) if found is None else found)
        return b"".join(packed)

    def decode(self, packed: bytes | None) -> str:
        strings = self.strings
        size = len(strings)
        ids = np.frombuffer(packed or b"", "<u4")
        if len(ids) and int(ids.max()) >= size:
            ids = ids[ids < size]
        return " ".join([strings[i] for i in ids.tolist()])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(key: str, source) -> Vocabulary:
    """A worker's vocabulary of a broadcast file, kept with its memory between tasks."""
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(source.value.decode())
    return _VOCABULARIES[key]


def _file(df: DataFrame, path: str):
    with open(path, "rb") as source:
        raw = source.read()
    return hashlib.sha256(raw).hexdigest(), df.sparkSession.sparkContext.broadcast(raw)


def _mapped(df: DataFrame, path: str, column: str, name: str, kind: str, method: str, keep: list[str]) -> DataFrame:
    """``keep`` and a new column: ``method`` of the vocabulary applied to ``column``."""
    key, source = _file(df, path)
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = getattr(vocabulary(key, source), method)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = pa.array([apply(v) for v in part.column(column).to_pylist()], arrow)
                kept = part.select(keep)
                yield pa.RecordBatch.from_arrays([*kept.columns, new], [*keep, name])

    schema = ddl(df.select(*[F.col(f"`{c}`") for c in keep]))
    return df.mapInArrow(run, f"{schema}, {name} {kind}" if schema else f"{name} {kind}")


def encode(docs: DataFrame, path: str, *, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to ``keep``.

    ``path`` is a tokenizer file, ``keep`` the columns of ``docs`` to keep (all).
    """
    docs = without(docs, "ids", "n_tokens")
    kept = [c for c in docs.columns if keep is None or c in keep]
    coded = _mapped(docs, path, "text", "ids", "binary", "encode", kept)
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (string) to rows with ``ids``; null ids count as none."""
    encoded = without(encoded, "decoded")
    return _mapped(encoded, path, "ids", "decoded", "string", "decode", encoded.columns)
