"""License scans: fuzzy search for short notices.

A phrase of the notices may be found with ``edits(phrase)`` errors at most. By the
pigeonhole principle one of its ``edits + 1`` pieces then stands in the text unchanged: one
automaton finds the pieces of all phrases, and only the window around such a seed is
verified, by the regex library's bounded-error matching. A match starts and ends at word
borders; its span is given in words and in code points of the text.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.

Cases: null and empty texts have no words and no matches; each row is scanned by itself, so
ties and repeated rows give equal results and an empty table an empty one; the columns
``n_words`` and ``matches`` of the input are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from calendra.llm.common import ddl, without

#: Phrases whose exact places count as base places.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels.
NOTICES = {
    **BASE,
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "isc license": "isc",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
    "spdx license identifier": "spdx",
}
MATCH = "array<struct<label: string, phrase: string, word: bigint, start: bigint, `end`: bigint, edits: int>>"
#: Lower case for A-Z, a blank for every ASCII character that isn't a letter or digit.
_FOLD = bytes(
    b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)
).lower()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def edits(phrase: str) -> int:
    return len(phrase) // 10


class Scanner:
    """The automaton of seeds and the bounded-error patterns of one set of notices."""

    def __init__(self, notices: Mapping[str, str]):
        import ahocorasick
        import regex

        self.notices = list(notices.items())
        self.patterns = [
            regex.compile(rf"(?b)(?<= )(?:{regex.escape(p, literal_spaces=True)}){{e<={edits(p)}}}(?= )") for p, _ in self.notices
        ]
        seeds = defaultdict(list)
        for at, (phrase, _) in enumerate(self.notices):
            pieces = edits(phrase) + 1
            cuts = [len(phrase) * i // pieces for i in range(pieces + 1)]
            for start, end in zip(cuts, cuts[1:]):
                seeds[phrase[start:end]].append((at, start))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        words = (text or "").encode().translate(_FOLD).split(b" ")
        words = [w for w in words if w]
        if not words:
            return 0, []
        norm = f" {b' '.join(words).decode()} "
        found: dict[tuple[int, int, int], int] = {}
        done: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(norm):
            for at, offset in places:
                start = end + 1 - size - offset
                if (at, start) in done:
                    continue
                done.add((at, start))
                phrase = self.notices[at][0]
                slack = edits(phrase)
                match = self.patterns[at].search(
                    norm, max(0, start - slack), min(len(norm), start + len(phrase) + slack + 1)
                )
                if match:
                    found[at, match.start(), match.end()] = sum(match.fuzzy_counts)
        return len(words), self._spans(text, norm, self._best(found)) if found else []

    @staticmethod
    def _best(found: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int, int]]:
        """Without matches that overlap one of the same phrase with fewer edits."""
        kept: list[tuple[int, int, int, int]] = []
        last: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (at, start, end), errors in sorted(found.items(), key=lambda x: (x[1], x[0])):
            if errors == 0 or all(end <= s or e <= start for s, e in last[at]):
                last[at].append((start, end))
                kept.append((start, end, at, errors))
        return sorted(kept)

    def _spans(self, text: str, norm: str, matches: list[tuple[int, int, int, int]]) -> list[tuple]:
        places = [m.span() for m in _WORD.finditer(text)]
        out, seen, word = [], 0, -1
        for start, end, at, errors in matches:
            word += norm.count(" ", seen, start)
            seen = start
            last = word + norm.count(" ", start, end)
            phrase, label = self.notices[at]
            out.append((label, phrase, word, places[word][0], places[last][1], errors))
        return out


def scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """Adds ``n_words`` and ``matches`` (label, phrase, first word, span, edits) by place."""
    docs = without(docs, "n_words", "matches")
    notices = dict(notices)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        names = ("label", "phrase", "word", "start", "end", "edits")
        for batch in batches:
            n_words, matches = [], []
            for text in batch["text"]:
                n, found = scanner.scan(text if isinstance(text, str) else None)
                n_words.append(n)
                matches.append([dict(zip(names, m, strict=True)) for m in found])
            yield batch.assign(n_words=n_words, matches=matches)

    return docs.mapInPandas(run, f"{ddl(docs)}, n_words bigint, matches {MATCH}")
