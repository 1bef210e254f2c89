"""Conversation repair against a plain dynamic program and an exhaustive search."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from calendra.llm import turn_repair
from calendra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def with_faults(rows):
    """role, text and fault of one conversation's rows in order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        found = BLANK.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by least (cost, audit) of every prefix and state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def offer(into, state, cost, audit, done):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, done)

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, done) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in step[state]:
                        offer(best, step[state][role[0]], cost + 5, audit + "I", (*done, (role, "")))
        return best

    for role, text, fault in rows:
        best, after = inserted(best), {}
        for state, (cost, audit, done) in best.items():
            offer(after, state, cost + 2, audit + "D", done)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] in step[state]:
                offer(after, step[state][role[:1]], cost + more, audit + "K", (*done, (role, text)))
            for new in ("user", "assistant"):
                if new[0] in step[state]:
                    offer(after, step[state][new[0]], cost + 1 + more, audit + "R", (*done, (new, text)))
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        marked = with_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, done = cheapest(marked)
        count = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def report(df):
    rows = turn_repair.ordered(turn_repair.damaged(df))
    marked = turn_repair.faults(rows)
    return turn_repair.report(df, rows, marked, turn_repair.plan(marked))


def as_tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_turn_repair"](spark, SF)
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in got.schema] == [
        "conv_id:bigint", *[f"{c}:bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "audit:string", "repaired_sha256:string"]
    assert as_tuples(got) == plain(rows)


def drawn(seed, convs, most):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "assistant", "user"]
    texts = ["Yes.", "No", " \n", "", None, "Why?", "é!  ", "a.\x0b", "　", "long " * 50]
    rows = []
    for conv in convs:
        for turn in range(draw.randrange(most)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), draw.choice(roles), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations_equal_plain(spark, seed):
    rows = drawn(seed, [None, *range(60)], 14)
    df = spark.createDataFrame(rows, SCHEMA).select(*[F.lit("x").alias(c) for c in ("part", "letters", "place")], "*").repartition(3)
    assert as_tuples(report(df)) == plain(rows)


def test_hot_conversation_over_many_ranges(spark):
    rows = drawn(11, [7], 2) + [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 90}{'.' if t % 5 else ''}") for t in range(3000)]
    often = next(t for t in itertools.count(1000) if zlib.crc32(f"7:{t}".encode()) % 20 > 4)
    rows += [(7, often, "user", "the same.")] * 900 + drawn(12, range(8, 20), 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        after = turn_repair.ordered(turn_repair.damaged(df))
        sizes = {r["part"]: r["count"] for r in after.filter("conv_id = 7").groupBy("part").count().collect()}
        assert len(sizes) > 5
        copies = after.filter("text = 'the same.'").groupBy("part").count().count()
        assert copies > 1  # copies of one row are spread
        assert as_tuples(report(df)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_all_gone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert report(none).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = as_tuples(report(spark.createDataFrame([(1, dropped, "user", "a.")], SCHEMA)))
    assert got == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_powers_equal_steps():
    draw = random.Random(4)
    for _ in range(200):
        symbol, count = draw.randrange(12), draw.randrange(1, 70)
        costs = np.array([draw.randrange(30) for _ in range(4)], np.int64)
        stepped = costs
        for _ in range(count):
            stepped = turn_repair.times(turn_repair.power(symbol, 0), stepped)
        assert turn_repair.advance(symbol, count, costs).tolist() == stepped.tolist()
    assert turn_repair.advance(3, 10**12, np.array([0, 10, 5, 0])).shape == (4,)


def test_audits_are_the_least_of_all_cheapest():
    """Exhaustive: all strings of edits of short conversations."""
    symbols = [("user", None), ("assistant", None), ("system", None), ("tool", None), ("user", "truncated"), ("assistant", "blank")]

    @lru_cache(maxsize=None)
    def ways(rows, state, inserts):
        """All (cost, audit) that end well, with at most so many inserted rows."""
        out = []
        if not rows and state in ("", "a"):
            out.append((0, ""))
        nxt = "a" if state == "u" else "u"
        if inserts:
            out += [(c + 5, "I" + a) for c, a in ways(rows, nxt, inserts - 1)]
        if rows:
            (role, fault), rest = rows[0], rows[1:]
            out += [(c + 2, "D" + a) for c, a in ways(rest, state, inserts)]
            if fault != "blank":
                more = 5 if fault else 0
                if role[0] == nxt or (role[0] == "s" and state == ""):
                    out += [(c + more, "K" + a) for c, a in ways(rest, role[0], inserts)]
                out += [(c + 1 + more, "R" + a) for c, a in ways(rest, nxt, inserts)]
        return out

    for n in range(5):
        for rows in itertools.product(symbols, repeat=n):
            want = min(ways(rows, "", 2))
            code = "".join(chr(turn_repair.FIRST + turn_repair.symbol_of(r[:1], f == "blank", f == "truncated")) for r, f in rows)
            letters, cost, _ = turn_repair._whole(code)
            assert (cost, letters) == want, rows
