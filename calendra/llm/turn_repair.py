"""Repair of conversation structure by a run-length dynamic program.

Each row of a conversation has a fault (blank, duplicate, truncated or none) and a role
initial. Edits keep, rerole, delete or insert rows so that the initials read
``(s?(ua)+)?``, at least cost; of the cheapest audits (the edits' initials) the least in
ASCII is taken. As the initials of kept, reroled and inserted rows are forced by the state
of this pattern (nothing yet, after s, after u, after a), an audit decides the repaired rows.

Method: a row's edits are a 4 x 4 min-plus matrix over these states, equal for equal symbols
(initial class and fault). Equal consecutive symbols are one run, and a run advances all
costs by the binary powers of its matrix, kept in a memory of the worker; choices are then
unrolled forward, least letter first, among those on a cheapest path.

A conversation of any size is spread: rows are sorted by ranges of (conversation, order),
so that a *segment* is a conversation's rows in one range. Every segment becomes a matrix;
the few segments of one conversation (one a range at most) meet to get the cost that is to
come after each; every segment is unrolled from every state it may be entered in; and the
conversation's segments meet again to follow the states. Texts are written once sorted, and
merged once with the edits of their segment, read as a stream.

Order: by turn, nulls first, then role, then text. Equal rows stand next to each other.

Cases: a null role or text counts as one space, a null conversation is a conversation; an
empty text is blank; a conversation without rows has no segment; roles are told by their
first letter only, and rows of other initials are reroled or deleted; an empty table gives
an empty one; columns other than conv_id, turn, role and text are left out. The digest of
one conversation (``digests``) reads its repaired rows one after another in one task, as
SHA-256 needs it, without holding them; audits have one letter an edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from calendra.llm.common import cut, ddl
from calendra.llm.importance import CRC_SQL

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = 2, 5, 0, 1
TRUNCATED = 5
FAR = 1 << 60
#: States of the pattern: nothing yet, after s, after u, after a; the pattern may end in the first and the last.
EMPTY, S, U, A = range(4)
STATES = 4
NEXT = (U, U, A, U)
ROLES = {S: "system", U: "user", A: "assistant"}
KEEPS = {("s", EMPTY): S, ("u", EMPTY): U, ("u", S): U, ("u", A): U, ("a", U): A}
ENDS = np.array([0, FAR, FAR, 0], np.int64)
#: Symbols: initial class, then whether the row must go, then whether it is truncated.
CLASSES = "sua?"
STARTS = {"s": S, "u": U, "a": A}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAULTS = ("blank", "duplicate", "truncated")
#: Rows taken out of an Arrow batch at once.
SLICE = 500
#: The letter of symbol 0 in a string of symbols.
FIRST = ord("A")


def symbol_of(initial: str, bad: bool, cut_off: bool) -> int:
    at = CLASSES.find(initial) if initial else -1
    return (at if at >= 0 else 3) * 3 + (1 if bad else 2 if cut_off else 0)


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Min-plus product of matrices, or of a matrix and a vector."""
    if right.ndim == 1:
        return np.minimum((left + right).min(1), FAR)
    return np.minimum((left[:, :, None] + right[None]).min(1), FAR)


def _identity() -> np.ndarray:
    out = np.full((STATES, STATES), FAR, np.int64)
    np.fill_diagonal(out, 0)
    return out


@lru_cache(maxsize=1)
def inserts() -> np.ndarray:
    """Costs of going from state to state by inserted rows alone."""
    one = _identity()
    for state in range(STATES):
        one[state, NEXT[state]] = INSERT
    out = one
    for _ in range(STATES):
        out = times(out, one)
    return out


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that take a row, in ASCII order."""
    initial, fault = CLASSES[symbol // 3], symbol % 3
    out = [("D", DELETE, state)]
    if fault != 1:
        more = TRUNCATED if fault == 2 else 0
        if (initial, state) in KEEPS:
            out.append(("K", KEEP + more, KEEPS[initial, state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@lru_cache(maxsize=4096)
def power(symbol: int, exponent: int) -> np.ndarray:
    """The transition of ``2 ** exponent`` equal rows, inserts before each row included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    row = np.full((STATES, STATES), FAR, np.int64)
    for state in range(STATES):
        for _, cost, after in choices(symbol, state):
            row[state, after] = min(row[state, after], cost)
    return times(inserts(), row)


def advance(symbol: int, count: int, costs: np.ndarray) -> np.ndarray:
    """Costs before a run (from each state) out of the costs after it; matrices alike."""
    exponent = 0
    while count:
        if count & 1:
            costs = times(power(symbol, exponent), costs)
        count >>= 1
        exponent += 1
    return costs


def runs(symbols: Iterable[int]) -> list[tuple[int, int]]:
    """Equal consecutive symbols as (symbol, count)."""
    out: list[tuple[int, int]] = []
    last, count = -1, 0
    for symbol in symbols:
        if symbol != last and count:
            out.append((last, count))
            count = 0
        last, count = symbol, count + 1
    return [*out, (last, count)] if count else out


def segment_matrix(segment: list[tuple[int, int]]) -> np.ndarray:
    out = _identity()
    for symbol, count in reversed(segment):
        out = advance(symbol, count, out)
    return out


def unroll(segment: list[tuple[int, int]], after: np.ndarray, state: int, ending: bool) -> tuple[str, int]:
    """Letters of the cheapest edits of a segment entered in ``state``, and the state it ends in.

    ``after`` has the costs to come after the segment; ``ending`` says that nothing but
    inserted rows comes.
    """
    behind = [after]
    for symbol, count in reversed(segment):
        behind.append(advance(symbol, count, behind[-1]))
    behind.reverse()
    letters: list[str] = []
    for at, (symbol, count) in enumerate(segment):
        costs = [behind[at + 1]]  # after each row of the run, the last one first
        for _ in range(count - 1):
            costs.append(times(power(symbol, 0), costs[-1]))
        now = behind[at].tolist()
        for left in reversed(costs):
            left = left.tolist()
            while True:
                letter, state_after, taken = _choice(symbol, state, now, left)
                letters.append(letter)
                state = state_after
                if taken:
                    break
            now = left
    while ending and state in (S, U):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def _choice(symbol: int, state: int, now: list[int], left: list[int]) -> tuple[str, int, bool]:
    """The least letter on a cheapest path, the next state, and whether the row is taken."""
    found = [(letter, after, True) for letter, cost, after in choices(symbol, state) if cost + left[after] == now[state]]
    if INSERT + now[NEXT[state]] == now[state]:
        found.append(("I", NEXT[state], False))
    return min(found)


# Rows


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) damaged by the hash of their key.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind"))
        .filter("_kind <> 0")
        .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    )


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place and part of the rows, written in their order.

    ``place`` grows with the order; its upper bits are ``part``, the range it was sorted in.
    Equal rows may go to different ranges, so that many copies of one row are spread; they are
    told apart by their place in the input, which must come in the same order when a lost
    executor's part of it is read again, as files do.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "_row"]
    place = F.monotonically_increasing_id()
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    keyed = turns.select("conv_id", "turn", role, text, F.monotonically_increasing_id().alias("_row"))
    return cut(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", place.alias("place"), F.shiftright(place, 33).cast("int").alias("part"))
    )


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, part, initial and fault of ordered rows, without their texts."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    keys = rows.select(
        "conv_id", "turn", "place", "part", F.substring("role", 1, 1).alias("initial"), last.alias("last"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256).alias("same"),
    )
    said = keys.groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    said = said.select(F.col("conv_id").alias("of"), F.col("same").alias("as"), "first")
    marked = keys.join(said, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("as")), "left")
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return marked.select("conv_id", "turn", "place", "part", "initial", fault.alias("fault"))


def segments(marked: DataFrame) -> DataFrame:
    """One row a segment: conv_id, part, ``symbols`` (a letter a row, in order) and counts of faults.

    A segment lies in one range, so the size of a range bounds it.
    """
    at = F.array_position(F.array(*map(F.lit, CLASSES[:3])), F.col("initial")).cast("int")
    fault = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    code = F.when(at > 0, at - 1).otherwise(3) * 3 + fault
    rows = F.array_sort(F.collect_list(F.struct("place", F.char(code + FIRST).alias("symbol"))))
    counted = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in FAULTS]
    return marked.groupBy("conv_id", "part").agg(
        F.array_join(F.transform(rows, lambda r: r["symbol"]), "").alias("symbols"), *counted,
    )


def _runs_of(symbols: str) -> list[tuple[int, int]]:
    return runs(ord(c) - FIRST for c in symbols)


def _illegal(symbols: str) -> int:
    """Neighbours whose initials cannot follow each other."""
    initials = "".join(CLASSES[(ord(c) - FIRST) // 3] for c in symbols)
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))


@lru_cache(maxsize=1 << 14)
def _whole(symbols: str) -> tuple[str, int, int]:
    """Letters, cost and illegal neighbours of a conversation of one segment."""
    segment, end = _runs_of(symbols), times(inserts(), ENDS)
    cost = end
    for symbol, count in reversed(segment):
        cost = advance(symbol, count, cost)
    return unroll(segment, end, EMPTY, True)[0], int(cost[EMPTY]), _illegal(symbols)


def _mapped(df: DataFrame, schema: str, function) -> DataFrame:
    """Columns of ``schema`` after those of ``df``: ``function`` gives their values of a row (a dict)."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [function(row) for row in batch.to_pylist()]
            new = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return df.mapInArrow(run, f"{ddl(df)}, {schema}")


def _grouped(df: DataFrame, schema: str, function) -> DataFrame:
    """conv_id, part and columns of ``schema``: ``function`` gives their values from a conversation's rows by part."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = function(table.to_pylist())
        new = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays([table["conv_id"], table["part"], *new], ["conv_id", "part", *names])

    return df.groupBy("conv_id").applyInArrow(run, f"{ddl(df.select('conv_id', 'part'))}, {schema}")


def _costs_to_come(rows: list[dict]) -> list[tuple[list[int], int, int]]:
    """Costs after each segment, the conversation's cost (at its first), and illegal neighbours across the border before it."""
    after, costs = [], times(inserts(), ENDS)
    for row in reversed(rows):
        after.append(costs.tolist())
        costs = times(np.asarray(row["matrix"], np.int64).reshape(STATES, STATES), costs)
    after.reverse()
    borders = [0, *(_illegal(a["symbols_last"] + b["symbols_first"]) for a, b in zip(rows, rows[1:], strict=False))]
    return [(later, int(costs[EMPTY]) if i == 0 else 0, border) for i, (later, border) in enumerate(zip(after, borders, strict=True))]


def _entries(rows: list[dict]) -> list[tuple[int]]:
    """The state that each segment is entered in."""
    out, state = [], EMPTY
    for row in rows:
        out.append((state,))
        state = row["exits"][state]
    return out


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return left.join(right, same).drop("_conv", "_part")


def plan(marked: DataFrame) -> DataFrame:
    """One row a segment: conv_id, part, ``state`` it is entered in, ``letters`` of its edits, and counts.

    ``cost`` stands at the conversation's first segment; ``illegal`` and the faults add up.
    """
    columns = ["conv_id", "part", "state", "letters", "cost", "illegal", *FAULTS]
    of = W.partitionBy("conv_id")
    found = cut(segments(marked).select("*", F.count("*").over(of).alias("parts"), (F.max("part").over(of) == F.col("part")).alias("ending")))
    alone = _mapped(found.filter("parts = 1"), "letters string, cost bigint, illegal bigint", lambda row: _whole(row["symbols"]))

    def matrix(row: dict) -> tuple:
        return segment_matrix(_runs_of(row["symbols"])).ravel().tolist(), row["symbols"][0], row["symbols"][-1]

    def paths(row: dict) -> tuple:
        segment, after = _runs_of(row["symbols"]), np.asarray(row["after"], np.int64)
        ways = [unroll(segment, after, state, row["ending"]) for state in range(STATES)]
        return [w[0] for w in ways], [w[1] for w in ways], _illegal(row["symbols"]) + row["border"]

    shared = found.filter("parts > 1")
    matrices = _mapped(shared.select("conv_id", "part", "symbols"), "matrix array<bigint>, symbols_first string, symbols_last string", matrix)
    later = _grouped(matrices.drop("symbols"), "after array<bigint>, cost bigint, border bigint", _costs_to_come)
    ways = cut(_mapped(_joined(shared, later), "ways array<string>, exits array<bigint>, illegal bigint", paths))
    entered = _grouped(ways.select("conv_id", "part", "exits"), "state int", _entries)
    several = _joined(ways, entered).withColumn("letters", F.get("ways", F.col("state")))
    return cut(alone.withColumn("state", F.lit(EMPTY)).select(*columns).unionByName(several.select(*columns)))


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, part, number, edit, role and text of the rows after the repair.

    The order is that of (part, number) in a conversation; ``edit`` is I, K or R.
    """
    none = F.lit(None)
    texts = rows.select("conv_id", "part", "place", "role", "text", none.cast("string").alias("letters"), none.cast("int").alias("state"))
    heads = planned.select(
        "conv_id", "part", F.lit(-1).cast("bigint").alias("place"), none.cast("string").alias("role"), none.cast("string").alias("text"), "letters", "state",
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "number", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, number, letters, at, state = None, None, 0, "", 0, EMPTY
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal number
            out.append((conv, part, number, edit, role, text))
            number += 1

        def inserted() -> None:
            nonlocal at, state
            while letters[at:at + 1] == "I":
                at, state = at + 1, NEXT[state]
                put("I", ROLES[state], "")

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), *[pa.string()] * 3]
            for piece in range(0, batch.num_rows, SLICE):
                for row in batch.slice(piece, SLICE).to_pylist():
                    inserted()  # what stands behind the segment's last row, or before this one
                    if row["place"] < 0:
                        conv, part, number = row["conv_id"], row["part"], 0
                        letters, at, state = row["letters"], 0, row["state"]
                        continue
                    edit, at = letters[at], at + 1
                    if edit == "K":
                        state = STARTS[row["role"][0]]
                        put(edit, row["role"], row["text"])
                    elif edit == "R":
                        state = NEXT[state]
                        put(edit, ROLES[state], row["text"])
                yield _batch(out, names, kinds)
                out.clear()
        inserted()
        if out:
            yield _batch(out, names, kinds)

    together = texts.unionByName(heads).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    return together.mapInArrow(run, f"conv_id {kind}, part int, number bigint, edit string, role string, text string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id and ``repaired_sha256`` of the lines ``role:text`` of repaired rows."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    lines = fixed.select("conv_id", "part", "number", F.concat_ws(":", "role", "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, kinds = None, None, []
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.string()]
            out = []
            for piece in range(0, batch.num_rows, SLICE):
                rows = batch.slice(piece, SLICE)
                for own, line in zip(rows["conv_id"].to_pylist(), rows["line"].to_pylist(), strict=True):
                    if running is not None and own == conv:
                        running.update(b"\n")
                    else:
                        if running is not None:
                            out.append((conv, running.hexdigest()))
                        conv, running = own, hashlib.sha256()
                    running.update(line.encode())
            yield _batch(out, ["conv_id", "repaired_sha256"], kinds)
        if running is not None:
            yield _batch([(conv, running.hexdigest())], ["conv_id", "repaired_sha256"], kinds)

    ranged = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ranged.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(turns: DataFrame, rows: DataFrame, marked: DataFrame, planned: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of every conversation of ``turns``.

    ``rows`` are the ordered rows after damage, ``marked`` their faults, ``planned`` the plan.
    """
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = marked.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    parts = F.array_sort(F.collect_list(F.struct("part", "letters")))
    sums = planned.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in (*FAULTS, "illegal", "cost")],
        F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit"),
    )
    out = turns.select("conv_id").distinct()
    for more in (gaps, sums, digests(repaired(rows, planned))):
        more = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """The query's result in SQL: a fold over each conversation's rows, least (cost, audit) by state."""
    far = "{'c': 1000000000::BIGINT, 'a': '', 'd': []::VARCHAR[]}"

    def gone(state: str) -> str:
        return f"{{'c': {state}.c + 2, 'a': {state}.a || 'D', 'd': {state}.d}}"

    def inserted(state: str, role: str) -> str:
        return f"{{'c': {state}.c + 5, 'a': {state}.a || 'I', 'd': list_append({state}.d, '{role}:')}}"

    def kept(state: str, initial: str) -> str:
        done = f"{{'c': {state}.c + late, 'a': {state}.a || 'K', 'd': list_append({state}.d, role || ':' || text)}}"
        return f"CASE WHEN left(role, 1) = '{initial}' AND NOT must THEN {done} ELSE {far} END"

    def reroled(state: str, role: str) -> str:
        done = f"{{'c': {state}.c + 1 + late, 'a': {state}.a || 'R', 'd': list_append({state}.d, '{role}:' || text)}}"
        return f"CASE WHEN must THEN {far} ELSE {done} END"

    into_u = ", ".join([gone("u"), *(f"{kept(x, 'u')}, {reroled(x, 'user')}" for x in "esa")])
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS word FROM conversations),
words AS (SELECT DISTINCT word FROM given),
{CRC_SQL.strip()},
damaged AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN crc % 20 = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given JOIN crcs USING (word) WHERE crc % 20 <> 0),
rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (
  SELECT conv_id, i, turn, role, text, last = '' AS blank, last <> '' AND seen > 1 AS duplicate,
         last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated,
         coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM rows_)),
fold AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'd': []::VARCHAR[]}} AS e, {far} AS s, {far} AS u, {far} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {gone('e')}, list_min([{gone('s')}, {kept('e', 's')}]),
         list_min([{into_u}]), list_min([{gone('a')}, {kept('u', 'a')}, {reroled('u', 'assistant')}])
  FROM (
    SELECT conv_id, i, e, s, u, list_min([a, {inserted('u', 'assistant')}]) AS a, role, text, must, late
    FROM (
      SELECT f.conv_id, m.i, e, s, a, list_min([u, {inserted('e', 'user')}, {inserted('s', 'user')}, {inserted('a', 'user')}]) AS u,
             m.role, m.text, m.blank OR m.duplicate AS must, CASE WHEN m.truncated THEN 5 ELSE 0 END AS late
      FROM fold f JOIN marked m ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = f.i + 1))),
ends AS (
  SELECT conv_id, list_min([e, a, {inserted('u', 'assistant')}]) AS best
  FROM (SELECT conv_id, i, e, a, list_min([u, {inserted('s', 'user')}]) AS u FROM fold)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
  FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(array_to_string(best.d, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN sums ON e.conv_id IS NOT DISTINCT FROM sums.conv_id
"""


ORACLE = _oracle()
