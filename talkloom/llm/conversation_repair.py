"""Structure repair of conversations at least cost, by Four-Russians block tables.

A conversation's role initials should read ``(s?(ua)+)?``. Rows are kept, given
the role of user or assistant, or deleted, and empty rows inserted; the cheapest
edits win, of equally cheap ones those whose letters come first. Only one of ten
symbols of a row matters for that: whether it is blank, a duplicate, truncated
or whole, and how its role begins.

What remains to be paid from a row on depends on which of four states its
predecessors left (nothing, after s, after u, after a). Less their least, such
cost vectors are few, so the vector before a block of ``LENGTH`` symbols is a
table's entry for the block and the vector behind it. A conversation is read
from its end by lookups, with a vector kept for every ``SEGMENT`` rows. Then it
is read from its start: each segment looks up the vectors behind its blocks, and
each block is expanded backward, symbol by symbol, so that at every row the
first letter that still costs the least is known. Another letter leads to another
state, so this is the first of all cheapest texts, whatever ties.

Both readings are streams of a conversation's rows, sorted by Spark: a task holds
a segment of symbols, one text and one vector for each 4,096 rows. Texts move once, for
the second reading, as a digest of a whole conversation must be made in order.
Duplicates are found by an aggregation over digests that combines before it moves.

Defined cases: null roles and texts are one space, null ids and turns too in
what is hashed for the damage; null turns come first, rows of one turn go by
role and the text's MD5; a null conversation id is a conversation of its own; a
conversation without rows after damage has no edits; no rows give no
conversations; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import stored

#: Costs, and what counts as white space and as an end.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FILLED, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Blank, duplicate; whole and truncated rows whose role begins with u, a, s or otherwise.
SYMBOLS = "BDuas-UAS+"
LENGTH, SEGMENT = 3, 4096
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a user or assistant row, which is all that can be inserted.
_then = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEVER = 1 << 20

Vector = tuple[int, int, int, int]


def _inserted(base: list[int]) -> Vector:
    """Costs when rows may be inserted before going on."""
    u, a = min(base[AFTER_U], INSERT + base[AFTER_A]), min(base[AFTER_A], INSERT + base[AFTER_U])
    return min(base[START], INSERT + u), min(base[AFTER_S], INSERT + u), u, a


#: Costs behind the last row.
END: Vector = _inserted([0, NEVER, NEVER, 0])


def _ways(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may happen to a row, by letter."""
    ways = [("D", DELETE, state)]
    if symbol in "BD":
        return ways
    more, initial = (0, symbol) if symbol in "uas-" else (TRUNCATED, symbol.lower())
    if initial == "s" and state == START:
        ways.append(("K", more, AFTER_S))
    elif initial == "ua"[state == AFTER_U]:
        ways.append(("K", more, _then[state]))
    return [*ways, ("R", REROLE + more, _then[state])]


def _before(symbol: str, behind: Vector) -> Vector:
    return _inserted([min(cost + behind[to] for _, cost, to in _ways(symbol, state)) for state in range(4)])


def normalised(costs: Vector) -> Vector:
    return tuple(c - min(costs) for c in costs)


@functools.cache
def tables() -> tuple[list[Vector], dict[str, tuple[int, ...]]]:
    """All normalised cost vectors, and for every symbol and block the vector before it for each vector behind it."""
    vectors, place = [normalised(END)], {normalised(END): 0}
    steps: dict[str, list[int]] = {s: [] for s in SYMBOLS}
    for v in vectors:  # grows meanwhile
        for s in SYMBOLS:
            new = normalised(_before(s, v))
            if new not in place:
                place[new] = len(vectors)
                vectors.append(new)
            steps[s].append(place[new])
    found = {s: tuple(x) for s, x in steps.items()}
    for block in map("".join, itertools.product(SYMBOLS, repeat=LENGTH)):
        at = range(len(vectors))
        for s in reversed(block):
            at = [steps[s][v] for v in at]
        found[block] = tuple(at)
    return vectors, found


def behind_blocks(symbols: str, behind: int) -> tuple[int, list[int]]:
    """The vector before the symbols, and those behind each of their blocks, from the vector behind them all."""
    _, table = tables()
    out = []
    for at in reversed(range(0, len(symbols), LENGTH)):
        out.append(behind)
        block = symbols[at : at + LENGTH]
        if len(block) == LENGTH:
            behind = table[block][behind]
        else:
            for s in reversed(block):
                behind = table[s][behind]
    return behind, out[::-1]


@functools.cache
def expanded(block: str, behind: int, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of each row of a block, insertions before it included, and the state that they lead to."""
    vectors, table = tables()
    after = [behind]
    for s in reversed(block[1:]):
        after.append(table[s][after[-1]])
    edits = []
    for s, v in zip(block, reversed(after), strict=True):
        costs, letters = _before(s, vectors[v]), ""
        while not letters or letters[-1] == "I":
            ways = [*_ways(s, state), ("I", INSERT, _then[state])]
            letter, _, to = min(w for w in ways if w[1] + (costs if w[0] == "I" else vectors[v])[w[2]] == costs[state])
            letters, state = letters + letter, to
        edits.append(letters)
    return tuple(edits), state


def traced(symbols: str, behind: int, state: int) -> tuple[list[str], int]:
    """The edits of each row of a segment, and the state behind it."""
    edits: list[str] = []
    for at, v in zip(range(0, len(symbols), LENGTH), behind_blocks(symbols, behind)[1], strict=True):
        block, state = expanded(symbols[at : at + LENGTH], v, state)
        edits += block
    return edits, state


def closing(state: int) -> str:
    """Insertions behind the last row."""
    return {AFTER_S: "II", AFTER_U: "I"}.get(state, "")


def _order(*more: str, down: bool = False) -> list[Column]:
    columns = [F.col(c) for c in ("conv", "turn", "role", "h", "tie", *more)]
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c in columns]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, h, tie, gone``: the rows after damage, and a row without text for each that was dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")
    return stored(rows.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("tie", F.monotonically_increasing_id()), "damaged")


def symbols(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, h, tie, symbol`` of rows as :func:`damaged` gives them."""
    blank = ~F.col("text").rlike(FILLED)
    fault = F.when(blank, "B").when(~F.col("text").rlike(ENDED), "T").otherwise("")
    slim = rows.where("not gone").select("conv", "turn", "role", "h", "tie", fault.alias("fault"))
    again = slim.where("fault <> 'B'").groupBy("conv", "role", "h").agg(F.min(F.struct("turn", "tie")).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("h").alias("_h"), F.col("first.tie").alias("first"))
    seen = slim.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("h") == F.col("_h")), "left")
    initial = F.substring("role", 1, 1)
    begins = F.when(initial.isin("u", "a", "s"), initial).otherwise(F.when(F.col("fault") == "T", "+").otherwise("-"))
    symbol = F.when(F.col("fault") == "B", "B").when(F.col("tie") != F.col("first"), "D").when(F.col("fault") == "T", F.upper(begins)).otherwise(begins)
    return seen.select("conv", "turn", "role", "h", "tie", symbol.alias("symbol"))


def segments(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, h, tie, symbols, behind``: for every segment the key of its first row, its symbols and the vector behind it."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "turn", "role", "h", "tie", "symbols", "behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, seen, behind, types = None, [], 0, None

        def close() -> int:
            told = "".join(reversed(seen))
            done.append((*key, told, behind))
            seen.clear()
            return behind_blocks(told, behind)[0]

        for b in batches:
            types = [*[f.type for f in b.schema][:5], pa.string(), pa.int32()]
            for *new, symbol in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is not None and (new[0] != key[0] or len(seen) == SEGMENT):
                    before = close()
                    behind = before if new[0] == key[0] else 0
                key = new
                seen.append(symbol)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()
        if key is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    ordered = rows.repartition("conv").sortWithinPartitions(*_order(down=True))
    return ordered.select("conv", "turn", "role", "h", "tie", "symbol").mapInArrow(run, f"conv {kind}, turn long, role string, h string, tie long, symbols string, behind int")


class _Repaired:
    """What is known of a conversation while its rows go by."""

    def __init__(self):
        self.text, self.first, self.audit, self.state = hashlib.sha256(), True, [], START
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.turn = self.initial = None
        self.edits: Iterator[str] = iter(())
        self.roles = START  # the state of what has been written

    def segment(self, symbols: str, behind: int) -> None:
        edits, self.state = traced(symbols, behind, self.state)
        self.blank, self.duplicate, self.truncated = self.blank + symbols.count("B"), self.duplicate + symbols.count("D"), self.truncated + sum(map(symbols.count, "UAS+"))
        self.audit.append(told := "".join(edits))
        self.cost += DELETE * told.count("D") + INSERT * told.count("I") + REROLE * told.count("R") + TRUNCATED * sum(s in "UAS+" and e[-1] != "D" for s, e in zip(symbols, edits, strict=True))
        self.edits = iter(edits)

    def write(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if self.roles == AFTER_U else "user"
        self.roles = AFTER_S if role[:1] == "s" else _then[self.roles]
        self.text.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def row(self, turn: int | None, role: str, text: str) -> None:
        *inserted, letter = next(self.edits)
        for _ in inserted:
            self.write(None, "")
        if letter != "D":
            self.write(role if letter == "K" else None, text)
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.least = turn if self.least is None else self.least

    def result(self) -> tuple:
        for letter in closing(self.state):
            self.audit.append(letter)
            self.cost += INSERT
            self.write(None, "")
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of rows as :func:`damaged` gives them."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, read, conv_type = None, None, None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return out

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, turn, role, text, gone, told, behind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if read is None or conv != now:
                    if read:
                        done.append((now, *read.result()))
                    now, read = conv, _Repaired()
                if told is not None:
                    read.segment(told, behind)
                elif not gone:
                    read.row(turn, role, text)
            if len(done) >= 1000:
                yield batch()
        if read:
            done.append((now, *read.result()))
        if done:
            yield batch()

    texts = rows.select("conv", "turn", "role", "h", "tie", F.lit(1).alias("kind"), "text", "gone", F.lit(None).cast("string").alias("symbols"), F.lit(None).cast("int").alias("behind"))
    marks = segments(symbols(rows)).select("conv", "turn", "role", "h", "tie", F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit(False).alias("gone"), "symbols", "behind")
    ordered = texts.unionByName(marks).repartition("conv").sortWithinPartitions(*_order("kind"))
    return ordered.select("conv", "turn", "role", "text", "gone", "symbols", "behind").mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def report(conversations: DataFrame, conv_col: str = "conv_id", **how) -> DataFrame:
    """Damages the conversations, repairs them, and tells what was found and done."""
    return repaired(damaged(conversations, conv_col, **how)).withColumnRenamed("conv", conv_col)


def _oracle() -> str:
    """A forward table of (cost, letters, text) for each state and row, without vectors or blocks."""
    add = lambda s, cost, letter, piece="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {piece}}}"
    best = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    never, nothing = "{'c': 1000000, 'a': '', 't': ''}", "{'c': 0, 'a': '', 't': ''}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def put(state: str, initial: str, role: str) -> str:
        own = f"CASE WHEN initial = '{initial}' THEN {add(state, 'more', 'K', 'own')} ELSE {add(state, '(3 + more)', 'R', f'chr(10) || {role!r} || chr(58) || text')} END"
        return f"CASE WHEN must THEN {never} ELSE {own} END"

    rows = [
        add("s0", 4, "D"),
        best(add("s1", 4, "D"), f"CASE WHEN must OR initial <> 's' THEN {never} ELSE {add('s0', 'more', 'K', 'own')} END"),
        best(add("s2", 4, "D"), *[put(s, "u", "user") for s in ("s0", "s1", "s3")]),
        best(add("s3", 4, "D"), put("s2", "a", "assistant")),
    ]
    insert2 = best("b2", *[add(s, 3, "I", user) for s in ("b0", "b1", "b3")])
    closed = lambda given: f"SELECT * EXCLUDE (b0, b1, b2, b3, c2), b0 AS s0, b1 AS s1, c2 AS s2, {best('b3', add('c2', 3, 'I', assistant))} AS s3 FROM (SELECT *, {insert2} AS c2 FROM ({given}))"
    step = f"SELECT p.conv_id, p.i, {', '.join(f'{x} AS b{k}' for k, x in enumerate(rows))} FROM paid JOIN placed p ON p.conv_id IS NOT DISTINCT FROM paid.conv_id AND p.i = paid.i + 1"
    start = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {nothing} AS b0, {never} AS b1, {never} AS b2, {never} AS b3 FROM (SELECT DISTINCT conv_id FROM conversations)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crc
), kept AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM kept
), told AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ragged,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS wrong
  FROM numbered
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, blank OR again AS must, CASE WHEN ragged THEN 3 ELSE 0 END AS more, chr(10) || role || chr(58) || text AS own FROM told
), paid AS (
  {closed(start)}
  UNION ALL
  {closed(step)}
), ends AS (
  SELECT conv_id, {best("s0", "s3")} AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM paid) WHERE back = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND ragged) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM told GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
