"""Conversation repair against a plain forward table, against all edits, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from talkloom.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, written rows) over (must, role, text, ragged), by a table of all rows and states, from the front."""
    emit = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def inserted(at):
        for _ in range(3):
            for q, (cost, audit, out) in list(at.items()):
                for c in "ua":
                    if (to := emit.get((q, c))) is not None:
                        new = (cost + 3, audit + "I", (*out, (names[c], "")))
                        at[to] = min(at.get(to, new), new)
        return at

    at = inserted({0: (0, "", ())})
    for must, role, text, ragged in rows:
        new = {}
        for q, (cost, audit, out) in at.items():
            ways = [(q, (cost + 4, audit + "D", out))]
            if not must:
                ways += [(emit[q, c], (cost + 3 + 3 * ragged, audit + "R", (*out, (names[c], text)))) for c in "ua" if (q, c) in emit]
                if (q, role[:1]) in emit:
                    ways.append((emit[q, role[:1]], (cost + 3 * ragged, audit + "K", (*out, (role, text)))))
            for to, x in ways:
                new[to] = min(new.get(to, x), x)
        at = inserted(new)
    return min(at[q] for q in (0, 3) if q in at)


def plain(rows):
    """The whole report, from (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, told in by.items():
        told.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, marks, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in told:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((fault in ("blank", "duplicate"), role, text, fault == "truncated"))
        cost, audit, written = cheapest(marks)
        assert GOAL.match("".join(r[0] for r, _ in written))
        turns = {t for t, *_ in told if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, digest))
    return out


def same(df, rows):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, want = {r[0]: tuple(r) for r in df.collect()}, {r[0]: r for r in plain(rows)}
    assert got == want


def test_block_tables_give_the_first_of_all_cheapest_edits():
    """Every short string of symbols against a plain table, and its blocks against single symbols."""
    r = random.Random(1)
    for n in [*range(1, 9)] * 40:
        symbols = "".join(r.choice(cr.SYMBOLS) for _ in range(n))
        rows = [(s in "BD", {"u": "user", "a": "assistant", "s": "system"}.get(s.lower(), "?"), "x", s in "UAS+") for s in symbols]
        edits, state = cr.traced(symbols, 0, cr.START)
        assert "".join(edits) + cr.closing(state) == cheapest(rows)[1]


def test_all_edit_sequences_of_short_conversations():
    """No sequence of edits at all is cheaper, or as cheap with earlier letters."""
    for symbols in map("".join, itertools.product("Buas-UA", repeat=3)):
        found = []
        for gaps in itertools.product(range(3), repeat=4):
            for letters in itertools.product("DKR", repeat=3):
                audit = "".join("I" * g + x for g, x in zip(gaps, letters, strict=False)) + "I" * gaps[3]
                at, cost, ok = 0, 0, True
                options = {""}
                for x in audit:
                    if x == "I":
                        cost, options = cost + 3, {o + c for o in options for c in "ua"}
                        continue
                    s, at = symbols[at], at + 1
                    ok &= x == "D" or s != "B"
                    cost += {"D": 4, "K": 0, "R": 3}[x] + (3 if s in "UA" and x != "D" else 0)
                    if x != "D":
                        options = {o + c for o in options for c in (s.lower() if x == "K" else "ua")}
                if ok and any(GOAL.match(o) for o in options):
                    found.append((cost, audit))
        edits, state = cr.traced(symbols, 0, cr.START)
        assert min(found)[1] == "".join(edits) + cr.closing(state)


def test_odd_rows_ties_and_clashing_columns(spark):
    texts = [None, "", " \t", "Fine.", "Ragged", "Why? \n", "...", "é漢!", "x" * 40_000, "Fine."]
    roles = ["user", "assistant", "system", None, "", "tool", "unknown", "Ärzte"]
    r = random.Random(2)
    rows = [(conv if conv % 41 else None, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for conv in range(120) for _ in range(r.randint(1, 9))]
    rows += rows[:60]  # repeated rows, and ties of every kind
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for c in ("conv", "h", "tie", "kind", "gone", "symbols", "behind", "symbol", "first", "audit", "cost"):
        df = df.withColumn(c, F.lit("mine"))
    same(cr.report(df), rows)


def test_a_conversation_of_many_segments_among_short_ones(spark):
    """A third of all rows in one conversation, of two segments and a piece; one text repeated throughout."""
    r = random.Random(3)
    pick = lambda: (r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice([f"Text {r.random()}.", "Again.", "", "cut"]))
    rows = [(-5, t, *pick()) for t in range(9000)] + [(conv, t, *pick()) for conv in range(2500) for t in range(7)]
    same(cr.report(spark.createDataFrame(rows, ROWS).repartition(6)), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 8192, 8193])
def test_segments_join_without_a_seam(n):
    r = random.Random(n)
    symbols = "".join(r.choice("uaUAs-BD") for _ in range(n))
    whole, state = cr.traced(symbols, 0, cr.START)
    parts, behind, pieces = [], 0, []
    for end in range(n, 0, -cr.SEGMENT):
        pieces.insert(0, (symbols[max(0, end - cr.SEGMENT) : end], behind))
        behind = cr.behind_blocks(pieces[0][0], behind)[0]
    at = cr.START
    for piece, v in pieces:
        edits, at = cr.traced(piece, v, at)
        parts += edits
    assert (parts, at) == (whole, state)


def test_no_rows(spark):
    assert cr.report(spark.createDataFrame([], ROWS)).collect() == []
