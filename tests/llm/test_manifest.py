"""The Merkle manifest against a plain tree, position by position and proof by proof."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talkloom.llm import merkle_manifest as mm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def postorder(leaves):
    """(level, index) of a tree's nodes in the order in which a recursion leaves them."""
    widths = [leaves]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // 3))

    def walk(level, k):
        for c in range(3 * k, min(3 * k + 3, widths[level - 1])) if level else ():
            yield from walk(level - 1, c)
        yield level, k

    return list(walk(len(widths) - 1, 0)), len(widths) - 1


@pytest.mark.parametrize("leaves", [*range(1, 40), 80, 81, 82, 243, 244, 730])
def test_positions_and_log_are_the_postorder(leaves):
    order, levels = postorder(leaves)
    assert levels == mm.height(leaves)
    assert [mm.position(level, k, leaves, levels) for level, k in order] == list(range(len(order)))
    digests = [sha(str(i)) for i in range(leaves)]
    nodes = {(0, i): d for i, d in enumerate(digests)}
    for level, k in order:
        if level:
            nodes[level, k] = sha(*[nodes[level - 1, c] for c in range(3 * k, 3 * k + 3) if (level - 1, c) in nodes])
    log = mm.log_of(digests, levels)
    assert log == [nodes[x] for x in order]
    assert all(mm.folded(d, s) == log[-1] for d, s in zip(digests, mm.steps_of(log, leaves, levels), strict=True))


def climbed(level):
    """The root over a list of digests and each one's (before, after) on the way up."""
    steps, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(place):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            steps[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level, place = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)], [k // 3 for k in place]
    return level[0], steps


def plain(rows):
    """Every row of the report, from (doc_id, text, lang, source, n_chars)."""
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, la, s, n: sha(*map(told, (d, s, la, n, t)))
    by = {}
    for d, t, la, s, n in rows:
        crc = zlib.crc32(("" if d is None else str(d)).encode())
        cut = t.replace("\n", "") if t is not None and crc % 2 == 0 else t
        by.setdefault(s, []).append(((d is not None, d or 0, leaf(d, t, la, s, n)), d, leaf(d, cut, la, s, n)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climbed([x[0][2] for x in sorted(by[s], key=lambda x: (x[0], x[2]))]) for s in order]
    root, crown = climbed([t[0] for t in trees])
    out = []
    for s, (subroot, steps), up in zip(order, trees, crown, strict=True):
        for (key, d, changed), own in zip(sorted(by[s], key=lambda x: (x[0], x[2])), steps, strict=True):
            node = changed
            for before, after in own + up:
                node = sha(before, node, after)
            out.append((d, key[2], subroot, root, sha(*[b + a for b, a in own + up]), node, node == root))
    return out


def same(df, rows):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(plain(rows), key=key)


def test_odd_rows_ties_and_clashing_columns(spark):
    texts = [None, "", "a\nb", "a\nb", "é漢\n", "\n" * 5, "x" * 50_000 + "\n", "plain"]
    rows = [(i, t, "en" if i % 3 else None, s, i if i % 2 else None) for i, t in enumerate(texts) for s in (None, "", "b", "é", "Z")]
    rows += [(None, "t\n", None, None, None)] * 2 + [(7, "same\n", "en", "b", 1)] * 5 + [(7, "other", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in ("leaf", "tree", "seg", "idx", "n", "digest", "id", "changed", "tie", "root", "log", "rank", "verified"):
        df = df.withColumn(c, F.lit("mine"))
    same(mm.report(df), rows)


def test_a_source_of_several_rounds_among_many_small_ones(spark):
    """One source holds two thirds of the rows, more than a segment of three rounds' fan-out needs."""
    rows = [(i, f"text {i}\n{i % 7}", "de", "hot" if i % 3 else f"s{i:05d}", i) for i in range(9000)]
    same(mm.report(spark.createDataFrame(rows, DOCS).repartition(7)), rows)


def test_no_rows_and_one_row(spark):
    assert mm.report(spark.createDataFrame([], DOCS)).collect() == []
    assert mm.build(mm.leaves(spark.createDataFrame([], DOCS))).root is None
    same(mm.report(spark.createDataFrame([(0, "a\n", "en", "s", 1)], DOCS)), [(0, "a\n", "en", "s", 1)])
