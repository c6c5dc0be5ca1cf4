"""A Merkle manifest of documents, kept as an append log in postorder.

Every document is a leaf; a source's leaves in order of their ids make a tree in
which each run of three nodes has one parent, and the sources' roots make one
more tree. A node is written when it is complete, children before their parent:
its place in the log follows from its level, its index and the number of leaves
alone (:func:`position`), so siblings are addressed, not searched.

Builders are aligned: a segment is the subtree of ``BLOCK`` = 3^7 consecutive
leaves, and one builder writes its piece of the log from a stream of leaves. The
segments' roots are the leaves of the next round, a 2,187th of the rows, until a
tree has one segment; a source of any size fills as many tasks as it has
segments. Proofs go the other way: each round's segments are joined with the
proofs of their own roots, one row to one.

A leaf is the lowercase hex SHA-256 of the listed columns, each ``-`` if null,
else its UTF-8 length, a colon and its value; a node is that of its children's
hex digests, concatenated.

Defined cases: a null source is a source of its own, first; null ids come first
in a source, equal ids go by leaf, equal rows are told apart and each has a
place; for tampering a null id counts as the empty text; a null text has no
newline to lose; other columns of the table don't matter, whatever their names;
an empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import crc_part, stored
from talkloom.operators.positions import running_total

#: Children of a node, levels of a segment, and so its leaves.
FAN, DEEP = 3, 7
BLOCK = FAN**DEEP
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def levels_of(in_tree: int) -> int:
    """Levels above the leaves of a segment, of a tree with so many leaves."""
    return DEEP if in_tree > BLOCK else height(in_tree)


def position(level: int, index: int, leaves: int, levels: int) -> int:
    """Place in postorder of node ``index`` of ``level`` in a tree of so many leaves and levels.

    Before it are all nodes below or at its level that begin before its end, and
    those above that end before its start.
    """
    start, end = index * FAN**level, min((index + 1) * FAN**level, leaves)
    return sum(-(-end // FAN**x) for x in range(level + 1)) + sum(start // FAN**x for x in range(level + 1, levels + 1)) - 1


def log_of(leaves: list[str], levels: int) -> list[str]:
    """A segment's nodes in the order in which they are complete."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        runs[level].append(node)
        if level < levels and len(runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        add(level + 1, hashed(*run))

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):  # the last runs, whatever their length
        if runs[level]:
            close(level)
    return log


def steps_of(log: list[str], leaves: int, levels: int) -> list[list[str]]:
    """For each leaf of a segment what stands before and after its node, level by level up to the segment's root."""
    above: list[list[str]] = [[]]
    for level in reversed(range(levels)):
        width = -(-leaves // FAN**level)
        nodes = [log[position(level, k, leaves, levels)] for k in range(width)]
        own = []
        for k in range(width):
            first = k // FAN * FAN
            own.append(["".join(nodes[first:k]), "".join(nodes[k + 1 : first + FAN]), *above[k // FAN]])
        above = own
    return above


def folded(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for before, after in zip(steps[::2], steps[1::2], strict=True):
        leaf = hashed(before, leaf, after)
    return leaf


def _segments(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """``tree, seg, n, log`` and a list of each kept column, from ``tree, idx, n, digest`` and these columns."""
    types = [nodes.schema[c].dataType.simpleString() for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, rows, kinds = None, [], None

        def close() -> None:
            if rows:
                (tree, seg), n = now, rows[0][0]
                done.append((tree, seg, n, log_of([r[1] for r in rows], levels_of(n)), *[[r[2 + k] for r in rows] for k in range(len(kept))]))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["tree", "seg", "n", "log", *kept])
            done.clear()
            return out

        for b in batches:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.list_(b.schema.field(4 + k).type) for k in range(len(kept))]]
            for tree, seg, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (tree, seg) != now:
                    close()
                    now, rows = (tree, seg), []
                rows.append(row)
                if len(done) >= 64:
                    yield batch()
        close()
        if done:
            yield batch()

    dealt = nodes.withColumn("seg", F.floor(F.col("idx") / BLOCK).cast("long")).repartition("tree", "seg").sortWithinPartitions("tree", "seg", "idx")
    lists = "".join(f", `{c}` array<{t}>" for c, t in zip(kept, types, strict=True))
    return dealt.select("tree", "seg", "n", "digest", *kept).mapInArrow(run, f"tree long, seg long, n long, log array<string>{lists}")


def grown(leaves: DataFrame, kept: list[str]) -> list[DataFrame]:
    """Rounds of stored segments over ``tree, idx, n, digest`` (and the kept columns), until every tree has one."""
    rounds, nodes = [], leaves
    while True:
        rounds.append(stored(_segments(nodes, [] if rounds else kept), "segments"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return rounds
        nodes = rounds[-1].where(F.col("n") > BLOCK).select("tree", F.col("seg").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.element_at("log", -1).alias("digest"))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """``tree, round, top``: each tree's root and the round that has it."""
    each = [r.where(F.col("n") <= BLOCK).select("tree", F.lit(k).alias("round"), F.element_at("log", -1).alias("top")) for k, r in enumerate(rounds)]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def descended(rounds: list[DataFrame], above: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Proofs of all leaves, from ``tree, round, top, steps`` of each tree's root; ``finish`` makes rows of the first round's segments."""
    lower = None
    for k in reversed(range(len(rounds))):
        here = above.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("idx"), "top", "steps")
        here = (here if lower is None else here.unionByName(lower)).withColumnsRenamed({"tree": "of_tree", "idx": "of_seg", "steps": "upper"})
        joined = rounds[k].join(here, (F.col("tree") == F.col("of_tree")) & (F.col("seg") == F.col("of_seg"))).drop("of_tree", "of_seg")
        if k == 0:
            return finish(joined)
        lower = stored(_unfolded(joined), "proofs")
    raise ValueError("there are no rounds")


def _unfolded(segments: DataFrame) -> DataFrame:
    """``tree, idx, top, steps`` of each leaf of ``tree, seg, n, log, top, upper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, seg, n, log, top, upper in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = min(BLOCK, n - seg * BLOCK)
                steps = [own + upper for own in steps_of(log, m, levels_of(n))]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * m), pa.array(range(seg * BLOCK, seg * BLOCK + m), pa.int64()), pa.array([top] * m), pa.array(steps, pa.list_(pa.string()))], ["tree", "idx", "top", "steps"])

    return segments.select("tree", "seg", "n", "log", "top", "upper").mapInArrow(run, "tree long, idx long, top string, steps array<string>")


def leaf(columns: dict[str, Column]) -> Column:
    """A row's digest over the columns' plain texts."""
    told = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns.values()]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``id, source, digest, changed, tie``: every row's leaf, and its leaf after the tampering that is to be found out."""
    whole = {c: F.col(c) for c in columns}
    cut = whole | {text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))}
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf(whole).alias("digest"), F.when(crc_part(id_col, 2) == 0, leaf(cut)).otherwise(leaf(whole)).alias("changed"))
    return stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")


@dataclass
class Manifest:
    """``sources``: tree, source, n. ``forest``: rounds of the sources' trees. ``crown``: rounds of the tree over their roots."""

    sources: DataFrame
    forest: list[DataFrame]
    crown: list[DataFrame]
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """The manifest of :func:`leaves`' rows."""
    by_source = [F.col("source").asc_nulls_first()]
    counted = rows.groupBy("source").agg(F.count("*").alias("n"))
    sources = stored(running_total(running_total(counted, F.lit(1), by_source, "nth"), F.col("n"), by_source, "until").select((F.col("nth") - 1).alias("tree"), "source", "n", "until"), "sources")
    ranked = running_total(rows, F.lit(1), [*by_source, *map(F.col, ("id", "digest", "tie"))], "rank")
    placed = ranked.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    forest = grown(placed.select("tree", (F.col("rank") - F.col("until") + F.col("n") - 1).alias("idx"), "n", "digest", "id", "changed"), ["id", "changed"])
    n = sources.count()
    crown = grown(tops(forest).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), F.col("top").alias("digest")), [])
    top = tops(crown).first()
    return Manifest(sources, forest, crown, top and top["top"])


def proofs(manifest: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf, with its changed leaf folded up."""
    root = manifest.root or ""
    crowns = tops(manifest.crown).withColumn("steps", F.array().cast("array<string>"))
    roots = descended(manifest.crown, crowns, _unfolded).select(F.col("idx").alias("tree"), "steps")
    kind = manifest.forest[0].schema["id"].dataType.elementType.simpleString()
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.schema.field(3).type.value_type
            for seg, n, log, ids, changed, subroot, upper in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, levels = min(BLOCK, n - seg * BLOCK), levels_of(n)
                steps = [own + upper for own in steps_of(log, m, levels)]
                own = [log[position(0, k, m, levels)] for k in range(m)]
                ends = [folded(c, s) for c, s in zip(changed, steps, strict=True)]
                columns = [pa.array(ids, id_type), pa.array(own), pa.array([subroot] * m), pa.array([root] * m), pa.array([hashed(*s) for s in steps]), pa.array(ends), pa.array([e == root for e in ends])]
                yield pa.RecordBatch.from_arrays(columns, names)

    def finish(joined: DataFrame) -> DataFrame:
        slim = joined.select("seg", "n", "log", "id", "changed", "top", "upper")
        return slim.mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    return descended(manifest.forest, tops(manifest.forest).join(roots, "tree"), finish)


def report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Each document's leaf, its source's root, the root, its proof's digest, and whether its tampered or original row leads to the root."""
    return proofs(build(leaves(docs, id_col, **how))).withColumnRenamed("id", id_col)


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), docs AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                        lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 2 = 1 AS spared,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         replace(text, chr(10), '') AS cut
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN spared THEN sha256(head || coalesce(strlen(text) || ':' || text, '-')) ELSE sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS changed FROM docs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS i FROM leaves
), grove AS (
  SELECT source, 0 AS level, i AS k, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, k // 3, sha256(string_agg(node, '' ORDER BY k)), CAST(ceil(any_value(n) / 3) AS BIGINT) FROM grove WHERE n > 1 GROUP BY source, level, k // 3
), subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM grove WHERE n = 1
), crown AS (
  SELECT 0 AS level, s AS k, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, k // 3, sha256(string_agg(node, '' ORDER BY k)), CAST(ceil(any_value(n) / 3) AS BIGINT) FROM crown WHERE n > 1 GROUP BY level, k // 3
), runs AS (
  SELECT source, level, k // 3 AS run, list(node ORDER BY k) AS nodes FROM grove WHERE n > 1 GROUP BY source, level, k // 3
), crown_runs AS (
  SELECT level, k // 3 AS run, list(node ORDER BY k) AS nodes FROM crown WHERE n > 1 GROUP BY level, k // 3
), climbed AS (
  SELECT source, i, 0 AS level, i AS k, changed AS node, '' AS proof FROM placed
  UNION ALL
  SELECT c.source, i, c.level + 1, k // 3,
         sha256(array_to_string(list_transform(nodes, lambda x, p: CASE WHEN p - 1 = k % 3 THEN node ELSE x END), '')), proof || array_to_string(list_filter(nodes, lambda x, p: p - 1 <> k % 3), '')
  FROM climbed c JOIN runs r ON c.source IS NOT DISTINCT FROM r.source AND c.level = r.level AND c.k // 3 = r.run
), met AS (
  SELECT source, i, max_by(node, level) AS node, max_by(proof, level) AS proof FROM climbed GROUP BY source, i
), ascended AS (
  SELECT m.source, i, 0 AS level, s AS k, node, proof FROM met m JOIN subroots u ON m.source IS NOT DISTINCT FROM u.source
  UNION ALL
  SELECT source, i, c.level + 1, k // 3,
         sha256(array_to_string(list_transform(nodes, lambda x, p: CASE WHEN p - 1 = k % 3 THEN node ELSE x END), '')), proof || array_to_string(list_filter(nodes, lambda x, p: p - 1 <> k % 3), '')
  FROM ascended c JOIN crown_runs r ON c.level = r.level AND c.k // 3 = r.run
), ends AS (
  SELECT source, i, max_by(node, level) AS folded, max_by(proof, level) AS proof FROM ascended GROUP BY source, i
)
SELECT doc_id, leaf, subroot, (SELECT node FROM crown WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM crown WHERE n = 1) AS verified
FROM placed p JOIN subroots u ON p.source IS NOT DISTINCT FROM u.source JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.i = e.i
"""
