"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queue ``copies`` times
one after the other. A queued document's virtual finish time is its source's
cumulative words up to and with it, divided by the source's weight. Documents
leave in order of finish time until the budget, ``share`` times all words, is
used up: a source that has run out leaves its share to the others by weight, so
a source's words come within one document of its target.

Cumulative words are summed in one order of all documents by ranges, in which
even equal rows are told apart, so that a source or an id of a third of all rows
fills as many tasks as it needs. Finish times are sorted globally by ranges; only
the ranges' sums and the last document inside the budget reach the driver. Texts
are not shuffled.

Defined cases: null text has no words; a null source is a source of its own,
last; documents without words are taken as 0 words; the order inside a source
depends on doc_id and seed only, so reruns agree, and rows equal in id and size
may stand for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import fresh, row_hash, stored
from talkloom.operators.positions import ranged, running_total, running_totals

WEIGHTS, SHARE, COPIES, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: What places an entry in the queue.
KEY = ("finish", "none", "source", "copy", "shuffled", "doc_id", "size", "tie")


def words(text: str | Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Targets share ``share`` times all words by weight; one above ``copies`` times
    its source stops there and the rest is shared anew, until none is above.
    """
    order = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = running_total(sizes, F.lit(1), order, "rank")
    ranked = ranked.select("source", "source_size", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumns({"cap": copies * F.col("source_size"), "stops": copies * F.col("source_size") / F.col("weight")})
    # in the order in which sources stop, the first that does not sets the level of all after it
    met = stored(running_totals(ranked, {"capped": F.col("cap"), "heavy": F.col("weight")}, [F.col("stops"), *order]), "sources")
    words_, weight = met.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weight:
        return met.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    level = (share * words_ - (F.col("capped") - F.col("cap")).cast("double")) / (F.lit(weight) - F.col("heavy") + F.col("weight")).cast("double")
    found = met.withColumn("level", level).where("level <= stops").agg(F.min_by("level", F.struct("stops", F.col("source").isNull(), "source"))).first()[0]
    cap = F.col("cap").cast("double")
    return met.select("source", "source_size", "weight", (cap if found is None else F.least(cap, F.col("weight") * F.lit(found))).alias("target"))


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, keep: str | None = None, **how) -> DataFrame:
    """``doc_id, size, source, source_size, target, weight, shuffled, passed, tie`` and the column ``keep``.

    ``passed``: the source's words up to and with the document, the first time
    round. ``tie`` tells equal rows apart.
    """
    ids = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = [F.col(keep)] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("size"), F.col(source_col).alias("source"), F.md5(ids.cast("binary")).alias("shuffled"), *kept)
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("shuffled", "doc_id", "size", "tie"))]
    placed = running_total(rows, F.col("size"), order, "all_passed")
    before = running_total(sources, F.col("source_size"), order[:1], "_until").withColumnRenamed("source", "_source")
    out = placed.join(before, F.col("source").eqNullSafe(F.col("_source"))).withColumn("passed", F.col("all_passed") - F.col("_until") + F.col("source_size"))
    return stored(out.select("doc_id", "size", "source", "source_size", "target", "weight", "shuffled", "passed", "tie", *kept), "queued")


def _finish(copy: Column) -> Column:
    return (F.col("passed") + copy * F.col("source_size")) / F.col("weight")


def cut(queue: DataFrame, share: float = SHARE, copies: int = COPIES) -> tuple | None:
    """The last queued entry (``KEY``) inside the budget; None when nothing is."""
    entries = queue.select("source", "shuffled", "doc_id", "size", "tie", "passed", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    entries = entries.select(_finish(F.col("copy")).alias("finish"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().cast("int").alias("none"), "copy", "shuffled", "doc_id", "size", "tie")
    key = [F.col(c) for c in KEY]
    r = ranged(entries, *key)
    budget, total, last = share * (queue.agg(F.sum("size")).first()[0] or 0), 0, None
    sums = sorted(tuple(x) for x in r.groupBy("part").agg(F.sum("size")).collect())  # a row per range
    for part, own in sums:
        if total + own > budget:
            run = F.sum("size").over(Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
            inside = r.where(F.col("part") == part).withColumn("run", run).where(F.col("run") <= budget - total)
            return inside.agg(F.max(F.struct(*key))).first()[0] or (last and r.where(F.col("part") == last).agg(F.max(F.struct(*key))).first()[0])
        total, last = total + own, part
    return r.agg(F.max(F.struct(*key))).first()[0]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """doc_id, size, source_size, target, n_taken (copies the mix takes), taken (words), finish (of the first copy)."""
    return _mixed(queued(docs, id_col, text_col, source_col, seed, weights=weights, share=share, copies=copies), share, copies).withColumnRenamed("doc_id", id_col).drop("row_hash")


def _mixed(queue: DataFrame, share: float, copies: int) -> DataFrame:
    last = cut(queue, share, copies)
    n = F.lit(0)
    if last is not None:
        limit = F.struct(*[F.lit(x).cast(t.dataType).alias(t.name) for x, t in zip(last, _keyed(queue, 0).schema, strict=True)])
        for c in range(copies):
            n = n + (F.struct(*_key(c)) <= limit).cast("int")
    kept = [c for c in ("row_hash",) if c in queue.columns]
    return queue.select("doc_id", "size", "source_size", "target", n.alias("n_taken"), (n * F.col("size")).alias("taken"), _finish(F.lit(0)).alias("finish"), *kept)


def _key(copy: int) -> list[Column]:
    """An entry's place in the queue: ``KEY``."""
    own = {"finish": _finish(F.lit(copy)), "none": F.col("source").isNull().cast("int"), "source": F.coalesce("source", F.lit("")), "copy": F.lit(copy)}
    return [own.get(c, F.col(c)).alias(c) for c in KEY]


def _keyed(queue: DataFrame, copy: int) -> DataFrame:
    return queue.select(*_key(copy))


def take(docs: DataFrame, id_col: str = "doc_id", share: float = SHARE, copies: int = COPIES, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, as often as they are taken.

    A row is known again by its id and a hash of all its columns. Rows equal in
    both are one row of which as many are taken as of all of them together.
    Columns of any name stay as they are.
    """
    text, source = how.get("text_col", "text"), how.get("source_col", "source")
    h, times, rows, named, hashed, row = fresh(docs, "row_hash", "mixed_times", "mixed_rows", "mixed_id", "mixed_hash", "mixed_row")
    whole = docs.withColumn(h, row_hash(docs))
    slim = whole.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(h).alias("row_hash"))
    how = {k: v for k, v in how.items() if k not in ("text_col", "source_col")}
    n = _mixed(queued(slim, keep="row_hash", share=share, copies=copies, **how), share, copies)
    n = n.groupBy("doc_id", "row_hash").agg(F.sum("n_taken").cast("int").alias(times), F.count("*").alias(rows)).where(F.col(times) > 0)
    n = stored(n.withColumnsRenamed({"doc_id": named, "row_hash": hashed}), "taken")
    same = F.col(id_col).eqNullSafe(F.col(named)) & (F.col(h) == F.col(hashed))
    once = whole.join(n.where(F.col(rows) == 1), same).select(*docs.columns, times)
    repeated = whole.join(n.where(F.col(rows) > 1), same).groupBy(named, hashed).agg(F.first(times).alias(times), F.first(F.struct(*docs.columns)).alias(row))
    every = once.unionByName(repeated.select(*[F.col(row)[c].alias(c) for c in docs.columns], times))
    return every.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(row)).drop(row)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, 2.0 * source_size / w AS r
  FROM s
), v AS (
  SELECT level FROM (SELECT *, (1.5 * (SELECT sum(size) FROM d) - CAST(capped AS DOUBLE)) / CAST(open_w AS DOUBLE) AS level FROM o)
  WHERE level <= r ORDER BY r, source NULLS LAST LIMIT 1
), t AS (SELECT source, source_size, w, least(CAST(2 * source_size AS DOUBLE), w * level) AS target FROM s, v
), q AS (
  SELECT d.*, source_size, w, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS passed
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CAST(passed + c * source_size AS DOUBLE) / w AS finish FROM q, (VALUES (0), (1)) AS x(c)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, c, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM e
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN run <= 1.5 * (SELECT sum(size) FROM d) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target, h
"""
