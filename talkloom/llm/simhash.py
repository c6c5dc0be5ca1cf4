"""SimHash near-duplicates by the generalised pigeonhole principle.

After Qin et al., "GPH: Similarity Search in Hamming Space", ICDE 2018. The 64
bits are grouped so that correlated bits share a partition. Each partition i
gets its own threshold T[i] with sum(T) = tau - m + 1; -1 leaves it out. By the
generalised pigeonhole principle two fingerprints at most tau bits apart differ
by at most T[i] bits in some partition i. Dynamic programming over estimated
candidate counts picks the partition number and the thresholds. Each distinct
fingerprint is indexed by its exact partition values and probes all values
within T[i]; what meets is verified on all 64 bits.

A partition value that more than ``most`` rows share (a group of near copies) is
not expanded into pairs. Its members instead meet at every value that is at most
one bit away from them: two fingerprints are at most two bits apart exactly when
some value is at most one bit from both, all that meet there are linked, and at
most 65 distinct fingerprints can meet at one value. This costs 65 rows for a
member, and no group grows with the data. (tau is 2.)

Exact copies are one distinct fingerprint from the start. Only bit statistics
(64 x 64), partition statistics and chosen thresholds reach the driver.

Defined cases: null or wordless text has fingerprint zero, linked like any
other; a null doc_id takes part in its group but is never its name; repeated
rows return as often as they come, and one of them stays of a deduplicated table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import fresh, row_hash, stored
from talkloom.operators.components import components

BITS, TAU, SEED, SHINGLE = 64, 2, 42, 3
#: What a probe costs (a shuffled row), against a verified candidate.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text's 3-word shingles, by XXH64 with seed 42."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        hashes, n = digest(b" ".join(words), SEED), 1
    else:
        joined = b" ".join(words)
        start = np.cumsum([0, *[len(w) + 1 for w in words]])
        ends = (start[SHINGLE:] - 1).tolist()
        hashes, n = b"".join([digest(joined[i:j], SEED) for i, j in zip(start.tolist(), ends, strict=False)]), len(ends)
    total = np.zeros(BITS, np.int64)
    h = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for i in range(0, n, 4096):
        total += np.unpackbits(h[i : i + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col, fp`` and the ``keep`` columns: nothing is shuffled."""
    names = [id_col, *(keep or [])]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(x.as_py()) for x in b.column(len(names))], pa.int64())], [*names, "fp"])

    return docs.select(*names, text_col).mapInArrow(run, schema)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += x.T @ x
            n += len(x)
        counts = np.concatenate([both.astype(np.int64).ravel(), [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["k", "n"])

    rows = distinct.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in rows:
        flat[k] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in ``parts`` groups; the most correlated ones together."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(free, key=lambda i: (corr[i, free].sum(), -i))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    """These bits set, as a signed 64-bit number."""
    m = sum(1 << (BITS - 1 - i) for i in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], collisions: list[float], tau: int = TAU) -> tuple[float, list[int]]:
    """The cheapest thresholds by dynamic programming, with their estimated cost.

    ``collisions[i]``: pairs that agree on partition i, counted over all rows.
    Pairs further apart there are estimated from each bit's own odds to differ.
    """
    q = np.diag(both) / max(1, n)
    differ = np.clip(2 * q * (1 - q), 1e-9, 0.5)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, same in zip(groups, collisions, strict=True):
        sizes, odds = [1.0], differ[bits] / (1 - differ[bits])
        for r in odds:  # elementary symmetric sums: pairs at distance d, against pairs that agree
            sizes = [a + r * b for a, b in zip([*sizes, 0.0], [0.0, *sizes], strict=True)][: tau + 1]
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, tau + 1):
                c = cost
                if t >= 0:
                    c += PROBE_COST * n * sum(math.comb(len(bits), d) for d in range(t + 1)) + CANDIDATE_COST * same * sum(sizes[: t + 1])
                if total + t not in step or c < step[total + t][0]:
                    step[total + t] = (c, [*chosen, t])
        best = step
    return best[tau - len(groups) + 1]


def plan(distinct: DataFrame, tau: int = TAU, choices: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds for these fingerprints; all of them are counted."""
    n, both = bit_statistics(distinct)
    options = {m: grouped_bits(n, both, m) for m in choices}
    keys = [(m, i) for m in choices for i in range(m)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(_lit(_mask(options[m][i]))).alias("v")) for k, (m, i) in enumerate(keys)])
    sizes = distinct.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
    rows = sizes.groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    pairs = {keys[r["k"]]: r["pairs"] for r in rows}
    found = {m: thresholds(n, both, options[m], [pairs.get((m, i), 0.0) for i in range(m)], tau) for m in choices}
    m = min(choices, key=lambda m: found[m][0])
    return options[m], found[m][1]


def links(distinct: DataFrame, groups: list[list[int]], chosen: list[int], most: int = 1024) -> DataFrame:
    """``a, b``: links whose components are those of all pairs at most TAU bits apart.

    Pairs of ordinary partition values are all there; crowded values give stars.
    """
    probes = []
    for k, (bits, t) in enumerate(zip(groups, chosen, strict=True)):
        for flips in itertools.chain.from_iterable(itertools.combinations(bits, d) for d in range(t + 1)):
            probes.append(F.struct(F.lit(k).alias("k"), _lit(_mask(bits)).alias("mask"), _lit(_mask(list(flips))).alias("flip"), F.lit(not flips).alias("own")))
    keyed = distinct.select("fp", F.explode(F.array(*probes)).alias("x"))
    keyed = keyed.select("fp", "x.k", F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(F.col("x.mask")).alias("v"), "x.own")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("c"), F.max("own").alias("met")).where("c > 1 AND met")
    met = stored(keyed.join(sizes.select("k", "v", (F.col("c") > most).alias("crowded")), ["k", "v"]), "met")
    quiet = met.where("NOT crowded")
    a, b = quiet.where("own").select("k", "v", F.col("fp").alias("a")), quiet.select("k", "v", F.col("fp").alias("b"), "own")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU) & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))
    pairs = a.join(b, ["k", "v"]).where(near).select("a", "b")
    members = met.where("crowded").select("fp").distinct()
    flips = F.explode(F.array(*[_lit(x) for x in (0, *(_mask([i]) for i in range(BITS)))]))
    around = members.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    meeting = around.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _named(marked: DataFrame, id_col: str, most: int) -> DataFrame:
    """``fp, component, smallest``: each fingerprint's component, named by one of its fingerprints, and its smallest id."""
    distinct = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    linked = components(links(distinct, *plan(distinct), most)).withColumnsRenamed({"node": "fp"})
    every = stored(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"), "named")
    return every.join(every.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("fp", "component", "smallest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024) -> DataFrame:
    """``id_col, fingerprint, component_id``: component_id is the smallest id reachable by links."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _named(marked, id_col, most)
    return marked.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("smallest").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024) -> DataFrame:
    """One row of ``docs`` for each group of linked fingerprints.

    It is the row of the smallest id (nulls last), of equal ids that of the least
    hash of all columns, of equal rows any. Two texts of one id that don't link
    are two groups, and both stay. Columns of any name stay as they are.
    """
    h, kept, hashed, row = fresh(docs, "row_hash", "kept_id", "kept_hash", "kept_row")
    whole = docs.withColumn(h, row_hash(docs))
    slim = whole.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(h).alias("row_hash"))
    marked = stored(fingerprints(slim, "id", "text", keep=["row_hash"]), "fingerprints")
    counted = marked.groupBy("fp", "id", "row_hash").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash", "fp", "rows")
    best = counted.join(_named(marked, "id", most).select("fp", "component"), "fp").groupBy("component").agg(F.min(order).alias("best"))
    chosen = stored(best.select(F.col("best.id").alias(kept), F.col("best.row_hash").alias(hashed), (F.col("best.rows") > 1).alias(row)), "chosen")
    same = F.col(id_col).eqNullSafe(F.col(kept)) & (F.col(h) == F.col(hashed))
    once = whole.join(chosen.where(~F.col(row)), same, "left_semi").select(*docs.columns)
    repeated = whole.join(chosen.where(F.col(row)), same).groupBy(kept, hashed).agg(F.first(F.struct(*docs.columns)).alias(row))
    return once.unionByName(repeated.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
