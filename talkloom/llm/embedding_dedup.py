"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

After Gao and Long, "RaBitQ", SIGMOD 2024. A unit vector o is rotated by a fixed
random rotation; its code is the vector of signs, one bit each, and its correction
factor is f = <code, o>, the code taken as a unit vector. For another unit vector
q, <code, q> / f estimates <o, q> without bias, and for a pair of cosine c the
error is at most sqrt(1 - c^2) * sqrt(1 - f^2) / f * eps / sqrt(D - 1), but for a
probability that falls as exp(-eps^2 / 2) (eps is 6 here). As asked for, q is
rounded to ``PLANES`` bits for each component, kept as bit planes, so that <code,
q> is a sum of bit counts of (code and plane); what rounding can change is at most
the length of the rounding error, which is stored and added to the bound. As c
minus that bound grows with c, a pair can be at the threshold or above only if its
estimate is at least the threshold minus the bound there. All other pairs are
dropped; the rest are computed again in double precision, and only that decides.

Codes, factors, planes and rounding errors are made once for each distinct vector
and stored with it. Only vectors of equal label and length meet. Equal vectors are
one vector with a number of copies; vectors are told apart by 128 bits of hash. A
label's distinct vectors are dealt into blocks by hash, and all pairs of its
blocks are compared, at every size: each pair of blocks is its own group, so no
task holds more than two blocks, and a group returns only each vector's number of
links and one link towards its component. In labels of more than ``cell_rows``
distinct vectors the blocks grow with the square root of the label's size, and so
does the number of times each vector is sent; inside a group, ``STEP`` rows at a
time are compared. The work grows with the square of a label's size.

Defined cases: null ids and labels, and vectors that are null, empty, zero or
hold null or non-finite components link with nothing; very large and very small
components are scaled first. Repeated rows are copies.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import stored
from talkloom.operators.components import components

THRESHOLD, EPS, SEED, STEP = 0.93, 6.0, 20_240_611, 1_024
PLANES = 4
CODES = "code binary, factor double, planes binary, step double, total long, off double"


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes(NamedTuple):
    """Of vectors of one length, a row each."""

    code: np.ndarray  # 64-bit words of signs
    factor: np.ndarray
    planes: np.ndarray  # vectors x PLANES x words
    step: np.ndarray  # a component is about step * (its number - half of the greatest)
    total: np.ndarray  # sum of the numbers
    off: np.ndarray  # length of the rounding error

    def take(self, at: np.ndarray | slice) -> Codes:
        return Codes(*(x[at] for x in self))


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    spare = -packed.shape[-1] % 8
    return np.concatenate([packed, np.zeros((*packed.shape[:-1], spare), np.uint8)], -1).view(np.uint64)


def coded(x: np.ndarray) -> Codes:
    """The codes of vectors (float64 rows)."""
    d = x.shape[1]
    u = (x / np.linalg.norm(x, axis=1)[:, None]) @ rotation(d)
    top = (1 << PLANES) - 1
    step = 2 * np.abs(u).max(1) / top
    n = np.clip(np.rint(u / step[:, None] + top / 2), 0, top).astype(np.uint8)
    off = np.linalg.norm(u - step[:, None] * (n - top / 2), axis=1)
    planes = np.stack([_words(n >> j & 1) for j in range(PLANES)], 1)
    return Codes(_words(u >= 0), np.abs(u).sum(1) / math.sqrt(d), planes, step, n.sum(1, dtype=np.int64), off)


def candidates(a: Codes, b: Codes, d: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of ``a``, rows of ``b``) that may be at the threshold or above: codes of ``a``, planes of ``b``.

    The estimate times factor and sqrt(d) is step * (2 s - total - top * (ones - d / 2)),
    s being the sum of the numbers where the code has ones.
    """
    top = (1 << PLANES) - 1
    error = np.sqrt(np.maximum(1 - a.factor**2, 0)) / a.factor * EPS / math.sqrt(max(d - 1, 1)) * math.sqrt(1 - threshold**2)
    ones = np.bitwise_count(a.code).sum(1, dtype=np.int64)
    left = np.stack([a.factor * (threshold - error) * math.sqrt(d), np.ones(len(ones)), top * (ones - d / 2)], 1)
    right = np.stack([1 / b.step, b.total - b.off * math.sqrt(d) / b.step, np.ones(len(b.step))])
    least = ((left @ right) / 2 - 1e-6).astype(np.float32)
    planes, i, j = np.ascontiguousarray(b.planes.transpose(1, 2, 0)), [], []
    for r in range(0, len(left), 64):  # a piece of the pairs that stays in the cache
        code, s = a.code[r : r + 64], np.zeros((min(64, len(left) - r), len(b.step)), np.uint16)
        for k in range(PLANES):
            for w in range(code.shape[1]):
                s += np.bitwise_count(code[:, w, None] & planes[k, w]) * np.uint16(1 << k)
        x, y = np.nonzero(s >= least[r : r + 64])
        i.append(x + r)
        j.append(y)
    return np.concatenate([np.zeros(0, int), *i]), np.concatenate([np.zeros(0, int), *j])


def linked(x: np.ndarray, y: np.ndarray, a: Codes, b: Codes, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of ``x`` and ``y`` (float64) with their codes; with ``same`` each pair of one block once."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for r in range(0, len(x), STEP):
        for c in range(r if same else 0, len(y), STEP):
            i, j = candidates(a.take(slice(r, r + STEP)), b.take(slice(c, c + STEP)), x.shape[1], threshold)
            i, j = i + r, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                m, n = i[k : k + 200_000], j[k : k + 200_000]
                keep = np.einsum("ij,ij->i", x[m], y[n]) / (nx[m] * ny[n]) >= threshold
                left.append(m[keep])
                right.append(n[keep])
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1)


def _with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the columns of CODES; the vectors are column ``embedding``."""
    for batch in batches:
        at = batch.schema.get_field_index("embedding")
        lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
        out: list[tuple] = [()] * batch.num_rows
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            c = coded(_matrix(batch.column(at).take(pa.array(rows))))
            for k, row in enumerate(rows.tolist()):
                out[row] = (c.code[k].tobytes(), float(c.factor[k]), c.planes[k].tobytes(), float(c.step[k]), int(c.total[k]), float(c.off[k]))
        kinds = [pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.int64(), pa.float64()]
        names = [x.split()[0] for x in CODES.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], [*batch.schema.names, *names])


def _codes(group: pa.Table) -> Codes:
    """The stored codes of a group."""
    n, number = group.num_rows, lambda c: group[c].to_numpy()
    words = lambda c: np.frombuffer(b"".join(group[c].to_pylist()), np.uint64)
    code = words("code").reshape(n, -1)
    return Codes(code, number("factor"), words("planes").reshape(n, PLANES, code.shape[1]), number("step"), number("total"), number("off"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, cell_rows: int = 16_384, block_rows: int = 2_048) -> DataFrame:
    """``id_col``, n_links, component_id, kept for every row."""
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), e.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = F.array_max(F.transform("embedding", F.abs))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & (largest > 0), F.lit(False))
    extreme = usable & ~largest.between(1e-100, 1e100)
    rows = rows.withColumns({"usable": usable, "embedding": F.when(extreme, F.transform("embedding", lambda x: x / largest)).otherwise(F.col("embedding"))})
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("b"), "embedding")})
    distinct = rows.where("usable").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    distinct = stored(distinct.mapInArrow(_with_codes, f"{kinds}, {CODES}"), "vectors")
    size = F.lit(block_rows) * F.sqrt(F.greatest(F.lit(1.0), F.col("n") / F.lit(cell_rows)))
    crowd = distinct.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("n > 1").select("label", "d", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt = distinct.withColumn("d", F.size("embedding")).join(crowd, ["label", "d"])
    own = F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    kind = vectors.schema[id_col].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        x, codes, copies = _matrix(group["embedding"]), _codes(group), group["copies"].to_numpy()
        own, low, high = group["own"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py()
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = linked(x[a], x[b], codes.take(a), codes.take(b), threshold, low == high) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
        i, j = a[i], b[j]
        n = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        met = np.flatnonzero(n)
        ids = group["id"].combine_chunks()
        root = _roots(len(x), i, j)
        return pa.table({"id": ids.take(pa.array(met)), "n": pa.array(n[met].astype(np.int64)), "root": ids.take(pa.array(root[met]))})

    sent = ["id", "copies", "embedding", "label", "d", "low", "high", "own", *(x.split()[0] for x in CODES.split(", "))]
    found = stored(dealt.select(*sent).groupBy("label", "d", "low", "high").applyInArrow(compare, f"id {kind}, n long, root {kind}"), "found")
    joined = components(found.select("id", "root"), "id", "root")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    told = distinct.select("label", "h1", "h2", "id", "copies").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    told = told.select(F.col("label").alias("l"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("embedding").join(told, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node
), c AS (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
