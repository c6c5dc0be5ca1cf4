"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters. Each has two labels, clean and toxic; the chain has
transition weights and, for each token, the summed weights of its lower-cased
word, its first three to six characters and its last three, hashed to ``PLACES``
weights. Forward-backward gives every token's marginal probability of being
toxic; a document's score comes from the expected number of toxic tokens, the
log-odds of its likeliest and its second likeliest one, and its length, by
logistic regression.

Training labels are of documents. Tokens are labelled from them: every token of
a clean document is clean; a token of a toxic document is toxic if at least two
of its features are telling: their odds to be in a toxic document are at least
``TELLING`` times those to be in a clean one, by more than chance (a likelihood
ratio over all labelled rows, counted by Spark; at most ``PLACES`` sums reach the
driver). Toxic documents without such a token don't
train the chain. Only features that at least ``LEAST_DF`` toxic documents have
get a weight. The chain (by AdaGrad) and the logistic regression are fitted on
a bounded sample: about ``per_label`` labelled rows of each label and never more
than a third above it, of at most ``chars`` characters, drawn by a hash of id and
text. Scoring takes every text whole and shuffles nothing.

Forward-backward runs over all tokens of a batch as one chain in which a
document's start forgets what came before: it is cut in equal lanes, each lane's
2x2 product is taken, lanes are chained, and all lanes are run at once again.

Defined cases: null, empty and letterless texts get the score of a document
without tokens (the lowest); with no labelled rows of both labels every score is
0; a null id is the empty text for the fold; rows return as often as they come.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import crc_part, stored

PLACES_LOG2 = 19
PLACES = 1 << PLACES_LOG2
KEPT, AT_ONCE = 500_000, 400_000
LANES, TELLING = 2048, 5.0
#: Toxic documents that a telling feature has at least; counts of no others reach the driver.
LEAST_DF = 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
tokens = re.compile(r"[^\W\d_]+").findall
places = re.compile(r"[^\W\d_]+").finditer


def features(word: str) -> list[int]:
    """The places of a token's features."""
    w = word.lower()
    f = [f"w{w}", f"s{w[-3:]}", *[f"p{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k]]
    return [zlib.crc32(x.encode("utf-8", "replace")) >> (32 - PLACES_LOG2) for x in f]


@dataclass
class Chain:
    """transitions: from clean to toxic, toxic to clean, toxic to toxic, and a start as toxic (clean to clean: 0)."""

    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, s: np.ndarray, start: np.ndarray, pairs: bool = False):
        """P(toxic) of each token and its share of log Z; with ``pairs`` also the transitions' expected uses in each token."""
        n = len(s)
        steps = max(1, -(-n // LANES))
        lanes = -(-n // steps) if n else 1
        e, first = np.zeros(steps * lanes), np.ones(steps * lanes, bool)
        e[:n], first[:n] = s, start
        e, first = np.exp(np.clip(e, -25, 25)).reshape(lanes, steps).T.copy(), first.reshape(lanes, steps).T.copy()
        t = np.exp(self.transitions)
        m01 = e * np.where(first, t[3], t[0])
        m11 = e * np.where(first, t[3], t[2])
        m10 = np.where(first, 1.0, t[1])
        a0, a1, zs = _run(m01, m11, m10)
        b0, b1 = _run_back(m01, m11, m10)
        z = a0 * b0 + a1 * b1
        p, logz = (a1 * b1 / z).T.ravel()[:n], np.log(zs).T.ravel()[:n]
        if not pairs:
            return p, logz
        flat = lambda x: x.T.ravel()[:n]
        a0, a1, b0, b1, m01, m11, m10 = map(flat, (a0, a1, b0, b1, m01, m11, m10))
        uses = np.zeros((4, n))
        inner = np.flatnonzero(~start)
        x00, x01 = a0[inner - 1] * b0[inner], a0[inner - 1] * m01[inner] * b1[inner]
        x10, x11 = a1[inner - 1] * m10[inner] * b0[inner], a1[inner - 1] * m11[inner] * b1[inner]
        uses[:3, inner] = np.array([x01, x10, x11]) / (x00 + x01 + x10 + x11)
        uses[3, start] = p[start]
        return p, logz, uses


def _scaled(a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = a0 + a1
    return a0 / z, a1 / z


def _run(m01: np.ndarray, m11: np.ndarray, m10: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages (steps x lanes), scaled to sum 1 at each token, and their sums before."""
    steps, lanes = m01.shape
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(steps):
        p00, p01 = p00 + p01 * m10[k], p00 * m01[k] + p01 * m11[k]
        p10, p11 = p10 + p11 * m10[k], p10 * m01[k] + p11 * m11[k]
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    into, a = np.empty((lanes, 2)), (1.0, 0.0)
    for c, (q00, q01, q10, q11) in enumerate(np.stack([p00, p01, p10, p11], 1).tolist()):
        into[c] = a
        x, y = a[0] * q00 + a[1] * q10, a[0] * q01 + a[1] * q11
        a = (x / (x + y), y / (x + y))
    a0, a1 = into[:, 0].copy(), into[:, 1].copy()
    out0, out1, sums = np.empty_like(m01), np.empty_like(m01), np.empty_like(m01)
    for k in range(steps):
        a0, a1 = a0 + a1 * m10[k], a0 * m01[k] + a1 * m11[k]
        z = sums[k] = a0 + a1
        a0, a1 = a0 / z, a1 / z
        out0[k], out1[k] = a0, a1
    return out0, out1, sums


def _run_back(m01: np.ndarray, m11: np.ndarray, m10: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward messages: what follows a token, for each of its labels."""
    steps, lanes = m01.shape
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(steps - 1, -1, -1):  # the product of the lane's matrices, from its end
        p00, p10 = p00 + m01[k] * p10, m10[k] * p00 + m11[k] * p10
        p01, p11 = p01 + m01[k] * p11, m10[k] * p01 + m11[k] * p11
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    into, b = np.empty((lanes, 2)), (0.5, 0.5)
    rows = np.stack([p00, p01, p10, p11], 1).tolist()
    for c in range(lanes - 1, -1, -1):
        into[c] = b
        q00, q01, q10, q11 = rows[c]
        x, y = q00 * b[0] + q01 * b[1], q10 * b[0] + q11 * b[1]
        b = (x / (x + y), y / (x + y))
    b0, b1 = into[:, 0].copy(), into[:, 1].copy()
    out0, out1 = np.empty_like(m01), np.empty_like(m01)
    for k in range(steps - 1, -1, -1):
        out0[k], out1[k] = b0, b1
        b0, b1 = _scaled(b0 + m01[k] * b1, m10[k] * b0 + m11[k] * b1)
    return out0, out1


class Emissions(dict):
    """Emission score of each token, kept for the words met so far."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > KEPT:
            self.clear()
        x = self[word] = float(self.weights[features(word)].sum())
        return x


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 6e-6, 1 - 6e-6)
    return np.log(p / (1 - p))


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: log expected toxic tokens, log-odds of its likeliest and second likeliest one, log tokens."""
    out = np.zeros((len(lengths), 4))
    out[:, 1:3] = _log_odds(np.zeros(1))
    out[:, 3] = np.log1p(lengths)
    full = np.flatnonzero(lengths)
    if len(full):
        first = (np.cumsum(lengths) - lengths)[full]
        top = np.maximum.reduceat(p, first)
        out[full, 0], out[full, 1] = np.log1p(np.add.reduceat(p, first)), _log_odds(top)
        at = np.flatnonzero(p == np.repeat(top, lengths[full]))
        others = p.copy()
        others[at[np.unique(np.searchsorted(first, at, side="right"), return_index=True)[1]]] = 0
        out[full, 2] = _log_odds(np.maximum.reduceat(others, first))
    return out


@dataclass
class Model:
    chain: Chain
    logistic: np.ndarray  # intercept, and a weight for each column of summary()

    def score(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + s @ self.logistic[1:], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (w * (y - p)) - 0.02 * beta)
    return beta


def telling(df: np.ndarray, docs: np.ndarray, odds: float = TELLING, least: float = 24.0) -> np.ndarray:
    """Features (``df``: clean, toxic documents with them) at least ``odds`` times as likely in toxic documents, by more than chance: likelihood ratio ``least``."""
    rate, n = docs[1] / max(1, docs.sum()), np.maximum(df.sum(0), 1)
    own = df[1] / n
    part = lambda k, p, q: np.where(k > 0, k * np.log(np.maximum(p, 1e-300) / q), 0)
    g = 2 * (part(df[1], own, max(rate, 1e-9)) + part(df[0], 1 - own, max(1 - rate, 1e-9)))
    return ((df[1] + 0.5) * docs[0] >= odds * (df[0] + 0.5) * docs[1]) & (own > rate) & (g >= least)


def train(texts: list[str], labels: list[int], df: np.ndarray, docs_of: np.ndarray, epochs: int = 10, rate: float = 0.3) -> Model | None:
    """The chain and the logistic regression from labelled documents.

    ``df``: clean and toxic documents with each feature; ``docs_of``: all clean
    and toxic documents. Both are of all labelled rows, for which the sample stands.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in tokens(t)], np.int64) for t in texts]
    feats = [np.array(features(w)) for w in words]
    flat, owner = np.concatenate([*feats, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    toxic_word = np.bincount(owner, weights=telling(df, docs_of)[flat], minlength=len(words)) >= 2
    useful = df[1, flat] >= LEAST_DF
    flat, owner = flat[useful], owner[useful]
    lengths = np.array([len(d) for d in docs])
    order = np.random.default_rng(7)
    weights, w2 = np.zeros(PLACES), np.full(PLACES, 1.0)
    trans, t2 = np.array([-4.0, 0.0, 0.0, -4.0]), np.full(4, 1.0)
    emit = lambda: np.bincount(owner, weights=weights[flat], minlength=len(words))
    use = [k for k in range(len(docs)) if len(docs[k]) and (not labels[k] or toxic_word[docs[k]].any())]
    for _ in range(epochs):
        order.shuffle(use)
        for i in range(0, len(use), 512):
            part = use[i : i + 512]
            seq = np.concatenate([docs[k] for k in part])
            n = lengths[part]
            start = np.zeros(len(seq), bool)
            start[np.cumsum(n) - n] = True
            p, _, uses = Chain(weights, trans).marginals(emit()[seq], start, pairs=True)
            gold = toxic_word[seq] & np.repeat(y[part] == 1, n)
            was, push = np.concatenate([[False], gold[:-1]]), gold - p
            g = np.array([(gold & ~was & ~start).sum(), (~gold & was & ~start).sum(), (gold & was & ~start).sum(), gold[start].sum()]) - uses.sum(1)
            grad = np.bincount(flat, weights=np.bincount(seq, weights=push, minlength=len(words))[owner], minlength=PLACES) - 2e-2 * weights
            w2 += grad * grad
            weights = weights + rate * grad / np.sqrt(w2)
            g -= 1e-2 * trans
            t2 += g * g
            trans = trans + 0.1 * g / np.sqrt(t2)
    seq = np.concatenate(docs)
    start = np.zeros(len(seq), bool)
    start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    chain = Chain(weights, trans)
    p = chain.marginals(emit()[seq], start)[0] if len(seq) else np.zeros(0)
    stands = np.where(y == 1, docs_of[1] / y.sum(), docs_of[0] / (len(y) - y.sum()))
    return Model(chain, _logistic(summary(p, lengths), y.astype(float), stands * len(y) / stands.sum()))


def document_counts(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``place, clean, toxic``: in how many documents of each label a feature's place occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, known = np.zeros((2, PLACES), np.int32), {}
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                met = set(tokens(text.as_py() or ""))
                if len(known) > KEPT // 4:
                    known.clear()
                for w in met.difference(known):
                    known[w] = features(w)
                if met:
                    df[label, np.unique(np.concatenate([known[w] for w in met]))] += 1
        place = np.flatnonzero(df.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(df[0, place].astype(np.int64)), pa.array(df[1, place].astype(np.int64))], ["place", "clean", "toxic"])

    found = rows.select(text_col, F.col(label_col).cast("int")).mapInArrow(run, "place long, clean long, toxic long")
    return found.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2500, chars: int = 20_000) -> Model | None:
    """A model from all labelled rows' counts and about ``per_label`` rows of each label, none longer than ``chars``.

    Never more than a third above ``per_label`` rows of a label reach the driver.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fits = F.length(text_col) <= chars
    counts = {r[0]: r[1:] for r in rows.groupBy(label_col).agg(F.count("*"), F.count(F.when(fits, 1)), F.coalesce(F.min(F.when(fits, draw)), F.lit(0.0))).collect()}
    if len(counts) < 2:
        return None
    docs_of = np.array([counts[0][0], counts[1][0]], float)
    df = np.zeros((2, PLACES))
    for place, clean, toxic in document_counts(rows, text_col, label_col).where(F.col("toxic") >= LEAST_DF).collect():
        df[:, place] = clean, toxic
    short = rows.where(fits).select(draw.alias("draw"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    part = lambda k: short.where((F.col("label") == k) & (F.col("draw") <= max(counts[k][2], 1.3 * per_label / max(1, counts[k][1])))).orderBy("draw", "text").limit(per_label + per_label // 3)
    sample = sorted(tuple(r) for k in (0, 1) for r in part(k).collect())
    return train([r[1] for r in sample], [int(r[2]) for r in sample], df, docs_of)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, toxic_from: float = 0.5) -> DataFrame:
    """The ``keep`` columns with score and spans: offsets of the tokens whose marginal is ``toxic_from`` or more.

    Kept columns of these two names give way to the results.
    """
    keep = [c for c in keep or docs.columns if c not in ("score", "spans")]
    columns = [*keep, *([] if text_col in keep else [text_col])]
    place = columns.index(text_col)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.chain.weights.astype(np.float32), model.chain.transitions, model.logistic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        m = shared.value and Model(Chain(*shared.value[:2]), shared.value[2])
        known = Emissions(m.chain.weights) if m else None
        for b in batches:
            scores, spans = [], []
            for texts in _pieces(b.column(place)):
                s, x = _scored(m, known, texts, toxic_from) if m else ([0.0] * len(texts), [[]] * len(texts))
                scores += s
                spans += x
            new = [pa.array(scores, pa.float64()), pa.array(spans, kinds.field("spans").type)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], schema=kinds)

    return docs.select(*columns).mapInArrow(run, schema)


def _pieces(column: pa.Array) -> Iterator[list[str | None]]:
    """Texts in groups of about AT_ONCE tokens."""
    out, size = [], 0
    for t in column:
        out.append(t.as_py())
        size += len(out[-1] or "")
        if size > 6 * AT_ONCE:
            yield out
            out, size = [], 0
    if out:
        yield out


def _scored(m: Model, known: Emissions, texts: list[str | None], toxic_from: float) -> tuple[list[float], list[list[dict]]]:
    found = [tokens(t) if t else [] for t in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    get = known.__getitem__
    s = np.fromiter((get(w) for x in found for w in x), np.float64, int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    start = np.zeros(len(s), bool)
    start[first[lengths > 0]] = True
    p = m.chain.marginals(s, start)[0] if len(s) else np.zeros(0)
    scores = m.score(summary(p, lengths))
    spans: list[list[dict]] = [[] for _ in texts]
    hot = np.flatnonzero(p >= toxic_from)
    for k in np.unique(np.searchsorted(np.cumsum(lengths), hot, side="right")).tolist():
        own = p[first[k] : first[k] + lengths[k]]
        spans[k] = [{"start": x.start(), "end": x.end(), "marginal": float(q)} for x, q in zip(places(texts[k]), own, strict=True) if q >= toxic_from]
    return scores.tolist(), spans


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 3, fold: int = 1, at: float = 0.7, **how) -> DataFrame:
    """Learns outside the held-out fold and scores all: id, held_out, score, predicted, n_spans."""
    known = labels.where(crc_part(id_col, folds) != fold).select(id_col, "toxic")
    labelled = stored(docs.select(id_col, "text").join(known.hint("merge"), id_col), "labelled")  # texts move once, at any size
    model = fit(labelled, id_col, **how)
    out = score(docs.select(id_col, "text"), model, keep=[id_col])
    return out.select(id_col, (crc_part(id_col, folds) == fold).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
