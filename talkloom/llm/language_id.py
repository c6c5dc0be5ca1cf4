"""Language identification with string kernels.

A text's blended spectrum is the set of its character n-grams of 1 to 3
characters (letters lower-cased, everything else a space), hashed to ``DIMS``
places. The kernel of two texts is the number of n-grams present in both,
divided by the root of the product of their numbers. Nyström landmarks turn
kernel values into a bounded number of features; kernel ridge regression, one
language against the rest, is fitted on them. Texts are scored in batches:
presence matrix times landmark matrix, then times the ridge weights.

Only fitting looks at a sample: ``per_lang`` labelled rows of each language at
most, drawn by a hash of id and text. All rows are scored whole, without a
shuffle; the model that is broadcast has langs x per_landmark x DIMS numbers.

Defined cases: null text and text without a letter give ``und`` with score 0,
as every text does when nothing could be learned (no labelled rows); a null id
counts as empty text for the fold; one learned language takes every text. A
caller may ask for texts of no learned language (foreign languages, keyboard
noise, program code) to be ``und`` too (``refuse``): those that no language's own
classifier claims (all below ``CLAIM``), that are no nearer to one language than
to the next by ``MARGIN``, and of whose n-grams the language knows less than
``KNOWN``. A text that one of the three speaks for stays, unless less than
``STRANGE`` of its n-grams are known, as in a foreign script.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import crc_part

DIMS_LOG2, NOTHING = 13, "und"
DIMS = 1 << DIMS_LOG2
#: Of a text's best one-versus-rest value, its lead over the second, and the share of n-grams that the language's sample has.
CLAIM, MARGIN, KNOWN, STRANGE = 0.0, 0.2, 0.8, 0.6
MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))
AT_ONCE, PIECE = 256, 1 << 20
_letter = re.compile(r"[^\W\d_]")
#: ASCII: upper case to lower, all but letters to a space.
_ASCII = np.array([ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _letter.search(text)
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def mark(text: str, row: np.ndarray) -> None:
    """Sets the places of the text's n-grams in ``row``."""
    for i in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, i - 2) : i + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
        a, b = c * MIX[0], c * MIX[1]
        shift = np.uint32(32 - DIMS_LOG2)
        row[a >> shift] = 1
        two = b[:-1] + a[1:] * np.uint32(31) + np.uint32(97)
        row[two >> shift] = 1
        row[(c[:-2] * MIX[2] ^ two[1:] * np.uint32(40503)) * np.uint32(2246822507) >> shift] = 1


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # landmarks x DIMS, float32
    weights: np.ndarray  # landmarks x langs
    known: np.ndarray  # langs x DIMS: the n-grams that the language's sample has

    def score(self, presence: np.ndarray) -> np.ndarray:
        return kernel(presence, self.landmarks) @ self.weights


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of all rows of ``x`` with all of ``y``."""
    return (x @ y.T) / np.sqrt(np.maximum(np.outer(x.sum(1), y.sum(1)), 1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, per_landmark: int = 24, ridge: float = 0.05) -> Model:
    """A model from about ``per_lang`` rows of each non-null language of ``docs``."""
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1:] for r in labelled.groupBy("lang").agg(F.count("*"), F.min("draw")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, 0)), np.zeros((0, DIMS), bool))
    most = F.create_map(*[F.lit(x) for k, (n, least) in counts.items() for x in (k, max(least, 1.3 * per_lang / n))])
    chosen = labelled.where(F.col("draw") <= most[F.col("lang")])  # equal rows share one draw: the window below bounds them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for t in b.column(2):
                row = np.zeros(DIMS, np.uint8)
                if has_letter(t.as_py()):
                    mark(t.as_py(), row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["lang", "draw", "bits"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))
    marked = chosen.mapInArrow(run, "lang string, draw double, bits binary")
    rows = sorted(tuple(r)[:3] for r in marked.withColumn("place", place).where(F.col("place") <= per_lang + per_lang // 3).collect())
    langs = sorted(counts)
    by = {k: [r for r in rows if r[0] == k and any(r[2])][:per_lang] for k in langs}
    langs = [k for k in langs if by[k]]
    if not langs:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, 0)), np.zeros((0, DIMS), bool))
    x = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8)[None], axis=1) for k in langs for r in by[k]]).astype(np.float32)
    y = np.array([[1.0 if k == q else -1.0 for q in langs] for k in langs for _ in by[k]])
    size = np.concatenate([np.full(len(by[k]), len(rows) / len(by[k])) for k in langs])
    marks = np.concatenate([np.arange(len(by[k]))[:per_landmark] + sum(len(by[q]) for q in langs[:i]) for i, k in enumerate(langs)])
    landmarks = x[marks]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, landmarks) @ root
    w = size / size.mean()
    beta = np.linalg.solve(phi.T @ (phi * w[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (y * w[:, None]))
    known = np.stack([x[sum(len(by[q]) for q in langs[:k]) :][: len(by[lang])].any(0) for k, lang in enumerate(langs)])
    return Model(langs, landmarks, root @ beta, known)


def claimed(value: np.ndarray, presence: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which texts some language claims, leads in, or knows the n-grams of."""
    best, order = value.argmax(1), np.sort(value, axis=1)
    lead = order[:, -1] - order[:, -2] if value.shape[1] > 1 else np.zeros(len(value))
    share = (presence * known[best]).sum(1) / np.maximum(presence.sum(1), 1)
    return (share >= KNOWN) | ((share >= STRANGE) & ((order[:, -1] >= CLAIM) | (lead >= MARGIN)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), refuse: bool = False) -> DataFrame:
    """The ``keep`` columns (all of ``docs`` by default) with the language and its score, 0 to 1, under ``names``.

    Kept columns of these names give way to the results.
    """
    keep = [c for c in keep or docs.columns if c not in names]
    columns = [*keep, *([] if text_col in keep else [text_col])]
    place = columns.index(text_col)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, np.packbits(model.landmarks.astype(np.uint8), axis=1), model.weights, np.packbits(model.known, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        langs, bits, weights, own = shared.value
        m = Model(langs, np.unpackbits(bits, axis=1)[:, :DIMS].astype(np.float32), weights, np.unpackbits(own, axis=1)[:, :DIMS].astype(np.float32))
        kinds, x = to_arrow_schema(schema), np.zeros((AT_ONCE, DIMS), np.float32)
        for b in batches:
            names, scores = [], []
            for i in range(0, b.num_rows, AT_ONCE):
                texts = b.column(place)[i : i + AT_ONCE].to_pylist()
                known = [bool(m.langs) and has_letter(t) for t in texts]
                x[: len(texts)] = 0
                for k, t in enumerate(texts):
                    if known[k]:
                        mark(t, x[k])
                if not m.langs:
                    names += [NOTHING] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                value = m.score(x[: len(texts)])
                f = 3.0 * value
                e = np.exp(f - f.max(1, keepdims=True))
                best = f.argmax(1)
                p = (e / e.sum(1, keepdims=True)).max(1)
                if refuse:
                    known = [ok and s for ok, s in zip(known, claimed(value, x[: len(texts)], m.known), strict=True)]
                names += [m.langs[j] if ok else NOTHING for j, ok in zip(best, known, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(p, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=kinds)

    return docs.select(*columns).mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, **how) -> DataFrame:
    """Learns from the rows outside fold 0 and predicts all: id, held_out, lang_pred, score."""
    model = fit(docs.where(crc_part(id_col, folds) != 0), id_col, **how)
    out = predict(docs.select(id_col, "text"), model, keep=[id_col])
    return out.select(id_col, (crc_part(id_col, folds) == 0).alias("held_out"), "lang_pred", "score")
