"""The language model against plain counts, plain softmax sums, numeric gradients and held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import language_model as lm
from tests.support import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "ÄÖ ß é É", "The THE the " * 300, "x\x0by\x0cz\x1cw\x85v", "q" * 3000, "one two\nthree", " wide"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def base(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    told = [[*words(t), "\n"] for _, t in rows]
    seen = Counter(w for (i, _), ws in zip(rows, told, strict=True) if crc(i) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    return [(i, crc(i) % 7 == 2, len(ws), sum(w in seen for w in ws), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, told, strict=True)], seen


def close(got, want):
    key = lambda r: tuple(map(str, r[:4])) + (round(r[5], 6),)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def score(model, vocabulary, seen, text):
    """The model's logarithm of a text's probability, each softmax summed by itself."""
    end, at, out = lm.WORDS + lm.CLASSES, [lm.WORDS + lm.CLASSES] * 2, 0.0
    own = {w: k for k, w in enumerate(vocabulary.words[: lm.WORDS])}
    for w in [*words(text), "\n"]:
        raw = w.encode()
        s = end if w == "\n" else own.get(raw, lm.WORDS + lm.class_of(raw))
        q = model.inputs[at[0]].astype(float) @ model.places[0] + model.inputs[at[1]].astype(float) @ model.places[1]
        z = model.outputs.astype(float) @ q + model.bias
        out += (z[s] - np.log(np.exp(z).sum())) / math.log(10)
        if lm.WORDS <= s < end:
            group = [x for x in seen if x != "\n" and x.encode() not in own and lm.class_of(x.encode()) == s - lm.WORDS]
            out += math.log10((seen[w] + 1) / (sum(seen[x] for x in group) + len(group) + 1))
        at = [s, at[0]] if s != end else [end, end]
    return out


def test_counts_and_base_scores_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, "null id"), (None, None), (3, "again the"), (3, "again the")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)
    for c in ("row", "id", "score", "word", "n", "held_out", "n_tokens", "rare", "k"):
        df = df.withColumn(c, F.lit("mine"))
    got = lm.report(df)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    close([tuple(r) for r in got.collect()], base(rows)[0])


@pytest.mark.parametrize("lookup", [lm.LOOKUP, 900, 0])
def test_scores_are_plain_softmax_sums_however_many_words_are_joined(spark, monkeypatch, lookup):
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text")).limit(60)
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, seen = base(rows)
    counts, vocabulary, model = lm.fit(docs.where(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)))
    got = {r["id"]: r for r in lm.scored(docs, counts, vocabulary, model).collect()}
    for i, _, n, known, _, b in want:
        assert (got[i].n_tokens, got[i].n_known) == (n, known) and got[i].base_score == pytest.approx(b)
    for i, text in rows[:8] + rows[-8:]:
        assert got[i].score == pytest.approx(score(model, vocabulary, seen, text), abs=1e-3)


def test_probabilities_of_all_continuations_add_up():
    r = np.random.default_rng(1)
    prior = r.dirichlet(np.ones(lm.WORDS + lm.CLASSES + 1))
    model = lm.start(prior)
    model.inputs[:] = r.normal(0, 2, model.inputs.shape)
    tables = model.tables()
    for before in ([3, 900], [1023, 1023], [0, 1]):
        n = len(prior)
        p = 10 ** lm.log10(tables, np.arange(n), [np.full(n, c) for c in before])
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_steps_follow_the_gradient_of_noise_contrastive_estimation():
    """The step of each parameter against differences of the objective, with the same noise."""
    r = np.random.default_rng(2)
    prior = r.dirichlet(np.ones(lm.WORDS + lm.CLASSES + 1))
    target, before = r.integers(0, 1024, 64), [r.integers(0, 1024, 64) for _ in range(2)]
    first = lm.start(prior)
    teacher = lm.Trainer(first, prior, 7)
    noise = np.searchsorted(np.cumsum(prior), np.random.default_rng(7).random(lm.NOISE) * np.cumsum(prior)[-1])

    def objective(flat):
        at, parts = 0, []
        for x in first.parts:
            parts.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        inputs, outputs, bias, places = parts
        q = sum(inputs[c] @ p for c, p in zip(before, places, strict=True))
        own = (q * outputs[target]).sum(1) + bias[target] - np.log(lm.NOISE * prior[target])
        others = q @ outputs[noise].T + bias[noise] - np.log(lm.NOISE * prior[noise])
        return -np.log1p(np.exp(-own)).sum() - np.log1p(np.exp(others)).sum()

    flat = first.packed().astype(float)
    teacher._step(target, before)
    moved = teacher.model.packed().astype(float) - flat
    shapes = np.cumsum([0, *[x.size for x in first.parts]])
    for at in [int(target[0]) * lm.WIDTH + shapes[1], int(noise[0]) * lm.WIDTH + 5 + shapes[1], int(before[0][3]) * lm.WIDTH + 2, int(target[5]) + shapes[2], shapes[3] + 17, shapes[3] + 300]:
        e = np.zeros_like(flat)
        e[at] = 1e-4
        slope = (objective(flat + e) - objective(flat - e)) / 2e-4
        assert moved[at] == pytest.approx(lm.STEP * slope / math.sqrt(1 + slope * slope), rel=2e-2, abs=1e-5)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 16)
    text = b"Aa bb  cc\tdd " * 9 + b"x" * 50 + b"\x0bLast"
    assert [w for p in lm.pieces(text) for w in p] == text.lower().split()
    assert len(list(lm.pieces(text))) > 5 and list(lm.pieces(b"")) == [[]]


def test_contexts_end_with_their_text():
    end = 9
    symbols = np.array([1, 2, end, 3, end, end, 4])
    a, b = lm.contexts(symbols, np.array([7, 8]), end)
    assert a.tolist() == [8, 1, 2, end, 3, end, end] and b.tolist() == [7, 8, 1, end, end, end, end]


def test_held_out_text_is_likelier_than_by_counts_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6, "doc_id").sortWithinPartitions("doc_id")
    runs = [{r.doc_id: r for r in lm.report(docs).collect()} for _ in range(2)]
    held = [r for r in runs[0].values() if r.held_out]
    assert len(held) > 100
    assert sum(r.score for r in held) > 0.985 * sum(r.base_score for r in held)
    assert all(runs[1][i].score == pytest.approx(r.score, rel=1e-9) for i, r in runs[0].items())


def test_nothing_to_learn_from_and_no_rows(spark):
    only = [(i, "a b") for i in range(60) if crc(i) % 7 == 2]
    got = lm.report(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got) and len(got) == len(only)
    assert lm.report(spark.createDataFrame([], DOCS)).collect() == []
