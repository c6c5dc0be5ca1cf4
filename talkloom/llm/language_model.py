"""Scores of texts by a log-bilinear language model, trained with noise-contrastive estimation.

Counting: every word of all training texts is counted, and the counts are a
table of any size. Of it, the ``LOOKUP`` most frequent words go to every task;
the others are met by a join on the word, so that no word's count is left out.

Model (Mnih and Teh, "A fast and simple algorithm for training neural
probabilistic language models", 2012): a token is one of ``WORDS`` frequent
words, the end, or one of ``CLASSES`` classes by the last three bytes; a context
of two tokens is the sum of their vectors, each through its place's matrix, and
a symbol's score its product with the symbol's own vector, plus a bias. Training
tells a text's symbols from noise that a minibatch shares. All training texts
are used once, in rounds of growing ``ROUNDS`` parts of them: a task trains on
its own texts from the last round's model, and the round's models are averaged,
weighted by tokens, by a tree of groups of ``MERGE`` tasks. The model's size is
fixed; only it and the frequent words pass through the driver.

Scoring: the logarithm of the probability of a text's tokens and its end. Batched
matrix products give the scores of all symbols after all contexts, normalised
exactly, once a task; a symbol of a class is divided among the class's words by
their counts, one added to each and to all words not seen together. So the
probabilities of all continuations of a context add up to one.

Defined cases: null text is empty and has its end alone; a text of any length is
read in pieces; equal and null ids are scored each by itself; a null id counts as
the empty text where parts are made; without training texts both scores are the
model's without any count (base 0); no rows give no rows; other columns don't
matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import crc_part, stored

#: Sizes of the model: own symbols, classes of the other words, components of a vector, symbols of the context.
WORDS, CLASSES, WIDTH, CONTEXT = 768, 255, 16, 2
#: Words whose counts every task has (a few MB); the rest is joined.
LOOKUP = 1 << 17
#: Training: noise of a minibatch, its tokens, step, parts of the training texts (eighths) of each round, models merged at once.
NOISE, BATCH, STEP, ROUNDS, MERGE = 32, 512, 0.2, ((0,), (1, 2), (3, 4, 5, 6, 7)), 32
#: Characters of a text split at once, tokens taken at once, distinct words counted at once.
PIECE, TOKENS, DISTINCT = 1 << 20, 100_000, 200_000
END_WORD = b"\n"
_space = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, A to Z in lower case; a long text in pieces."""
    at = 0
    while len(text) - at > PIECE:
        end = _space.search(text, at + PIECE)
        if not end:
            break
        yield text[at : end.start()].lower().split()
        at = end.end()
    yield text[at:].lower().split()


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def counted(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, class, n`` over all texts; the end is a word of its own, without a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def batch() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([class_of(w) if w != END_WORD else None for w in words], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "class", "n"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0):
                for words in pieces(text.as_py()):
                    seen.update(words)
                    if len(seen) > DISTINCT:
                        yield batch()
                seen[END_WORD] += 1
        if seen:
            yield batch()

    parts = texts.select(_raw(text_col)).mapInArrow(run, "word binary, class int, n long")
    return stored(parts.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "counts")


@dataclass
class Vocabulary:
    """Frequent words with counts, and the totals of symbols; what is sent to tasks."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    ends: int
    symbol_tokens: np.ndarray
    symbol_words: np.ndarray
    places: dict[bytes, int] = field(default_factory=dict)

    @property
    def end(self) -> int:
        return WORDS + CLASSES

    def open(self) -> Vocabulary:
        """The words' symbols and places, once a task."""
        if not self.places:
            self.places = {w: k for k, w in enumerate(self.words)}
            self.symbol_at = np.array([k if k < WORDS else WORDS + class_of(w) for k, w in enumerate(self.words)], np.int32)
            self.log_at = np.log10(self.counts + 1.0)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("places", "symbol_at", "log_at")} | {"places": {}}

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's symbol, and its place among the frequent words; -1: not among them, -2: an end."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int32, len(words))
        symbols = self.symbol_at[at] if len(self.symbol_at) else np.zeros(len(at), np.int32)
        for k in np.flatnonzero(at < 0):
            if words[k] == END_WORD:
                symbols[k], at[k] = self.end, -2
            else:
                symbols[k] = WORDS + class_of(words[k])
        return symbols, at

    def prior(self) -> np.ndarray:
        return (self.symbol_tokens + 1) / (self.symbol_tokens.sum() + len(self.symbol_tokens))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Of :func:`counted`'s table: its totals, its ``LOOKUP`` most frequent words, and a total for each symbol."""
    tokens, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("class").isNull(), F.col("n")))).first()
    often = counts.where("class is not null").orderBy(F.col("n").desc(), "word").limit(LOOKUP).select("word", "n").toArrow()
    words, n = often.column("word").to_pylist(), np.array(often.column("n").to_pylist(), np.int64)
    symbol_tokens, symbol_words = np.zeros(WORDS + CLASSES + 1, np.int64), np.zeros(WORDS + CLASSES + 1, np.int64)
    for c, total, own in counts.where("class is not null").groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # a row for each class
        symbol_tokens[WORDS + c], symbol_words[WORDS + c] = total, own
    for k, w in enumerate(words[:WORDS]):
        c = WORDS + class_of(w)
        symbol_tokens[c], symbol_words[c] = symbol_tokens[c] - n[k], symbol_words[c] - 1
        symbol_tokens[k], symbol_words[k] = n[k], 1
    symbol_tokens[-1], symbol_words[-1] = ends or 0, 1
    return Vocabulary(tokens or 0, distinct, words, n, ends or 0, symbol_tokens, symbol_words)


def contexts(symbols: np.ndarray, last: np.ndarray, end: int) -> list[np.ndarray]:
    """The symbol before each one, the one before that and so on, ``last`` being those before the first; ends before a text's start."""
    whole, out, ended = np.concatenate([last, symbols]), [], None
    for h in range(1, CONTEXT + 1):
        c = whole[CONTEXT - h : len(whole) - h].copy()
        if ended is not None:
            c[ended] = end
        ended = c == end
        out.append(c)
    return out


@dataclass
class Model:
    """Vectors of symbols in a context and as what follows, biases, and a matrix for each of the two places."""

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    places: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.bias, self.places]

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        n, at, out = WORDS + CLASSES + 1, 0, []
        for shape in ((n, WIDTH), (n, WIDTH), (n,), (CONTEXT, WIDTH, WIDTH)):
            size = math.prod(shape)
            out.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return Model(*out)

    def tables(self) -> list[np.ndarray]:
        """What each place's symbol adds to each symbol's score, and the normaliser of every context, as logarithms.

        A score is a sum over places, so its exponential is a product, and the sum
        over all symbols, for all contexts at once, one product of two matrices.
        """
        first, second = ((self.inputs @ m).astype(float) @ self.outputs.T for m in self.places)
        first += self.bias
        most = [x.max(1, keepdims=True) for x in (first, second)]
        norm = np.log(np.exp(first - most[0]) @ np.exp(second - most[1]).T) + most[0] + most[1].T
        return [x / math.log(10) for x in (first, second, norm)]


def log10(tables: list[np.ndarray], symbols: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """The logarithm of each symbol's probability after its context."""
    first, second, norm = tables
    return first[before[0], symbols] + second[before[1], symbols] - norm[before[0], before[1]]


def start(prior: np.ndarray) -> Model:
    """The model before training: small vectors, and the symbols' own shares as biases."""
    r, n = np.random.default_rng(1), len(prior)
    places = np.stack([np.eye(WIDTH, dtype=np.float32) * 0.7**h for h in range(CONTEXT)])
    return Model(r.normal(0, 0.1, (n, WIDTH)).astype(np.float32), r.normal(0, 0.1, (n, WIDTH)).astype(np.float32), np.log(prior).astype(np.float32), places)


class Trainer:
    """Noise-contrastive training of a model, minibatch by minibatch, with steps divided by the root of past squares."""

    def __init__(self, model: Model, prior: np.ndarray, seed: int):
        self.model = Model(*[x.copy() for x in model.parts])
        self.squares = [np.ones_like(x) for x in model.parts]
        self.reach, self.log_noise = np.cumsum(prior), np.log(NOISE * prior).astype(np.float32)
        self.random = np.random.default_rng(seed)
        self.seen = 0

    def learn(self, symbols: np.ndarray, before: list[np.ndarray]) -> None:
        order = self.random.permutation(len(symbols))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            self._step(symbols[at], [c[at] for c in before])
        self.seen += len(symbols)

    def _step(self, target: np.ndarray, before: list[np.ndarray]) -> None:
        m, size = self.model, WIDTH * len(self.model.bias)
        vectors = [m.inputs[c] for c in before]
        q = sum(v @ p for v, p in zip(vectors, m.places, strict=True))
        noise = np.searchsorted(self.reach, self.random.random(NOISE) * self.reach[-1])
        own, others = m.outputs[target], m.outputs[noise]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) + m.bias[target] - self.log_noise[target]))  # 1 - P(text)
        down = -1 / (1 + np.exp(self.log_noise[noise] - m.bias[noise] - q @ others.T))  # -P(text) of noise
        back = up[:, None] * own + down @ others

        def gathered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.bincount((rows[:, None] * WIDTH + np.arange(WIDTH)).ravel(), values.ravel(), size).reshape(-1, WIDTH)

        outputs, bias = gathered(target, up[:, None] * q), np.bincount(target, up, len(m.bias))
        np.add.at(outputs, noise, down.T @ q)
        np.add.at(bias, noise, down.sum(0))
        inputs = sum(gathered(c, back @ p.T) for c, p in zip(before, m.places, strict=True))
        places = np.stack([v.T @ back for v in vectors])
        for x, step, squares in zip(m.parts, (inputs, outputs, bias, places), self.squares, strict=True):
            step = step.astype(np.float32) * np.float32(64 / len(target))
            squares += step * step
            x += np.float32(STEP) * step / np.sqrt(squares)


def _read(batches: Iterator[pa.RecordBatch], column: int, vocabulary: Vocabulary) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(batch, row of each token, tokens, symbols, places, contexts) for the tokens of all texts, some ``TOKENS`` at a time."""
    last = np.full(CONTEXT, vocabulary.end, np.int32)
    for b in batches:
        words: list[bytes] = []
        rows: list[tuple[int, int]] = []
        for row, text in enumerate(b.column(column)):
            for some in pieces(text.as_py()):
                words += some
                rows.append((row, len(some)))
                if len(words) >= TOKENS:
                    yield b, *_taken(words, rows, last, vocabulary)
                    words, rows = [], []
            words.append(END_WORD)
            rows.append((row, 1))
        if words:
            yield b, *_taken(words, rows, last, vocabulary)


def _taken(words: list[bytes], rows: list[tuple[int, int]], last: np.ndarray, vocabulary: Vocabulary) -> tuple:
    symbols, places = vocabulary.read(words)
    before = contexts(symbols, last, vocabulary.end)
    last[:] = np.concatenate([last, symbols])[-CONTEXT:]
    at, n = np.array(rows).T
    return np.repeat(at, n), words, symbols, places, before


def trained(texts: DataFrame, words: Vocabulary, model: Model, text_col: str = "text") -> Model:
    """The average of the models that the tasks make of their texts, from ``model`` on."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((words, model))  # a size fixed by LOOKUP, WORDS and CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = sent.value
        task = TaskContext.get().partitionId()
        teacher = Trainer(model, words.open().prior(), task)
        for _, _, _, symbols, _, before in _read(batches, 0, words):
            teacher.learn(symbols, before)
        if teacher.seen:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([teacher.seen], pa.int64()), pa.array([(teacher.model.packed().astype(np.float64) * teacher.seen).tobytes()], pa.binary())], ["task", "n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, total = None, 0, None
        for b in batches:
            for t, more, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t // MERGE != task:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "n", "sums"])
                    task, n, total = t // MERGE, 0, np.zeros(len(sums) // 8)
                n, total = n + more, total + np.frombuffer(sums)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "n", "sums"])

    kind = "task long, n long, sums binary"
    made = stored(texts.select(_raw(text_col)).mapInArrow(run, kind), "models")
    while (made.agg(F.max("task")).first()[0] or 0) > 0:
        made = stored(made.repartition((F.col("task") / MERGE).cast("long")).sortWithinPartitions("task").mapInArrow(merge, kind), "models")
    row = made.first()  # one model
    sent.unpersist()
    return Model.of(np.frombuffer(row["sums"]) / row["n"]) if row else model


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, Model]:
    """The training texts' word counts, what of them every task gets, and the model."""
    counts = counted(training, text_col)
    words = vocabulary(counts)
    model = start(words.prior())
    part = F.floor(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) / 7) % sum(map(len, ROUNDS))
    for eighths in ROUNDS if words.tokens else ():
        model = trained(training.where(part.isin(*eighths)), words, model, text_col)
    return counts, words, model


def scored(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of every text."""
    sent = docs.sparkSession.sparkContext.broadcast((words, model))  # as above
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "n_tokens", "n_known", "base", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = sent.value
        words.open()
        tables = model.tables()
        log_end = math.log10(words.ends + 1)
        shared = np.zeros(WORDS + CLASSES + 1)  # what a class's words divide among them
        shared[WORDS:-1] = np.log10(words.symbol_tokens[WORDS:-1] + words.symbol_words[WORDS:-1] + 1)
        for b, row, tokens, symbols, places, before in _read(batches, 2, words):
            of_count = np.where(places >= 0, words.log_at[places] if len(words.log_at) else 0.0, np.where(places == -2, log_end, 0.0))
            of_class = (symbols >= WORDS) & (symbols != words.end)
            score = log10(tables, symbols, before) - shared[symbols] + np.where(of_class, of_count, 0.0)
            first, m = row[0], row[-1] - row[0] + 1
            sums = [np.bincount(row - first, x, m) for x in (np.ones(len(row)), (places >= 0) | ((places == -2) & (words.ends > 0)), of_count, score)]
            rare: list[list[bytes]] = [[] for _ in range(m)]
            for k in np.flatnonzero(places == -1):
                rare[row[k] - first].append(tokens[k])
            ids = b.slice(first, m)
            yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *[pa.array(x.astype(np.int64)) for x in sums[:2]], *[pa.array(x) for x in sums[2:]], pa.array(rare, pa.list_(pa.binary()))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _raw(text_col))
    schema = f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rare array<binary>"
    parts = stored(rows.mapInArrow(run, schema), "scores")
    seldom = parts.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    met = seldom.join(counts.select("word", "n"), "word").select("row", "k", (F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    none = lambda t: F.lit(None).cast(t)
    met = met.select("row", none(kind).alias("id"), none("long").alias("n_tokens"), F.col("k").alias("n_known"), F.col("more").alias("base"), F.col("more").alias("score"))
    every = parts.drop("rare").unionByName(met).groupBy("row").agg(F.max("id").alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(words.tokens + words.distinct + 1))
    return every.select("id", "n_tokens", "n_known", base.alias("base_score"), "score")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the documents of six crc32 parts of seven, and scores all."""
    held_out = crc_part(id_col, 7) == 2
    counts, words, model = fit(docs.where(~held_out), id_col, text_col)
    out = scored(docs, counts, words, model, id_col, text_col).withColumnRenamed("id", id_col)
    return out.select(id_col, held_out.alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
