"""Token counts by rank-synchronous array merging.

Pre-tokens become ragged arrays of symbol ids. In every round each sequence's
lowest-rank adjacent pair is found and all its occurrences are merged, in all
sequences of the batch at once; a sequence with no rankable pair is finished
and its surviving symbols are its token count. A merged symbol only takes part
in pairs of higher rank than its own, so merging all occurrences of the lowest
pair together gives what merging them one by one gives.

Equal pre-tokens of a Python worker are merged once: a bounded dictionary keeps
their counts. Nothing is shuffled; a task holds one Arrow batch.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a special token's
string inside a text is one token, as the library has it by default; rows are
never dropped or merged, so repeated rows and ties return as often as they came.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 1_000_000, 64
#: Bytes merged at once.
AT_ONCE = 4_000_000
#: Unicode's White_Space, spelled out: the regex libraries differ on \s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this family.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class RankMerger:
    """Counts the BPE symbols of byte strings, many at a time."""

    SLOTS = 1 << 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are counted here")
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.key, self.rank, self.made = np.full(self.SLOTS, -1, np.int64), np.full(self.SLOTS, NEVER, np.int32), np.zeros(self.SLOTS, np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):  # open addressing: each round places what finds a free slot
            at = self._slot(keys[todo], self.probes)
            free = self.key[at] < 0
            self.key[at[free]] = keys[todo[free]]
            won = self.key[at] == keys[todo]
            self.rank[at[won]], self.made[at[won]] = todo[won], made[todo[won]]
            todo, self.probes = todo[~won], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1 | 1) >> 23) + probe * 7919) & (self.SLOTS - 1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        keys = left << 20 | right
        at = self._slot(keys, 0)
        rank, made = np.where(self.key[at] == keys, self.rank[at], NEVER), self.made[at]
        open_ = np.flatnonzero((self.key[at] != keys) & (self.key[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            k = keys[open_]
            at = self._slot(k, probe)
            same = self.key[at] == k
            rank[open_[same]], made[open_[same]] = self.rank[at[same]], self.made[at[same]]
            open_ = open_[~same & (self.key[at] >= 0)]
        return rank, made

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each byte string."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = length.copy()
        name = np.flatnonzero(length > 1)  # what a row of the ragged arrays is called outside
        if not len(name):
            return out
        sym = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in name]), np.uint8)]
        length = length[name]
        last = np.cumsum(length) - 1
        rank, made = self._pairs(sym, last)
        while True:
            first = last - length + 1
            best = np.minimum.reduceat(rank, first)
            alive = best != NEVER
            if not alive.all():
                out[name[~alive]] = length[~alive]
                if not alive.any():
                    return out
                keep = np.repeat(alive, length)
                sym, rank, made = sym[keep], rank[keep], made[keep]
                name, best, length = name[alive], best[alive], length[alive]
                last = np.cumsum(length) - 1
            hit = np.flatnonzero(rank == np.repeat(best, length))
            # of overlapping occurrences (a a a) the leftmost merges, then every other one of the run
            near = np.empty(len(hit), bool)
            near[0] = False
            np.equal(hit[1:], hit[:-1] + 1, out=near[1:])
            if near.any():
                start = np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = made[hit]
            row = np.searchsorted(last, hit)
            gone = np.ones(len(sym), bool)
            gone[hit + 1] = False
            new_at = hit - np.arange(len(hit))  # each earlier hit has removed one symbol
            sym, rank, made = sym[gone], rank[gone], made[gone]
            length = length - np.bincount(row, minlength=len(length))
            last = np.cumsum(length) - 1
            ends = np.zeros(len(sym), bool)
            ends[last] = True
            touched = np.concatenate([new_at, new_at[new_at > 0] - 1])
            done = ends[touched]
            rank[touched[done]] = NEVER
            touched = touched[~done]
            rank[touched], made[touched] = self._find(sym[touched], sym[touched + 1])

    def _pairs(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._find(sym[:-1], sym[1:])
        rank[last] = NEVER
        return rank, made


class TextCounter:
    """Tokens of whole texts: specials, pre-tokens, then merged pre-tokens by dictionary."""

    def __init__(self, path: str):
        import regex

        self.merger = RankMerger(path)
        self.split = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, sorted(self.merger.specials, key=len, reverse=True)))) if self.merger.specials else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens between them."""
        if self.special is None or not (cut := self.special.split(text))[1:]:
            return self.split(text), 0
        return [p for part in cut for p in self.split(part)], len(cut) - 1

    def learn(self, new: list[str]) -> dict[str, int]:
        """Counts of pre-tokens; short ones are kept for later texts."""
        got: dict[str, int] = {}
        batch, size = [], 0
        for p in [*new, None]:
            if p is None or size > AT_ONCE:
                got.update(zip(batch, self.merger.counts([x.encode("utf-8", "surrogatepass") for x in batch]).tolist(), strict=True))
                batch, size = [], 0
            if p is not None:
                batch.append(p)
                size += len(p)
        return got

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out = []
        for i in range(0, len(texts), 256):
            cut = [self.pieces(t or "") for t in texts[i : i + 256]]
            known = self.known
            new = list(set().union(*[p for p, _ in cut]).difference(known))
            if new:
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = list(set().union(*[p for p, _ in cut]))
                known.update(self.learn(new))
            out += [sum(map(known.__getitem__, p)) + n for p, n in cut]
            for p in new:
                if len(p) > KEPT_CHARS:
                    del known[p]
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    """One per worker process and vocabulary."""
    return TextCounter(path)


def token_counts(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``df``.

    Null text: 0 bytes and 0 tokens. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counter(vocab).count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
