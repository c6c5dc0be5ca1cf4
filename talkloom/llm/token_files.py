"""Token ids in compressed binary files: an adaptive context-mixing range coder.

Texts are encoded by the tokenizers library and laid out in ascending id order,
each document followed by the end id. Documents fill segments (a file row each);
a segment's ids are cut in blocks of ``BLOCK`` ids, each coded from the same
start and checksummed, so each can be decoded alone with the segment's header.
The blocks of a group (``LANES`` at most) are coded in step by numpy: position k
of every block at once.

The header names the segment's ids with their rounded frequencies: the order-0
model that every block starts from. Ids that are typical for one sort of blocks
(a language, say) stand together by falling frequency, in groups of about equal
frequency: an id alone where it is frequent. A block's model predicts the next id
in orders: order 2 and order 1 remember the id that last followed the two ids, or
the id, before it and how often that held; their adaptive probabilities are mixed
in the logistic domain by learned weights into the chance that the candidate (that
of order 2, where it has one) is right. Anything else is coded by order 0: the
frequency of the id's group, the start's and the recent ones, which fade, and the
start's frequency of the id in its group. Frequencies, probabilities and weights
learn at ``RENEWALS``, the remembered ids at once. The three parts make one
interval of 2**35 for each id, which drives a 63-bit range coder with carries.
Files decode alike everywhere: all arithmetic is of integers, or exact.

File format: Parquet rows of (part, segment, doc_ids, lengths, alphabet, weights,
sizes, crcs, payload): the documents' ids and token counts, the header, and each
block's payload bytes and the crc32 of its ids as little-endian unsigned 32-bit
integers. Rows in (part, segment) order hold documents in ascending order.
Written by Spark's own writer to a shared folder: lost tasks are redone, readers
see whole files.

A task holds the ids of two and a half segments (a document longer than ``SEGMENT``
ids is in one with at most as many before it) and the models of one group of
blocks: about 100 MB at most. The rest of a task is cut in segments of like size.

Defined cases: null text is empty and has the end id alone; null ids come first;
rows of equal id go by the text's MD5; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import shared_folder, stored
from talkloom.llm.token_counts import byte_symbols
from talkloom.operators.storage import forgotten

BLOCK, END = 2048, 2
#: The ids of a block after which its models learn.
RENEWALS = (96, 256, 640, 1280)
#: Blocks coded in step, less where their models would have more than PLACES entries; ids that close a segment (at the next document's end); chunks a worker keeps.
LANES, PLACES, SEGMENT, KEPT = 2048, 1 << 24, 1536 * 2048, 400_000
#: Ids of each block that are coded between tables; the models' slots for what followed.
STRIDE, SLOTS_LOG2 = 32, 11
MOST = max(j - i for i, j in itertools.pairwise((0, *RENEWALS, BLOCK)))
#: A chance's total; those of groups and of ids in a group; groups aimed at, and the most ids in one; sorts of blocks that the order of ids looks at.
ONE, HIGH, LOW, GROUPS, WIDEST, SORTS = 4096, 2048, 4096, 96, 2048, 8
#: The start's share of the groups' frequencies against STEP for an id, of which a quarter fades each time that models learn.
START, STEP, FADE = 1500, 24, 2
LOW_MASK, LEAST, U16, U35, U47 = np.uint64((1 << 63) - 1), np.uint64(1 << 47), np.uint64(16), np.uint64(35), np.uint64(47)
#: Eighths of powers of two, in which the header rounds frequencies.
POWER = np.array([round(2 ** (q / 8)) for q in range(256)], np.int64)
#: The first chances (of 65536) that a candidate is right, by how often it came in a row (0: there is none).
RIGHT = np.array([0, 600, 1400, 1760, 2120, 2480, 2840, 3200], np.int32) << 4


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch(p / 4096) and its inverse, scaled by 256."""
    stretch = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
    squash = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-3072, 3072)], np.int32)
    return stretch, squash


STRETCH, SQUASH = _tables()


class Start:
    """The order-0 model that blocks start from. Symbols are places in the alphabet, from 1 on, in groups of neighbours."""

    def __init__(self, alphabet: list[int] | np.ndarray, weights: bytes):
        m = max(1, len(alphabet))
        if m > (HIGH // 4) * WIDEST:
            raise ValueError(f"{m} different ids in a segment")
        self.alphabet, p = np.zeros(m + 1, np.int32), np.ones(m, np.int64)
        self.alphabet[1 : len(alphabet) + 1] = alphabet
        p[: len(weights)] = POWER[np.frombuffer(weights, np.uint8)]
        first, mass, share, before = [0], 0, max(1, int(p.sum()) // GROUPS), 0
        for k, x in enumerate(p.tolist()):  # a group ends where its share is full, and where the next sort of blocks begins
            if k > first[-1] and (mass + x // 2 > share or k - first[-1] == WIDEST or x > before):
                first.append(k)
                mass = 0
            mass += x
            before = x
        self.groups = n = len(first)
        size = np.diff([*first, m])
        self.group = np.concatenate([[0], np.repeat(np.arange(n), size)])
        high = np.add.reduceat(p, first)
        self.high = (1 + START * high // max(1, high.sum())).astype(np.int32)
        f = 1 + (LOW - np.repeat(size, size)) * p // np.repeat(high, size)
        f[first] += LOW - np.add.reduceat(f, first)
        end = np.cumsum(f)
        self.share = np.concatenate([[0], (end - f) % LOW << 16 | f])
        self.symbol = np.repeat(np.arange(1, m + 1, dtype=np.uint16 if m < 1 << 16 else np.int32), f)
        self.kind = np.int16 if m < 1 << 12 else np.int32  # of a symbol * 8 + 7
        at, mask = np.arange(m + 1), (1 << SLOTS_LOG2) - 1
        self.hashes = (at * 30011 >> 3 & mask) << 16 | at * 40503 >> 4 & mask

    @property
    def lanes(self) -> int:
        return max(16, min(LANES, PLACES // (HIGH + 2 * (1 << SLOTS_LOG2) + 2 * MOST + 3 * 128 + 4 * self.groups)))


def _sorts(rows: np.ndarray, m: int) -> np.ndarray:
    """Which of SORTS each id of 0 to m - 1 is most typical for, if blocks alike in their ids are of one sort."""
    all_ = (np.bincount(rows.ravel(), minlength=m) + 1.0).astype(np.float32)
    all_ /= all_.sum()
    typical = lambda n: np.log((n + 64 * all_) / (n.sum() + 64) / all_).astype(np.float32)
    scores = np.zeros((SORTS, len(rows)), np.float32)
    for k in range(1, SORTS):  # each from the block that those so far fit least
        worst = int(scores[:k].max(0).argmin()) if k > 1 else 0
        scores[k] = typical(np.bincount(rows[worst], minlength=m)).take(rows).sum(1)
    for again in (True, True, False):
        mine = scores.argmax(0)
        counts = [np.bincount(rows[mine == k].ravel(), minlength=m) for k in range(SORTS)]
        models = [typical(c) for c in counts]
        if again:
            scores = np.stack([x.take(rows).sum(1) for x in models])
    return np.argmax(models, 0)


def header(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ids by the sort of blocks that they are typical for and falling frequency, and their frequencies' logarithms in eighths."""
    c = np.bincount(ids)
    alphabet = np.argsort(-c, kind="stable")[: np.count_nonzero(c)]
    n = len(ids) // BLOCK
    if n > 2 * SORTS:
        place = np.zeros(len(c), np.int32)
        place[alphabet] = np.arange(len(alphabet))
        alphabet = alphabet[np.argsort(_sorts(place[ids[: n * BLOCK : 16]].reshape(n, -1), len(alphabet)), kind="stable")]
    return alphabet.astype(np.int32), bytes(min(255, round(8 * math.log2(x))) for x in c[alphabet].tolist())


class Mixer:
    """The models of many blocks, in step."""

    def __init__(self, lanes: int, start: Start):
        self.lanes, self.start, self.step, self.new = lanes, start, 0, 0
        lane, g = np.arange(lanes), start.groups
        self.group, self.states, self.places = lane * g, lane << 7, lane * HIGH
        self.base = np.stack([lane, lane + (lanes << SLOTS_LOG2)])  # of order 1 and of order 2, here as in all that follows; a slot's blocks are neighbours
        self.seen = np.zeros(2 * lanes << SLOTS_LOG2, start.kind)  # symbol * 8 + times in a row
        self.right = np.tile(RIGHT, (2, lanes, 1))
        self.weights = np.full((2, lanes), 1 << 15, np.int32)
        self.at, self.hash2 = self.base.copy(), np.zeros(lanes, np.int64)
        self.recent = np.zeros((lanes, g), np.int32)
        self.ids, self.was = np.zeros((2, MOST, lanes), np.int32)
        self.held = np.zeros((MOST, 2, lanes), bool)
        self.count()
        self.mix()

    def count(self) -> None:
        """The groups' frequencies, HIGH in all and none zero, what lies before each, and the group at each place."""
        n = self.start.groups
        count = self.start.high + self.recent
        f = (count * (((HIGH - n) << 14) // count.sum(-1, keepdims=True, dtype=np.int32)) >> 14) + 1
        f[:, 0] += HIGH - f.sum(-1, dtype=np.int32)
        self.freq = f
        self.share = ((np.cumsum(f, axis=-1) - f).astype(np.int64) << 16 | f).ravel()

    def at_places(self) -> np.ndarray:
        """The group at each of HIGH places."""
        return np.repeat(np.tile(np.arange(self.start.groups, dtype=np.uint8 if self.start.groups <= 256 else np.int16), self.lanes), self.freq.ravel())

    def mix(self) -> None:
        """The candidate's chance of ONE in each state: whether both orders name it, and how often each one's came in a row."""
        t1, t2 = STRETCH[self.right[0] >> 4][:, :, None], STRETCH[self.right[1] >> 4][:, None, :]
        t1[:, 0] = t2[:, :, 0] = 0
        s = np.empty((2, self.lanes, 2, 8, 8), np.int32)
        s[0, :, 1], s[1, :, 1] = t1, t2
        s[0, :, 0], s[1, :, 0] = -t1 >> 2, t2
        s[0, :, 0, :, 0] = t1[:, :, 0]
        self.stretched = s.reshape(2, self.lanes, 128)
        mixed = (self.weights[:, :, None] * self.stretched).sum(0, dtype=np.int32) >> 16
        chances = SQUASH[np.clip(mixed, -3072, 3071) + 3072]
        chances[:, 64] = 1  # there is no candidate
        self.chances = chances.astype(np.int16).ravel()

    def predict(self) -> np.ndarray:
        """The candidate (0: none); its state is ``state``."""
        self.e = e = self.seen.take(self.at)
        n = e & 7
        state = np.multiply((e[0] ^ e[1]) < 8, 64, dtype=e.dtype)
        state += n[0] << 3
        state += n[1]
        self.state = self.states + state
        return np.where(e[1] > 0, e[1], e[0]) >> 3

    def update(self, x: np.ndarray) -> None:
        """Learns the symbols that came."""
        k, came = self.new, (x << 3).astype(self.start.kind)
        self.seen[self.at] = self._after(self.e, came, self.held[k])
        self.ids[k], self.was[k] = x, self.state
        one = self.start.hashes.take(x)
        two = one >> 16
        one &= 0xFFFF
        np.multiply(one, self.lanes, out=self.at[0])
        one ^= self.hash2
        np.multiply(one, self.lanes, out=self.at[1])
        self.at += self.base
        self.hash2 = two
        self.step, self.new = self.step + 1, k + 1

    @staticmethod
    def _after(e: np.ndarray, came: np.ndarray, held: np.ndarray) -> np.ndarray:
        """What is kept instead of ``e``: the symbol that came, and its times in a row, 7 at most."""
        e = e ^ came  # below 8: it held
        np.less(e, 8, out=held)
        no = e - 8
        no >>= 8 * no.itemsize - 1  # all bits where it held
        np.minimum(e, 6, out=e)
        e &= no
        e += came
        e += 1
        return e

    def follow(self, part: np.ndarray) -> np.ndarray:
        """Learns known symbols, some for each block and not beyond where it renews: where the candidate was right."""
        n, k = len(part), self.new
        one = self.start.hashes.take(part)
        two = np.concatenate([self.hash2[None], one >> 16])
        one &= 0xFFFF
        at = np.empty((n + 1, 2, self.lanes), np.int64)
        at[0] = self.at
        np.multiply(one, self.lanes, out=at[1:, 0])
        one ^= two[:-1]
        np.multiply(one, self.lanes, out=at[1:, 1])
        at[1:] += self.base
        came, seen, after, held = (part << 3).astype(self.start.kind), self.seen, self._after, self.held[k : k + n]
        was = np.empty((n, 2, self.lanes), seen.dtype)
        for e, i, c, ok in zip(was, at, came, held, strict=False):
            seen.take(i, out=e, mode="clip")
            seen[i] = after(e, c, ok)
        self.at, self.hash2 = at[n].copy(), two[n]
        e1, e2 = was[:, 0], was[:, 1]
        state = np.multiply((e1 ^ e2) < 8, 64, dtype=e1.dtype)
        state += (e1 & 7) << 3
        state += e2 & 7
        self.ids[k : k + n] = part
        self.state = np.add(self.states, state, out=self.was[k : k + n], casting="same_kind")
        self.step, self.new = self.step + n, k + n
        second = e2 > 0
        return second & held[:, 1] | ~second & held[:, 0]

    def renew(self) -> None:
        """Learns frequencies, probabilities and weights from the ids since the last time."""
        n, g, new = self.lanes, self.start.groups, self.new
        self.new = 0
        self.recent += (np.bincount((self.start.group.take(self.ids[:new]) + self.group).ravel(), minlength=n * g) * STEP).astype(np.int32).reshape(n, g)
        self.count()
        self.recent -= self.recent >> FADE
        at = self.was[:new] << 2  # by state and which of the orders held
        at += self.held[:new, 0] * np.int8(2) + self.held[:new, 1]
        none, two, one, both = np.bincount(at.ravel(), minlength=n << 9).reshape(-1, 4).T
        held1, held2 = (one + both).reshape(n, 128), (two + both).reshape(n, 128)
        met = (none + two).reshape(n, 128) + held1
        for o, held in enumerate((held1, held2)):
            right, all_ = (x[:, :64].reshape(n, 8, 8) + x[:, 64:].reshape(n, 8, 8) for x in (held, met))
            right, all_ = ((x[:, :, 0:8:2] + x[:, :, 1:8:2]) if o == 0 else (x[:, 0:8:2] + x[:, 1:8:2]) for x in (right, all_))
            right, all_ = right.sum(2 - o), all_.sum(2 - o)
            self.right[o] = (self.right[o].astype(np.int64) * 32 + 65535 * right) // (32 + all_)
        held2[:, ::8] = held1[:, ::8]  # where only order 1 has a candidate
        err = held2 * ONE - met * self.chances.reshape(n, 128)
        err[:, 64] = 0
        for o in (0, 1):
            self.weights[o] = np.clip(self.weights[o] + ((self.stretched[o] * err).sum(1) >> 12), -(1 << 17), 1 << 17)
        self.mix()


def _encode(rows: np.ndarray, start: Start) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian words of each row of symbols, and how many of them count. Rows may end in padding."""
    n, lane = len(rows), np.arange(len(rows))
    m = Mixer(n, start)
    low, span = np.zeros(n, np.uint64), np.full(n, 1 << 63, np.uint64)
    out, pos = np.zeros((n, BLOCK), np.int32), np.ones(n, np.int64)
    for j in range(0, rows.shape[1], STRIDE):
        part = rows[:, j : j + STRIDE].T.astype(np.int64, order="C")
        hit = m.follow(part)
        c = m.chances.take(m.state).astype(np.int64)  # all else stands still: intervals are found at once
        at = start.group.take(part)
        at += m.group
        f, low_ = m.share.take(at), start.share.take(part)
        begin = f >> 16
        begin <<= 12
        f &= 0xFFFF
        begin += (low_ >> 16) * f
        low_ &= 0xFFFF
        f *= low_
        rest = ONE - c
        c <<= 23
        begin *= rest
        begin += c
        f *= rest
        begin[hit] = 0
        np.copyto(f, c, where=hit)
        begin, width = begin.view(np.uint64), f.view(np.uint64)
        if int(pos.max()) + 3 * STRIDE + 8 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        flat, line = out.ravel(), lane * out.shape[1]
        pos += line
        for b, w in zip(begin, width, strict=True):
            span >>= U35
            b *= span
            low += b  # the highest bit is the carry, and goes out with the next word
            span *= w
            short = (span < LEAST).nonzero()[0]
            while short.size:
                p, v, s = pos.take(short), low.take(short), span.take(short)
                flat[p] = v >> U47
                p += 1
                v <<= U16
                v &= LOW_MASK
                s <<= U16
                pos[short], low[short], span[short] = p, v, s
                short = short[s < LEAST]
        pos -= line
        if m.step in RENEWALS:
            m.renew()
    for _ in range(4):
        out[lane, pos] = low >> U47
        low = low << U16 & LOW_MASK
        pos += 1
    while (over := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += over[:, 1:]
    return out[:, 1:].astype(">u2"), pos - 1


def _like(n: int, most: int) -> int:
    """The size of the fewest groups of like size, ``most`` or fewer each, that hold ``n``."""
    return max(1, -(-n // max(1, -(-n // most))))


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray, bytes]:
    """Each block's payload, the crc32 of its ids, and the segment's header."""
    alphabet, weights = header(ids)
    start, place = Start(alphabet, weights), np.ones(int(ids.max(initial=0)) + 1, np.uint16 if len(alphabet) < 1 << 16 else np.int32)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    payloads, crcs = [], []
    lanes = _like(-(-len(ids) // BLOCK), start.lanes)
    for k in range(0, len(ids), BLOCK * lanes):
        part = ids[k : k + BLOCK * lanes]
        rows = np.ones((-(-len(part) // BLOCK), BLOCK), place.dtype)
        rows.ravel()[: len(part)] = place[part]
        words, size = _encode(rows[:, : min(BLOCK, len(part))], start)
        payloads += [words[i, :n].tobytes() for i, n in enumerate(size.tolist())]
        crcs += [zlib.crc32(part[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(part), BLOCK)]
    return payloads, crcs, alphabet, weights


def _decode(payloads: list[bytes], steps: int, start: Start) -> np.ndarray:
    """``steps`` symbols of each payload."""
    n, m = len(payloads), Mixer(len(payloads), start)
    width = max(map(len, payloads)) // 2 + 8
    words = np.zeros((n, width), ">u2")
    for i, p in enumerate(payloads):
        words[i, : len(p) // 2] = np.frombuffer(p, ">u2")
    bits = words.astype(np.uint16)  # the code starts with 63 bits: words come a bit late
    words = bits >> 1
    words[:, 1:] |= bits[:, :-1] << 15
    words = words.ravel()
    code, span, pos = np.zeros(n, np.uint64), np.full(n, 1 << 63, np.uint64), np.arange(n) * width
    for _ in range(4):
        code = code << U16 | words.take(pos)
        pos += 1
    out, top = np.zeros((steps, n), np.int32), np.uint64((1 << 35) - 1)
    for k in range(steps):
        if m.new == 0:
            places = m.at_places()
        cand = m.predict()
        c = m.chances.take(m.state).astype(np.int64)
        span >>= U35
        t = np.minimum(code // span, top).view(np.int64)
        rest = ONE - c
        c <<= 23
        t -= c
        hit = t < 0
        # quotients of whole numbers far below 2**53: floating point floors them exactly
        v = (np.maximum(t, 0) / rest).astype(np.int64)
        g = places.take((v >> 12) + m.places)
        share = m.share.take(m.group + g)
        f = share & 0xFFFF
        begin = share >> 16
        begin <<= 12
        v -= begin
        at = (v / f).astype(np.int64)
        at += g.astype(np.int64) << 12
        sym = start.symbol.take(at).astype(np.int64)
        share = start.share.take(sym)
        begin += (share >> 16) * f
        share &= 0xFFFF
        f *= share
        begin *= rest
        begin += c
        f *= rest
        begin[hit] = 0
        np.copyto(f, c, where=hit)
        np.copyto(sym, cand, where=hit)
        code -= span * begin.view(np.uint64)
        span *= f.view(np.uint64)
        short = (span < LEAST).nonzero()[0]
        while short.size:
            p, v, s = pos.take(short), code.take(short), span.take(short)
            v <<= U16
            v |= words.take(p, mode="clip")  # beyond the end in damaged payloads only
            p += 1
            s <<= U16
            pos[short], code[short], span[short] = p, v, s
            short = short[s < LEAST]
        out[k] = sym
        m.update(sym)
        if m.step in RENEWALS:
            m.renew()
    return out.T


def decode(payloads: list[bytes], total: int, crcs: list[int], alphabet: list[int] | np.ndarray, weights: bytes) -> np.ndarray:
    """The ids of a segment's blocks; raises if a checksum differs."""
    start, out = Start(alphabet, weights), np.zeros(total, np.int32)
    lanes = _like(len(payloads), start.lanes)
    for k in range(0, len(payloads), lanes):
        at = k * BLOCK
        part = out[at : at + lanes * BLOCK]
        part[:] = start.alphabet[_decode(payloads[k : k + lanes], min(BLOCK, len(part)), start)].ravel()[: len(part)]
    for i, want in enumerate(crcs):
        if zlib.crc32(out[BLOCK * i : BLOCK * (i + 1)].astype("<u4").tobytes()) != want:
            raise ValueError(f"block {i}: its checksum differs")
    return out


#: Unicode's White_Space, spelled out, and what str.split() takes besides.
_spaces = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Fixed value: the splitting pattern under which letters, and a run of other marks behind them, are pre-tokens.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PUNCTUATION = string.punctuation
BYTE_SYMBOLS = {k: x for k, x in enumerate(byte_symbols()) if x != byte_symbols()[32]}
#: Letters that neither normalising nor a neighbour changes, and whose lower case is one letter as long.
_LETTERS = [x for x in map(chr, [*range(0x1100), *range(0xAC00, 0xD7A4)]) if x.isalpha() and is_normalized("NFC", x) and x != "\u03a3" and len(x.lower()) == 1 and len(x.lower().encode()) == len(x.encode())]
LETTERS = "".join(x for x, y in zip(_LETTERS, pc.utf8_lower(pa.array(_LETTERS)).to_pylist(), strict=True) if y == x.lower())
#: Bytes of text that are cut in chunks at once, or a longer text.
SLICE = 1 << 23
_odd = re.compile("[\x1c-\x1f]")


def _runs(of: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of these beginnings and sizes, one after another."""
    end = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(end[-1], of.dtype)
    for k in range(0, len(size), 16_384):  # what a processor's cache holds
        i, j = end[k], end[min(k + 16_384, len(size))]
        at = np.repeat(first[k : k + 16_384] - end[k : min(k + 16_384, len(size))], size[k : k + 16_384])
        at += np.arange(i, j)
        of.take(at, out=out[i:j], mode="clip")
    return out


class Encoder:
    """The library's ids of whole texts; chunks between white space are encoded once and kept.

    Only for vocabularies whose pre-tokens never hold or look at white space, so
    that a text's ids are its chunks' ids; others are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.by_chunk = bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"] and "(?" not in split[0]["pattern"]["Regex"] and any(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.vocab = self.lib.get_vocab_size()
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.low = self.by_chunk and any(x.get("type") == "Lowercase" for x in spec["normalizer"]["normalizers"])
        self.low &= split[1:] == [] and spec["pre_tokenizer"]["pretokenizers"][1:] == [plain | {"trim_offsets": True}] and split[0]["pattern"]["Regex"] == LETTER_RUNS
        self.low &= all(re.search(r"[^\w\s]\w", x["content"]) for x in spec.get("added_tokens", []))  # none is in a word with marks behind it
        self.low &= spec["model"].get("end_of_word_suffix") == "</w>"
        self.plain = Tokenizer(self.lib.model)  # of words that are normal and cut already
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(1 + max(self.lib.get_vocab().values(), default=0), bool)
        self.last[[i for w, i in self.lib.get_vocab().items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Keeps words that came again, if they are few, with half of how often that was; other chunks go."""
        keep = np.flatnonzero(self.times > 1) if hasattr(self, "times") else np.zeros(0, np.int64)
        if not 0 < len(keep) <= KEPT // 2:
            self.words, self.slot, self.times = pa.array([], pa.large_string()), *np.zeros((2, 0), np.int64)
            keep = self.slot
        ids, size = (self._gather(self.slot[keep]), self.size[self.slot[keep]]) if len(keep) else (np.zeros(0, np.int32), keep)
        self.words, self.times = self.words.take(pa.array(keep)), self.times[keep] >> 1
        self.ids, self.first, self.size, self.used, self.slots = np.zeros(1 << 16, np.int32), *np.zeros((2, 1 << 16), np.int64), 0, 1  # the slot 0 is of nothing
        self.known: dict[str, int] = {"": 0}
        self.slot = self._keep(ids, size)

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of these chunks, one after another."""
        return _runs(self.ids, self.first.take(slots), self.size.take(slots))

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New slots for chunks of these sizes, whose ids follow one another."""
        n, k = self.used + len(ids), self.slots + len(size)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(n, np.int32)])
        if k > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(k, np.int64)]) for x in (self.first, self.size))
        self.ids[self.used : n] = ids
        self.size[self.slots : k] = size
        self.first[self.slots : k] = self.used + np.cumsum(size) - size
        new = np.arange(self.slots, k)
        self.used, self.slots = n, k
        return new

    def _words(self, found: pa.Array, times: np.ndarray) -> np.ndarray:
        """Slots of different lower-case words of LETTERS: the library's model alone knows their ids."""
        at = pc.index_in(found, value_set=self.words)
        if len(self.words) + at.null_count > KEPT:
            self._forget()
            at = pc.index_in(found, value_set=self.words)
        if at.null_count:
            new = found.filter(at.is_null())
            cuts = pa.array([*range(0, len(new), 64), len(new)], pa.int32())
            lines = pc.binary_join(pa.ListArray.from_arrays(cuts, new.cast(pa.string())), " ").to_pylist()
            lines = [x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_SYMBOLS) for x in lines]
            got = [x.ids for i in range(0, len(lines), 256) for x in self.plain.encode_batch_fast(lines[i : i + 256], add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(got), np.int32, sum(map(len, got)))
            size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(size) != len(new) or size.sum() != len(ids):
                raise ValueError("the vocabulary lacks an end of a word")
            known = len(self.words)
            self.words, self.slot = pa.concat_arrays([self.words, new]), np.concatenate([self.slot, self._keep(ids, size)])
            self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
            where = at.fill_null(0).to_numpy().astype(np.int64)
            where[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(known, len(self.words))
        else:
            where = at.to_numpy().astype(np.int64)
        self.times[where] += times
        return self.slot[where]

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        """Slots of any chunks, as the library encodes them."""
        new = [x for x in dict.fromkeys(chunks) if x not in self.known]
        got = [x.ids for x in self.lib.encode_batch_fast(new, add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        self.known.update(zip(new, self._keep(np.fromiter(itertools.chain.from_iterable(got), np.int32, int(size.sum())), size).tolist(), strict=True))
        return np.array([self.known[x] for x in chunks], np.int64)

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Each text's chunks between white space. Arrow and Python know the same, which is four characters more than the library's."""
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        if ((raw - np.uint8(0x1C)) < 4).any() and any(_odd.search(t) for t in texts.to_pylist()):
            return pa.array([[x for x in _spaces.split(t) if x] for t in texts.to_pylist()], pa.list_(pa.large_string()))
        return pc.utf8_split_whitespace(texts)

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text.

        A chunk of letters, with or without a run of ASCII punctuation behind it,
        is one pre-token or two: its letters go straight to the library's model.
        All other chunks take the library's whole way.
        """
        cut = self._cut(texts)
        bounds, found = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        chunks, at = found.dictionary, found.indices.to_numpy()
        times = np.bincount(at, minlength=len(chunks))
        slots = np.zeros((len(chunks), 2), np.int64)
        if len(self.known) > KEPT // 4:
            self._forget()
        rest = np.ones(len(chunks), bool)
        if self.low:
            tails = pc.utf8_ltrim(chunks, LETTERS)
            plain = pc.and_(pc.equal(pc.utf8_ltrim(tails, PUNCTUATION), ""), pc.less(pc.binary_length(tails), pc.binary_length(chunks)))
            rest = ~plain.to_numpy(zero_copy_only=False)
            heads = pc.utf8_lower(pc.utf8_rtrim(chunks.filter(plain), PUNCTUATION)).dictionary_encode()
            tails = tails.filter(plain).dictionary_encode()
            own = heads.indices.to_numpy()
            slots[~rest, 0] = self._words(heads.dictionary, np.bincount(own, times[~rest], len(heads.dictionary)).astype(np.int64)).take(own)
            slots[~rest, 1] = self._chunks(tails.dictionary.to_pylist()).take(tails.indices.to_numpy())
        slots[rest, 0] = self._chunks(chunks.filter(pa.array(rest)).to_pylist())
        size = self.size[slots].sum(1)
        first, own = np.cumsum(size) - size, size.take(at)
        ids = _runs(self._gather(slots.ravel()), first.take(at), own)
        ends = np.concatenate([[0], np.cumsum(own)])[bounds].tolist()
        return [ids[i:j] for i, j in itertools.pairwise(ends)]

    def slices(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of each text, for some texts at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE
        for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]):
            if i < j and self.by_chunk:
                yield self._encode(pa.concat_arrays([texts.slice(i, j - i)]))
            elif i < j:
                yield [np.array(x.ids, np.int32) for x in self.lib.encode_batch_fast(texts.slice(i, j - i).to_pylist(), add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        return [x for found in self.slices(pa.array(texts, pa.large_string())) for x in found]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def written(docs: DataFrame, path: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> str:
    """Writes the token files of ``docs`` to ``path``."""
    kind = docs.schema[id_col].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("part", long), T.StructField("segment", long), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(long)), T.StructField("alphabet", T.ArrayType(T.IntegerType())), T.StructField("weights", T.BinaryType()), T.StructField("sizes", T.ArrayType(long)), T.StructField("crcs", T.ArrayType(long)), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, enc = to_arrow_schema(schema), encoder(vocab)
        names, ids, size, part, segment = [], [], 0, 0, 0

        def closed(most: int) -> pa.RecordBatch:
            """The first documents that have ``most`` ids, as a segment."""
            nonlocal size, segment
            n = 1 + int(np.searchsorted(np.cumsum([len(x) for x in ids]), most))
            own, whose = ids[:n], names[:n]
            pa.default_memory_pool().release_unused()
            del ids[:n], names[:n]
            payloads, crcs, alphabet, weights = encode(np.concatenate(own))
            row = [[part], [segment], [whose], [[len(x) for x in own]], [alphabet], [weights], [[len(x) for x in payloads]], [crcs], [b"".join(payloads)]]
            size, segment = size - sum(map(len, own)), segment + 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, kinds, strict=True)], schema=kinds)

        for b in batches:
            if b.num_rows:
                part, whose = b.column(2)[0].as_py(), iter(b.column(0).to_pylist())
            for found in enc.slices(b.column(1)):
                for x, name in zip(found, whose, strict=False):
                    names.append(name)
                    ids.append(np.append(x, end).astype(np.uint16 if enc.vocab <= 1 << 16 else np.int32))
                    size += len(ids[-1])
                while size >= SEGMENT * 5 // 2:
                    yield closed(SEGMENT)
        for k in range(max(1, round(size / SEGMENT)), 0, -1):  # the rest in like parts
            if names:
                yield closed(-(-size // k))

    tied = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"digest": F.md5(F.col("text").cast("binary")), "tie": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("id", "digest", "tie")]  # rows of one id, even equal ones, fill as many files as they need
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, segment, place, doc_id, ids`` (binary, little-endian unsigned 32-bit): a row for each document."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                cuts = np.cumsum([0, *row["sizes"]]).tolist()
                payloads = [row["payload"][i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                raw = decode(payloads, sum(row["lengths"]), row["crcs"], row["alphabet"], row["weights"]).astype("<u4").tobytes()
                ends = 4 * np.cumsum([0, *row["lengths"]])
                n = len(row["doc_ids"])
                for k in range(0, n, 2000):
                    m = min(n, k + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * (m - k)), pa.array([row["segment"]] * (m - k)), pa.array(range(k, m), pa.int64()), pa.array(row["doc_ids"][k:m], b.schema.field("doc_ids").type.value_type), pa.Array.from_buffers(pa.binary(), m - k, [None, *map(pa.py_buffer, ((ends[k : m + 1] - ends[k]).astype(np.int32), raw[ends[k] : ends[m]]))])],
                        ["part", "segment", "place", "doc_id", "ids"],
                    )

    return files.select("part", "segment", "doc_ids", "lengths", "alphabet", "weights", "sizes", "crcs", "payload").mapInArrow(run, f"part long, segment long, place long, doc_id {kind}, ids binary")


def index(spark: SparkSession, path: str) -> DataFrame:
    """``part, segment, before``: the ids in all segments before each; a row for each segment, no payload is read."""
    own = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    segments = spark.read.parquet(path).select("part", "segment", own.alias("own"))
    parts = segments.groupBy("part").agg(F.sum("own").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row for each file
    inside = segments.select("part", "segment", (F.sum("own").over(Window.partitionBy("part").orderBy("segment")) - F.col("own")).alias("inside"))
    return inside.join(before, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("before"))


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32. Files without a ``path`` go when they have been read."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
        found = stored(round_trip(docs, vocab, id_col, text_col, path), "token-rows")
        forgotten(spark.read.parquet(path))
        return found
    written(docs, path, vocab, id_col, text_col)
    rows = read(spark, path).select("part", "segment", "place", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    earlier = F.sum("n_tokens").over(Window.partitionBy("part", "segment").orderBy("place")) - F.col("n_tokens")  # a segment is one file row
    rows = rows.withColumn("inside", earlier).join(index(spark, path), ["part", "segment"])
    return rows.select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
