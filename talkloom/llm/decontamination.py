"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

Texts are normalised (A-Z lower-cased, words of letters, digits and all
characters beyond ASCII) byte for byte, so that every normalised word keeps its
place in the original. The automaton's alphabet is the benchmark's own words:
each gets one code point and every other word one common code point, so a text
is scanned once, word by word, and the automaton has at most ten nodes for each
benchmark word. The documents are never shuffled.

The benchmark is broadcast in slices of ``slice_bytes`` of text (1 MB: about 100
MB of automaton in a worker), packed. A worker holds one slice's automaton at a
time: of a larger benchmark, all slices scan the same ``HELD`` bytes of texts in
turn, and their hits meet in the text's own words. Nothing is joined, so a
document needs no id, and no size is refused or cut. All slices stay broadcast,
packed, until the rows are read: some 0.4 MB for each MB of benchmark text on the
driver and on each executor, so that a benchmark of 1 GB takes 0.4 GB there, and
each text is scanned once for each slice.

Defined cases: null or wordless text has no words and no hits; null or wordless
items have no windows; repeated documents are reported as often as they come,
each with its own hits; a repeated item id is one item with all its texts; kept
columns named like the results give way to them.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
#: Bytes that separate words, after bytes.lower(): all ASCII but digits and a-z.
BLANKED = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FIRST_CODE = 0x10000
HELD = 64 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def normalised(text: str | None) -> bytes:
    """Same length as the text's UTF-8, separators as spaces."""
    return (text or "").encode("utf-8", "replace").lower().translate(BLANKED)


class Scanner:
    """The automaton of some items; finds their windows in whole texts."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        self.items = [x[0] for x in items]
        self.automaton, self.owners = ahocorasick.Automaton(), []
        at: dict[str, int] = {}
        for k, (_, text) in enumerate(items):
            words = normalised(text).split()
            coded = "".join([self.codes.setdefault(w, chr(FIRST_CODE + len(self.codes))) for w in words])
            for i in range(max(1, len(words) - window + 1) if words else 0):
                key = coded[i : i + window]
                if key not in at:
                    at[key] = len(self.owners)
                    self.owners.append((len(key), set()))
                self.owners[at[key]][1].add(k)
        for key, n in at.items():
            self.automaton.add_word(key, n)
        if at:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, list, bytes]:
        """Number of words, which words are hit (None: none), the items hit, the normalised text."""
        plain = normalised(text)
        words = plain.split()
        if self.automaton is None or not words:
            return len(words), None, [], plain
        get = self.codes.get
        found = list(self.automaton.iter("".join([get(w, "\0") for w in words])))
        if not found:
            return len(words), None, [], plain
        edge = np.zeros(len(words) + 1, np.int64)
        hit = set()
        for end, n in found:
            k, owners = self.owners[n]
            edge[end - k + 1] += 1
            edge[end + 1] -= 1
            hit |= owners
        return len(words), np.cumsum(edge)[:-1] > 0, [self.items[k] for k in sorted(hit)], plain


def spans(plain: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets of the original text."""
    b = np.frombuffer(b" " + plain + b" ", np.uint8)
    blank = b == 32
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    chars = np.concatenate([[0], np.cumsum((b[1:-1] & 0xC0) != 0x80)])
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(chars[starts[i]]), "end": int(chars[ends[j - 1]])} for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


#: The worker's last scanner, by the digest of its items and the window.
_LAST: dict[tuple[str, int], Scanner] = {}


def _scanner(key: str, window: int, shared: Broadcast) -> Scanner:
    if (key, window) not in _LAST:
        _LAST.clear()
        _LAST[key, window] = Scanner(pickle.loads(zlib.decompress(shared.value)), window)
    return _LAST[key, window]


def _scanned(docs: DataFrame, slices: list[tuple[str, Broadcast]], window: int, item_type: T.DataType, columns: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", SPANS)])
    place = columns.index(text_col) if text_col in columns else len(columns)

    def scanned(held: list[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[int, int], int] = {}
        hits: dict[tuple[int, int], np.ndarray] = {}
        items: dict[tuple[int, int], set] = {}
        for key, shared in sorted(slices, key=lambda x: (x[0], window) not in _LAST):  # the worker's last scanner first
            scanner = _scanner(key, window, shared)
            for n, b in enumerate(held):
                for i, text in enumerate(b.column(place)):
                    words[n, i], hit, found, _ = scanner.scan(text.as_py())
                    if hit is not None:
                        hits[n, i] = hits[n, i] | hit if (n, i) in hits else hit
                        items.setdefault((n, i), set()).update(found)
        for n, b in enumerate(held):
            at = [(n, i) for i in range(b.num_rows)]
            told = (
                [words[x] for x in at], [int(hits[x].sum()) if x in hits else 0 for x in at], [sorted(items.get(x, ()), key=str) for x in at],
                [spans(normalised(b.column(place)[x[1]].as_py()), hits[x]) if x in hits else [] for x in at],
            )
            new = [pa.array(x, kinds.field(len(columns) + i).type) for i, x in enumerate(told)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *new], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held, size = to_arrow_schema(schema), [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(slices) == 1 or size >= HELD:
                yield from scanned(held, kinds)
                held, size = [], 0
        if held:
            yield from scanned(held, kinds)

    return docs.select(*columns, *([] if text_col in columns else [text_col])).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = 1_000_000, keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (or the ``keep`` columns), n_words, n_hit, items (the item ids hit), spans.

    ``spans`` are the runs of hit words, as character offsets [start, end) of the original.
    """
    spark = docs.sparkSession
    columns = [c for c in keep or [id_col] if c.lower() not in ("n_words", "n_hit", "items", "spans")]
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    slices = max(1, math.ceil(total / slice_bytes))
    shared = []
    for k in range(slices):
        part = benchmark if slices == 1 else benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(slices)) == k)
        rows = sorted(((r[0], r[1]) for r in part.select(item_col, item_text).collect()), key=str)
        key = hashlib.sha256(repr(rows).encode("utf-8", "replace")).hexdigest()
        shared.append((key, spark.sparkContext.broadcast(zlib.compress(pickle.dumps(rows)))))
    return _scanned(docs, shared, window, benchmark.schema[item_col].dataType, columns, text_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`contamination`."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT k FROM win
), grams AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE len(ws) >= k)
), hits AS (SELECT doc_id, item_id, k, i FROM grams JOIN win USING (k, g)
), cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
