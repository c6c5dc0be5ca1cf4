"""The training-data operators against SQL, brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkloom.llm import chat_format, decontamination, embedding_dedup, html_text, language_id, mixing, queries, simhash, token_counts, token_files, toxicity
from talkloom.operators.components import components
from tests.support import SF, difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "a", "ÄÖ ß é", "the " * 3000, "<|endoftext|> x", "a" * 3000, "\x1c x \x85y"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""


def noise(n, seed, alphabet="aab cdE's'  \n\t\r\x0b\x1c\x85\xa0ßéñ漢½²Ⅷ٣12!?%-Σ"):
    r = random.Random(seed)
    return ["".join(r.choice([*alphabet, "<|endoftext|>", "the ", "ing"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark):
    texts = ODD + noise(1500, 1)
    want = [len(x.ids) for x in Tokenizer.from_file(BYTE_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), BYTE_BPE).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 1024) for i, t in enumerate(texts))
    assert token_counts.token_counts(docs(spark, []), BYTE_BPE).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 49407) | st.sampled_from([0, 1, 2, 49407]), max_size=300), st.integers(0, 3))
def test_coder_round_trip(ids, times):
    x = np.array(ids * (1 + 10 * times), np.int32)
    payloads, crcs, *head = token_files.encode(x)
    assert (token_files.decode(payloads, len(x), crcs, *head) == x).all()


def test_coder_detects_damage_and_decodes_blocks_alone():
    x = np.random.default_rng(1).integers(0, 900, 3 * token_files.BLOCK).astype(np.int32)
    payloads, crcs, *head = token_files.encode(x)
    assert (token_files.decode(payloads[1:2], token_files.BLOCK, crcs[1:2], *head) == x[token_files.BLOCK : 2 * token_files.BLOCK]).all()
    bad = [payloads[0][:50] + bytes([payloads[0][50] ^ 1]) + payloads[0][51:], *payloads[1:]]
    with pytest.raises(ValueError, match="block 0"):
        token_files.decode(bad, len(x), crcs, *head)


def test_coder_in_groups_of_blocks_and_of_a_wide_alphabet(monkeypatch):
    monkeypatch.setattr(token_files, "PLACES", 1 << 17)
    x = np.concatenate([np.random.default_rng(2).integers(0, 49_408, 40 * token_files.BLOCK), np.zeros(3000), np.arange(49_408)]).astype(np.int32)
    payloads, crcs, *head = token_files.encode(x)
    assert token_files.Start(*head).lanes == 16 < len(payloads)
    assert (token_files.decode(payloads, len(x), crcs, *head) == x).all()


def test_coder_beats_the_ids_own_entropy(spark):
    """With its header, on the ids of a whole table: less than order 0 knows of them, and than zlib makes of them."""
    enc = token_files.Encoder(WORD_BPE)
    ids = np.concatenate([np.append(x, 2) for x in enc.encode([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()])]).astype(np.int32)
    payloads, _, alphabet, weights = token_files.encode(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    size = sum(map(len, payloads)) + 2 * len(alphabet) + len(weights)
    assert 8 * size < 0.97 * len(ids) * -(share * np.log2(share)).sum()
    assert size < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_token_files_read_back(spark):
    lib, texts = Tokenizer.from_file(WORD_BPE), ODD + noise(300, 2)
    rows = token_files.round_trip(docs(spark, texts).withColumn("start", F.lit(1)), WORD_BPE).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(docs(spark, []), WORD_BPE).count() == 0


def test_token_files_deal_out_rows_of_one_id(spark, tmp_path):
    """A third of all rows without an id, many of them equal: no file holds more than its share, and nothing is lost."""
    rows = [(i if i % 3 else None, f"text {i % 50} of many" if i % 2 else "the same text", "en", "s", 0) for i in range(12_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_files.written(spark.createDataFrame(rows, DOCS).repartition(5), str(tmp_path / "t"), WORD_BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[1] for r in spark.read.parquet(path).groupBy("part").agg(F.sum(F.size("doc_ids"))).collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 12_000 / len(sizes) and sum(sizes) == 12_000
    found = token_files.round_trip(spark.createDataFrame(rows, DOCS), WORD_BPE).collect()
    assert min(r.start for r in found if r.doc_id is None) == 0 and len({r.start for r in found}) == 12_000


def test_added_tokens_are_found_in_the_raw_text_only():
    lib = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "A <|endoftext|> B <|STARTOFTEXT|>x", "Ab<|endoftext|>Cd Ef", "PLAIN Text", "<|ENDOFTEXT|", "Éa<|startoftext|>"]
    got = token_files.Encoder(WORD_BPE).encode([*texts, *texts[::-1]])
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in [*texts, *texts[::-1]]]


def test_encoder_is_the_librarys_on_letters_of_any_script():
    """Words with marks behind them, capitals, final sigmas, letters that change when normalised, contractions and spaces of all kinds."""
    lib = Tokenizer.from_file(WORD_BPE)
    letters = [chr(i) for i in [*range(33, 0x1200), *range(0x1E00, 0x2100), *range(0x3041, 0x3100), *range(0xAC00, 0xAC40), *range(0xFB00, 0xFB50)]]
    texts = [" ".join(f"{x}a{x}{'!' * (k % 3)}" for k, x in enumerate(letters[i : i + 50])) for i in range(0, len(letters), 50)]
    texts += ["DON'T we'll o'Re rock'n'roll dogs' ''s", "ΟΔΥΣΣΕΥΣ Σ ΑΣ.", "e\u0301te\u0301 \u1100\u1161 İstanbul ſ ﬁn", "a\x1cb c\x85d\u2003e\u2028f", "", " ", "x" * 5000 + "...", "1st 22nd a1 $$$ ...!"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    enc = token_files.Encoder(WORD_BPE)
    for _ in range(2):  # found new, and known
        assert [x.tolist() for x in enc.encode(texts)] == want
    assert [x.tolist() for t in texts for x in enc.encode([t])] == want


def test_encoder_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 400)
    monkeypatch.setattr(token_files, "SLICE", 3000)
    lib, enc = Tokenizer.from_file(WORD_BPE), token_files.Encoder(WORD_BPE)
    texts = [" ".join(f"{w}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}," for k in range(i, i + 60) for w in ("Word", "an")) for i in range(0, 900, 30)] * 2
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.words) <= 400


def test_token_files_cost_of_an_id():
    """Ids of whole texts made, coded and decoded: CPU microseconds each, on a machine that sums a million numbers in 24 ms. It took 1.5 once."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()[:2200]
    best = []
    for _ in range(3):
        enc = token_files.Encoder(WORD_BPE)
        began = time.process_time()
        sum(range(1_000_000))
        spin = (time.process_time() - began) / 0.024
        began = time.process_time()
        ids = np.concatenate([np.append(x, 2) for x in enc.encode(texts)]).astype(np.int32)
        payloads, crcs, *head = token_files.encode(ids)
        assert (token_files.decode(payloads, len(ids), crcs, *head) == ids).all()
        best.append((time.process_time() - began) / len(ids) * 1e6 / spin)
    assert min(best) < 0.9, best


def classes(fps):
    """Smallest id reachable over links of at most two differing bits."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps.items(), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(["alpha", "beta", "Gamma", "ß", "x"]) + str(r.randint(0, 50)) for _ in range(120)) for _ in range(6)]
    near = [b.replace("x", "y", k) for b in base for k in range(6)]
    texts = ODD + base + near + base
    got = {x.doc_id: x for x in simhash.groups(docs(spark, texts), most=3).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x.component_id for i, x in got.items()} == classes(fps)
    kept = simhash.deduplicated(docs(spark, texts).union(docs(spark, texts[:3])))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(classes(fps).values()))
    assert simhash.groups(docs(spark, [])).count() == 0


def test_simhash_keeps_every_text_of_a_repeated_id(spark):
    """Two texts under one id, in either order, and ids that are null; columns named like the operator's own."""
    base, other = "one long text that says the same thing as the next one does " * 9, "something else altogether is told here by many other words " * 9
    rows = [(3, base), (5, base), (5, other), (None, other), (None, "null ids only, told twice and kept once " * 5), (None, "null ids only, told twice and kept once " * 5), (9, None), (8, " "), (None, "")]
    want = sorted([(3, base), (5, other), (None, rows[4][1]), (8, " ")], key=str)
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in some], DOCS).repartition(3)
        d = d.withColumns({c: F.lit("mine") for c in ("fp", "row_hash", "component", "Kept_Id", "kept_row", "kept_hash", "rows", "id")})
        kept = simhash.deduplicated(d)
        assert kept.columns == d.columns and kept.where("fp <> 'mine' OR row_hash <> 'mine'").count() == 0
        assert sorted([(x.doc_id, x.text) for x in kept.collect()], key=str) == want


@pytest.mark.parametrize(("parts", "most"), [(2, 3), (3, 1000), (4, 3)])
def test_simhash_links_lose_nothing(spark, parts, most):
    r, fps = random.Random(parts), {}
    for _ in range(12):
        seed = r.getrandbits(64)
        for _ in range(25):
            x = seed
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps[len(fps)] = x
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fps.items()}
    d = spark.createDataFrame([(x, i) for i, x in signed.items()], "fp long, i long").groupBy("fp").agg(F.min("i").alias("least"))
    groups, chosen = simhash.plan(d, choices=(parts,))
    assert sum(chosen) == 2 - parts + 1
    c = components(simhash.links(d, groups, chosen, most)).join(d.withColumnRenamed("fp", "node"), "node")
    named = {x.node: x.s for x in c.join(c.groupBy("component").agg(F.min("least").alias("s")), "component").collect()}
    first = {x.fp: x.least for x in d.collect()}
    assert {i: named.get(x, first[x]) for i, x in signed.items()} == classes(fps)


def test_decontamination_slices_agree_and_spans_are_of_the_original(spark):
    d, b = table(spark, "documents"), table(spark, "benchmark")
    one = decontamination.contamination(d, b)
    many = decontamination.contamination(d, b, slice_bytes=1500)
    assert sorted(map(tuple, decontamination.report(one).collect())) == sorted(map(tuple, decontamination.report(many).collect()))
    item = spark.createDataFrame([(1, "Ünï one TWO three"), (2, None), (3, " , "), (4, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    text = "é: ünï, ONE two-three! " + " ".join(f"W{i}" for i in range(1, 11)) + " end"
    r = decontamination.contamination(docs(spark, [text, None, ""]).withColumn("items", F.lit("x")), item, keep=["doc_id", "items"]).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].n_hit, r[0].items) == (16, 10, [4])  # ASCII folding leaves the capital Ü of item 1 another word
    assert [text[s.start : s.end] for s in r[0].spans] == [" ".join(f"W{i}" for i in range(1, 11))]
    assert [x.n_words for x in r[1:]] == [0, 0]
    assert decontamination.contamination(docs(spark, ["a b"]), item.limit(0)).first().n_hit == 0


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 40}])
def test_decontamination_of_null_and_repeated_ids(spark, how):
    items = [(k, " ".join(f"i{k}w{n}" for n in range(10))) for k in range(4)]
    b = spark.createDataFrame([*items, items[1], (2, "another text of item two")], "item_id long, text string")
    rows = [(None, items[0][1]), (7, f"x {items[1][1]}"), (7, "clean"), (None, f"{items[2][1]} y another text of item two"), (8, f"{items[1][1]} {items[3][1]}")]
    d = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], DOCS)
    got = decontamination.contamination(d, b, keep=["n_chars", "doc_id"], **how).orderBy("n_chars").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got] == [(None, 10, 10, [0]), (7, 11, 10, [1]), (7, 1, 0, []), (None, 16, 15, [2]), (8, 20, 20, [1, 3])]
    assert [[tuple(s) for s in r.spans] for r in got] == [[(0, 49)], [(2, 51)], [], [(0, 49), (52, 76)], [(0, 99)]]


def test_embeddings_planted_clusters(spark):
    g = np.random.default_rng(3)
    v = [c + g.normal(0, 0.25 * abs(g.normal()), 16) for c in g.normal(size=(12, 16)) for _ in range(15)]
    rows = [(i, [float(np.float32(y)) for y in x], i % 2) for i, x in enumerate(v)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [1.0, None], 0), (1005, rows[0][1], None), (1006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0))
    x = {i: np.array(e, float) for i, e, lab in rows if e and None not in e and np.isfinite(e).all() and any(e) and lab is not None}
    lab, near = {i: k for i, _, k in rows}, {i: set() for i, *_ in rows}
    for i, j in itertools.combinations(x, 2):
        if lab[i] == lab[j] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93:
            near[i].add(j)
            near[j].add(i)
    root = {i: i for i in near}
    for _ in near:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in near}
    for how in ({}, {"cell_rows": 16, "block_rows": 8}, {"block_rows": 7}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, **how).collect()}
        assert got == {i: (len(near[i]), root[i], root[i] == i) for i in near}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_a_large_label_lose_no_pair(spark):
    """17,000 distinct vectors of a label; random hyperplanes (those of one bit of 8 dimensions) part the planted pairs in every table."""
    g = np.random.default_rng(5)
    planes = np.random.default_rng([embedding_dedup.SEED, 8, 1]).standard_normal((5, 1, 8))[:, 0]
    pairs = []
    while len(pairs) < 4:
        u, w = g.normal(size=(2, 200_000, 8))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w -= (w * u).sum(1)[:, None] * u
        v = 0.9302 * u + np.sqrt(1 - 0.9302**2) * w / np.linalg.norm(w, axis=1)[:, None]
        pairs += [(u[k], v[k]) for k in np.flatnonzero(((u @ planes.T >= 0) != (v @ planes.T >= 0)).all(1))]
    x = np.concatenate([g.normal(size=(17_000, 8)), np.array(pairs).reshape(-1, 8)])
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    y, want = x / np.linalg.norm(x, axis=1)[:, None], []
    for k in range(0, len(y), 1000):
        want += ((y[k : k + 1000] @ y.T >= 0.93).sum(1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == want and sum(want[17_000:]) >= 8


def test_embedding_codes_estimate_without_bias():
    """Estimates from codes, factors and planes, rebuilt plainly: right on average, and inside the bound."""
    g, d = np.random.default_rng(9), 64
    u, w = g.normal(size=(2, 4000, d))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    c = g.uniform(-0.2, 0.99, 4000)
    v = c[:, None] * u + np.sqrt(1 - c**2)[:, None] * w / np.linalg.norm(w, axis=1)[:, None]
    a, b = embedding_dedup.coded(u), embedding_dedup.coded(v)
    signs = 2.0 * np.unpackbits(a.code.view(np.uint8), axis=1)[:, :d] - 1
    numbers = sum(np.unpackbits(b.planes[:, k].copy().view(np.uint8), axis=1)[:, :d].astype(int) << k for k in range(embedding_dedup.PLANES))
    got = (signs * b.step[:, None] * (numbers - (2**embedding_dedup.PLANES - 1) / 2)).sum(1) / math.sqrt(d) / a.factor
    bound = embedding_dedup.EPS * np.sqrt((1 - c**2) * (1 - a.factor**2) / (d - 1)) / a.factor + b.off / a.factor
    assert (np.abs(got - c) <= bound).all() and abs((got - c).mean()) < 0.005
    i, j = embedding_dedup.candidates(a, b, d, 0.93)
    assert set(np.flatnonzero(c >= 0.93)) <= set(i[i == j]) and len(i) < 0.01 * 4000**2


def test_embeddings_query_with_planted_links_matches_sql(spark, tmp_path):
    """The given vectors with near copies of a third of them, of 64 dimensions, so that there is something to link."""
    v, g = table(spark, "embeddings").collect(), np.random.default_rng(4)
    rows = [tuple(r) for r in v]
    for k, r in enumerate(v[:60]):
        x = np.array(r.embedding, float)
        rows += [(10_000 + 4 * k + m, (x + g.normal(0, s * np.linalg.norm(x) / 8, len(x))).tolist(), r.label) for m, s in enumerate((0.1, 0.3, 0.41, 0.5))]
    spark.createDataFrame(rows, table(spark, "embeddings").schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op3_embedding_dedup"](spark, str(tmp_path))
    assert got.where("n_links > 0").count() > 150 and difference(got, embedding_dedup.ORACLE, str(tmp_path)) == ""


def test_embeddings_of_extreme_size_link(spark):
    rows = [(1, [1e160, 0.0], 0), (2, [1e160, 1e150], 0), (3, [1e-160, 0.0], 0), (4, [0.0, 5e-324], 0), (5, [0.0, 1.0], 0), (6, [float("inf"), 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_mixing_meets_targets(spark):
    d = table(spark, "documents")
    rows = mixing.mixed(d.withColumn("weight", F.lit(0))).collect()
    again = mixing.mixed(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    odd = spark.createDataFrame([(1, None, "en", None, 0), (2, "a b", "en", None, 0), (None, "c", None, "s", 0), (2, "a b", "en", None, 0), (3, "", "en", "t", 0)], DOCS)
    assert mixing.mixed(odd).count() == 5 and mixing.mixed(odd.limit(0)).count() == 0
    clash = odd.withColumns({c: F.lit("mine") for c in ("row_hash", "Mixed_Times", "mixed_id", "mixed_hash", "mixed_rows", "mixed_row", "size", "tie", "passed")})
    for d in (odd, clash):
        taken = mixing.take(d)
        assert taken.columns == d.columns and mixing.take(d.limit(0)).count() == 0
        assert sorted(map(str, taken.select(*odd.columns).collect())) == sorted(map(str, mixing.take(odd).collect()))
    assert taken.where("row_hash <> 'mine' OR mixed_times <> 'mine'").count() == 0


def test_mixing_takes_rows_of_null_and_repeated_ids(spark):
    """Each row is taken by itself: rows of one id, or of none, do not share their luck."""
    r = random.Random(3)
    rows = [(None if k % 3 == 0 else k % 7 if k % 3 == 1 else k, " ".join("w" * r.randint(1, 9)) + f" u{k // 2}", "en", "ab"[k % 2], k // 2) for k in range(600)]
    rows += [(None, "the same row of ten words in all its columns ok", "en", "b", 0)] * 300
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    told = mixing.mixed(d).collect()
    taken = mixing.take(d)
    assert len(told) == len(rows) and taken.columns == d.columns
    got = {x.source: (x.n, x.words) for x in taken.groupBy("source").agg(F.count("*").alias("n"), F.sum(mixing.words("text")).alias("words")).collect()}
    assert sum(x.n_taken for x in told) == sum(n for n, _ in got.values()) and sum(x.taken for x in told) == sum(w for _, w in got.values())
    targets = {x.source_size: x.target for x in told}
    assert all(min(abs(w - t) for t in targets.values()) <= 22 for _, w in got.values())
    assert taken.groupBy(*d.columns).count().agg(F.max("count")).first()[0] > 300  # equal rows are taken together


def test_language_scores_match_plain_kernels(spark):
    """The prediction rebuilt from sets of n-grams and the model's weights, text by text."""
    d = table(spark, "documents").limit(40)
    model = language_id.fit(table(spark, "documents"))

    def grams(text):
        row = np.zeros(language_id.DIMS, np.uint8)
        language_id.mark(text, row)
        return set(np.flatnonzero(row).tolist())

    marks = [set(np.flatnonzero(x).tolist()) for x in model.landmarks]
    for r in language_id.predict(d, model, keep=["doc_id", "text"]).collect():
        own = grams(r.text)
        f = [3 * sum(len(own & m) / math.sqrt(len(own) * len(m)) * w for m, w in zip(marks, ws, strict=True)) for ws in model.weights.T]
        e = [math.exp(x - max(f)) for x in f]
        assert r.lang_pred == model.langs[f.index(max(f))] and abs(r.score - max(e) / sum(e)) < 1e-4


def test_language_marks_are_the_n_grams_of_one_to_three_characters():
    for text in ("", "a", "ab", "Ab c1", "über älles, ß 漢字"):
        plain = "".join(c.lower() if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
        row = np.zeros(language_id.DIMS, np.uint8)
        language_id.mark(text, row)
        every = np.zeros(language_id.DIMS, np.uint8)
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                language_id.mark(plain[i : i + n], every)
        assert (row == every).all() and row.any() == bool(text)


def test_language_refuses_what_it_does_not_know(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(d)
    foreign = [
        "漢字仮名交じり文の例です。" * 30, "Привет мир как дела " * 30,
        "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Se on toinen Suomen virallisista kielistä.",
        "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike. Legközelebbi rokonai a manysi és a hanti nyelv.",
        "Język polski należy do grupy języków zachodniosłowiańskich, stanowiącej część rodziny języków indoeuropejskich. Jest językiem urzędowym w Polsce.",
        "asdfkjh qwelkjrh zxcvmnb asdkfjh qpowieur zmxncbv lkajshdf qowieuryt bnvmcx zlkjahsd fpqowieur xcvbzm alskdjfh wqieury mznxbcv",
        "xq7 zzkw pfft 9933 ghjk vbnm uiop wxcv qsdf hjkl mpoi yttr nbvg zzz kkk lll 123 wrq tgb yhn ujm ik ol p",
        "def main(args):\n    for i in range(10):\n        if args[i] == None:\n            raise ValueError('bad')\n    return {k: v for k, v in items.items()}",
    ]
    odd = docs(spark, [*foreign, d.where("lang = 'en'").first().text]).withColumn("lang_pred", F.lit("x"))
    assert [r.lang_pred for r in language_id.predict(odd, model, refuse=True).orderBy("doc_id").collect()] == ["und"] * len(foreign) + ["en"]
    assert "und" not in [r.lang_pred for r in language_id.predict(odd, model).collect()]
    for given in (d, table(spark, "documents")):
        assert language_id.predict(given, model, refuse=True).where("lang_pred = 'und'").count() == given.where("text IS NULL OR NOT text RLIKE '[A-Za-zÀ-ÿ]'").count()
    nothing = spark.createDataFrame([(None, "abc " * 40, "en", "s", 0)] * 3000, DOCS)
    assert language_id.fit(nothing, per_lang=30).langs == ["en"]


def test_language_held_out_accuracy(spark):
    d = table(spark, "documents")
    rows = language_id.languages(d.drop("n_chars").withColumn("score", F.lit(0))).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0
    got = {r.doc_id: r for r in language_id.languages(docs(spark, ODD)).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[5].lang_pred == "en"
    assert {r.lang_pred for r in language_id.languages(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward_matches_enumeration():
    g = np.random.default_rng(5)
    lengths = [1, 4, 2, 7]
    chain = toxicity.Chain(np.zeros(1), g.normal(size=4))
    s, start = g.normal(size=sum(lengths)) * 2, np.zeros(sum(lengths), bool)
    start[np.cumsum([0, *lengths[:-1]])] = True
    p, logz, uses = chain.marginals(s, start, pairs=True)
    t, at = chain.transitions, 0
    for n in lengths:
        total, toxic, used = 0.0, np.zeros(n), np.zeros(4)
        for labels in itertools.product((0, 1), repeat=n):
            count = np.zeros(4)
            count[3] = labels[0]
            for a, b in itertools.pairwise(labels):
                if (a, b) != (0, 0):
                    count[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[a, b]] += 1
            w = np.exp(np.dot(labels, s[at : at + n]) + count @ t)
            total, toxic, used = total + w, toxic + w * np.array(labels), used + w * count
        assert np.allclose(p[at : at + n], toxic / total) and np.isclose(logz[at : at + n].sum(), np.log(total)) and np.allclose(uses[:, at : at + n].sum(1), used / total)
        at += n


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    d = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(d.withColumn("spans", F.lit(0)), labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    bad = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) > 0
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
    odd = toxicity.toxicity(docs(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r.score for r in odd} == {0.0}


def test_toxicity_scores_match_plain_forward_backward(spark):
    """Every score from plain recursions over one document's tokens at a time, with the fitted weights."""
    g = np.random.default_rng(6)
    clean, bad = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)], ["nastyx", "nastyy", "nastyz"]
    texts = [" ".join([*g.choice(clean, 30), *(g.choice(bad, 3) if k % 4 == 0 else [])]) for k in range(400)]
    rows = [(k, t, int(k % 4 == 0)) for k, t in enumerate(texts)] + [(None, texts[0], 1)] * 40
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), per_label=150)
    asked = [*texts[:30], *ODD, "nastyx", "nastyx nastyy", "x " * 5000 + "nastyz nastyx"]
    got = [r.score for r in toxicity.score(docs(spark, asked).withColumn("score", F.lit(1)), model).orderBy("doc_id").collect()]
    weights, t = model.chain.weights.astype(np.float32), model.chain.transitions
    move = np.exp([[0.0, t[0]], [t[1], t[2]]])
    for text, score in zip(asked, got, strict=True):
        e = [np.array([1.0, math.exp(float(weights[toxicity.features(w)].sum()))]) for w in toxicity.tokens(text or "")]
        ahead, back = [], []
        for k, x in enumerate(e):
            a = x * (ahead[-1] @ move if k else np.exp([0.0, t[3]]))
            ahead.append(a / a.sum())
        for k in range(len(e)):
            b = move @ (e[-k] * back[-1]) if k else np.ones(2)
            back.append(b / b.sum())
        p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back[::-1], strict=True)])
        best = [*sorted(p, reverse=True), 0.0, 0.0]
        odds = lambda q: math.log(min(max(q, 6e-6), 1 - 6e-6) / (1 - min(max(q, 6e-6), 1 - 6e-6)))
        x = np.array([1, math.log1p(p.sum()), odds(best[0]), odds(best[1]), math.log1p(len(p))])
        assert abs(score - 1 / (1 + math.exp(-np.clip(x @ model.logistic, -50, 50)))) < 1e-4
    assert got[0] > 0.7 > 0.3 > got[1]


HOSTILE = st.text(st.sampled_from("ab\\<>[]/ \ns") | st.characters(codec="utf-8"), max_size=12) | st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", " ", "[", "x", "] "]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "[ROLE"]), HOSTILE), max_size=4))
def test_chat_round_trip(turns):
    pieces = [chat_format.rendered(r, t) for r, t in turns]
    assert [x[:2] for x in chat_format.parse("".join(p[0] for p in pieces))] == turns


def test_chat_defined_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</s>"), (1, 1, "assistant", "</s>"), (None, None, None, "x"), (2, 0, "assistant", "a" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 8, hashlib.sha256(b"</s></s>").hexdigest())
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest() and got[2].loss_chars == 100_000
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site <a href=x>Home</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>The &amp; title</h1></header><p>First  <b>para</b>graph,\n with a few more words than the rest of it.<p>Second<br>line<ul><li>One<li>Two</ul><div class="ad">Buy</div><aside>Aside</aside><p>Er.</p>
<script>var a = "</p><p>no</p>";</script><form><label>Mail</label></form></article><section id="comments"><h2>Comments</h2><p>A reader says a lot of things here, at great length and more.</p></section></main><footer>&copy; Foot</footer></body></html>"""


def test_html_text():
    want = "The & title\nFirst paragraph, with a few more words than the rest of it.\nSecond line\nOne\nTwo\nEr."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("article>", "div>")).startswith("First paragraph") or "First paragraph" in html_text.main_text(PAGE.replace("article>", "div>"))
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain &lt; text <b", "<script>x</script>")] == ["", "", "", "plain < text", ""]


A, B, C = ("A thousand letters " * 52).strip(), ("A hundred letters " * 6).strip(), ("Ninety more letters " * 5).strip()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p>", ["Title", A, B, C]),
        (f"<div><h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div><a href=x>Home</a> <a href=y>Contact us</a></div>", ["Title", A, B, C]),
        (f"<div><p>{B}</p></div><div><p>{A}</p><p>{C}</p></div>", [B, A, C]),
        (f"<div><p>{A}</p></div><div><p>{B}</p></div>", [A, B]),
        (f"<div><a href=x>Home</a></div><div><h1>Title</h1></div><div>By Ann</div><div><p>{A}</p><p>Short.</p></div>", ["Title", "By Ann", A, "Short."]),
    ],
)
def test_html_without_article_keeps_every_paragraph(body, want):
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == "\n".join(want)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><h1>Title</h1><p>{A}</p><h2 id='related-work'>Related work</h2><p>{B}</p><section id='discussion'><h2>Discussion</h2><p>{C}</p></section><div id='follow-up'><p>We went back.</p></div></article>", ["Title", A, "Related work", B, "Discussion", C, "We went back."]),
        (f"<form action=x><input name=q><label>Find</label><main><h1>Title</h1><p>{A}</p></main><button>Go</button></form>", ["Title", A]),
        (f"<form action=x><div><h1>Title</h1><p>{A}</p><p>{B}</p><select><option>One</select></div></form>", ["Title", A, B]),
        (f"<div class='layout-sidebar-right'><h1>Title</h1><p>{A}</p><p>{B}</p></div>", ["Title", A, B]),
        (f"<article><p>{A}</p><div class='related'><a href=x>Another story with a long title to click on</a></div><div class='share'>Share</div><div class='comments'><p>{A}</p></div><form><p>{B}</p></form></article>", [A]),
    ],
)
def test_html_marks_need_a_second_witness(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == "\n".join(want)


BOXES = [f"class='{c}'" for c in ("notice", "alert", "related", "share", "popular", "promotion", "site-notice", "discussion", "commentlist", "notices", "share-bar", "relatedPosts", "recommended", "trending-stories", "user-comments", "reply", "social-links")] + ["role='alert'", "role='complementary'", "id='user-comments'", "id='comments'"]
BOXES_INSIDE = [f"class='{c}'" for c in ("disclaimer", "copyright", "feedback", "print", "register")]


@pytest.mark.parametrize("tag", ["article", "main", "div", None])
def test_html_drops_boxes_with_sentences(tag):
    """Notices, promotions, related stories, share bars and readers' comments go, however long their sentences; headings and sections by id stay."""
    wrapped = lambda x: f"<{tag}>{x}</{tag}>" if tag else x
    for box in BOXES + (BOXES_INSIDE if tag in ("article", "main") else []):
        for kind in ("div", "section", "ul"):
            inner = f"<p>{B} It has a sentence.</p><p>And another one, with a <a href=x>link</a>.</p>"
            page = f"<html><body>{wrapped(f'<h1>Title</h1><p>{A}</p><{kind} {box}>{inner}</{kind}><p>{B}</p><p>{C}</p>')}</body></html>"
            assert html_text.main_text(page) == "\n".join(["Title", A, B, C]), page
    kept = f"<h1>Title</h1><p>{A}</p><h2 class='related'>Related work</h2><p>{B}</p><section id='discussion'><h2>Discussion</h2><p>{C}</p></section><div id='notice'><p>{B}</p></div><div class='notice-of-intent'><p>{C}</p></div>"
    assert html_text.main_text(f"<html><body>{wrapped(kept)}</body></html>") == "\n".join(["Title", A, "Related work", B, "Discussion", C, B, C])


def test_html_drops_teasers_and_keeps_lists_of_articles():
    teaser = lambda k: f"<article><h3><a href=/{k}>Another story number {k}</a></h3><p>What it says, told in one sentence.</p></article>"
    page = f"<html><body><main><article><h1>Title</h1><p>{A}</p><p>{B}</p></article>{teaser(1)}{teaser(2)}<section class=related><h2>More</h2>{teaser(3)}</section></main></body></html>"
    assert html_text.main_text(page) == "\n".join(["Title", A, B])
    listed = html_text.main_text(f"<html><body><main>{teaser(1)}{teaser(2)}{teaser(3)}</main></body></html>")
    assert all(f"Another story number {k}\nWhat it says" in listed for k in (1, 2, 3))
    parts = f"<html><body><main><h1>Title</h1><article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article></main></body></html>"
    assert html_text.main_text(parts) == "\n".join(["Title", "One", A, "Two", B])


def test_html_an_article_outweighs_longer_text_around_it(monkeypatch):
    page = f"<html><body><div><p>{B}</p><p>{B}</p></div><article><h1>Title</h1><p>{C}</p></article><div><p>Short.</p></div></body></html>"
    assert html_text.main_text(page) == f"Title\n{C}"
    monkeypatch.setattr(html_text, "INSIDE", 1.0)
    assert html_text.main_text(page) != f"Title\n{C}"


def test_html_clusters_decide(monkeypatch):
    body = f"<nav><a href=x>Home</a></nav><div>Login to see more</div><div><h1>Title</h1><p>{A}</p><p>{B}</p></div><div>All rights kept</div><footer>Foot</footer>"
    pages = [f"<html><body>{body}</body></html>", PAGE]
    cut = [html_text.main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "threshold", lambda x: -1.0)
    assert cut[0] == "\n".join(["Title", A, B]) and all(html_text.main_text(x) != y for x, y in zip(pages, cut, strict=True))


def test_html_planted_articles():
    """Random pages whose article is known, in wrappers with and without article tags, among menus, adverts, sidebars and comments."""
    r = random.Random(8)
    said = lambda n: " ".join("".join(r.choice("abcdeno") for _ in range(r.randint(2, 8))) for _ in range(n))
    link = lambda: f"<a href=/{said(1)}>{said(2)}</a>"
    noise = [lambda: f"<nav><ul>{''.join(f'<li>{link()}' for _ in range(6))}</ul></nav>", lambda: f"<div class='ad'>{said(8)}.</div>", lambda: f"<aside><p>{said(12)}</p></aside>", lambda: f"<div class=sidebar>{said(5)} {link()}</div>", lambda: f"<footer>{said(9)}</footer>", lambda: "<script>var x = '<p>no</p>';</script>", lambda: f"<section class='comments'><p>{said(30)}.</p></section>", lambda: f"<div {r.choice(BOXES)}><p>{said(9).capitalize()}. {said(7)}.</p></div>", lambda: f"<ol class=commentlist>{''.join(f'<li><p>{said(12)}.</p></li>' for _ in range(4))}</ol>"]
    for k in range(200):
        blocks = [f"{said(r.randint(20, 90))}." for _ in range(r.randint(2, 7))]
        title = said(4).title()
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{b.replace(' ', r.choice([' ', chr(10), '  ']), 1)}{r.choice(['</p>', '', r.choice(noise)()])}" for b in blocks)
        around = [r.choice(noise)() for _ in range(6)]
        tag = ("article", "main", "div")[k % 3]
        page = f"<html><head><title>{title}</title></head><body>{''.join(around[:3])}<{tag}>{inner}</{tag}>{''.join(around[3:])}</body></html>"
        assert html_text.main_text(page) == "\n".join([title, *blocks]), page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<![foo[ bar]]>b</p>", "ab"), ("<p>x</p><![CDATA[some <b> text]]>", "x\nsome <b> text"), ("<!DOCTYPE html [<!ELEMENT x>]><p>hi</p>", "hi"), ('<p><b title="a<b">q</b> 1 < 2</p>', "q 1 < 2"), ("<p>x</p><!-- y", "x\ny"), ("<p>x</p><b", "x"),
        *[(t * 20_000, None) for t in ("<div>x", "<i ", "<li>x", "</div>x", '<i "', "<!--", "<![CDATA[", "<!", "&", "<script>", "<b><p>", "<div class=ad>")],
    ],
)
def test_html_of_any_markup_in_time(page, want):
    began = time.time()
    got = html_text.main_text(page)
    assert time.time() - began < 10 and (want is None or got == want)


def test_html_whole_table(spark):
    pages = table(spark, "pages")
    rows = html_text.extracted(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 5 for r in rows)
    assert html_text.extracted(pages.limit(0)).count() == 0 and html_text.extracted(pages.limit(1).union(pages.limit(1)).withColumn("html", F.lit(None).cast("string"))).collect()[1].text == ""


def test_pipeline(spark):
    import corpus_pipeline

    d = table(spark, "documents")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before = d.count()
        d = stage(spark, d, SF)
        d = corpus_pipeline.stored(d, name)
        sizes[name] = (before, d.count(), d.columns)
    assert all(sizes[n][2] == table(spark, "documents").columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert sizes["language_id"][0] == sizes["language_id"][1] and sizes["simhash_near_dedup"][1] < sizes["simhash_near_dedup"][0]
    assert sizes["decontamination"][1] < sizes["decontamination"][0] and sizes["token_output"][0] == sizes["token_output"][1]


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls, repeats, empty tables and columns that clash with an operator's own: each stage keeps the columns and all clean rows."""
    import corpus_pipeline

    d = table(spark, "documents")
    clean = d.where("length(text) > 400").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, "漢字仮名交じり文 " * 40, None, "s", 0), (7, "漢字仮名交じり文 " * 40, None, "s", 0)], DOCS)
    extra = {c: F.lit(k) for k, c in enumerate(("n_hit", "items", "score", "lang_pred", "size", "target", "fp", "start", "row_hash", "mixed_times", "kept_row"))}
    rows = clean.unionByName(odd).withColumns(extra)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        sizes[name] = out.count()
        assert name == "token_output" or (out.columns == rows.columns and out.where("size <> 4 OR n_hit <> 0").count() == 0)
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert sizes["language_id"] == 40 and sizes["token_output"] == 44
    unlabelled = clean.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, unlabelled, SF).count() == 40
