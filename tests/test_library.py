"""The library's operators on small cases, and against plain models of the order-sensitive ones."""

import difflib
import itertools
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from talkloom import catalogue
from talkloom.functions import passages, rules, text
from talkloom.operators import concordance, content, enrich, indexes, naming, pages, records, resolve
from talkloom.sources import files
from tests.support import SF, difference


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def found(t, alone=True):
    return [x.ref for x in passages.Reader().citations(t, alone)]


def test_citations():
    assert found("We read 1 Cor 15 and Matthew 12:38-45; Rev 8:6-9:21, Revelation chapter 8 verse 6.")[:4] == ["1 Corinthians 15", "Matthew 12:38-45", "Revelation 8:6-9:21", "Revelation 8:6"]
    assert found("In Jude 17-23 we") == ["Jude 17-23"] and found("Luke fourteen verse twelve") == ["Luke 14:12"]
    assert found("Jonah 17, Exodus 2022, Revelation 129 and Jude 202") == [] and found("John said hello") == []
    assert found("Turn to John") == ["John"] and found("Turn to John", False) == []
    assert found("Romans 5. Then chapter 6 and verse 3-5.") == ["Romans 5", "Romans 6", "Romans 6:3-5"]
    assert len(rules.BOOKS) == 66 and sum(rules.BOOKS.values()) == 1189
    assert passages.Reader({("Revelation", 7): 17}).citations("Revelation 7:30") == []


def rec(spark, rows, schema):
    return records.conform(spark.createDataFrame(rows, schema))


def test_pruning_and_flags(spark):
    df = spark.createDataFrame([(["Revelation", "Revelation 8:6-9:21", "Revelation 8", "Jude 3", "Jude", "nonsense", "Mark 4"],), (["Revelation"],)], "r array<string>")
    assert [x.p for x in df.select(passages.pruned("r").alias("p")).collect()] == [["Revelation 8:6-9:21", "Jude 3", "nonsense", "Mark 4"], ["Revelation"]]
    r = rec(spark, [("a", "1", ["John 3:16"]), ("a", "2", ["John 3:16"])], "archive_id string, record_id string, primary_refs array<string>")
    total = concordance.flagged(concordance.totals(concordance.entries(concordance.counted(r)))).collect()
    assert [(x.ref, x.records, x.mentions, x.primary_records, x.flag) for x in total] == [("John 3:16", 2, 2, 2, "Repeated passage")]


def test_primary_is_not_the_announced_one(spark):
    r = rec(spark, [("a", "1", "Courage", "Next week we are in Jonah. Turn to Mark 4. Jonah 2 is later.")], "archive_id string, record_id string, title string, transcript_text string")
    x = concordance.inferred(r).first()
    assert x.primary_refs == ["Mark 4"] and "Jonah 2" in x.mentioned_refs and rules.INFERRED_FLAG in x.review_flags and rules.NO_SPEAKER in x.review_flags


def test_text_functions(spark):
    df = spark.createDataFrame([(" 7/19/26 ", "2026-07-05_Ordinary_Courage", "one two three-four five", "a, b")], "d string, s string, t string, l string")
    x = df.select(text.normalize_date("d").alias("d"), text.normalize_date(F.lit("1/2/85")).alias("old"), text.filename_date("s").alias("fd"), text.filename_title("s").alias("ft"), text.shortened("t", 17).alias("cut"), text.split_list("l").alias("l"), text.tokens(F.lit("Stories walking walked dogs about it's café")).alias("tok"), text.unique_values(F.array(F.lit(" A "), F.lit("a"), F.lit("")), F.array(F.lit("B"))).alias("u"), text.page_stem("d", F.lit("a/b")).alias("stem")).first()
    assert (x.d, x.old, x.fd, x.ft, x.cut, x.l) == ("2026-07-19", "1985-01-02", "2026-07-05", "Ordinary Courage", "one two three-...", ["a", "b"])
    assert x.tok == ["story", "walk", "walk", "dogs", "it's", "caf"] and x.u == ["A", "B"] and x.stem == " 7/19/26  - a b"


def test_sources(spark, tmp_path):
    def put(name, body):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)

    put("t/2026-07-05_Ordinary_Courage.txt", "Title: Real title\nAuthor: Ann Lee\nSquarespace URL: https://x/y\n---\n\nBody here.\n")
    put("t/front.md", "---\ntitle: 'Fronted'\ntopics: [a, b]\nscripture: John 3\n---\nText: stays\n")
    put("t/transcription_log.txt", "no")
    put("h/2026-07-19_Steady_Hope.html", "<p>Intro</p><p>Transcript</p><p>One<br>two &amp; three</p><p>lost<p>Last</p><script>'</p>'</script>")
    put("c/2026-07-12_Patient_Faith.vtt", "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<i>Hello</i>  there\nHello there\n\n00:00:02.000 --> 00:00:03.000\nbye\n")
    put("a/2026-07-05_Ordinary_Courage.mp3", "x")
    put("v/video.json", json.dumps({"entries": [{"id": "q1", "title": "V", "upload_date": "20260705", "url": "/watch?v=q1", "duration": 61.9}, {"id": "q2", "timestamp": 0, "url": "q2"}]}))
    put("f/2026-07-05-ordinary/metadata.json", json.dumps({"title": "F", "youtube_id": "q1", "upload_date": "2026-07-05", "duration_seconds": 60}))
    put("f/2026-07-05-ordinary/transcript.clean.md", "# Transcript\n\nClean text.")
    put("f/2026-07-05-ordinary/audio.mp3", "x")
    put("k.csv", "title,date,has_transcript,topics,duration_min\nOrdinary,7/5/26,True,a; b,2\n")
    put("k.json", json.dumps({"sermons": [{"title": "J", "topics": ["x", "y"]}]}))
    d = str(tmp_path)
    t = {r.title: r for r in files.transcripts(spark, f"{d}/t").collect()}
    assert set(t) == {"Real title", "Fronted"} and (t["Real title"].speaker, t["Real title"].date, t["Real title"].transcript_text, t["Real title"].source_files[1]) == ("Ann Lee", "2026-07-05", "Body here.", "https://x/y")
    assert (t["Fronted"].topics, t["Fronted"].primary_refs, t["Fronted"].transcript_text) == (["a", "b"], ["John 3"], "Text: stays")
    h = files.html_pages(spark, f"{d}/h").first()
    assert (h.title, h.transcript_text, h.transcript_status) == ("Steady Hope", "One\ntwo & three\n\nLast", "provided")
    c = files.captions(spark, f"{d}/c").first()
    assert (c.transcript_text, c.transcript_status) == ("Hello there\nbye", "caption-derived")
    a = files.audio_files(spark, f"{d}/a").first()
    assert a.audio_files[0].endswith("Courage.mp3") and a.review_flags == [files.AUDIO_FLAG]
    v = sorted(files.video_metadata(spark, f"{d}/v").collect(), key=lambda r: r.video_id)
    assert [(r.title, r.date, r.video_url, r.duration_seconds) for r in v] == [("V", "2026-07-05", "https://www.youtube.com/watch?v=q1", 61), ("q2", "1970-01-01", "https://www.youtube.com/watch?v=q2", None)]
    f = files.talk_folders(spark, f"{d}/f").first()
    assert (f.title, f.transcript_text, f.duration_seconds, len(f.audio_files)) == ("F", "Clean text.", 60, 1)
    k = files.csv_catalog(spark, f"{d}/k.csv").first()
    assert (k.date, k.transcript_status, k.topics, k.duration_seconds) == ("2026-07-05", "catalog-listed", ["a", "b"], 120)
    assert files.json_catalog(spark, f"{d}/k.json").first().topics == ["x", "y"]
    everything = files.collected(files.csv_catalog(spark, f"{d}/k.csv"), files.transcripts(spark, f"{d}/t"), files.video_metadata(spark, f"{d}/v"), files.talk_folders(spark, f"{d}/f"))
    merged = {r.date: r for r in resolve.resolved(everything).collect() if r.date}
    assert merged["2026-07-05"].n_sources == 4 and merged["2026-07-05"].title == "Ordinary" and merged["2026-07-05"].video_id == "q1" and merged["2026-07-05"].transcript_status == "provided"


def greedy(rows):
    """The sequential rule, told plainly: rows of (id, title, date, video)."""
    groups, known, out = {}, {}, {}

    def keys(title, date, video):
        slug = title.lower().replace(" ", "-") if title else ""
        ks = [f"v{video}"] if video else []
        ks += [f"dt{date}{slug}", f"yt{date[:4]}{slug}"] if date and slug else []
        return (ks + ([f"d{date}"] if date else [f"t{slug}"] if slug else [])) or ["unknown"]

    for i, *own in rows:
        ks = keys(*own)
        home = next((known[k] for k in ks if k in known), i)
        groups[home] = [a or b for a, b in zip(groups.get(home, [None] * 3), own, strict=True)]
        for k in [*ks, *keys(*groups[home])]:
            known[k] = home
        out[i] = home
    return out


@pytest.mark.parametrize(("n", "titles", "days", "videos"), [(60, 3, 3, 2), (5000, 40, 300, 400), (5000, 1, 900, 0), (5000, 2000, 2, 50)])
def test_ordered_resolving_matches_the_plain_rule(spark, n, titles, days, videos):
    r = random.Random(n + titles)
    day = lambda k: f"{2019 + k % 4}-{k % 12 + 1:02d}-{k % 28 + 1:02d}"
    rows = [(i, r.choice([None, *[f"T {r.randrange(titles)}"] * 5]), r.choice([None, *[day(r.randrange(days))] * 4]), f"v{r.randrange(videos)}" if videos and r.random() < 0.3 else None) for i in range(n)]
    df = spark.createDataFrame([("a", *x, None) for x in rows], "archive_id string, raw_id long, title string, date string, video_id string, video_url string")
    assert {x.raw_id: x.group_id for x in resolve.link_in_order(df).collect()} == greedy(rows)


def test_ordered_resolving_keeps_only_names_to_come():
    state, last = resolve._Replay(), 100_000
    for i in range(last):
        state.home_of(i, [(f"2020-01-{i % 28 + 1:02d}x{i}", i), ("hot", last), (None, None), (f"v{i}", i)], None)
        assert len(state.known) < 4 and len(state.groups) < 3 and len(state.ends) < 9


def test_recurring_titles_and_chains(spark):
    schema = "archive_id string, raw_id long, title string, date string, speaker string, video_id string, transcript_text string, transcript_status string, review_flags array<string>"
    flag = [files.AUDIO_FLAG]
    rows = [("a", 1, "Hope", "2020-01-05", None, None, None, "missing", flag), ("a", 2, "Hope", "2020-01-06", "Ann", "x", " text ", "provided", []), ("a", 3, "Other", None, "Bob", "x", "second", "provided", []), ("a", 4, "Hope", "2021-01-05", "Cy", None, None, "missing", [])]
    raw = spark.createDataFrame(rows, schema)
    raw = records.conform(raw, records.RAW).withColumn("raw_id", F.when(F.col("date") == "2020-01-05", 1).when(F.col("speaker") == "Ann", 2).when(F.col("speaker") == "Bob", 3).otherwise(4).cast("long"))
    got = {x.group_id: x for x in resolve.resolved(raw).collect()}
    assert set(got) == {1, 4} and (got[1].n_sources, got[1].speaker, got[1].transcript_text, got[1].transcript_status, got[1].review_flags) == (3, "Ann", " text ", "provided", [])


def test_near_duplicate_names_lose_nothing(spark):
    r = random.Random(6)
    names = sorted({" ".join([r.choice(["Pastor", "Ann", "Jo"]), *(["".join(r.choice("abc") for _ in range(r.randint(2, 9)))] * r.randint(0, 1)), r.choice(["Smith", "Smyth", "Smithe", "Lee", "Li"])][: r.randint(1, 3)]) for _ in range(60)} | {"abcdefghijklm", "abcdefghijkl m", "abcdefghijklmn"})
    df = spark.createDataFrame([("a", n) for n in names], "archive_id string, speaker string")
    key = naming._plain_key

    def alike(a, b):
        x, y = key(a).split(), key(b).split()
        if x == y or not x or not y:
            return False
        if len(x) > 1 and len(y) > 1 and x[0] == y[0]:
            return difflib.SequenceMatcher(None, x[-1], y[-1]).ratio() >= 0.78
        return difflib.SequenceMatcher(None, key(a), key(b)).ratio() >= 0.92

    want = {(a, b) for a, b in itertools.combinations(sorted(names, key=lambda n: (n.casefold(), n)), 2) if alike(a, b)}
    assert {(x.value, x.replacement) for x in naming.near_duplicate_names(df, "speaker").collect()} == want and want


def test_related_matches_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    rows = [(r.choice("ab"), f"{i:03}", r.choice(["s", "t", None]), [r.choice(["John 3", "Mark 4"])], [r.choice(["x", "y"])], " ".join(r.choice(["grace", "hope", "lion", "tree", "river", "stone", "cloud"]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    df = rec(spark, rows, "archive_id string, record_id string, series string, primary_refs array<string>, topics array<string>, transcript_text string")
    counts = content.term_counts(df)
    vectors = content.term_vectors(counts, content.document_frequency(counts, df))
    v = {}
    for x in vectors.collect():
        v.setdefault(x.record_id, {})[x.term] = x.weight
    want = {}
    for a in rows:
        scores = []
        for b in rows:
            if a is not b and a[0] == b[0]:
                x, y = v.get(a[1], {}), v.get(b[1], {})
                dot = sum(w * y.get(t, 0) for t, w in x.items())
                s = dot / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())) if dot else 0
                s += 0.05 * bool(a[2] and a[2] == b[2]) + 0.02 * len({*a[3]} & {*b[3]}) + 0.02 * len({*a[4]} & {*b[4]})
                if round(s, 9) >= 0.12:
                    scores.append((-round(s, 9), b[1]))
        want.update({(a[1], b): k + 1 for k, (_, b) in enumerate(sorted(scores)[:5])})
    for cuts in (content.CUTS, (2, 7)):
        monkeypatch.setattr(content, "CUTS", cuts)
        assert {(x.record_id, x.other_id): x.rank for x in content.related(df, vectors).collect()} == want


def test_diverse_pick(spark):
    rows = [([(9.0, 3, "c", ["a", "b"]), (8.0, 1, "a", ["a", "b", "c"]), (7.0, 0, "z", ["x"]), (6.0, 2, "y", ["q"])],)]
    df = spark.createDataFrame(rows, "r array<struct<score:double,position:int,sentence:string,terms:array<string>>>")
    assert df.select(content.diverse(F.col("r"), 3).alias("x")).first().x == ["z", "y", "c"]


def test_enrichment(spark):
    df = rec(spark, [("a", str(i), f"t{i}", ["old"]) for i in range(4)], "archive_id string, record_id string, title string, themes array<string>")

    def fn(fields):
        i = int(fields["record_id"])
        return [{"summary": "s", "themes": ["Old", "n"]}, {"skipped": True}, "plain", None][i]

    got = {x.record_id: x for x in enrich.merged(df, enrich.enrich(df, fn)).collect()}
    assert (got["0"].summary, got["0"].themes, got["0"].summary_source) == ("s", ["old", "n"], "external_command")
    assert got["1"].summary is None and got["1"].review_flags == [] and got["2"].summary == "plain" and got["3"].review_flags == ["External summary empty."]


def test_enrichment_stays_in_its_scope_and_time(spark):
    rows = [(a, i, f"{a}{i}") for a in "ab" for i in ("1", "2")]
    df = rec(spark, rows, "archive_id string, record_id string, title string")

    def fn(fields):
        if fields["title"] == "b2":
            time.sleep(30)
        return f"about {fields['title']}"

    began = time.time()
    got = {(x.archive_id, x.record_id): x for x in enrich.merged(df, enrich.enrich(df, fn, timeout=2, workers=4)).collect()}
    assert len(got) == 4 and time.time() - began < 25
    assert {k: x.summary for k, x in got.items()} == {("a", "1"): "about a1", ("a", "2"): "about a2", ("b", "1"): "about b1", ("b", "2"): None}
    assert got["b", "2"].review_flags == ["External summary timed out."]


def test_equal_rows_of_two_archives_stay_apart(spark):
    rows = spark.createDataFrame([("Hope", "2020-01-05", "x"), ("Hope", "2020-01-05", "x"), ("Other", "2021-01-05", None)], "title string, date string, topics string")
    found = resolve.resolved(files.collected(files.catalog(rows.limit(1), "c", "a"), files.catalog(rows, "c", "b"))).collect()
    assert sorted((r.archive_id, r.title, r.n_sources) for r in found) == [("a", "Hope", 1), ("b", "Hope", 2), ("b", "Other", 1)]


def test_places_among_equal_names(spark):
    r = random.Random(9)
    rows = [(r.choice("xy"), f"{i:03}") for i in range(200)] + [(None, f"n{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "name string, i string").repartition(6)
    got = {x.i: x.n for x in indexes.numbered(df, ["name"], [F.col("i")]).collect()}
    assert got == {i: 1 + sum(n == m and j < i for m, j in rows) for n, i in rows}


def test_pages_are_rewritten_by_archive(spark, tmp_path):
    df = rec(spark, [("a", "1", "|giv| Week 1", "2025-11-30"), ("b", "2", "T", None)], "archive_id string, record_id string, title string, date string")
    out = str(tmp_path / "pages")
    pages.write(pages.record_pages(df), out)
    pages.write(pages.record_pages(df.where("archive_id = 'b'").withColumn("title", F.lit("New"))), out)
    assert {r.path for r in spark.read.parquet(out).collect()} == {"2025-11-30 - giv Week 1.md", "New.md"}


def test_record_pages_hold_the_whole_text(spark, tmp_path):
    rows = [(1, "a word " * 20 + end, "en", "s", 0) for end in ("one", "two")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in catalogue.queries()["record_pages"](spark, str(tmp_path)).collect()]
    assert len(found) == 2 and len(set(found)) == 2


def test_references_without_a_semicolon(spark):
    """In paragraphs they are characters, in the text of pages without any they stay."""
    from talkloom.sources.html import transcript_text

    pages = ["<title>A &amp;&amp</title><nav>B &copy; &#38;&#x26; &nosuch; &ltx</nav>", "<title>A &amp</title><p>B &amp C &copy D &lt;</p>", "&amp", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = [r.t for r in df.orderBy("i").select(transcript_text("h").alias("t")).collect()]
    assert got == ["A &&ampB © && &nosuch; &ltx", "B & C © D <", "&amp", ""]


def test_saved_pages_without_paragraphs_keep_open_references(spark, tmp_path):
    (tmp_path / "2026-07-19_Cut-short.html").write_text("<title>Gest &amp;&amp</title><h1>Gest &quot;x&quot;</h1>")
    (tmp_path / "2026-07-20_Whole.htm").write_text("<title>A &amp</title><p>&lt;B &amp</p>")
    got = {r.title: r.transcript_text for r in files.html_pages(spark, str(tmp_path)).collect()}
    assert got == {"Cut short": 'Gest &&ampGest "x"', "Whole": "<B &"}


def test_texts_with_primary_references_are_not_read_for_more(spark):
    """Only counting reads them; what is inferred of the others stays."""
    r = rec(spark, [("a", "1", "Mark 4", "Turn to John 3:16.", ["Luke 2"]), ("a", "2", "Mark 4", "Turn to John 3:16.", [])], "archive_id string, record_id string, title string, transcript_text string, primary_refs array<string>")
    x = concordance.inferred(r)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("find(CASE WHEN (size(primary_refs") == 2  # title and opening
    got = {y.record_id: (y.primary_refs, sorted(y.mentioned_refs)) for y in x.collect()}
    assert got["1"] == (["Luke 2"], ["John 3:16", "Luke 2", "Mark 4"]) and sorted(got["2"][0]) == ["John 3:16", "Mark 4"]
