"""The ingest chain, re-runs, the page sink's two phases, folds of very large groups."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from talkloom.operators import enrich, ingest, pages, resolve, storage
from talkloom.operators.records import RAW, conform
from talkloom.sources import files


def under(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, fs in os.walk(folder) for f in fs}


def test_a_failing_page_leaves_all_pages_whole(spark, tmp_path):
    folder = str(tmp_path / "site")
    first = spark.createDataFrame([(f"d{k % 3}/p{k}.md", f"old {k}") for k in range(40)], "path string, text string")
    assert pages.write_files(first, folder) == 40
    before = under(folder)
    worse = first.repartition(8).withColumn("text", F.when(F.col("path").endswith("p17.md"), F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no"):
        pages.write_files(worse, folder)
    assert under(folder) == before and len(before) == 40 and not [d for d in os.listdir(folder) if d.startswith("_")]
    assert pages.write_files(first.withColumn("text", F.lit("new")).union(first.limit(0)), folder) == 40 and set(under(folder).values()) == {"new"}
    assert pages.write_files(first.limit(0), str(tmp_path / "none")) == 0


def test_reruns_compute_what_has_changed_and_give_the_whole(spark):
    schema = "archive_id string, raw_id string, title string, topics array<string>, extra map<string,string>"
    rows = [(f"a{k % 5}", str(k), f"t{k}", ["x"], {"k": str(k)}) for k in range(50)] + [(None, "n", "t", None, None)]
    before = spark.createDataFrame(rows, schema)
    now = spark.createDataFrame([r for r in rows if r[0] != "a4"] + [("a0", "99", None, None, {}), ("a9", "1", "t", [], None)], schema)
    assert ingest.changes(ingest.manifest(before), ingest.manifest(before.repartition(7))).count() == 0
    found = ingest.changes(ingest.manifest(before), ingest.manifest(now))
    assert {(r.archive_id, r.change) for r in found.collect()} == {("a0", "changed"), ("a4", "gone"), ("a9", "new")}
    run = lambda d: {(r.archive_id, r.title) for r in d.collect()}
    kept = before.join(found.select("archive_id"), "archive_id", "left_anti")
    assert run(kept) | run(ingest.to_rerun(now, found)) == run(now)


def test_records_of_very_many_rows_hold_their_first_values(spark):
    """30,000 rows without a key are one record; its lists are cut where that is asked for, and are whole as rows."""
    n, most = 30_000, 500
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").alias("archive_id"), F.format_string("%06d", "id").alias("raw_id"), F.array(F.format_string("f%06d", "id"), F.lit("same")).alias("source_files"), F.lit("missing").alias("transcript_status"))
    raw = conform(df, RAW).withColumn("raw_id", F.element_at(F.split(F.col("source_files")[0], "f"), 2))
    member = resolve.link(raw)
    got = {r.archive_id: r for r in resolve.fold(raw, member, listed=most).collect()}
    assert set(got) == {"a", None} and all(r.n_sources == n / 2 for r in got.values())
    for start, archive in ((0, "a"), (1, None)):
        want = [f"f{start:06d}", "same", *[f"f{k:06d}" for k in range(start + 2, n, 2)]]
        assert got[archive].source_files == want[:most]
    values = resolve.list_values(raw.join(member, "raw_id"))
    assert values.where("kind = 'source_files'").count() == n + 2
    whole = resolve.fold(raw, member).where("archive_id = 'a'").first()
    assert len(whole.source_files) == n / 2 + 1


def test_yaml_rows_come_one_by_one(spark, tmp_path):
    bodies = {
        "a.yaml": "- title: One\n  topics: [x, 'y']\n  date: 2020-01-02\n- just text\n- {name: Two, duration_min: 2.5}\n",
        "b.yml": "about: &a {sermons: [{title: No}]}\nsermons:\n- title: Three\n  speaker: *s\n".replace("*s", "Ann") + "other: *a\n",
        "c.yaml": "", "d.yaml": "# nothing\n", "e.yaml": "sermons:\n", "f.yaml": "plain: text\n",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    got = files.yaml_catalog(spark, str(tmp_path)).select("title", "speaker", "date", "topics", "duration_seconds").collect()
    assert sorted((r.title, r.speaker, r.date, tuple(r.topics), r.duration_seconds) for r in got) == [("One", None, "2020-01-02", ("x", "y"), None), ("Three", "Ann", None, (), None), ("Two", None, None, (), 150)]


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("title,speaker\n" + "".join(f"T{k:06d},{'x' * 60}\n" for k in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        raw = files.csv_catalog(spark, str(tmp_path), multiline=False)
        assert raw.rdd.getNumPartitions() > 4
        ordered = [r.title for r in resolve.with_raw_id(raw).orderBy("raw_id").select("title").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == [f"T{k:06d}" for k in range(20_000)]


def test_enrichment_asks_once_though_a_worker_dies(spark, tmp_path):
    """A task that is killed midway: what was answered before is not asked again, in the next run or for an equal record."""
    asked, kept = tmp_path / "asked", str(tmp_path / "kept")
    asked.mkdir()
    log, stop = str(asked), str(tmp_path / "stop")
    open(stop, "w").close()

    def summarise(fields):
        with open(f"{log}/{fields['title']}", "a") as f:
            f.write("x")
        if fields["title"] == "t25":
            if os.path.exists(stop):
                os._exit(1)
            raise ValueError("never")
        return f"of {fields['title']}"

    rows = [("a", str(k), f"t{k % 30}") for k in range(60)]
    df = conform(spark.createDataFrame(rows, "archive_id string, record_id string, title string")).coalesce(1)
    run = lambda: {r.record_id: (r.outcome, r.output) for r in enrich.enrich(df, summarise, ["title"], kept=kept).collect()}
    with pytest.raises(Exception, match="."):
        run()
    before = len(os.listdir(log))
    os.remove(stop)
    got = run()
    assert 20 < before < 30 and len(got) == 60
    assert all(got[i] == (("failed", "never") if t == "t25" else ("ok", f"of {t}")) for _, i, t in rows)
    calls = {t: len((asked / t).read_text()) for t in os.listdir(log)}
    assert calls.pop("t25") >= 3 and set(calls.values()) == {1} and len(calls) == 29
    assert run() == got and all(len((asked / t).read_text()) == 1 for t in calls)


def test_rows_of_their_own_are_folded_without_being_gathered(spark, monkeypatch):
    """Only groups of several, and rows with long lists, go through the fold by values; both ways give the same."""
    rows = [(k, f"t{k // 2 if k < 4 else k}", [" A", "a", "", None, f"b{k}"], {"x": 1, "": 2}, {"p": " ", "q": str(k)}, " s " if k % 2 else None, " " if k % 3 else "said") for k in range(9)]
    rows.append((9, "long", [f"v{k % 400}" for k in range(900)], None, None, "", None))
    df = spark.createDataFrame(rows, "n int, title string, topics array<string>, ref_counts map<string,int>, extra map<string,string>, speaker string, transcript_text string")
    raw = conform(df.withColumns({"archive_id": F.lit("a"), "review_flags": F.array(F.lit("f"), F.lit("f")), "transcript_status": F.when(F.col("n") == 5, "listed"), "source_rank": F.lit(0), "source_ord": F.col("n").cast("string")}), RAW)
    told = lambda d: sorted(map(str, d.collect()))
    gathered, together = [], resolve._folded_together
    monkeypatch.setattr(resolve, "_folded_together", lambda joined, *a: gathered.append(joined.count()) or together(joined, *a))
    got = told(resolve.resolved(raw))
    assert gathered == [5] and len(got) == 8
    monkeypatch.setattr(resolve, "SHORT", -1)
    assert told(resolve.resolved(raw)) == got and gathered == [5, 10]


def test_stored_tables_leave_no_shuffle_files(spark):
    of = lambda: {f for d, _, fs in os.walk(tempfile.gettempdir()) if "blockmgr-" in d for f in (f"{d}/{x}" for x in fs) if "/shuffle_" in f and f.endswith(".data")}
    before, conf = of(), spark.conf.get(storage.CLEANED, None)
    storage.stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counted")
    for _ in range(50):  # they go beside the driver's next steps
        if of() <= before:
            break
        time.sleep(0.2)
    assert of() <= before and spark.conf.get(storage.CLEANED, None) == conf


def test_a_group_that_gains_a_key_meets_single_rows_and_groups(spark):
    """Rows 0 and 1 share a video; folded they have the title of one in the year of the other, as the group of 2 and 3 and row 4 have."""
    rows = [("0", "A", None, None, "v"), ("1", None, "2020-01-01", None, "v"), ("2", "A", "2020-07-07", "w", None), ("3", "Z", "2021-02-02", "w", None), ("5", "Q", "2019-02-02", None, None)]
    group = lambda rows: {x.raw_id.split("\t")[-1]: x.group_id.split("\t")[-1] for x in resolve.link(resolve.with_raw_id(conform(spark.createDataFrame(rows, "source_ord string, title string, date string, video_url string, video_id string").withColumns({"archive_id": F.lit("a"), "source_rank": F.lit(0)}), RAW))).collect()}
    assert group(rows) == {"0": "0", "1": "0", "2": "0", "3": "0", "5": "5"}
    assert group(rows[:2] + [("4", "A", "2020-09-09", None, None)] + rows[4:]) == {"0": "0", "1": "0", "4": "0", "5": "5"}


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """As Spark's readers list them, by rounds of folders; no list of files is made by the driver."""
    from talkloom.sources import folders

    for k in range(60):
        at = tmp_path / f"y{k % 3}" / f"talk {k}+%"
        at.mkdir(parents=True)
        (at / "a b.TXT").write_text(f"said {k}")
        (at / "none.txt").write_text("")
        (at / ".hidden.txt").write_text("x")
        (at / "x.mp3").write_bytes(b"\xff")
    (tmp_path / "_gone").mkdir()
    (tmp_path / "_gone" / "a.txt").write_text("x")
    for k in range(25):
        (tmp_path / f"t{k}.txt").write_text(f"top {k}")
    monkeypatch.setattr(folders, "ROWS", 10)
    got = sorted(map(tuple, folders.bodies(spark, str(tmp_path), r"(?i)\.txt$").collect()))
    want = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,TXT}").text(str(tmp_path), wholetext=True).select("_metadata.file_path", "value")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 85
    raw = files.audio_files(spark, str(tmp_path))
    assert raw.count() == 60 and not raw.inputFiles()[0].endswith(".mp3")  # what it reads is a table of files
    assert sorted(r.path for r in folders.files(spark, f"file://{tmp_path}/t7.txt", "").collect()) == [f"file:{tmp_path}/t7.txt"]
    assert folders.files(spark, str(tmp_path / "y*"), "") is None and folders.files(spark, str(tmp_path / "no"), "") is None


def test_video_files_are_read_by_tasks_as_by_sparks_reader(spark, tmp_path, monkeypatch):
    from talkloom.sources import folders

    bodies = {"list.json": '[{"id": "a", "duration": 3}, {"id": "b", "title": "B", "upload_date": 20200102}]', "one.json": '{"id": "c", "url": "/w", "timestamp": 5}', "many.json": '{"id": "x", "entries": [{"id": "d"}, {"title": "E"}]}', "none.json": '{"entries": []}', "bad.json": "{nothing", "empty.json": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    told = lambda: sorted(map(str, files.video_metadata(spark, str(tmp_path)).collect()))
    got = told()
    assert not files.video_metadata(spark, str(tmp_path)).inputFiles()[0].endswith(".json")
    monkeypatch.setattr(folders, "files", lambda *a: None)
    assert told() == got and len(got) == 6


def test_transcripts_are_listed_by_tasks(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"2020-01-01_T{k}.txt").write_text(f"said {k}")
    t = files.transcripts(spark, str(tmp_path))
    assert sorted(r.transcript_text for r in t.collect()) == sorted(f"said {k}" for k in range(12)) and not [f for f in t.inputFiles() if f.endswith(".txt")]


def test_yaml_events_come_from_the_c_parser():
    import yaml

    body = "a: &x [1, 0x1f, 1_000, 2.5, yes, ~, 2020-01-02, '7', \"q\\n\", plain text]\nb: *x\nc: {<<: {d: 1}, e: |\n  long\n  text\n}\n" .replace("{<<: {d: 1}, e: |\n  long\n  text\n}", "\n  <<: {d: 1}\n  e: |\n    long\n    text")
    of = lambda kind: kind(body).get_single_data()
    assert issubclass(files.yaml_loader(), yaml.cyaml.CParser) == yaml.__with_libyaml__
    assert of(files.yaml_loader()) == of(yaml.SafeLoader) and of(files.yaml_loader())["c"] == {"d": 1, "e": "long\ntext\n"}
