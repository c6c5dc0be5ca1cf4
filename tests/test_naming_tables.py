"""Rules that are tables against the same rules given by hand."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import naming
from talkloom.operators.records import conform


@pytest.fixture(scope="module")
def given():
    r = random.Random(5)
    names = ["Ann Bell", "a.  BELL", "Bo", "bo!", "The Choir", "", None, "Zoë", "Unknown Name"]
    titles = ["Hope, week 2", "On hope and  love", "A hope", "hopeful", None, "Love: on HOPE and love", "Nothing"]
    rows = [(f"r{k}", r.choice(names), r.choice(titles), r.choice([None, "Old", "hope"]), r.choice([None, [], ["pray", "Prayer", "x"], ["pray"]]), r.choice([None, ["1 cor 15", "the text"], ["jn 3:16"]])) for k in range(300)]
    aliases = {"Ann Bell": ["a bell", "Unknown name"], "Bo": "Bob Best", "Prayer": ["pray"], "John 3:16": ["jn 3:16"]}
    return rows, aliases


def run(records, aliases, ignored, titles):
    r = naming.series(naming.speakers(records, aliases, ignored), aliases, titles=titles)
    r = naming.passages(naming.named_lists(r, ["topics"], aliases), aliases)
    return sorted((x.record_id, x.speaker, x.series, x.topics, x.primary_refs, x.review_flags, x.log) for x in r.collect())


def test_tables_do_what_rules_by_hand_do(spark, given, monkeypatch):
    rows, aliases = given
    records = conform(spark.createDataFrame(rows, "record_id string, speaker string, title string, series string, topics array<string>, primary_refs array<string>"))
    patterns = [{"pattern": r"\bon\s+hope\s+and\s+love\b", "series": "Both", "override_existing": True}, {"pattern": r"\bhope\b", "series": "On  Hope", "override_existing": False}]
    phrases = spark.createDataFrame([(2, "hope", "On  Hope", False), (1, "On hope and LOVE", "Both", True), (0, "", "No", True), (3, None, "No", True), (4, "hope", "Late", True)], "ord int, phrase string, series string, override boolean")
    by_hand = run(records, aliases, ["the choir"], patterns)
    told = [(a, c) for c, xs in (("Ann Bell", ["a bell", "Unknown name"]), ("Bob Best", ["Bo"]), ("Prayer", ["pray"]), ("John 3:16", ["jn 3:16"])) for a in xs] + [(None, "x"), ("", "y"), ("z", None)]
    tables = spark.createDataFrame(told, "alias string, canonical string")
    ignored = spark.createDataFrame([("The choir!",), (None,), ("the choir",)], "name string")
    assert run(records, tables, ignored, phrases) == by_hand and any(x[1] == "Bob Best" for x in by_hand) and any(x[2] == "Both" for x in by_hand)
    monkeypatch.setattr(naming, "BY_HAND", 2)
    assert run(records, aliases, ["the choir"], patterns) == by_hand
    empty = run(records, tables.limit(0), ignored.limit(0), phrases.limit(0))
    assert empty == run(records, None, None, None)


def test_rules_of_one_key_go_by_order(spark):
    rules = spark.createDataFrame([("A x", "First", 1), ("a-X", "Second", 2), ("first", "Third", 0)], "alias string, canonical string, ord int")
    got = {r.key: r.canonical for r in naming.alias_table(spark, rules).collect()}
    assert got == {"a x": "Second", "first": "Third", "second": "Second", "third": "Third"}


def test_many_phrases_are_met_by_their_rarest_word(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    phrases = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 3))), f"S{k}", k % 2 == 0) for k in range(1500)]
    titles = [" ".join(r.choice([*words, "of", "the"]) for _ in range(r.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in titles], "_tkey string")
    found = naming.titles_by_phrase(df, spark.createDataFrame(phrases, "ord int, phrase string, series string, override boolean"))
    for x in found.select("_tkey", F.col("_title.series").alias("series")).collect():
        assert x.series == next((s for _, p, s, _ in phrases if f" {p} " in f" {x['_tkey']} "), None)
