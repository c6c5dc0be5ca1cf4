"""Queries over text functions, sources, resolving, naming, content and enrichment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import rules, text
from talkloom.operators import content, enrich, naming, pages, records, resolve
from talkloom.plans.adapters import TALKS, table, talks
from talkloom.sources import files


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("  "), F.col("p_name"), F.lit("'s ["), F.col("p_brand"), F.lit("]  Straße \t"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_value(v).alias("value"), text.normalized_key(v).alias("key"), text.slugify(v).alias("slug"), text.safe_filename(v).alias("file"), text.wikilink(v).alias("link"))


def _catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 5 == 0, F.date_format(d, "M/d/yy")).when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy")).when(k % 5 == 2, F.date_format(d, "yyyyMMdd")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd")).otherwise("some day")
    return table(spark, sf_dir, "orders").select(
        k.alias("key"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"), F.lit("Second name").alias("name"), date.alias("preached_on"), F.when(k % 2 == 0, F.lit(" x; y |z ")).otherwise("a, b,,c").alias("topics"),
        F.when(k % 3 == 0, F.lit("Yes")).otherwise("no").alias("has_transcript"), F.when(k % 4 == 0, F.lit("t.txt")).alias("transcript"), F.when(k % 6 == 0, F.lit("90.7")).when(k % 6 == 1, "bad").alias("duration_seconds"), F.lit("2.5").alias("duration_min"),
    )


def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalog_rows(spark, sf_dir).withColumn("permalink", F.concat(F.lit("k"), F.col("key").cast("string")))
    return files.catalog(rows, "c.csv").select("title", "date", F.array_join("topics", ";").alias("topics"), F.array_join("source_files", ";").alias("sources"), "transcript_status", "duration_seconds", F.size("review_flags").cast("long").alias("n_flags"))


def video_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("v"), k.cast("string")).alias("id"), F.when(k % 3 == 0, F.lit("A title")).alias("title"), F.lit(None).cast("string").alias("fulltitle"), F.when(k % 2 == 0, F.lit("/watch?v=1")).when(k % 5 == 0, "short").otherwise("https://x/y").alias("webpage_url"), F.lit(None).cast("string").alias("url"),
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).alias("upload_date"), F.unix_timestamp("o_orderdate").cast("double").alias("timestamp"), k.alias("row"), F.lit(None).cast("double").alias("release_timestamp"), (k % 100 + 0.5).cast("double").alias("duration"),
    )
    return files.video_records(items, F.lit("f.json")).select("video_id", "title", "date", "video_url", "duration_seconds")


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("WEBVTT\n\n12\n00:00:01.000 --> 00:00:02.000\n<b>"), F.coalesce("text", F.lit("")), F.lit("</b>\n\nNOTE x\n13\n00:00:02.000 --> 00:00:03.000 align:start\nsame\nsame \n<i>same</i>\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(files.caption_text(body).cast("binary")).alias("digest"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, opt = F.col("o_orderkey"), lambda n, c: F.when(k % n != 0, c)
    df = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("archive_id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), opt(3, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("speaker"),
        opt(7, F.concat(F.lit("v"), (k % 40).cast("string"))).alias("video_id"), F.array(F.concat(F.lit("T"), (k % 3).cast("string")), F.concat(F.lit("t"), (k % 2).cast("string"))).alias("topics"), (k % 3).cast("int").alias("source_rank"), F.lpad(k.cast("string"), 12, "0").alias("source_ord"),
        F.when(k % 4 == 0, F.concat(F.lit(" text "), k.cast("string"))).alias("transcript_text"), F.when(k % 4 == 0, "provided").when(k % 5 == 0, "catalog-listed").otherwise("missing").alias("transcript_status"),
        F.array(F.lit(records.RESOLVED[1]), F.concat(F.lit("Check "), (k % 3).cast("string"))).alias("review_flags"), F.create_map(F.concat(F.lit("R "), (k % 3).cast("string")), (k % 5 + 1).cast("int")).alias("ref_counts"),
        F.create_map(F.concat(F.lit("e"), (k % 2).cast("string")), F.when(k % 3 > 0, k.cast("string")).otherwise("")).alias("extra"),
    )
    return resolve.with_raw_id(records.conform(df, records.RAW))


def records_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve.resolved(_raw(spark, sf_dir))
    told = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";").alias(c)
    text = [F.trim("transcript_text").alias("said"), "transcript_status", F.array_join("review_flags", ";").alias("flags"), told("ref_counts"), told("extra")]
    return r.select("archive_id", "group_id", "n_sources", "title", "date", "speaker", "video_id", F.array_join("topics", ",").alias("topics"), *text)


def records_resolved_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(_raw(spark, sf_dir), mode="ordered").select("archive_id", "group_id", "n_sources", "title", "date")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, F.lit("  Anna   Bell ")).when(k % 5 == 1, "a. bell").when(k % 5 == 2, "Grace Church Team").when(k % 5 == 3, "1 Peter 2:11-12").otherwise(F.col("c_name"))
    df = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), (k % 3).cast("string")).alias("archive_id"), k.cast("string").alias("record_id"), F.when(k % 4 == 0, F.lit("giv 25 week 1")).when(k % 4 == 1, "2 Samuel 3 again").when(k % 4 == 2, "Remember this").otherwise("Plain").alias("title"), F.when(k % 2 == 0, F.lit("2022-05-01")).alias("date"), said.alias("speaker"),
        F.when(k % 3 == 0, F.lit("GIV")).when(k % 3 == 1, "old  name").alias("series"), F.array(F.lit("the"), F.lit("1 cor 15"), F.lit("Exodus 21-23")).alias("primary_refs"), F.array(F.lit(" Prayer "), F.lit("prayers"), F.lit("x")).alias("topics"),
    )
    return records.conform(df)


ANNUAL = [{"canonical": "giv {year}", "aliases": ["giv"], "require_week": True, "override_existing": True}]
TITLES = [{"pattern": "re.?member", "series": "Re:Member"}]


def _all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = naming.speakers(_named(spark, sf_dir), {"Anna Bell": ["A. Bell"]}, ["Customer 000000009"], "The Grace Church")
    r = naming.series(r, {"New Name": ["old name"]}, ANNUAL, TITLES)
    return naming.named_lists(naming.passages(r), ["topics"], {"Prayer": ["prayers"]})


def names_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_names(spark, sf_dir).select("record_id", "speaker", "series", F.array_join("primary_refs", "; ").alias("refs"), F.array_join("topics", "; ").alias("topics"), F.size("log").cast("long").alias("n_log"))


def _by_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made uniform by aliases, ignored names and title phrases that are tables: as many rules as there are customers."""
    o, c = table(spark, sf_dir, "orders").withColumn("hall", F.format_string("Hall %06d", "o_custkey")), table(spark, sf_dir, "customer")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("  THE cust "), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("Cust. "), F.col("o_custkey").cast("string")))
    df = records.conform(
        o.select(
            F.lit("a").alias("archive_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.concat(F.lit("At "), F.lower("hall"), F.lit(", again")).alias("title"), said.alias("speaker"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("Old")).alias("series"), F.array(F.concat(F.lit("cust "), (F.col("o_custkey") % 50).cast("string")), F.lit("x")).alias("topics"),
        )
    )
    ids = F.col("c_custkey").cast("string")
    aliases = c.select(F.concat(F.lit("cust "), ids).alias("alias"), F.col("c_name").alias("canonical"))
    ignored = c.where("c_nationkey = 3").select(F.concat(F.lit("the cust "), ids).alias("name"))
    phrases = o.groupBy("hall").agg(F.min("o_orderkey").alias("ord")).select("ord", F.col("hall").alias("phrase"), F.concat(F.lit("Of "), "hall").alias("series"), (F.right("hall", F.lit(1)) == "7").alias("override"))
    r = naming.speakers(df, aliases, ignored)
    r = naming.series(r, None, titles=phrases, from_book=False)
    return naming.named_lists(r, ["topics"], aliases)


def names_by_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.transform("log", lambda x: F.concat_ws("|", x["kind"], x["scope"], x["value"], x["replacement"]))
    return _by_tables(spark, sf_dir).select("record_id", "speaker", "series", F.array_join("topics", "; ").alias("topics"), F.array_join(log, "; ").alias("log"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_log(_all_names(spark, sf_dir)).unionByName(naming.naming_log(_by_tables(spark, sf_dir)))


def naming_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_summary(_log(spark, sf_dir))


def naming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_totals(_log(spark, sf_dir))


def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("archive_id"), F.concat_ws(" ", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 5 == 0, F.lit("s"))).alias("speaker"))
    return naming.near_duplicate_names(p, "speaker")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talks(spark, sf_dir)
    return content.document_frequency(content.term_counts(t), t).select("archive_id", "term", "df", "n", F.round("idf", 6).alias("idf"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.term_counts(talks(spark, sf_dir)).groupBy("record_id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_terms"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = talks(spark, sf_dir)
    counts = content.stored(content.term_counts(t), "terms")
    frequency = content.stored(content.document_frequency(counts, t), "frequency")
    return t, frequency, content.term_vectors(counts, frequency)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.vector_norms(_vectors(spark, sf_dir)[2]).select("record_id", "n", F.round("norm", 4).alias("norm"))


def related_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, v = _vectors(spark, sf_dir)
    i = F.col("record_id").cast("long")
    said = lambda n, of: F.concat(F.lit(of), (i % n).cast("string"))
    t = t.withColumns({"primary_refs": F.when(i % 3 > 0, F.array(said(5, "John "), said(7, "Luke "))), "mentioned_refs": F.when(i % 2 == 0, F.array(said(5, "JOHN "), said(2, "Mark "), said(11, "Acts ")))})
    return content.related(t, v).select("archive_id", "record_id", "other_id", F.round("score", 6).alias("score"), "rank")


def sentence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f, _ = _vectors(spark, sf_dir)
    return content.scored_sentences(t, f).groupBy("record_id").agg(F.count("*").alias("n"), F.min("position").cast("long").alias("first"), F.sum(F.length("sentence")).alias("chars"))


def content_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("record_id").cast("long")
    said = F.concat(F.when(i % 2 == 0, F.lit("Grace and mercy. ")).otherwise("The Holy Spirit, hope! "), F.coalesce("transcript_text", F.lit("")), F.when(i % 3 == 0, F.lit(" we pray in prayer, love, love, money")).otherwise(""))
    t = talks(spark, sf_dir).withColumn("said", said)
    both = rules.THEMES | rules.TOPICS
    return t.select("record_id", F.explode(content.label_scores(both, F.coalesce("series", F.lit("")), "said")).alias("x")).select("record_id", "x.label", F.col("x.score").cast("long").alias("score"))


def content_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries, labels and related records of all talks, told whole by their digests."""
    i = F.col("record_id").cast("long")
    said = F.concat(F.col("transcript_text"), F.when(i % 2 == 0, F.lit("\nWhat we see is grace and mercy and hope for all who stand here together tonight. ")).otherwise("\n"), F.when(i % 3 == 0, F.lit("We pray in prayer, and the point is that love, love and money never met. ")).otherwise(""))
    r = content.indexed(talks(spark, sf_dir).withColumn("transcript_text", said))
    digest = lambda c: F.md5(c.cast("binary"))
    return r.select("archive_id", "record_id", digest(F.coalesce("summary", F.lit(""))).alias("summary"), "summary_status", "summary_source", F.array_join("themes", ";").alias("themes"), F.array_join("topics", ";").alias("topics"), F.array_join("review_flags", ";").alias("flags"), digest(F.array_join("related", "|")).alias("related"))


def _summarise(fields: dict) -> object:
    i = int(fields["record_id"])
    if i % 10 == 0:
        raise ValueError("no")
    return {"skipped": True} if i % 10 == 1 else f"plain {i}" if i % 10 == 2 else {"summary": f" s{i} ", "themes": ["Theme 0", "new"], "questionable_claims": []}


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talks(spark, sf_dir)
    r = enrich.merged(t, enrich.enrich(t, _summarise, ["record_id", "title"]))
    return r.select("record_id", "summary", "summary_status", F.array_join("themes", ";").alias("themes"), F.size("review_flags").cast("long").alias("n_flags"))


def page_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = pages.frontmatter(talks(spark, sf_dir)).withColumn("f", F.from_json("front", "title string, date string, status string, questionable_claims array<string>"))
    return front.select("record_id", "f.title", "f.date", "f.status", F.size("f.questionable_claims").cast("long").alias("n_claims"))


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages.record_pages(talks(spark, sf_dir))
    return p.select("archive_id", "path", F.md5(p["text"].cast("binary")).alias("digest"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkloom.operators.indexes import entity_index

    return pages.index_rows(entity_index(talks(spark, sf_dir), F.array("speaker")))


def theme_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkloom.operators.indexes import group_lists

    p = pages.group_pages(group_lists(talks(spark, sf_dir), F.concat("topics", "themes"), chunk=50), "Theme")
    return p.select("archive_id", "path", F.md5(F.col("text").cast("binary")).alias("digest"))


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ingest_rows(talks(spark, sf_dir))


def related_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of related records by title, by page name, and one that names nothing."""
    t = talks(spark, sf_dir)
    t = t.withColumn("related", F.array_compact(F.array(F.col("title"), text.page_stem("date", "title"), F.lit("no such record"))))
    return content.resolve_related(t).select("archive_id", "record_id", F.col("place").cast("long").alias("place"), "label", "target_id")


def alias_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a joined table of aliases, one for every second customer."""
    c = table(spark, sf_dir, "customer")
    aliases = c.where("c_custkey % 2 = 0").select(text.normalized_key("c_name").alias("key"), F.concat(F.lit("Canon "), F.col("c_custkey").cast("string")).alias("canonical"))
    return naming.apply_alias_table(c.select("c_custkey", F.upper("c_name").alias("name")), "name", aliases)


def first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_rule(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dropped_repeats(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus")


QUERIES = {
    f.__name__: f
    for f in (
        name_keys, catalog_records, video_records, caption_texts, records_resolved, records_resolved_in_order, names_normalized, names_by_tables, naming_summary, naming_totals, near_duplicate_names, term_frequency, token_totals, vector_norms,
        related_records, sentence_candidates, content_labels, content_index, enriched, page_fronts, record_pages, index_rows, theme_documents, ingest_rows, related_resolved, alias_joined, first_rules, changed_lines,
    )
}

_V = "'  ' || p_name || '''s [' || p_brand || ']  Straße ' || chr(9)"
_STEM = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in rules.STOPWORDS)


def _tokens(x: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[a-z][a-z'']{{2,}}'), lambda q: trim(q, '''')), lambda q: length(q) >= 3 AND q NOT IN ({_STOP}))"
    return f"list_transform({words}, lambda w: {_STEM})"


_TF = f"""{TALKS}, tok AS (SELECT archive_id, record_id, unnest({_tokens("concat_ws(' ', title, series, transcript_text)")}) AS term FROM t),
tf AS (SELECT archive_id, record_id, term, count(*) AS tf FROM tok GROUP BY ALL), nn AS (SELECT archive_id, count(*) AS n FROM t GROUP BY archive_id),
df AS (SELECT archive_id, term, count(*) AS df, any_value(n) AS n, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN nn USING (archive_id) GROUP BY archive_id, term)"""
_SKIP = "|".join(w.replace("'", "''") for w in rules.SKIP_PHRASES)
_KEYS = "[CASE WHEN video_id IS NOT NULL THEN 'i' || video_id END, 'yt' || left(date, 4) || title, 'd' || date]"
_RAW = f"""r0 AS (
  SELECT 'c' || o_custkey AS archive_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 <> 0 THEN 'S' || (o_orderkey % 4) END AS speaker, CASE WHEN o_orderkey % 7 <> 0 THEN 'v' || (o_orderkey % 40) END AS video_id,
    ['T' || (o_orderkey % 3), 't' || (o_orderkey % 2)] AS topics, o_orderkey AS ok, CASE WHEN o_orderkey % 4 = 0 THEN 'text ' || o_orderkey END AS said, CASE WHEN o_orderkey % 4 = 0 THEN 'provided' WHEN o_orderkey % 5 = 0 THEN 'catalog-listed' ELSE 'missing' END AS status, 'c' || o_custkey || chr(9) || (o_orderkey % 3) || chr(9) || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS raw_id FROM orders
), k AS (SELECT archive_id, raw_id, unnest({_KEYS}) AS key FROM r0), e AS (SELECT DISTINCT a.raw_id AS a, b.raw_id AS b FROM k a JOIN k b USING (archive_id, key) WHERE a.raw_id <> b.raw_id),
g(node, seen) AS (SELECT raw_id, raw_id FROM r0 UNION SELECT e.b, g.seen FROM g JOIN e ON e.a = g.node), m AS (SELECT node AS raw_id, min(seen) AS group_id FROM g GROUP BY node)"""
_WORDS = "(VALUES " + ", ".join(f"('{k}', '{w}', {rules.LABEL_MINIMUM.get(k, 4)})" for k, ws in (rules.THEMES | rules.TOPICS).items() for w in ws) + ") AS kw(label, word, least)"
_hits = lambda x: f"len(regexp_extract_all(regexp_replace({x}, '[À-ɏ]', 'q', 'g'), '\\b' || word || '\\b'))"  # noqa: E731  (its word ends know ASCII letters only)
_MDY = "CAST(month(o_orderdate) AS VARCHAR)"
_BY_TABLES = r"""o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN '  THE cust ' || o_custkey ELSE 'Cust. ' || o_custkey END AS raw, trim(CASE WHEN o_orderkey % 4 = 0 THEN '  THE cust ' || o_custkey ELSE 'Cust. ' || o_custkey END) AS clean,
  o_orderkey % 4 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3) AS ign, CASE WHEN o_orderkey % 3 = 0 THEN 'Old' END AS ser FROM orders),
n AS (SELECT o.*, CASE WHEN o_orderkey % 4 = 0 THEN clean ELSE coalesce(c.c_name, clean) END AS known, t.c_name AS tname, 'cust ' || (o_custkey % 50) AS topic, 'Of Hall ' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS of_hall, ser IS NULL OR o_custkey % 10 = 7 AS takes
  FROM o LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer t ON t.c_custkey = o_custkey % 50)"""
_SAID = r"""text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'What we see is grace and mercy and hope for all who stand here together tonight. ' ELSE chr(10) END || CASE WHEN doc_id % 3 = 0 THEN 'We pray in prayer, and the point is that love, love and money never met. ' ELSE '' END"""
_SAID_TF = _TF.replace("text AS transcript_text", f"{_SAID} AS transcript_text")
_SIGNAL = "|".join(re.escape(w).replace("'", "''") for w in rules.SIGNAL_PHRASES)
_fold = lambda x: f"replace(lower({x}), 'ß', 'ss')"
_cut = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(regexp_extract(left({x}, {n - 2}), '^(.*)\\s', 1, 's')) || '...' END"  # noqa: E731  (no hyphenated words stand at these texts' cuts)
_jaccard = lambda a, b: f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"
_labels = lambda kinds, n: f"SELECT archive_id, record_id, list(label ORDER BY score DESC, label)[1:{n}] AS ls FROM lab WHERE label IN ({', '.join(repr(k) for k in kinds)}) GROUP BY archive_id, record_id"
_added = lambda old, new: f"list_concat({old}, list_filter(coalesce({new}, []), lambda x: NOT list_contains(list_transform({old}, lambda y: {_fold('y')}), {_fold('x')})))"
_INDEX = rf"""WITH {_SAID_TF}, s AS (SELECT archive_id, record_id, unnest(regexp_split_to_array(regexp_replace(transcript_text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS raw, generate_subscripts(regexp_split_to_array(regexp_replace(transcript_text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), 1) - 1 AS position FROM t WHERE has_text),
c AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS sentence FROM s),
k AS (SELECT *, {_tokens('sentence')} AS toks, {_fold('sentence')} AS low, row_number() OVER (PARTITION BY archive_id, record_id ORDER BY position) AS n FROM c WHERE length(sentence) BETWEEN 55 AND 420 AND NOT regexp_matches({_fold('sentence')}, '{_SKIP}') AND len({_tokens('sentence')}) >= 8),
w0 AS (SELECT archive_id, record_id, position, sum(idf) AS s FROM (SELECT archive_id, record_id, position, unnest(toks) AS term FROM k WHERE n <= 900) JOIN df USING (archive_id, term) GROUP BY ALL),
q AS (SELECT k.*, list_distinct(toks) AS terms, round(s / sqrt(len(toks)) * CASE WHEN list_has_any({_tokens("concat_ws(' ', t.title, t.series)")}, toks) THEN 1.08 ELSE 1.0 END * CASE WHEN position < 6 THEN 0.55 ELSE 1.0 END * CASE WHEN regexp_matches(low, '{_SIGNAL}') THEN 1.35 ELSE 1.0 END
    * CASE WHEN contains(' ' || low || ' ', ' uh ') OR contains(' ' || low || ' ', ' um ') THEN 0.78 ELSE 1.0 END * CASE WHEN len(regexp_extract_all(low, ' i ')) + len(regexp_extract_all(low, ' me ')) + len(regexp_extract_all(low, ' my ')) >= 4 THEN 0.82 ELSE 1.0 END * CASE WHEN length(sentence) > 320 THEN 0.78 ELSE 1.0 END, 9) AS score
  FROM k JOIN w0 USING (archive_id, record_id, position) JOIN t USING (archive_id, record_id)),
rk AS (SELECT archive_id, record_id, position, sentence, terms, row_number() OVER (PARTITION BY archive_id, record_id ORDER BY score DESC, position DESC) AS rk FROM q),
p1 AS (SELECT * FROM rk WHERE rk = 1),
p2 AS (SELECT DISTINCT ON (r.archive_id, r.record_id) r.* FROM rk r JOIN p1 USING (archive_id, record_id) WHERE r.rk > 1 AND {_jaccard('p1.terms', 'r.terms')} <= 0.45 ORDER BY r.archive_id, r.record_id, r.rk),
p3 AS (SELECT DISTINCT ON (r.archive_id, r.record_id) r.* FROM rk r JOIN p1 USING (archive_id, record_id) JOIN p2 USING (archive_id, record_id) WHERE r.rk > p2.rk AND {_jaccard('p1.terms', 'r.terms')} <= 0.45 AND {_jaccard('p2.terms', 'r.terms')} <= 0.45 ORDER BY r.archive_id, r.record_id, r.rk),
pk AS (SELECT archive_id, record_id, string_agg(sentence, ' ' ORDER BY position) AS picked FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) GROUP BY archive_id, record_id),
pt AS (SELECT t.*, picked, CASE WHEN coalesce(series, '') <> '' AND NOT contains({_fold("coalesce(title, '')")}, {_fold('series')}) THEN 'Series: ' || series || '.' END AS part, trim(regexp_replace(transcript_text, '\s+', ' ', 'g')) AS flat FROM t LEFT JOIN pk USING (archive_id, record_id)),
pw AS (SELECT *, concat_ws(' ', part, 'Generated review summary:', picked) AS long_ FROM pt),
mk AS (SELECT *, coalesce(CASE WHEN picked IS NOT NULL THEN {_cut('long_', 950)} END, nullif(concat_ws(' ', part, {_cut('flat', 520)}), '')) AS made FROM pw),
sm AS (SELECT * EXCLUDE (summary), has_text AND summary IS NULL AND made IS NOT NULL AS fresh, CASE WHEN has_text AND summary IS NULL AND made IS NOT NULL THEN made ELSE summary END AS summary FROM mk),
lab AS (SELECT archive_id, record_id, label, sum(8 * {_hits('m')} + 3 * {_hits('e0')} + {_hits('f0')}) AS score FROM (SELECT archive_id, record_id, {_fold("concat_ws(' ', title, series, '')")} AS m, {_fold("left(transcript_text, 5000)")} AS e0, {_fold('transcript_text')} AS f0 FROM t WHERE has_text), {_WORDS} GROUP BY archive_id, record_id, label, least
  HAVING sum(8 * {_hits('m')} + 3 * {_hits('e0')} + {_hits('f0')}) >= least),
th AS ({_labels(rules.THEMES, 6)}), tp AS ({_labels(rules.TOPICS, 8)}),
lb AS (SELECT sm.* EXCLUDE (themes, topics), {_added('sm.themes', 'th.ls')} AS themes, {_added('sm.topics', 'tp.ls')} AS topics FROM sm LEFT JOIN th USING (archive_id, record_id) LEFT JOIN tp USING (archive_id, record_id)),
w AS (SELECT tf.*, (1 + ln(tf)) * idf AS weight FROM tf JOIN df USING (archive_id, term)), v AS (SELECT *, row_number() OVER (PARTITION BY archive_id, record_id ORDER BY round(weight, 9) DESC, term) AS rn FROM w),
x AS (SELECT archive_id, record_id, term, weight FROM v WHERE rn <= 180), nm AS (SELECT archive_id, record_id, sqrt(sum(weight * weight)) AS norm FROM x GROUP BY ALL),
dot AS (SELECT a.archive_id, a.record_id AS a, b.record_id AS b, sum(a.weight * b.weight) AS dot FROM x a JOIN x b ON a.archive_id = b.archive_id AND a.term = b.term AND a.record_id <> b.record_id GROUP BY ALL),
l AS (SELECT archive_id, record_id, series, list_distinct(list_transform(list_concat(topics, themes), lambda q: lower(q))) AS labels FROM lb),
pairs AS (SELECT p.archive_id, p.record_id AS a, q.record_id AS b, CASE WHEN p.series = q.series THEN 0.05 ELSE 0 END + least(0.08, 0.02 * len(list_intersect(p.labels, q.labels))) AS bonus FROM l p JOIN l q ON p.archive_id = q.archive_id AND p.record_id <> q.record_id),
sc AS (SELECT archive_id, a, b, round(CAST(bonus AS DOUBLE) + coalesce(dot / (m.norm * n.norm), 0), 9) AS score FROM pairs LEFT JOIN dot USING (archive_id, a, b) LEFT JOIN nm m ON m.archive_id = pairs.archive_id AND m.record_id = a LEFT JOIN nm n ON n.archive_id = pairs.archive_id AND n.record_id = b),
best AS (SELECT *, row_number() OVER (PARTITION BY archive_id, a ORDER BY score DESC, b) AS rank FROM sc WHERE score >= 0.12),
stems AS (SELECT archive_id, record_id, coalesce(date || ' - ', '') || coalesce(nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), '{rules.UNTITLED}') AS stem FROM t),
rl AS (SELECT archive_id, a AS record_id, string_agg(stem, '|' ORDER BY rank) AS related FROM (SELECT best.archive_id, a, {_fold('stem')} AS fs, arg_min(stem, rank) AS stem, min(rank) AS rank FROM best JOIN stems ON stems.archive_id = best.archive_id AND stems.record_id = b WHERE rank <= 5 GROUP BY ALL) GROUP BY archive_id, a)
SELECT lb.archive_id, lb.record_id, md5(coalesce(summary, '')) AS summary, CASE WHEN fresh THEN 'deterministic_review_required' END AS summary_status, CASE WHEN fresh THEN 'deterministic_content_index' END AS summary_source, array_to_string(themes, ';') AS themes, array_to_string(topics, ';') AS topics,
  array_to_string(CASE WHEN has_text AND summary IS NOT NULL THEN list_append(review_flags, '{rules.CONTENT_FLAG}') ELSE review_flags END, ';') AS flags, md5(coalesce(related, '')) AS related FROM lb LEFT JOIN rl USING (archive_id, record_id)"""
ORACLES = {
    "name_keys": rf"""WITH v AS (SELECT p_partkey, {_V} AS v FROM part), w AS (SELECT p_partkey, v, trim(regexp_replace(v, '\s+', ' ', 'g')) AS value, trim(regexp_replace(regexp_replace(v, '[\[\]#]+', ' ', 'g'), '\s+', ' ', 'g')) AS file FROM v)
SELECT p_partkey, value, trim(regexp_replace(replace(lower(v), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS key, trim(regexp_replace(replace(lower(trim(v)), '''', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug, file, '[[' || value || ']]' AS link FROM w""",
    "catalog_records": """SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority ELSE 'Second name' END AS title, CASE WHEN o_orderkey % 5 = 4 THEN 'some day' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
CASE WHEN o_orderkey % 2 = 0 THEN 'x;y;z' ELSE 'a;b;c' END AS topics, concat_ws(';', 'c.csv', CASE WHEN o_orderkey % 4 = 0 THEN 't.txt' END, 'k' || o_orderkey) AS sources,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'catalog-listed' ELSE 'catalog-only' END AS transcript_status, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 90 WHEN o_orderkey % 6 = 1 THEN NULL ELSE 150 END AS INTEGER) AS duration_seconds,
CAST(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_flags FROM orders""",
    "video_records": """SELECT 'v' || o_orderkey AS video_id, CASE WHEN o_orderkey % 3 = 0 THEN 'A title' ELSE 'v' || o_orderkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.youtube.com/watch?v=1' WHEN o_orderkey % 5 = 0 THEN 'https://www.youtube.com/watch?v=v' || o_orderkey ELSE 'https://x/y' END AS video_url, CAST(floor(o_orderkey % 100 + 0.5) AS INTEGER) AS duration_seconds FROM orders""",
    "caption_texts": r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+')) AS ls FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_append(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), 'same'), chr(10))) AS digest FROM l""",
    "records_resolved": f"""WITH RECURSIVE {_RAW}, f AS (SELECT r0.*, group_id FROM r0 JOIN m USING (raw_id)),
tp AS (SELECT archive_id, group_id, lower(x) AS lx, arg_min(x, raw_id || p) AS x, min(raw_id || p) AS o FROM (SELECT archive_id, group_id, raw_id, unnest(topics) AS x, unnest([1, 2]) AS p FROM f) GROUP BY ALL),
tj AS (SELECT archive_id, group_id, string_agg(x, ',' ORDER BY o) AS topics FROM tp GROUP BY ALL),
fl AS (SELECT archive_id, group_id, x, min(raw_id || p) AS o FROM (SELECT archive_id, group_id, raw_id, unnest(['{records.RESOLVED[1]}', 'Check ' || (ok % 3)]) AS x, unnest([1, 2]) AS p FROM f) GROUP BY archive_id, group_id, x),
fg AS (SELECT archive_id, group_id, count(*) AS n, count(said) > 0 AS has FROM f GROUP BY archive_id, group_id),
fj AS (SELECT archive_id, group_id, coalesce(string_agg(x, ';' ORDER BY o) FILTER (NOT (n > 1 AND has AND x = '{records.RESOLVED[1]}')), '') AS flags FROM fl JOIN fg USING (archive_id, group_id) GROUP BY archive_id, group_id),
rc AS (SELECT archive_id, group_id, string_agg(t, ';' ORDER BY t) AS ref_counts FROM (SELECT archive_id, group_id, 'R ' || (ok % 3) || '=' || sum(ok % 5 + 1) AS t FROM f GROUP BY archive_id, group_id, ok % 3) GROUP BY archive_id, group_id),
ex AS (SELECT archive_id, group_id, string_agg(t, ';' ORDER BY t) AS extra FROM (SELECT archive_id, group_id, 'e' || (ok % 2) || '=' || arg_max(ok, raw_id) AS t FROM f WHERE ok % 3 > 0 GROUP BY archive_id, group_id, ok % 2) GROUP BY archive_id, group_id)
SELECT archive_id, group_id, count(*) AS n_sources, arg_min(said, raw_id) FILTER (WHERE said IS NOT NULL) AS said, coalesce(CASE WHEN count(said) > 0 THEN 'provided' END, arg_min(status, raw_id) FILTER (WHERE status <> 'missing'), 'missing') AS transcript_status,
  any_value(fj.flags) AS flags, any_value(rc.ref_counts) AS ref_counts, coalesce(any_value(ex.extra), '') AS extra, arg_min(title, raw_id) AS title, arg_min(date, raw_id) AS date, arg_min(speaker, raw_id) FILTER (WHERE speaker IS NOT NULL) AS speaker, arg_min(video_id, raw_id) FILTER (WHERE video_id IS NOT NULL) AS video_id, any_value(topics.topics) AS topics
FROM f JOIN tj AS topics USING (archive_id, group_id) JOIN fj USING (archive_id, group_id) JOIN rc USING (archive_id, group_id) LEFT JOIN ex USING (archive_id, group_id) GROUP BY archive_id, group_id""",
    "records_resolved_in_order": f"""WITH RECURSIVE {_RAW}, q AS (
  SELECT archive_id, raw_id, title, date, video_id, row_number() OVER (PARTITION BY archive_id ORDER BY raw_id) AS n, list_filter(['i' || video_id, 'dt' || date || title, 'yt' || left(date, 4) || title, 'd' || date], lambda x: x IS NOT NULL) AS ks FROM r0
), s AS (
  SELECT DISTINCT archive_id, CAST(0 AS BIGINT) AS n, map(CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])) AS known, map(CAST([] AS VARCHAR[]), CAST([] AS STRUCT(t VARCHAR, d VARCHAR, v VARCHAR)[])) AS merged, CAST(NULL AS VARCHAR) AS raw_id, CAST(NULL AS VARCHAR) AS home FROM r0
  UNION ALL
  SELECT archive_id, n, map_concat(known, map(allk, list_transform(allk, lambda x: home))), map_concat(merged, map([home], [m])), raw_id, home
  FROM (SELECT *, list_distinct(list_concat(ks, list_filter(['i' || m.v, 'dt' || m.d || m.t, 'yt' || left(m.d, 4) || m.t, 'd' || m.d], lambda x: x IS NOT NULL))) AS allk
    FROM (SELECT *, {{'t': coalesce(merged[home].t, title), 'd': coalesce(merged[home].d, date), 'v': coalesce(merged[home].v, video_id)}} AS m
      FROM (SELECT q.*, known, merged, coalesce(list_filter(list_transform(ks, lambda x: known[x]), lambda x: x IS NOT NULL)[1], q.raw_id) AS home FROM s JOIN q ON q.archive_id = s.archive_id AND q.n = s.n + 1)))
)
SELECT archive_id, home AS group_id, count(*) AS n_sources, arg_min(title, raw_id) AS title, arg_min(date, raw_id) AS date FROM s JOIN r0 USING (archive_id, raw_id) GROUP BY archive_id, home""",
    "names_normalized": """WITH c AS (SELECT c_custkey AS k, c_name, c_custkey % 4 AS t, c_custkey % 3 AS s FROM customer)
SELECT CAST(k AS VARCHAR) AS record_id, CASE k % 5 WHEN 0 THEN 'Anna Bell' WHEN 1 THEN 'Anna Bell' WHEN 4 THEN CASE WHEN k <> 9 THEN c_name END END AS speaker,
  CASE WHEN t = 0 THEN 'giv 2025' WHEN s = 0 AND k % 2 = 0 THEN 'giv 2022' WHEN s = 0 THEN 'GIV' WHEN s = 1 THEN 'New Name' WHEN t = 2 THEN 'Re:Member' WHEN t = 1 THEN '2 Samuel' END AS series,
  '1 Corinthians 15; Exodus 21-23' || CASE WHEN k % 5 = 3 THEN '; 1 Peter 2:11-12' ELSE '' END AS refs, 'Prayer; x' AS topics,
  CAST(CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE CASE WHEN k = 9 THEN 2 ELSE 0 END END + CASE WHEN s = 1 THEN 2 ELSE 0 END + CASE WHEN t = 0 THEN 1 WHEN s = 0 AND k % 2 = 0 THEN 1 WHEN s = 2 AND t IN (1, 2) THEN 1 ELSE 0 END + 3 + 1 AS BIGINT) AS n_log FROM c""",
    "names_by_tables": rf"""WITH {_BY_TABLES}
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN NOT ign THEN known END AS speaker, CASE WHEN takes THEN of_hall ELSE ser END AS series, coalesce(tname, topic) || '; x' AS topics,
  concat_ws('; ', CASE WHEN raw <> clean THEN 'change|speaker|' || raw || '|' || clean END, CASE WHEN ign THEN 'change|speaker|' || clean || '|; warning|speaker|' || clean || '|' END, CASE WHEN NOT ign AND known <> clean THEN 'change|speaker|' || clean || '|' || known END,
    CASE WHEN takes THEN 'change|series|' || coalesce(ser, '') || '|' || of_hall END, CASE WHEN tname IS NOT NULL THEN 'change|theme|' || topic || '|' || tname END) AS log FROM n""",
    "naming_summary": f"""WITH {_BY_TABLES}, e AS (
  SELECT 'scripture' AS scope, 'the' AS value, 'scripture field did not look like a Bible reference' AS reason, count(*) AS n FROM customer
  UNION ALL SELECT 'theme', 'prayers', 'configured alias', count(*) FROM customer
  UNION ALL SELECT 'speaker', 'a. bell', 'configured alias', count(*) FROM customer WHERE c_custkey % 5 = 1
  UNION ALL SELECT 'series', 'old name', 'configured alias', count(*) FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT 'speaker', 'Grace Church Team', 'speaker field looked like a church, team, or organization instead of a person', count(*) FROM customer WHERE c_custkey % 5 = 2
  UNION ALL SELECT 'speaker', '1 Peter 2:11-12', 'speaker field looked like a scripture reference', count(*) FROM customer WHERE c_custkey % 5 = 3
  UNION ALL SELECT 'speaker', c_name, 'speaker field looked like a church, team, or organization instead of a person', 1 FROM customer WHERE c_custkey = 9
  UNION ALL SELECT 'speaker', clean, 'configured alias', count(*) FROM n WHERE NOT ign AND known <> clean GROUP BY clean
  UNION ALL SELECT 'speaker', clean, 'speaker field looked like a church, team, or organization instead of a person', count(*) FROM n WHERE ign GROUP BY clean
  UNION ALL SELECT 'theme', topic, 'configured alias', count(*) FROM n WHERE tname IS NOT NULL GROUP BY topic)
SELECT scope, value, reason, CAST(sum(n) AS BIGINT) AS n FROM e WHERE n > 0 GROUP BY scope, value, reason ORDER BY n DESC, scope, value, reason LIMIT 40""",
    "naming_totals": f"""WITH {_BY_TABLES}, c AS (SELECT c_custkey AS k, c_custkey % 4 AS t, c_custkey % 3 AS s FROM customer), e AS (SELECT 'warning' AS kind, CAST(sum(1 + CASE WHEN k % 5 IN (2, 3) OR k = 9 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM c
UNION ALL SELECT 'change', CAST(sum(CASE WHEN k % 5 < 4 OR k = 9 THEN 1 ELSE 0 END + CASE WHEN s = 1 THEN 2 ELSE 0 END + CASE WHEN t = 0 THEN 1 WHEN s = 0 AND k % 2 = 0 THEN 1 WHEN s = 2 AND t IN (1, 2) THEN 1 ELSE 0 END + 3) AS BIGINT) FROM c
UNION ALL SELECT 'warning', count(*) FROM n WHERE ign
UNION ALL SELECT 'change', CAST(sum(CASE WHEN raw <> clean THEN 1 ELSE 0 END + CASE WHEN ign OR known <> clean THEN 1 ELSE 0 END + CASE WHEN takes THEN 1 ELSE 0 END + CASE WHEN tname IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) FROM n)
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY kind""",
    "near_duplicate_names": r"""WITH RECURSIVE v AS (
  SELECT p_brand AS archive_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 5 = 0 THEN ' s' ELSE '' END AS value FROM part
), n AS (SELECT archive_id, value, count(*) AS n, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS key, lower(value) AS fold FROM v GROUP BY archive_id, value),
w AS (SELECT *, string_split(key, ' ') AS ws FROM n WHERE key <> ''),
p AS (
  SELECT row_number() OVER () AS pid, a.archive_id, a.value, b.value AS replacement, a.n AS n_value, b.n AS n_replacement, len(a.ws) > 1 AND len(b.ws) > 1 AND a.ws[1] = b.ws[1] AS same,
    CASE WHEN same THEN a.ws[-1] ELSE a.key END AS x, CASE WHEN same THEN b.ws[-1] ELSE b.key END AS y, CASE WHEN same THEN 0.78 ELSE 0.92 END AS least
  FROM w a JOIN w b ON a.archive_id = b.archive_id AND (a.fold, a.value) < (b.fold, b.value) AND a.key <> b.key
), c AS (
  SELECT * FROM p WHERE 2 * least(length(x), length(y)) >= least * (length(x) + length(y))
    AND 2 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda q: least(length(x) - length(replace(x, q, '')), length(y) - length(replace(y, q, ''))))) >= least * (length(x) + length(y))
), s AS (
  SELECT pid, CAST(0 AS BIGINT) AS pos, x, y, CAST(0 AS BIGINT) AS k FROM c
  UNION ALL
  SELECT pid, CASE WHEN side = 1 THEN pos ELSE pos + b.i - 1 + b.k END AS pos, CASE WHEN side = 1 THEN substr(x, 1, b.i - 1) ELSE substr(x, b.i + b.k) END AS x, CASE WHEN side = 1 THEN substr(y, 1, b.j - 1) ELSE substr(y, b.j + b.k) END AS y, CASE WHEN side = 1 THEN b.k ELSE 0 END AS k
  FROM (
    SELECT pid, pos, x, y, arg_max({'i': i, 'j': j, 'k': k}, k * 1000000 - i * 1000 - j) AS b
    FROM (SELECT *, unnest(range(1, least(length(x) - i, length(y) - j) + 2)) AS k FROM (SELECT *, unnest(range(1, length(y) + 1)) AS j FROM (SELECT pid, pos, x, y, unnest(range(1, length(x) + 1)) AS i FROM s WHERE x <> '' AND y <> '')) WHERE substr(x, i, 1) = substr(y, j, 1))
    WHERE substr(x, i, k) = substr(y, j, k) GROUP BY pid, pos, x, y
  ), (VALUES (1), (2)) AS sides(side)
), m AS (SELECT pid, sum(k) AS matched FROM s GROUP BY pid)
SELECT archive_id, value, replacement, n_value, n_replacement FROM c JOIN m USING (pid) WHERE 2.0 * matched / (length(x) + length(y)) >= least""",
    "term_frequency": f"WITH {_TF} SELECT archive_id, term, df, n, round(idf, 6) AS idf FROM df",
    "token_totals": f"WITH {_TF} SELECT record_id, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_terms FROM tf GROUP BY record_id",
    "vector_norms": f"""WITH {_TF}, w AS (SELECT tf.*, (1 + ln(tf)) * idf AS weight FROM tf JOIN df USING (archive_id, term)), v AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(weight, 9) DESC, term) AS rn FROM w)
SELECT record_id, count(*) AS n, round(sqrt(sum(weight * weight)), 4) AS norm FROM v WHERE rn <= 180 GROUP BY record_id""",
    "content_index": _INDEX,
    "content_labels": f"""WITH {TALKS}, s AS (SELECT record_id, coalesce(series, '') AS m, replace(lower(CASE WHEN CAST(record_id AS BIGINT) % 2 = 0 THEN 'Grace and mercy. ' ELSE 'The Holy Spirit, hope! ' END || coalesce(transcript_text, '') || CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN ' we pray in prayer, love, love, money' ELSE '' END), 'ß', 'ss') AS f0,
  CASE WHEN CAST(record_id AS BIGINT) % 2 = 0 THEN 'Grace and mercy. ' ELSE 'The Holy Spirit, hope! ' END || coalesce(transcript_text, '') || CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN ' we pray in prayer, love, love, money' ELSE '' END AS raw FROM t)
SELECT record_id, label, CAST(sum(8 * {_hits('m')} + 3 * {_hits("replace(lower(left(raw, 5000)), 'ß', 'ss')")} + {_hits('f0')}) AS BIGINT) AS score FROM s, {_WORDS} GROUP BY record_id, label, least
HAVING sum(8 * {_hits('m')} + 3 * {_hits("replace(lower(left(raw, 5000)), 'ß', 'ss')")} + {_hits('f0')}) >= least""",
    "enriched": f"""WITH {TALKS}, i AS (SELECT *, CAST(record_id AS BIGINT) % 10 AS q FROM t)
SELECT record_id, CASE WHEN q < 2 THEN summary WHEN q = 2 THEN 'plain ' || record_id ELSE 's' || record_id END AS summary, CASE WHEN q >= 2 THEN 'ai_generated_review_required' END AS summary_status,
  CASE WHEN q > 2 AND themes[1] = 'Theme 0' THEN array_to_string(list_append(themes, 'new'), ';') WHEN q > 2 THEN array_to_string(list_concat(themes, ['Theme 0', 'new']), ';') ELSE array_to_string(themes, ';') END AS themes,
  len(review_flags) + CASE WHEN q = 1 THEN 0 ELSE 1 END AS n_flags FROM i""",
    "record_pages": rf"""WITH {TALKS}, s AS (SELECT *, coalesce(nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), '{rules.UNTITLED}') AS safe, list_concat(review_flags, questionable_claims) AS fl FROM t)
SELECT archive_id, coalesce(date || ' - ', '') || safe || '.md' AS path, md5(concat_ws(chr(10), '# ' || coalesce(title, ''),
  CASE WHEN len(fl) > 0 THEN '> [!warning] Review needed' || chr(10) || array_to_string(list_transform(fl, lambda x: '> - ' || x), chr(10)) END, '## Metadata',
  '- **Date:** ' || coalesce(date, 'Review needed'), '- **Speaker:** ' || coalesce('[[' || speaker || ']]', 'Review needed'), '- **Series:** ' || coalesce('[[' || series || ']]', 'Review needed'), '- **Scripture:** Review needed',
  '- **Transcript status:** ' || transcript_status, '## Generated Summary', coalesce(summary, '_No summary._'), '## Transcript', CASE WHEN has_text THEN regexp_replace(transcript_text, '^\s+|\s+$', '', 'g') ELSE '_No transcript text is available yet._' END)) AS digest FROM s""",
    "sentence_candidates": rf"""WITH {_TF}, s AS (SELECT archive_id, record_id, unnest(regexp_split_to_array(regexp_replace(transcript_text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS raw, generate_subscripts(regexp_split_to_array(regexp_replace(transcript_text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), 1) - 1 AS position FROM t WHERE has_text),
c AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS sentence FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY archive_id, record_id ORDER BY position) AS n FROM c WHERE length(sentence) BETWEEN 55 AND 420 AND NOT regexp_matches(replace(lower(sentence), 'ß', 'ss'), '{_SKIP}') AND len({_tokens('sentence')}) >= 8)
SELECT record_id, count(*) AS n, CAST(min(position) AS BIGINT) AS first, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM k WHERE n <= 900 GROUP BY record_id""",
    "related_records": f"""WITH {_TF}, w AS (SELECT tf.*, (1 + ln(tf)) * idf AS weight FROM tf JOIN df USING (archive_id, term)), v AS (SELECT *, row_number() OVER (PARTITION BY archive_id, record_id ORDER BY round(weight, 9) DESC, term) AS rn FROM w),
x AS (SELECT archive_id, record_id, term, weight FROM v WHERE rn <= 180), nm AS (SELECT archive_id, record_id, sqrt(sum(weight * weight)) AS norm FROM x GROUP BY ALL),
dot AS (SELECT a.archive_id, a.record_id AS a, b.record_id AS b, sum(a.weight * b.weight) AS dot FROM x a JOIN x b ON a.archive_id = b.archive_id AND a.term = b.term AND a.record_id <> b.record_id GROUP BY ALL),
l AS (SELECT archive_id, record_id, series, list_distinct(list_transform(list_concat(topics, themes), lambda q: lower(q))) AS labels,
  list_distinct(list_concat(CASE WHEN i % 3 > 0 THEN ['john ' || (i % 5), 'luke ' || (i % 7)] ELSE [] END, CASE WHEN i % 2 = 0 THEN ['john ' || (i % 5), 'mark ' || (i % 2), 'acts ' || (i % 11)] ELSE [] END)) AS refs FROM (SELECT *, CAST(record_id AS BIGINT) AS i FROM t)),
pairs AS (SELECT p.archive_id, p.record_id AS a, q.record_id AS b, CASE WHEN p.series = q.series THEN 0.05 ELSE 0 END + least(0.08, 0.02 * len(list_intersect(p.refs, q.refs))) + least(0.08, 0.02 * len(list_intersect(p.labels, q.labels))) AS bonus FROM l p JOIN l q ON p.archive_id = q.archive_id AND p.record_id <> q.record_id),
sc AS (SELECT archive_id, a, b, round(CAST(bonus AS DOUBLE) + coalesce(dot / (m.norm * n.norm), 0), 9) AS score FROM pairs LEFT JOIN dot USING (archive_id, a, b) LEFT JOIN nm m ON m.archive_id = pairs.archive_id AND m.record_id = a LEFT JOIN nm n ON n.archive_id = pairs.archive_id AND n.record_id = b),
rk AS (SELECT *, row_number() OVER (PARTITION BY archive_id, a ORDER BY score DESC, b) AS rank FROM sc WHERE score >= 0.12)
SELECT archive_id, a AS record_id, b AS other_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5""",
    "theme_documents": f"""WITH {TALKS}, x AS (SELECT archive_id, record_id, title, date, unnest(list_concat(topics, themes)) AS name FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY archive_id, name ORDER BY coalesce(date, '9999-99-99'), replace(lower(coalesce(title, '')), 'ß', 'ss'), record_id) AS n, coalesce(date || ' - ', '') || coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), '{rules.UNTITLED}') AS stem, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS label FROM x),
z AS (SELECT *, CAST(floor((n - 1) / 50) AS BIGINT) AS page, '- [[' || stem || CASE WHEN label <> '' AND label <> stem THEN '|' || label ELSE '' END || ']]' AS line FROM y)
SELECT archive_id, name || CASE WHEN page > 0 THEN ' ' || (page + 1) ELSE '' END || '.md' AS path, md5('# ' || name || chr(10) || chr(10) || 'Theme index generated for private review.' || chr(10) || chr(10) || '## Records' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10)) AS digest FROM z GROUP BY archive_id, name, page""",
    "ingest_rows": f"WITH {TALKS} SELECT archive_id, record_id, '| ' || coalesce(date, '?') || ' | ' || coalesce(title, '') || ' | ' || transcript_status || ' | ' || array_to_string(list_concat(review_flags, questionable_claims), '; ') || ' |' AS row FROM t",
    "related_resolved": f"""WITH {TALKS}, s AS (SELECT *, coalesce(date || ' - ', '') || coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), '{rules.UNTITLED}') AS stem FROM t),
w AS (SELECT archive_id, record_id, unnest(list_filter([title, stem, 'no such record'], lambda q: q IS NOT NULL)) AS label, generate_subscripts(list_filter([title, stem, 'no such record'], lambda q: q IS NOT NULL), 1) - 1 AS place FROM s),
a AS (SELECT archive_id, title AS label, max(record_id) AS t0 FROM s WHERE title IS NOT NULL GROUP BY ALL), b AS (SELECT archive_id, stem AS label, max(record_id) AS t1 FROM s GROUP BY ALL), c AS (SELECT archive_id, replace(stem, ' - ', ' ') AS label, max(record_id) AS t2 FROM s GROUP BY ALL)
SELECT archive_id, record_id, place, label, coalesce(t0, t1, t2) AS target_id FROM w LEFT JOIN a USING (archive_id, label) LEFT JOIN b USING (archive_id, label) LEFT JOIN c USING (archive_id, label) WHERE coalesce(t0, t1, t2) IS NOT NULL""",
    "alias_joined": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Canon ' || c_custkey ELSE upper(c_name) END AS name FROM customer",
    "first_rules": "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "changed_lines": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NULL OR b <> o_orderstatus",
    "page_fronts": f"WITH {TALKS} SELECT record_id, title, date, 'draft' AS status, len(questionable_claims) AS n_claims FROM t",
    "index_rows": f"WITH {TALKS} SELECT archive_id, speaker AS name, '| [[' || speaker || ']] | ' || count(*) || ' | ' || coalesce(min(date), '') || ' | ' || coalesce(max(date), '') || ' |' AS row FROM t WHERE speaker <> '' GROUP BY archive_id, speaker",
}
