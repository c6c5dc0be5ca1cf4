"""Queries over the concordance and the record indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import rules
from talkloom.functions.passages import citations, first_refs, parsed, refs, verse_counts
from talkloom.operators import concordance, indexes, records
from talkloom.plans.adapters import CITED, TALKS, cited, table, talks

_TOTALS = ("archive_id", "ref", "records", "mentions", "primary_records", "first_date", "latest_date")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.totals(concordance.entries(concordance.counted(cited(spark, sf_dir))))


def passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.ranked(concordance.flagged(_totals(spark, sf_dir)))


def frequent_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.frequent(_totals(spark, sf_dir)).select(*_TOTALS, "flag")


def passage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.entries(concordance.counted(cited(spark, sf_dir))).select("archive_id", "record_id", "date", "ref", "mentions", "is_primary")


def passage_first_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("record_id", F.array_join(first_refs(citations("transcript_text"), 3), "; ").alias("refs"))


def passage_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _totals(spark, sf_dir).select("ref").distinct().withColumn("p", parsed("ref"))
    return refs.select("ref", "p.book", "p.start_chapter", "p.end_chapter", "p.specificity")


def passage_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes of inference: primary references, mentions, flags."""
    r = concordance.inferred(concordance.inferred(cited(spark, sf_dir)))
    return r.select("record_id", F.size("primary_refs").cast("long").alias("n_primary"), F.size("questionable_claims").cast("long").alias("n_claims"), F.array_join("review_flags", "; ").alias("flags"))


def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.by_name(indexes.placed(indexes.entity_index(talks(spark, sf_dir), F.array("series")), indexes.name_order()))


def speaker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.by_count(indexes.placed(indexes.entity_index(talks(spark, sf_dir), F.array("speaker")), indexes.count_order()))


def theme_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.by_name(indexes.entity_index(talks(spark, sf_dir), F.concat("topics", "themes")))


def theme_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = indexes.group_lists(talks(spark, sf_dir), F.concat("topics", "themes"), chunk=50)
    ids = F.array_join(F.transform("entries", lambda x: x["record_id"]), ",")
    return pages.select("archive_id", "name", F.col("page").cast("long").alias("page"), F.size("entries").cast("long").alias("n"), F.md5(ids.cast("binary")).alias("ids"))


def completeness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.completeness_counts(talks(spark, sf_dir), ["archive_id"])


def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.archive_stats(talks(spark, sf_dir), ["archive_id"])


def review_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.review_inbox(talks(spark, sf_dir)).select("record_id", "flags")


def completeness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.incomplete(talks(spark, sf_dir)).select("record_id", F.array_join("issues", "; ").alias("issues"))


def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("record_id", F.array_join(records.gap_flags(), "; ").alias("flags"))


def recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.recent(talks(spark, sf_dir)).select("archive_id", "record_id", F.col("newest").cast("long").alias("newest"))


def preview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.preview(talks(spark, sf_dir)).select("record_id", "date", "title", "flags")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.unique_paths(talks(spark, sf_dir)).select("archive_id", "record_id", "path")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.search(talks(spark, sf_dir), "speaker 1").select("record_id")


def index_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = records.sort_order("records", "number", True, ["name", "archive_id"])
    return indexes.placed(indexes.entity_index(talks(spark, sf_dir), F.array("series")), order).orderBy(*order).select("archive_id", "name", "records", "place")


def passage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference's place among all, and its row of the index page."""
    from talkloom.operators.pages import passage_rows

    total = indexes.placed(_totals(spark, sf_dir), concordance.rank_order())
    return total.select("archive_id", "ref", "place").join(passage_rows(total), ["archive_id", "ref"])


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-references and info box of pages that mention more references than are shown; three forms of media addresses."""
    from talkloom.functions.text import media_uri
    from talkloom.operators import pages

    part, ref = F.col("l_partkey") % 500, F.format_string("Psalm %d", F.col("l_suppkey") % 70 + 1)
    t = table(spark, sf_dir, "lineitem").groupBy(part.alias("part")).agg(F.array_sort(F.collect_set(ref)).alias("mentioned_refs"))  # 70 at most
    p = F.col("part")
    given = {"record_id": p.cast("string"), "series": F.when(p % 3 == 0, F.lit("S | s")), "speaker": F.when(p % 4 == 0, F.lit("[Ann]")), "primary_refs": F.when(p % 5 > 0, F.transform(F.slice("mentioned_refs", 1, 2), F.upper)), "topics": F.when(p % 2 == 0, F.array(F.lit("T")))}
    t = records.conform(t.withColumns(given).withColumn("mentioned_refs", F.when(p % 7 > 0, F.col("mentioned_refs"))))
    i = F.col("record_id").cast("int")
    address = media_uri(F.when(i % 3 == 0, F.concat(F.lit("/a b/"), "record_id")).when(i % 3 == 1, F.lit(" https://x/y z ")).otherwise("a b.mp3"))
    return t.select("record_id", F.array_join(pages.cross_references(), "\n").alias("lines"), pages.box_references().alias("box"), address.alias("address"))


def transcript_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talks(spark, sf_dir).where(records.has_text())
    digest = lambda c: F.md5(c.cast("binary"))
    return t.select("record_id", digest(records.excerpt(200)).alias("head"), digest(records.excerpt(0, False)).alias("short"), F.size(F.split(records.excerpt(), "\n\n")).cast("long").alias("paragraphs"))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the saved pages by the transcript rules: closed paragraphs, or all text."""
    from talkloom.sources.html import transcript_text

    read = table(spark, sf_dir, "pages").select("page_id", transcript_text("html").alias("text"))
    return read.select("page_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n\n")).cast("long").alias("paragraphs"))


def passage_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations checked against a table of verses: one less in each chapter than the greatest that is cited there."""
    li, b = table(spark, sf_dir, "lineitem"), (F.col("l_partkey") % 66 + 1).cast("int")
    book, chapters = (F.element_at(F.array(*[F.lit(x[k]) for x in rules.BOOKS.items()]), b) for k in (0, 1))
    cited_ = li.select("l_orderkey", "l_linenumber", book.alias("book"), (1 + F.col("l_suppkey") % chapters).cast("int").alias("chapter"), F.col("l_linenumber").alias("verse"))
    verses = verse_counts(cited_.groupBy("book", "chapter").agg((F.max("verse") - 1).alias("verses")))
    found = citations(F.format_string("In %s %d:%d it says", "book", "chapter", "verse"), verses=verses)
    return cited_.select("l_orderkey", "l_linenumber", F.array_join(refs(found), ";").alias("refs"))


QUERIES = {
    f.__name__: f
    for f in (
        passage_index, frequent_passages, passage_entries, passage_first_refs, passage_parsed, passage_inferred, series_index, speaker_index, theme_index, theme_pages, completeness_counts, archive_stats,
        review_inbox, completeness_report, gap_flags, recent_records, preview_records, page_paths, text_search, index_sorted, passage_places, page_references, transcript_excerpts, page_parts, passage_verses,
    )
}

_FLAG = "CASE WHEN spec = 0 THEN NULL WHEN records >= 3 THEN 'Frequent passage' WHEN records >= 2 AND mentions >= 2 THEN 'Repeated passage' WHEN mentions >= 5 THEN 'Often mentioned' END"
_ORDER = "coalesce(date, '9999-99-99'), replace(lower(coalesce(title, '')), 'ß', 'ss'), record_id"


def _index(names: str) -> str:
    return f"WITH {TALKS} SELECT archive_id, name, count(*) AS records, min(date) AS first_date, max(date) AS latest_date FROM (SELECT archive_id, date, unnest({names}) AS name FROM t) WHERE name <> '' GROUP BY archive_id, name"


_SUMMARY, _AUDIO = "(summary IS NOT NULL)", "(len(audio_files) > 0)"
_n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
ORACLES = {
    "passage_index": f"WITH {CITED} SELECT archive_id, ref, records, mentions, primary_records, first_date, latest_date, {_FLAG} AS flag FROM tot",
    "frequent_passages": f"WITH {CITED} SELECT * FROM (SELECT archive_id, ref, records, mentions, primary_records, first_date, latest_date, {_FLAG} AS flag FROM tot) WHERE flag IS NOT NULL ORDER BY mentions DESC, records DESC, lower(ref), archive_id LIMIT 20",
    "passage_entries": f"WITH {CITED} SELECT archive_id, CAST(k AS VARCHAR) AS record_id, date, ref, mentions, is_primary FROM kept",
    "passage_first_refs": f"WITH {CITED} SELECT CAST(k AS VARCHAR) AS record_id, string_agg(ref, '; ' ORDER BY pos) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM e) WHERE rn <= 3 GROUP BY k",
    "passage_parsed": f"WITH {CITED} SELECT DISTINCT ref, book, CAST(CASE WHEN spec = 0 THEN 0 ELSE ch END AS INTEGER) AS start_chapter, CAST(CASE WHEN spec = 0 THEN 0 ELSE ch END AS INTEGER) AS end_chapter, spec AS specificity FROM kept",
    "passage_inferred": f"""WITH {CITED}, g AS (
  SELECT k, ref, any_value(book) AS book, any_value(form) AS form, min(n) AS n FROM r GROUP BY k, ref
), s AS (SELECT g.* FROM g WHERE NOT (form = 0 AND EXISTS (SELECT 1 FROM g o WHERE o.k = g.k AND o.form <> 0 AND o.book = g.book)))
SELECT CAST(k AS VARCHAR) AS record_id, CASE WHEN k % 3 = 0 THEN 1 ELSE least(8, (SELECT count(*) FROM s WHERE s.k = g.k)) END AS n_primary,
  CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS n_claims, CASE WHEN k % 3 = 0 THEN '' ELSE 'Review inferred scripture reference.; ' END || 'Add or confirm speaker.; Add or confirm series.' AS flags FROM g GROUP BY k""",
    "passage_verses": f"""WITH {CITED.split(", said AS")[0].replace("WITH ", "")}, v AS (SELECT book, c, max(v) - 1 AS most FROM l GROUP BY book, c)
SELECT k AS l_orderkey, n AS l_linenumber, CASE WHEN v <= most THEN book || ' ' || c || ':' || v ELSE '' END AS refs FROM l JOIN v USING (book, c)""",
    "series_index": _index("[series]").replace("SELECT archive_id, name,", "SELECT row_number() OVER (ORDER BY replace(lower(name), 'ß', 'ss'), name, archive_id) AS place, archive_id, name,"),
    "speaker_index": _index("[speaker]").replace("SELECT archive_id, name,", "SELECT row_number() OVER (ORDER BY count(*) DESC, replace(lower(name), 'ß', 'ss'), name, archive_id) AS place, archive_id, name,"),
    "passage_places": f"""WITH {CITED} SELECT archive_id, ref, row_number() OVER (ORDER BY mentions DESC, lower(ref), ref, archive_id) AS place,
'| [[' || replace(ref, ':', ' ') || ']] | ' || records || ' | ' || mentions || ' | ' || primary_records || ' | ' || coalesce(first_date, '') || ' | ' || coalesce(latest_date, '') || ' |' AS row FROM tot""",
    "page_references": """WITH p AS (SELECT l_partkey % 500 AS part, list_sort(list_distinct(list('Psalm ' || (l_suppkey % 70 + 1)))) AS refs FROM lineitem GROUP BY l_partkey % 500),
m AS (SELECT part, CASE WHEN part % 7 > 0 THEN refs ELSE [] END AS men, CASE WHEN part % 5 > 0 THEN list_transform(refs[1:2], lambda x: upper(x)) ELSE [] END AS pri FROM p),
o AS (SELECT *, list_filter(men, lambda x: NOT list_contains(pri, upper(x))) AS other, list_filter(men[1:40], lambda x: NOT list_contains(pri, upper(x))) AS shown FROM m),
l AS (SELECT *, list_concat(CASE WHEN part % 3 = 0 THEN ['- **Series:** [[S s]]'] ELSE [] END, CASE WHEN part % 4 = 0 THEN ['- **Speaker:** [[Ann]]'] ELSE [] END, list_transform(pri, lambda x: '- **Scripture:** [[' || x || ']]'), list_transform(shown, lambda x: '- **Referenced Scripture:** [[' || x || ']]'),
  CASE WHEN len(men) > 40 THEN ['- **Referenced Scripture:** +' || (len(men) - 40) || ' more detected references'] ELSE [] END, CASE WHEN part % 2 = 0 THEN ['- **Topic:** [[T]]'] ELSE [] END) AS ls FROM o)
SELECT CAST(part AS VARCHAR) AS record_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE '- Review needed: no cross-references found yet.' END AS lines,
  array_to_string(list_concat(other[1:12], CASE WHEN len(other) > 12 THEN ['+' || (len(other) - 12) || ' more'] ELSE [] END), ', ') AS box, CASE part % 3 WHEN 0 THEN 'file:///a%20b/' || part WHEN 1 THEN 'https://x/y z' ELSE 'a b.mp3' END AS address FROM l""",
    "theme_index": _index("list_concat(topics, themes)"),
    "theme_pages": f"""WITH {TALKS}, x AS (SELECT archive_id, record_id, title, date, unnest(list_concat(topics, themes)) AS name FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY archive_id, name ORDER BY {_ORDER}) AS n FROM x)
SELECT archive_id, name, CAST(floor((n - 1) / 50) AS BIGINT) AS page, count(*) AS n, md5(string_agg(record_id, ',' ORDER BY n)) AS ids FROM y GROUP BY archive_id, name, floor((n - 1) / 50)""",
    "completeness_counts": f"""WITH {TALKS} SELECT archive_id, count(*) AS records, {_n(_AUDIO)} AS with_audio, {_n('has_text')} AS with_transcript, {_n('NOT has_text')} AS missing_transcript, {_n(_SUMMARY)} AS with_summary, {_n('NOT ' + _SUMMARY)} AS missing_summary,
{_n(_AUDIO + ' AND NOT has_text')} AS audio_missing_transcript, {_n(_AUDIO + ' AND NOT ' + _SUMMARY)} AS audio_missing_summary, {_n("transcript_status = 'catalog-listed' AND NOT has_text")} AS catalog_listed_missing_transcript FROM t GROUP BY archive_id""",
    "archive_stats": f"WITH {TALKS} SELECT archive_id, count(*) AS records, count(DISTINCT series) AS series, count(DISTINCT speaker) AS speakers, {_n('NOT has_text')} AS missing_text, count(*) AS drafts, {_n('len(review_flags) > 0 OR len(questionable_claims) > 0')} AS flagged FROM t GROUP BY archive_id",
    "review_inbox": f"WITH {TALKS} SELECT record_id, array_to_string(list_concat(list_concat(review_flags, questionable_claims), list_concat(CASE WHEN has_text THEN [] ELSE ['Missing transcript text'] END, CASE WHEN summary IS NULL THEN [] ELSE ['Review generated summary'] END)), '; ') AS flags FROM t WHERE len(review_flags) > 0 OR len(questionable_claims) > 0 OR NOT has_text OR summary IS NOT NULL",
    "completeness_report": f"""WITH {TALKS}, i AS (SELECT record_id, concat_ws('; ', CASE WHEN NOT has_text THEN 'Missing transcript text' END, CASE WHEN NOT {_SUMMARY} THEN 'Missing generated summary' END, CASE WHEN {_AUDIO} AND NOT has_text THEN 'Audio present but transcript text missing' END,
CASE WHEN {_AUDIO} AND NOT {_SUMMARY} THEN 'Audio present but generated summary missing' END, CASE WHEN transcript_status = 'catalog-listed' AND NOT has_text THEN 'Catalog lists a transcript, but local transcript text was not found' END) AS issues FROM t) SELECT * FROM i WHERE issues <> ''""",
    "gap_flags": f"""WITH {TALKS} SELECT record_id, concat_ws('; ', CASE WHEN len(review_flags) > 0 OR speaker IS NULL THEN 'Add or confirm speaker.' END, CASE WHEN series IS NULL THEN 'Add or confirm series.' END,
CASE WHEN transcript_status = 'missing' THEN 'Transcript missing; page is metadata-only until a transcript is added.' END) AS flags FROM t""",
    "recent_records": f"WITH {TALKS} SELECT archive_id, record_id, newest FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY coalesce(date, '9999-99-99') DESC, replace(lower(coalesce(title, '')), 'ß', 'ss') DESC, record_id DESC) AS newest FROM t) WHERE newest <= 12",
    "preview_records": f"WITH {TALKS} SELECT record_id, date, title, len(review_flags) + len(questionable_claims) AS flags FROM t ORDER BY {_ORDER} LIMIT 25",
    "page_paths": f"""WITH {TALKS}, s AS (SELECT *, trim(regexp_replace(lower(trim(concat_ws(' ', date, title))), '[^a-z0-9]+', '-', 'g'), '-') AS slug0 FROM t),
n AS (SELECT *, coalesce(nullif(slug0, ''), 'untitled') AS slug, row_number() OVER (PARTITION BY archive_id, coalesce(nullif(slug0, ''), 'untitled') ORDER BY {_ORDER}) AS n FROM s)
SELECT archive_id, record_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS path FROM n""",
    "text_search": f"WITH {TALKS} SELECT record_id FROM t WHERE contains(lower(concat_ws(' ', title, date, speaker, series, array_to_string(audio_files, ' '), transcript_status)), 'speaker 1')",
    "index_sorted": f"WITH {TALKS} SELECT row_number() OVER (ORDER BY count(*) DESC, series, archive_id) AS place, archive_id, series AS name, count(*) AS records FROM t WHERE series <> '' GROUP BY archive_id, series",
    "transcript_excerpts": rf"""WITH {TALKS}, x AS (SELECT record_id, regexp_replace(transcript_text, '^\s+|\s+$', '', 'g') AS s, transcript_text AS raw, trim(regexp_replace(transcript_text, '\s+', ' ', 'g')) AS one FROM t WHERE has_text)
SELECT record_id, md5(regexp_replace(left(s, 200), '\s+$', '') || CASE WHEN length(raw) > 200 THEN '...' ELSE '' END) AS head,
  md5(CASE WHEN length(one) <= 1200 THEN one ELSE rtrim(regexp_extract(left(one, 1198), '^(.*)\s', 1, 's')) || '...' END) AS short, CAST(len(string_split(s, chr(10) || chr(10))) AS BIGINT) AS paragraphs FROM x""",
}
