"""Records derived from the given tables, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import rules
from talkloom.operators.records import conform


#: Added to the ids of the records without a text; a multiple of what the gaps go by.
BARE = 10_080_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document with its text: archives by source, gaps in the fields by id. Every sixth is listed once more without a text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    d = d.unionByName(d.where(i % 6 == 0).select((i + BARE).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source"))
    opt = lambda n, c: F.when(i % n != 0, c)
    lists = lambda cond, *x: F.when(cond, F.array(*x)).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("", F.lit(""), (i % 23).cast("string"))
    return conform(
        d.select(
            F.col("source").alias("archive_id"), i.cast("string").alias("record_id"), F.trim(F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(24))).alias("title"),
            opt(11, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (i % 700).cast("int")), "yyyy-MM-dd")).alias("date"), opt(7, F.concat(F.lit("Speaker "), text)).alias("speaker"), opt(5, F.col("lang")).alias("series"),
            lists(F.lit(True), F.concat(F.lit("Topic "), (i % 6).cast("string"))).alias("topics"), lists(F.lit(True), F.concat(F.lit("Theme "), (i % 4).cast("string")), F.concat(F.lit("Topic "), (i % 3).cast("string"))).alias("themes"),
            lists(i % 4 == 0, F.lit(rules.NO_SPEAKER)).alias("review_flags"), lists(i % 9 == 0, F.lit("claim")).alias("questionable_claims"), lists(i % 3 == 0, F.concat(F.lit("a"), i.cast("string"), F.lit(".mp3"))).alias("audio_files"),
            F.col("text").alias("transcript_text"), F.when(i < BARE, "provided").when(i % 12 == 0, "missing").otherwise("catalog-listed").alias("transcript_status"), F.when(i % 8 == 0, F.lit("S")).alias("summary"),
        )
    )


TALKS = f"""d AS (
  SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT doc_id + {BARE}, NULL, lang, source FROM documents WHERE doc_id % 6 = 0
), t AS (
  SELECT source AS archive_id, CAST(doc_id AS VARCHAR) AS record_id, nullif(trim(left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 24)), '') AS title,
    CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%d') END AS date,
    CASE WHEN doc_id % 7 <> 0 THEN 'Speaker ' || (doc_id % 23) END AS speaker, CASE WHEN doc_id % 5 <> 0 THEN lang END AS series,
    ['Topic ' || (doc_id % 6)] AS topics, ['Theme ' || (doc_id % 4), 'Topic ' || (doc_id % 3)] AS themes,
    CASE WHEN doc_id % 4 = 0 THEN ['{rules.NO_SPEAKER}'] ELSE CAST([] AS VARCHAR[]) END AS review_flags,
    CASE WHEN doc_id % 9 = 0 THEN ['claim'] ELSE CAST([] AS VARCHAR[]) END AS questionable_claims,
    CASE WHEN doc_id % 3 = 0 THEN ['a' || doc_id || '.mp3'] ELSE CAST([] AS VARCHAR[]) END AS audio_files,
    text AS transcript_text, CASE WHEN doc_id < {BARE} THEN 'provided' WHEN doc_id % 12 = 0 THEN 'missing' ELSE 'catalog-listed' END AS transcript_status,
    CASE WHEN doc_id % 8 = 0 THEN 'S' END AS summary, coalesce(regexp_matches(text, '\\S'), false) AS has_text
  FROM d
)"""  # fmt: skip

_BOOKS = list(rules.BOOKS.items())


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order whose text cites a passage for each line item, in five forms."""
    li = table(spark, sf_dir, "lineitem")
    b = (F.col("l_partkey") % 66 + 1).cast("int")
    book, chapters = (F.element_at(F.array(*[F.lit(x[k]) for x in _BOOKS]), b) for k in (0, 1))
    chapter, v, form = 1 + F.col("l_suppkey") % chapters, F.col("l_linenumber"), (F.col("l_partkey") + F.col("l_linenumber")) % 5
    text = F.format_string("%s %d:%d", book, chapter, v)
    said = F.when(form == 0, book).when(form == 1, F.format_string("%s %d", book, chapter)).when(form == 2, text).when(form == 3, F.format_string("%s chapter %d verse %d", book, chapter, v)).otherwise(F.format_string("%s-%d", text, v + 2))
    ref = F.when(form == 0, book).when(form == 1, F.format_string("%s %d", book, chapter)).when(form == 4, F.format_string("%s-%d", text, v + 2)).otherwise(text)
    lines = li.select("l_orderkey", "l_shipdate", F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("Turn to "), said, F.lit(".")).alias("said"), ref.alias("ref")).alias("x"))
    k = F.col("l_orderkey")
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("l_shipdate").alias("d"))  # an order has a few lines
    first = F.array(F.col("xs")[0]["ref"])
    return conform(
        orders.select(
            F.concat(F.lit("a"), (k % 4).cast("string")).alias("archive_id"), k.cast("string").alias("record_id"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.date_format("d", "yyyy-MM-dd").alias("date"),
            F.when(k % 3 == 0, first).otherwise(F.array().cast("array<string>")).alias("primary_refs"), F.array_join(F.transform("xs", lambda x: x["said"]), " ").alias("transcript_text"), F.lit("provided").alias("transcript_status"),
        )
    )


CITED = (
    "b AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}', {n})" for i, (name, n) in enumerate(_BOOKS)) + ") AS x(i, book, chapters)), "
    """l AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate, book, chapters, (l_partkey + l_linenumber) % 5 AS form, 1 + l_suppkey % chapters AS c, l_linenumber AS v
  FROM lineitem JOIN b ON l_partkey % 66 = i
), said AS (
  SELECT *, book || CASE form WHEN 0 THEN '' WHEN 1 THEN ' ' || c WHEN 4 THEN ' ' || c || ':' || v || '-' || (v + 2) ELSE ' ' || c || ':' || v END AS ref,
    CASE WHEN form = 0 THEN 0 WHEN form = 1 AND chapters > 1 THEN 1 ELSE 2 END AS spec, CASE WHEN form = 1 AND chapters = 1 THEN 1 ELSE c END AS ch,
    CASE form WHEN 3 THEN book || ' chapter ' || c || ' verse ' || v END AS other FROM l
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, coalesce(other, ref) || '.', ref) AS pos FROM said
), p AS (SELECT k, any_value(ref) FILTER (WHERE pos = 1) AS first_ref, strftime(min(l_shipdate), '%Y-%m-%d') AS date FROM r GROUP BY k
), e AS (
  SELECT k, ref, any_value(book) AS book, any_value(spec) AS spec, any_value(ch) AS ch, min(pos) AS pos, count(*) + CASE WHEN k % 3 = 0 AND min(pos) = 1 AND any_value(spec) > 0 THEN 1 ELSE 0 END AS mentions FROM r GROUP BY k, ref
), kept AS (
  SELECT e.*, 'a' || (e.k % 4) AS archive_id, p.date, e.k % 3 = 0 AND e.ref = first_ref AS is_primary FROM e JOIN p USING (k)
  WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.k = e.k AND o.book = e.book AND o.ref <> e.ref AND o.spec > e.spec AND (e.spec = 0 OR o.ch = e.ch))
), tot AS (
  SELECT archive_id, ref, any_value(spec) AS spec, count(*) AS records, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS primary_records, min(date) AS first_date, max(date) AS latest_date
  FROM kept GROUP BY archive_id, ref
)"""
)
