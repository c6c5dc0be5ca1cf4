"""The record table: its schema, and the projections and predicates over one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions import rules
from talkloom.functions.text import appended, casefold, col, shortened, stripped

_S, _L = T.StringType(), T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [
        *[T.StructField(n, _S) for n in ("archive_id", "record_id", "title", "date", "speaker", "series")],
        T.StructField("primary_refs", _L), T.StructField("mentioned_refs", _L), T.StructField("ref_counts", T.MapType(_S, T.IntegerType())),
        T.StructField("topics", _L), T.StructField("themes", _L), T.StructField("related", _L), T.StructField("source_files", _L), T.StructField("audio_files", _L),
        *[T.StructField(n, _S) for n in ("transcript_path", "transcript_text", "transcript_status", "video_url", "video_id")],
        T.StructField("duration_seconds", T.IntegerType()),
        *[T.StructField(n, _S) for n in ("status", "review_status", "summary", "summary_status", "summary_source")],
        T.StructField("questionable_claims", _L), T.StructField("review_flags", _L), T.StructField("extra", T.MapType(_S, _S)),
    ]
)
RAW = T.StructType([*SCHEMA.fields, T.StructField("source_kind", _S), T.StructField("source_rank", T.IntegerType()), T.StructField("source_ord", _S)])
SCOPE = ["archive_id"]
#: Flags that a merged text resolves.
RESOLVED = ["Audio file found; add transcript or run a separate transcription workflow.", "Catalog says a transcript exists, but no local transcript file/text was provided.", "HTML transcript file did not contain extractable transcript text."]


def conform(df: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """The schema's columns: typed, absent ones null, absent lists empty, blank text null; others dropped."""
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.dataType == _S and f.name != "transcript_text":
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def has_text(c: str = "transcript_text") -> Column:
    return F.coalesce(stripped(c) != "", F.lit(False))


def has_audio() -> Column:
    return F.coalesce(F.exists("audio_files", lambda x: stripped(x) != ""), F.lit(False))


def gap_flags(flags: str | Column = "review_flags") -> Column:
    """The flags with one for each of speaker, series and transcript that is missing."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return appended(col(flags), F.when(blank("speaker"), F.lit(rules.NO_SPEAKER)), F.when(blank("series"), F.lit(rules.NO_SERIES)), F.when(F.col("transcript_status") == "missing", F.lit(rules.NO_TRANSCRIPT)))


def unresolved_flags(flags: str | Column = "review_flags", text: str = "transcript_text") -> Column:
    """The flags without those that a text resolves, where there is one."""
    return F.when(has_text(text), F.filter(col(flags), lambda x: ~x.isin(*RESOLVED))).otherwise(col(flags))


def review_inbox(records: DataFrame) -> DataFrame:
    """Records that need a look: flagged, claimed, without text, or with a summary; ``flags`` joins all reasons."""
    reasons = F.concat(F.col("review_flags"), F.col("questionable_claims"), F.array_compact(F.array(F.when(~has_text(), F.lit("Missing transcript text")), F.when(has_text("summary"), F.lit("Review generated summary")))))
    return records.withColumn("flags", F.array_join(reasons, "; ")).where((F.size("review_flags") > 0) | (F.size("questionable_claims") > 0) | ~has_text() | has_text("summary"))


def completeness_issues() -> Column:
    text, summary = has_text(), has_text("summary")
    listed = F.coalesce(F.col("transcript_status") == "catalog-listed", F.lit(False))
    found = [(~text, "Missing transcript text"), (~summary, "Missing generated summary"), (has_audio() & ~text, "Audio present but transcript text missing"), (has_audio() & ~summary, "Audio present but generated summary missing"), (listed & ~text, "Catalog lists a transcript, but local transcript text was not found")]
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in found]))


def incomplete(records: DataFrame) -> DataFrame:
    return records.withColumn("issues", completeness_issues()).where(F.size("issues") > 0)


def completeness_counts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    text, summary, audio = has_text(), has_text("summary"), has_audio()
    listed = F.coalesce(F.col("transcript_status") == "catalog-listed", F.lit(False))
    return records.groupBy(*(by or [])).agg(
        F.count("*").alias("records"), n(audio).alias("with_audio"), n(text).alias("with_transcript"), n(~text).alias("missing_transcript"), n(summary).alias("with_summary"), n(~summary).alias("missing_summary"),
        n(audio & ~text).alias("audio_missing_transcript"), n(audio & ~summary).alias("audio_missing_summary"), n(listed & ~text).alias("catalog_listed_missing_transcript"),
    )


def archive_stats(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return records.groupBy(*(by or [])).agg(
        F.count("*").alias("records"), F.countDistinct(F.nullif("series", F.lit(""))).alias("series"), F.countDistinct(F.nullif("speaker", F.lit(""))).alias("speakers"), n(~has_text()).alias("missing_text"),
        n(F.coalesce(F.col("review_status"), F.lit("draft")) == "draft").alias("drafts"), n((F.size("review_flags") > 0) | (F.size("questionable_claims") > 0)).alias("flagged"),
    )


def search(records: DataFrame, query: str) -> DataFrame:
    """Records that hold the query in any searched field, whatever its case."""
    lists = [F.array_join(F.col(c), " ") for c in ("primary_refs", "mentioned_refs", "audio_files")]
    blob = F.concat_ws(" ", "title", "date", "speaker", "series", *lists, "transcript_status")
    return records.where(F.contains(F.lower(blob), F.lit(query.lower())))


def referenced_only(most: int | None = None) -> Column:
    """Mentioned references that aren't primary."""
    primary = F.transform("primary_refs", casefold)
    out = F.filter("mentioned_refs", lambda r: ~F.array_contains(primary, casefold(r)))
    return out if most is None else F.slice(out, 1, most)


def and_more(values: Column, most: int, all_: Column | None = None, words: str = "more") -> Column:
    """The first ``most`` values, and how many there are besides."""
    rest = F.size(values if all_ is None else all_) - most
    return F.concat(F.slice(values, 1, most), F.when(rest > 0, F.array(F.concat(F.lit("+"), rest.cast("string"), F.lit(f" {words}")))).otherwise(F.array().cast("array<string>")))


def excerpt(chars: int = 0, full: bool = True) -> Column:
    """The text for a page: its first characters, all of it, or a shortened line."""
    text = stripped("transcript_text")
    if chars > 0:
        return F.concat(F.regexp_replace(F.left(text, F.lit(chars)), r"(?U)\s+$", ""), F.when(F.length("transcript_text") > chars, F.lit("...")).otherwise(F.lit("")))
    return text if full else shortened(text, 1200)


def chronological() -> list[Column]:
    """By date, undated last, then by title."""
    return [F.coalesce(F.nullif("date", F.lit("")), F.lit("9999-99-99")), casefold(F.coalesce("title", F.lit("")))]


def sort_order(column: str, kind: str = "text", descending: bool = False, ties: list[str] | None = None) -> list[Column]:
    """As text, number or date; unreadable numbers and blank dates are least; ``ties`` go up."""
    key = {"text": casefold(F.coalesce(F.col(column).cast("string"), F.lit(""))), "number": F.coalesce(F.regexp_replace(F.col(column).cast("string"), ",", "").try_cast("double"), F.lit(float("-inf"))), "date": F.coalesce(F.col(column).cast("string"), F.lit(""))}[kind]
    return [key.desc() if descending else key.asc(), *map(F.col, ties or [])]


def sorted_index(df: DataFrame, column: str, kind: str = "text", descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(*sort_order(column, kind, descending, ties))


def catalog_status(has_transcript: Column, path: Column) -> tuple[Column, Column]:
    """Transcript status and flags of a catalog row."""
    listed = has_transcript & (F.coalesce(path, F.lit("")) == "")
    return F.when(listed, F.lit("catalog-listed")).otherwise(F.lit("catalog-only")), F.when(listed, F.array(F.lit(RESOLVED[1]))).otherwise(F.array().cast("array<string>"))


