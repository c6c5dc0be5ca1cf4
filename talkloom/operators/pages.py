"""Publishable pages and report tables: DataFrames of (path, text), written by Spark."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import casefold, page_stem, safe_filename, table_row, wikilink
from talkloom.operators.records import and_more, excerpt, has_text, referenced_only
from talkloom.operators.storage import forgotten, stored

FRONT = ("title", "date", "speaker", "series", "primary_refs", "mentioned_refs", "ref_counts", "source_files", "audio_files", "video_url", "transcript_status", "status", "review_status", "summary_status", "questionable_claims", "review_flags")


def frontmatter(records: DataFrame) -> DataFrame:
    """record_id and the page's fields as JSON; the status is always draft."""
    draft = {"status": F.lit("draft"), "review_status": F.lit("draft")}
    return records.select("archive_id", "record_id", F.to_json(F.struct(*[draft.get(c, F.col(c)).alias(c) for c in FRONT])).alias("front"))


def record_pages(records: DataFrame, excerpt_chars: int = 0, full: bool = True) -> DataFrame:
    """archive_id, path, text: one Markdown page for each record."""
    link = lambda c: wikilink(safe_filename(c))
    or_needed = lambda c, x: F.when(F.coalesce(F.col(c), F.lit("")) != "", x).otherwise("Review needed")
    links = lambda a: F.array_join(F.transform(a, link), ", ")
    other = referenced_only()
    flags = F.concat("review_flags", "questionable_claims")
    lines: list[Column] = [
        F.concat(F.lit("# "), F.coalesce("title", F.lit(""))),
        F.when(F.size(flags) > 0, F.concat(F.lit("> [!warning] Review needed\n"), F.array_join(F.transform(flags, lambda x: F.concat(F.lit("> - "), x)), "\n"))),
        F.lit("## Metadata"), F.concat(F.lit("- **Date:** "), or_needed("date", F.col("date"))), F.concat(F.lit("- **Speaker:** "), or_needed("speaker", link("speaker"))), F.concat(F.lit("- **Series:** "), or_needed("series", link("series"))),
        F.concat(F.lit("- **Scripture:** "), F.when(F.size("primary_refs") > 0, links("primary_refs")).otherwise("Review needed")),
        F.when(F.size(other) > 0, F.concat(F.lit("- **Referenced Scripture:** "), links(F.slice(other, 1, 20)), F.when(F.size(other) > 20, F.concat(F.lit(", +"), (F.size(other) - 20).cast("string"), F.lit(" more"))).otherwise(""))),
        F.concat(F.lit("- **Transcript status:** "), F.coalesce("transcript_status", F.lit(""))), F.lit("## Generated Summary"), F.coalesce("summary", F.lit("_No summary._")),
        F.lit("## Transcript"), F.when(has_text(), excerpt(excerpt_chars, full)).otherwise("_No transcript text is available yet._"),
    ]
    return records.select("archive_id", F.concat(page_stem("date", "title"), F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


#: How many mentioned references a page's cross-references and an info box show.
REFERENCES, BOX_REFERENCES = 40, 12


def cross_references() -> Column:
    """The lines of a page's links to its series, speaker, references, topics, themes and related records.

    Of the first 40 mentioned references those that aren't primary are shown.
    """
    link = lambda c: wikilink(safe_filename(c))
    none = F.array().cast("array<string>")
    lines = lambda label, a: F.transform(F.coalesce(a, none), lambda x: F.concat(F.lit(f"- **{label}:** "), link(x)))
    one = lambda label, c: lines(label, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)))
    primary = F.transform("primary_refs", casefold)
    shown = F.filter(F.slice("mentioned_refs", 1, REFERENCES), lambda x: ~F.array_contains(primary, casefold(x)))
    rest = F.size("mentioned_refs") - REFERENCES
    more = F.when(rest > 0, F.array(F.concat(F.lit("- **Referenced Scripture:** +"), rest.cast("string"), F.lit(" more detected references")))).otherwise(none)
    found = F.concat(one("Series", "series"), one("Speaker", "speaker"), lines("Scripture", F.col("primary_refs")), lines("Referenced Scripture", shown), more, lines("Topic", F.col("topics")), lines("Theme", F.col("themes")), lines("Related sermon suggestion", F.col("related")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("- Review needed: no cross-references found yet.")))


def box_references() -> Column:
    """The mentioned references of an info box, 12 and how many more, as one text."""
    return F.array_join(and_more(referenced_only(), BOX_REFERENCES), ", ")


def index_rows(index: DataFrame) -> DataFrame:
    """The table rows of an entity index."""
    return index.select("archive_id", "name", table_row(wikilink(safe_filename("name")), F.col("records"), F.col("first_date"), F.col("latest_date")).alias("row"))


def passage_rows(total: DataFrame) -> DataFrame:
    """The table rows of the passage index."""
    return total.select("archive_id", "ref", table_row(wikilink(safe_filename("ref")), F.col("records"), F.col("mentions"), F.col("primary_records"), F.col("first_date"), F.col("latest_date")).alias("row"))


def group_pages(lists: DataFrame, kind: str) -> DataFrame:
    """archive_id, path, text: a document for each page of :func:`indexes.group_lists`, with a link for each of its entries."""
    link = lambda e: F.concat(F.lit("- "), wikilink(page_stem(e["date"], e["title"]), F.coalesce(e["title"], F.lit(""))))
    number = F.when(F.col("page") > 0, F.concat(F.lit(" "), (F.col("page") + 1).cast("string"))).otherwise("")
    head = [F.concat(F.lit("# "), F.col("name")), F.lit(""), F.lit(f"{kind} index generated for private review."), F.lit(""), F.lit("## Records"), F.lit("")]
    return lists.select("archive_id", F.concat(safe_filename("name"), number, F.lit(".md")).alias("path"), F.concat(F.concat_ws("\n", *head, F.array_join(F.transform("entries", link), "\n")), F.lit("\n")).alias("text"))


def ingest_rows(records: DataFrame) -> DataFrame:
    """The ingest report's table rows; its counts are :func:`records.completeness_counts`."""
    flags = F.array_join(F.concat("review_flags", "questionable_claims"), "; ")
    return records.select("archive_id", "record_id", table_row(F.coalesce(F.nullif("date", F.lit("")), F.lit("?")), F.col("title"), F.col("transcript_status"), flags).alias("row"))


def write(pages: DataFrame, path: str, form: str = "parquet", by: str = "archive_id") -> None:
    """Replaces only the archives that are in ``pages``; a large archive is dealt to several tasks."""
    pages.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(form).save(path)


def write_files(pages: DataFrame, folder: str) -> int:
    """One file for each (path, text) under ``folder`` of any file system that Arrow knows; gives their number.

    In two phases: tasks first write all files to a folder beside, which readers
    pass over, then move them into place. Where any page fails, the folder beside
    goes and all pages stay as they were. A repeated task writes, or moves, the same
    files again. Of rows with one path one stays.
    """
    folder = re.sub("^file:/+", "/", folder)
    beside = f"{folder}/_writing-{uuid.uuid4().hex}"

    def parents(system: object, whole: str, made: set[str]) -> None:
        parent = whole.rsplit("/", 1)[0]
        if parent not in made:
            system.create_dir(parent)
            made.add(parent)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, base = FileSystem.from_uri(beside)
        made: set[str] = set()
        for b in batches:
            for path, text in zip(b.column(0), b.column(1), strict=True):
                whole = f"{base}/{path.as_py()}"
                parents(system, whole, made)
                with system.open_output_stream(whole) as f:
                    f.write((text.as_py() or "").encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        (system, base), (_, there) = FileSystem.from_uri(folder), FileSystem.from_uri(beside)
        made: set[str] = set()
        for b in batches:
            for path in b.column(0).to_pylist():
                parents(system, f"{base}/{path}", made)
                if system.get_file_info(f"{there}/{path}").type != FileType.NotFound:  # else it has been moved
                    system.move(f"{there}/{path}", f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    try:
        written = stored(pages.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(put, "path string"), "written")
        n = written.mapInArrow(move, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        forgotten(written)
        return n
    finally:
        _removed(beside)


def _removed(folder: str) -> None:
    from pyarrow.fs import FileSystem, FileType

    system, path = FileSystem.from_uri(folder)
    if system.get_file_info(path).type == FileType.Directory:
        system.delete_dir(path)
