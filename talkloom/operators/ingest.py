"""From sources to records: read, collected in order, resolved, inferred; and only what has changed of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import concordance, resolve
from talkloom.operators.records import SCOPE
from talkloom.sources import files


def sources(spark: SparkSession, archive: str = "archive", catalogs: Iterable[str] = (), transcripts: Iterable[str] = (), pages: Iterable[str] = (), captions: Iterable[str] = (), audio: Iterable[str] = (), videos: Iterable[str] = (), folders: Iterable[str] = ()) -> DataFrame:
    """The raw rows of all given sources of an archive; their kinds keep this order. Catalogs are told apart by their names' ends."""

    def catalog(path: str) -> DataFrame:
        read = files.json_catalog if path.rstrip("/").endswith(".json") else files.yaml_catalog if path.rstrip("/").endswith((".yaml", ".yml")) else files.csv_catalog
        return read(spark, path, archive)

    readers = [(catalogs, catalog)] + [(paths, lambda p, read=read: read(spark, p, archive)) for paths, read in ((transcripts, files.transcripts), (pages, files.html_pages), (captions, files.captions), (audio, files.audio_files), (videos, files.video_metadata), (folders, files.talk_folders))]
    found = [read(p) for paths, read in readers for p in paths]
    if not found:
        raise ValueError("no source is given")
    return files.collected(*found)


def ingested(raw: DataFrame, verses: dict | None = None, scope: list[str] = SCOPE, mode: str = "transitive", keys: tuple[str, ...] = resolve.KEYS) -> DataFrame:
    """Records of raw rows: rows of one talk folded into one, then references inferred and gaps flagged. ``record_id`` is the group's."""
    merged = resolve.resolved(raw, scope, mode, keys).withColumn("record_id", F.col("group_id"))
    return concordance.inferred(merged, verses)


def manifest(raw: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """scope, rows, sum1, sum2: a digest of each archive's raw rows, whatever their order; it combines before it moves."""
    columns = [F.to_json(c) if f.dataType.typeName() in ("map", "struct") else c for f in raw.schema for c in (F.col(f"`{f.name}`"),)]
    columns += [F.col(f"`{f.name}`").isNull() for f in raw.schema]
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return raw.groupBy(*scope).agg(F.count("*").alias("rows"), of("one").alias("sum1"), of("two").alias("sum2"))


def changes(before: DataFrame, now: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """scope, change: archives that are new, changed or gone between two manifests. A later run needs the first two only."""
    old = before.withColumnsRenamed({c: f"_{c}" for c in before.columns})
    same = F.lit(True)
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = now.join(old, same, "full_outer")
    equal = (F.col("rows") == F.col("_rows")) & (F.col("sum1") == F.col("_sum1")) & (F.col("sum2") == F.col("_sum2"))
    change = F.when(F.col("_rows").isNull(), "new").when(F.col("rows").isNull(), "gone").when(~equal, "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*[F.coalesce(c, f"_{c}").alias(c) for c in scope], "change")


def to_rerun(raw: DataFrame, found: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """The raw rows of new and changed archives."""
    todo = found.where("change <> 'gone'").select(*[F.col(c).alias(f"_{c}") for c in scope])
    same = F.lit(True)
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return raw.join(todo, same, "left_semi")
