"""Indexes of records by name, and ordered picks from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import casefold, slugify
from talkloom.operators.positions import running_total
from talkloom.operators.records import SCOPE, chronological
from talkloom.operators.storage import stored


def entity_index(records: DataFrame, keys: Column, scope: list[str] = SCOPE) -> DataFrame:
    """records, first_date, latest_date by name; ``keys`` is an array of any number of names for each record.

    A name that a record has twice counts twice. Blank names are skipped.
    """
    date = F.nullif("date", F.lit(""))
    named = records.select(*scope, "date", F.explode(keys).alias("name")).where("name <> ''")
    return named.groupBy(*scope, "name").agg(F.count("*").alias("records"), F.min(date).alias("first_date"), F.max(date).alias("latest_date"))


def name_order(scope: list[str] = SCOPE) -> list[Column]:
    """By name whatever its case; ties by spelling, then scope."""
    return [casefold("name"), F.col("name"), *map(F.col, scope)]


def count_order(scope: list[str] = SCOPE) -> list[Column]:
    return [F.desc("records"), *name_order(scope)]


def by_name(index: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    return index.orderBy(*name_order(scope))


def by_count(index: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    return index.orderBy(*count_order(scope))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, each row's number in an order of all rows, by ranges."""
    return running_total(df, F.lit(1), order, "place")


def recent(records: DataFrame, most: int = 12, scope: list[str] = SCOPE) -> DataFrame:
    """The last records of each scope in chronological order, newest first by ``newest``."""
    order = [c.desc() for c in [*chronological(), F.col("record_id")]]
    w = Window.partitionBy(*scope).orderBy(*order)
    return records.withColumn("newest", F.row_number().over(w)).where(F.col("newest") <= most)


def preview(records: DataFrame, most: int = 25) -> DataFrame:
    """The first records in chronological order with their number of flags and claims."""
    return records.orderBy(*chronological(), "record_id").limit(most).withColumn("flags", (F.size("review_flags") + F.size("questionable_claims")).cast("long"))


def unique_paths(records: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """``path``: each record's page address; repeats get -2, -3 and so on in chronological order."""
    r = records.withColumn("slug", slugify(F.concat_ws(" ", "date", "title")))
    narrow = numbered(r.select(*scope, "slug", "record_id", "date", "title"), [*scope, "slug"], [*chronological(), F.col("record_id")])
    path = F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n"))
    return records.join(narrow.select(*scope, "record_id", path.alias("path")), [*scope, "record_id"])


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``n``: the place of each row among those of equal ``by``, from 1.

    All rows are put in one order by ranges, so that a popular value fills as many
    tasks as it needs; only each value's first place is looked up.
    """
    placed = stored(running_total(df, F.lit(1), [*map(F.col, by), *order], "_at"), "placed")
    first = placed.groupBy(*by).agg(F.min("_at").alias("_first")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(first, same).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias("n"))


def group_lists(records: DataFrame, keys: Column, scope: list[str] = SCOPE, chunk: int = 1000) -> DataFrame:
    """Pages of at most ``chunk`` entries by name: ordered structs of date, title and id, so that no popular name meets in one row or task."""
    order = [*chronological(), F.col("record_id")]
    named = records.select(*scope, "record_id", "title", "date", F.explode(keys).alias("name")).where("name <> ''")
    paged = numbered(named, [*scope, "name"], order).withColumn("page", F.floor((F.col("n") - 1) / chunk))
    entry = F.struct("n", "date", "title", "record_id")
    return paged.groupBy(*scope, "name", "page").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
