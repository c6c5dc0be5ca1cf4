"""Passage concordance: citations counted by record, pruned, totalled and ranked.

Counting and pruning stay inside a row; the one shuffle is the total by
reference, which combines before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import rules
from talkloom.functions.passages import citation_counts, citations, opening_sentences, parsed, pruned, refs, specific_first
from talkloom.functions.text import appended, casefold, let, unique_values
from talkloom.operators.records import SCOPE, gap_flags


def inferred(records: DataFrame, verses: dict | None = None) -> DataFrame:
    """Primary references inferred where there are none, all mentions counted, gaps flagged."""
    empty = F.array().cast("array<string>")
    wanted = lambda c: citations(F.when(F.size("primary_refs") == 0, c), verses=verses)  # noqa: E731  (others are not read for it)
    r = records.withColumns({"_series": wanted(F.col("series")), "_title": wanted(F.col("title")), "_open": wanted(F.array_join(opening_sentences("transcript_text"), "\n"))})
    found = specific_first(unique_values(refs("_series"), refs("_title"), refs("_open")))
    guess = (F.size("primary_refs") == 0) & (F.size("_guess") > 0)
    r = r.withColumn("_guess", found).withColumns(
        {
            "questionable_claims": F.when(guess, appended(F.col("questionable_claims"), F.lit(rules.INFERRED_CLAIM))).otherwise(F.col("questionable_claims")),
            "review_flags": F.when(guess, appended(F.col("review_flags"), F.lit(rules.INFERRED_FLAG))).otherwise(F.col("review_flags")),
            "primary_refs": F.when(guess, F.col("_guess")).otherwise(F.coalesce("primary_refs", empty)),
        }
    )
    return counted(r.drop("_series", "_title", "_open", "_guess"), verses).withColumn("review_flags", gap_flags())


def counted(records: DataFrame, verses: dict | None = None) -> DataFrame:
    """``mentioned_refs`` and ``ref_counts`` from series, title, primary references and text."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", part("series"), part("title"), F.nullif(F.array_join("primary_refs", " "), F.lit("")), part("transcript_text"))
    r = records.withColumn("_found", citation_counts(text, verses))
    r = r.withColumn("mentioned_refs", unique_values("primary_refs", refs("_found")))
    counts = F.map_from_arrays(refs("_found"), F.transform("_found", lambda x: x["n"]))
    counts = let(F.struct(counts.alias("n"), F.col("mentioned_refs").alias("refs")), lambda b: F.map_from_arrays(b["refs"], F.transform(b["refs"], lambda x: F.coalesce(F.try_element_at(b["n"], x), F.lit(1)))))
    return r.withColumn("ref_counts", counts).drop("_found")


def entries(records: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """scope, record_id, title, date, ref, mentions, is_primary: one row for each record and pruned reference."""
    primary = F.transform("primary_refs", casefold)
    kept = pruned(unique_values("primary_refs", "mentioned_refs", F.map_keys("ref_counts")))
    r = records.select(*scope, "record_id", "title", "date", "speaker", "series", "ref_counts", primary.alias("_p"), F.explode(kept).alias("ref"))
    mentions = F.greatest(F.lit(1), F.coalesce(F.try_element_at("ref_counts", F.col("ref")), F.lit(1)))
    return r.select(*scope, "record_id", "title", "date", "speaker", "series", "ref", mentions.cast("long").alias("mentions"), F.array_contains("_p", casefold("ref")).alias("is_primary"))


def totals(found: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """records, mentions, primary_records, first_date, latest_date by reference, of :func:`entries` (a row for each record and reference)."""
    date = F.nullif("date", F.lit(""))
    return found.groupBy(*scope, "ref").agg(F.count("*").alias("records"), F.sum("mentions").alias("mentions"), F.sum(F.col("is_primary").cast("long")).alias("primary_records"), F.min(date).alias("first_date"), F.max(date).alias("latest_date"))


def flagged(total: DataFrame) -> DataFrame:
    """``flag``: how a specific reference stands out; null for others."""
    specific = F.coalesce(parsed("ref")["specificity"] > 0, F.lit(False))
    flag = F.when(F.col("records") >= 3, "Frequent passage").when((F.col("records") >= 2) & (F.col("mentions") >= 2), "Repeated passage").when(F.col("mentions") >= 5, "Often mentioned")
    return total.withColumn("flag", F.when(specific, flag))


def rank_order(scope: list[str] = SCOPE) -> list[Column]:
    """Most mentions first; ties by reference whatever its case, its spelling, then scope."""
    return [F.desc("mentions"), casefold("ref"), F.col("ref"), *map(F.col, scope)]


def ranked(total: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    return total.orderBy(*rank_order(scope))


def frequent(total: DataFrame, most: int = 20, scope: list[str] = SCOPE) -> DataFrame:
    """The flagged references that are mentioned most."""
    return flagged(total).where("flag IS NOT NULL").orderBy(F.desc("mentions"), F.desc("records"), casefold("ref"), *scope).limit(most)
