"""Text, date and list functions: columns in, columns out, built-in functions only.

White space is Unicode's, case folding is lower() with sharp s as ss, and
missing text is null; functions of null give null unless they say otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom.functions import rules

SPACES = r"(?U)\s+"
SENTENCE = r"(?<=[.!?])(?U:\s+)|\n+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def casefold(c: str | Column) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def normalized_value(c: str | Column) -> Column:
    """Trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def normalized_key(c: str | Column) -> Column:
    """For comparing names: case-folded, all but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9]+", " "))


def slugify(c: str | Column) -> Column:
    """For addresses; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "['’]", ""), "[^a-z0-9]+", "-")
    s = F.btrim(s, F.lit("-"))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def safe_filename(c: str | Column) -> Column:
    s = normalized_value(F.regexp_replace(col(c), r'[/\\:*?"<>|#\[\]^]+', " "))
    return F.when(s == "", F.lit(rules.UNTITLED)).otherwise(s)


def page_stem(date: str | Column, title: str | Column) -> Column:
    """A page's name from its date and title, either of which may be null."""
    name = safe_filename(F.coalesce(col(title), F.lit("")))
    return F.when(F.coalesce(col(date), F.lit("")) != "", F.concat(col(date), F.lit(" - "), name)).otherwise(name)


def smart_title(c: str | Column) -> Column:
    """Capitalised only if it has no lower-case letter at all."""
    s = stripped(c)
    return F.when(s == "", F.lit(rules.UNTITLED)).when(s.rlike(r"\p{Ll}"), s).otherwise(F.initcap(s))


def filename_date(stem: str | Column) -> Column:
    d = F.regexp_extract(stripped(stem), r"^(\d{4}-\d{2}-\d{2})[_ -]+.+", 1)
    return F.nullif(d, F.lit(""))


def filename_title(stem: str | Column) -> Column:
    s = stripped(stem)
    t = F.when(filename_date(s).isNotNull(), F.regexp_extract(s, r"^\d{4}-\d{2}-\d{2}[_ -]+(.+)$", 1)).otherwise(s)
    return smart_title(normalized_value(F.regexp_replace(t, "[_-]", " ")))


def normalize_date(c: str | Column) -> Column:
    """ISO dates as they are; m/d/yy, m/d/yyyy and yyyymmdd as ISO; other text unchanged, blank as null.

    Two-digit years from 69 are of the twentieth century.
    """
    s = stripped(c)
    us = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    year = F.regexp_extract(s, us, 3)
    whole = F.when(F.length(year) == 4, year).when(year >= "69", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    iso = F.concat_ws("-", whole, F.lpad(F.regexp_extract(s, us, 1), 2, "0"), F.lpad(F.regexp_extract(s, us, 2), 2, "0"))
    compact = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = lambda x: F.date_format(F.try_to_date(x, "yyyy-MM-dd"), "yyyy-MM-dd")
    out = F.when(s.rlike(us), F.coalesce(day(iso), s)).when(s.rlike(r"^\d{8}$"), F.coalesce(day(compact), s)).otherwise(s)
    return F.nullif(out, F.lit(""))


def split_list(c: str | Column) -> Column:
    """Parts between ; or |; between commas if that gives one part. Blank parts go; null gives none."""
    s = F.coalesce(stripped(c), F.lit(""))
    parts = F.when(s.rlike("[;|]"), F.split(s, "[;|]")).otherwise(F.split(s, ","))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def truthy(c: str | Column) -> Column:
    return F.coalesce(F.lower(stripped(c)).isin("1", "true", "yes", "y"), F.lit(False))


def duration_seconds(seconds: str | Column, minutes: str | Column) -> Column:
    """Whole seconds; minutes only where seconds are blank; unreadable numbers are null."""
    s, m = blank_to_null(seconds), blank_to_null(minutes)
    return F.when(s.isNotNull(), s.try_cast("double").cast("int")).otherwise((m.try_cast("double") * 60).cast("int"))


def stemmed(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(F.left(w, n - 3), F.lit("y")))
        .when((n > 5) & w.endswith("ing"), F.left(w, n - 3))
        .when((n > 4) & w.endswith("ed"), F.left(w, n - 2))
        .when((n > 4) & w.endswith("s"), F.left(w, n - 1))
        .otherwise(w)
    )


def raw_words(c: str | Column) -> Column:
    """Words of three characters or more, letters and apostrophes, in order."""
    return F.regexp_extract_all(casefold(F.coalesce(col(c), F.lit(""))), F.lit("([a-z][a-z']{2,})"), F.lit(1))


def carries_weight(word: Column) -> Column:
    """Of a word without outer apostrophes."""
    return (F.length(word) >= 3) & ~word.isin(*rules.STOPWORDS)


def tokens(c: str | Column) -> Column:
    """Stemmed words of three letters or more that carry weight, in order, with repeats."""
    words = F.transform(raw_words(c), lambda w: F.btrim(w, F.lit("'")))
    return F.transform(F.filter(words, carries_weight), stemmed)


def sentences(c: str | Column) -> Column:
    """Sentences in order, white space collapsed; blank ones stay, so that positions are those of the text."""
    return F.transform(F.split(F.coalesce(col(c), F.lit("")), SENTENCE), normalized_value)


def idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(c: Column, phrases: list[str]) -> Column:
    return c.rlike("|".join(map(re.escape, phrases)))


def shortened(c: str | Column, width: int) -> Column:
    """White space collapsed; cut after the last whole word (or hyphenated part) that leaves room for ``...``."""
    s = normalized_value(c)
    cut = F.regexp_extract(s, rf"^(.{{0,{width - 3}}})(?:(?=\s)|(?<=[A-Za-z]{{2}}-)(?=[A-Za-z]{{2}}))", 1)
    return F.when(F.length(s) <= width, s).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def wikilink(target: str | Column, label: str | Column | None = None) -> Column:
    clean = lambda x: normalized_value(F.replace(col(x), F.lit("|"), F.lit(" ")))
    t = clean(target)
    if label is None:
        return F.concat(F.lit("[["), t, F.lit("]]"))
    name = clean(label)
    return F.when((name != "") & (name != t), F.concat(F.lit("[["), t, F.lit("|"), name, F.lit("]]"))).otherwise(F.concat(F.lit("[["), t, F.lit("]]")))


def table_row(*cells: Column) -> Column:
    clean = [F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def media_uri(c: str | Column) -> Column:
    """Addresses as they are; absolute paths as file addresses; other paths unchanged."""
    s = stripped(c)
    return F.when(s.rlike("^(?:https?|file)://"), s).when(s.startswith("/"), F.concat(F.lit("file://"), F.replace(s, F.lit(" "), F.lit("%20")))).otherwise(s)


def strip_heading(c: str | Column) -> Column:
    """Without one leading ``# Transcript``."""
    return stripped(F.regexp_replace(col(c), r"(?iU)^\s*#\s*Transcript\s*", ""))


def unique_values(*arrays: str | Column) -> Column:
    """Arrays one after the other: trimmed, blanks dropped, the first spelling of each case-folded value."""
    empty = F.array().cast("array<string>")
    values = F.concat(*[F.coalesce(col(a), empty) for a in arrays])
    values = F.filter(F.transform(values, stripped), lambda x: x.isNotNull() & (x != ""))

    def firsts(vs: Column, ks: Column) -> Column:
        marked = F.transform(vs, lambda x, i: F.struct(x.alias("v"), (F.array_position(ks, F.get(ks, i)) == i + 1).alias("first")))
        return F.transform(F.filter(marked, lambda s: s["first"]), lambda s: s["v"])

    return let(values, lambda vs: let(F.transform(vs, casefold), lambda ks: firsts(vs, ks)))


def appended(array: Column, *values: Column) -> Column:
    """The array with each non-null value that it lacks, in order."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(array, empty), F.array_compact(F.array(*values)))
