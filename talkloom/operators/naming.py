"""Names made uniform by rule tables, with a log of every change and of likely duplicates."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions import rules
from talkloom.functions.passages import _book_of, citations, refs
from talkloom.functions.text import appended, casefold, col, let, normalized_key, normalized_value, unique_values
from talkloom.operators.records import SCOPE
from talkloom.operators.resolve import first_rule
from talkloom.operators.storage import stored

#: Rules given by hand are looked up in the plan up to so many, and joined beyond; tables are always joined.
BY_HAND = 1000
Rules = dict | DataFrame | None


def _plain_key(s: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", s.casefold()).split())


def alias_map(given: dict) -> dict[str, str]:
    """Normalised key to canonical name, from canonical: [aliases] or alias: canonical. Canonical names map to themselves."""
    out = {}
    for name, value in given.items():
        canonical, others = (name, value) if isinstance(value, list) else (value, [name])
        canonical = " ".join(str(canonical).split())
        for x in (canonical, *others):
            if _plain_key(str(x)) and canonical:
                out[_plain_key(str(x))] = canonical
    return out


def aliased(c: str | Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a value, or the value, by a map in the plan."""
    if not aliases:
        return col(c)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, normalized_key(c)), col(c))


def alias_table(spark: SparkSession, aliases: Rules) -> dict[str, str] | DataFrame:
    """What :func:`alias_map` makes of a few rules; of many, and of a table of (alias, canonical, optionally ord), rows of (key, canonical).

    Of a table's rows with one key the last by ``ord`` counts, without it the greatest name; canonical names stand for themselves unless a row says otherwise.
    """
    if not isinstance(aliases, DataFrame):
        few = alias_map(aliases or {})
        return few if len(few) <= BY_HAND else spark.createDataFrame(list(few.items()), "key string, canonical string")
    ord_ = F.col("ord") if "ord" in aliases.columns else F.lit(0)
    given = aliases.select(normalized_key("alias").alias("key"), normalized_value("canonical").alias("canonical"), F.lit(1).alias("said"), ord_.alias("ord"))
    itself = given.select(normalized_key("canonical").alias("key"), "canonical", F.lit(0).alias("said"), "ord")
    rows = given.unionByName(itself).where("key <> '' AND canonical <> ''")
    return rows.groupBy("key").agg(F.max_by("canonical", F.struct("said", "ord", "canonical")).alias("canonical"))


def apply_alias_table(df: DataFrame, column: str, aliases: dict[str, str] | DataFrame, into: str | None = None) -> DataFrame:
    """The canonical name of a column's values, or the values; a table of (key, canonical) of any size is joined."""
    if isinstance(aliases, dict):
        return df.withColumn(into or column, aliased(column, aliases))
    a = aliases.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
    return df.withColumn("_k", normalized_key(column)).join(a, F.col("_k") == F.col("_key"), "left").withColumn(into or column, F.coalesce("_canonical", column)).drop("_k", "_key", "_canonical")


def _apply_to_lists(df: DataFrame, column: str, aliases: dict[str, str] | DataFrame, into: str) -> DataFrame:
    """The same for every value of a list; a table is joined with the values of distinct lists only."""
    if isinstance(aliases, dict):
        return df.withColumn(into, F.transform(column, lambda x: aliased(x, aliases)))
    lists = df.select(F.col(column).alias("_list")).where("_list IS NOT NULL").distinct()
    one = apply_alias_table(lists.select("_list", F.posexplode("_list").alias("_at", "_value")), "_value", aliases)
    new = one.groupBy("_list").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"]).alias("_new"))
    return df.join(new, F.col(column) == F.col("_list"), "left").withColumn(into, F.coalesce("_new", column)).drop("_list", "_new")


def _is_listed(df: DataFrame, key: str, names: list[str] | DataFrame | None, into: str) -> DataFrame:
    """Whether a key is that of one of the names; a table of ``name`` is joined."""
    if isinstance(names, DataFrame):
        listed = names.select(normalized_key("name").alias("_key")).where("_key <> ''").distinct()
        return df.join(listed, F.col(key) == F.col("_key"), "left").withColumn(into, F.col("_key").isNotNull()).drop("_key")
    few = [k for k in map(_plain_key, names or []) if k]
    return df.withColumn(into, F.coalesce(F.col(key).isin(*few), F.lit(False)) if few else F.lit(False))


def titles_by_phrase(df: DataFrame, rules_: DataFrame, key: str = "_tkey") -> DataFrame:
    """Adds ``_title``, the first rule (by ``ord``) whose ``phrase`` stands in the title as whole words: STRUCT<series, reason, override>.

    Rules of any number are listed under the word of theirs that the fewest rules
    have, and joined to the words of distinct titles.
    """
    r = rules_.select("ord", normalized_key("phrase").alias("phrase"), normalized_value("series").alias("series"), F.col("override").cast("boolean").alias("override")).where("phrase <> '' AND series <> ''")
    words = r.select("ord", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n"))
    under = words.join(rare, "word").groupBy("ord", "phrase").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    listed = r.join(under, ["ord", "phrase"])
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    titles = df.select(F.col(key).alias("_key")).where("_key <> ''").distinct()
    met = titles.select("_key", F.explode(F.array_distinct(F.split("_key", " "))).alias("word")).join(listed, "word").where(F.contains(padded("_key"), padded("phrase")))
    rule = F.struct("series", F.lit("series inferred from title pattern").alias("reason"), "override")
    return df.join(first_rule(met.withColumn("rule", rule), ["_key"], "ord", "rule").withColumnRenamed("rule", "_title"), F.col(key) == F.col("_key"), "left").drop("_key")


def _change(scope: str, value: Column, replacement: Column, reason: Column | str, kind: str = "change") -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), value.alias("value"), F.coalesce(replacement, F.lit("")).alias("replacement"), reason.alias("reason"))


def _organisation(key: Column, name: str) -> Column:
    own = _plain_key(name)
    short = " ".join(w for w in own.split() if w not in ("church", "of", "the"))
    variants = {x for x in (own, short) if x}
    if not variants:
        return F.lit(False)
    part = lambda words: F.greatest(*[F.contains(key, F.lit(w)) for w in words], F.lit(False))
    return key.isin(*variants) | (part(rules.ORGANISATION_WORDS) & part(sorted(variants)))


def speakers(records: DataFrame, aliases: Rules = None, ignored: list[str] | DataFrame | None = None, organisation: str = "") -> DataFrame:
    """Speakers cleaned: passages go to the references, organisations and ignored names go, aliases become canonical.

    ``log`` holds what was changed and warned of. Aliases and ignored names may be tables (see :func:`alias_table`; ``name``).
    """
    names = alias_table(records.sparkSession, aliases)
    r = records.withColumns({"_clean": F.nullif(normalized_value("speaker"), F.lit("")), "_cited": refs(citations("speaker", alone=False))})
    r = _is_listed(r.withColumn("_own", normalized_key("_clean")), "_own", ignored, "_ignored")
    r = apply_alias_table(r, "_clean", names, "_known").withColumnRenamed("_own", "_key")
    passage = F.coalesce(F.exists("_cited", lambda x: normalized_key(x) == F.col("_key")), F.lit(False))
    group = F.coalesce(F.col("_ignored") | _organisation(F.col("_key"), organisation), F.lit(False))
    r = r.withColumn("_case", F.when(F.col("_clean").isNull(), "none").when(passage, "passage").when(group, "group").otherwise("name"))
    case, clean, known = F.col("_case"), F.col("_clean"), F.col("_known")
    why_p, why_g = "speaker field looked like a scripture reference", "speaker field looked like a church, team, or organization instead of a person"
    log = F.array_compact(
        F.array(
            F.when((F.col("speaker") != "") & (F.coalesce(clean, F.lit("")) != F.col("speaker")), _change("speaker", F.col("speaker"), clean, "trimmed/collapsed whitespace")),
            F.when(case == "passage", _change("speaker", clean, F.lit(""), why_p)), F.when(case == "passage", _change("speaker", clean, F.lit(""), why_p, "warning")),
            F.when(case == "group", _change("speaker", clean, F.lit(""), why_g)), F.when(case == "group", _change("speaker", clean, F.lit(""), why_g, "warning")),
            F.when((case == "name") & (known != clean), _change("speaker", clean, known, "configured alias")),
        )
    )
    flags = appended(F.col("review_flags"), F.when(case == "passage", F.lit("Speaker field contained a scripture reference; confirm the missing speaker.")), F.when(case == "group", F.lit("Speaker value looked like a church/team label; confirm the preacher.")))
    old = F.col("log") if "log" in records.columns else F.array().cast("array<struct<kind:string,scope:string,value:string,replacement:string,reason:string>>")
    out = r.withColumns({"log": F.concat(old, log), "review_flags": flags, "primary_refs": F.when(case == "passage", unique_values("primary_refs", "_cited")).otherwise(F.col("primary_refs")), "_new": F.when(case == "name", known)})
    return out.withColumn("speaker", F.col("_new")).drop("_clean", "_cited", "_key", "_case", "_new", "_known", "_ignored")


def _annual(key: Column, date: Column, rule: dict, need_week: bool) -> Column:
    """The rule's series for a text's key; null where it doesn't match.

    Each alias is looked for among the key's words: it stands there as it is, or
    its last word is followed by two to four digits. The year is the key's first
    year, else two digits right behind an alias, else the date's.
    """
    words = F.split(key, " ")
    year = F.get(F.filter(words, lambda w: w.rlike("^(?:19|20)[0-9]{2}$")), F.lit(0))
    dated = F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.left(date, F.lit(4)))
    found = []
    for alias in map(_plain_key, rule["aliases"]):
        behind = F.filter(F.split(F.concat(F.lit(" "), key, F.lit(" ")), f" {re.escape(alias)}(?=[ 0-9])"), lambda part, i: i > 0)
        digits = F.transform(behind, lambda part: F.regexp_extract(part, "^[0-9]*", 0))
        stands = F.exists(digits, lambda d: F.length(d) != 1)
        short = F.get(F.filter(F.transform(behind, lambda part: F.regexp_extract(part, "^ ?([0-9]{2}) ", 1)), lambda d: d != ""), F.lit(0))
        of = F.coalesce(year, F.concat(F.lit("20"), short), dated)
        found.append(F.when(stands & of.isNotNull(), F.replace(F.lit(rule["canonical"]), F.lit("{year}"), of)))
    out = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.when(F.array_contains(words, "week"), out) if need_week else out


def _first(choices: list[tuple[Column, str, bool]]) -> Column:
    """STRUCT<series, reason, override> of the first choice that isn't null."""
    made = [F.when(c.isNotNull(), F.struct(c.alias("series"), F.lit(why).alias("reason"), F.lit(force).alias("override"))) for c, why, force in choices]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<series:string,reason:string,override:boolean>")


def series(records: DataFrame, aliases: Rules = None, annual: list[dict] | None = None, titles: list[dict] | DataFrame | None = None, from_book: bool = True) -> DataFrame:
    """Series decided in order: alias, annual rules, title rules, the book a title begins with, the cleaned value.

    A rule fills a blank, respells the same key, or overrides where it may (flagged).
    Title rules are patterns, or a table of phrases (see :func:`titles_by_phrase`).
    """
    names = alias_table(records.sparkSession, aliases)
    r = records.withColumns({"_clean": F.nullif(normalized_value("series"), F.lit("")), "_tkey": normalized_key("title"), "_skey": normalized_key("series"), "_cited": refs(citations("title"))})
    r = apply_alias_table(r, "_clean", names, "_known")
    by_year: list[tuple[Column, str, bool]] = []
    for rule in annual or []:
        by_year.append((_annual(F.col("_tkey"), F.col("date"), rule, rule.get("require_week", True)), "annual series inferred from title/date", rule.get("override_existing", False)))
        by_year.append((_annual(F.col("_skey"), F.col("date"), rule, False), "annual series normalized from series/date", True))
    by_title = []
    for rule in titles if isinstance(titles, list) else []:
        try:
            re.compile(rule["pattern"])
        except re.error:
            continue
        by_title.append((F.when(F.col("title").rlike("(?i)" + rule["pattern"]), F.lit(" ".join(rule["series"].split()))), "series inferred from title pattern", rule.get("override_existing", False)))
    book = _book_of(F.get("_cited", F.lit(0))) if from_book else F.lit(None).cast("string")
    bkey = normalized_key(book)
    begins = F.when((F.col("_tkey") == bkey) | F.startswith(F.col("_tkey"), F.concat(bkey, F.lit(" "))), book)
    r = r.withColumns({"_year": _first(by_year), "_book": begins})
    r = titles_by_phrase(r, titles) if isinstance(titles, DataFrame) else r.withColumn("_title", _first(by_title))
    known = F.col("_known")

    def applies(rule: str) -> Column:
        new = F.col(f"{rule}.series")
        same = normalized_key(known) == normalized_key(new)
        return new.isNotNull() & (known.isNull() | ((known != new) & (same | F.col(f"{rule}.override"))))

    pick = F.when(applies("_year"), F.lit("_year")).when(applies("_title"), F.lit("_title")).when(known.isNull() & F.col("_book").isNotNull(), F.lit("_book")).otherwise("")
    r = r.withColumn("_pick", pick)
    new = F.when(F.col("_pick") == "_year", F.col("_year.series")).when(F.col("_pick") == "_title", F.col("_title.series")).when(F.col("_pick") == "_book", F.col("_book")).otherwise(known)
    why = F.when(F.col("_pick") == "_year", F.col("_year.reason")).when(F.col("_pick") == "_title", F.col("_title.reason")).otherwise(F.lit("inferred Bible-book series from title"))
    changed = F.col("_pick") != ""
    overridden = changed & known.isNotNull() & (normalized_key(known) != normalized_key(new))
    log = F.array_compact(
        F.array(
            F.when((F.col("series") != "") & (F.coalesce(F.col("_clean"), F.lit("")) != F.col("series")), _change("series", F.col("series"), F.col("_clean"), "trimmed/collapsed whitespace")),
            F.when(known != F.col("_clean"), _change("series", F.col("_clean"), known, "configured alias")), F.when(changed, _change("series", F.coalesce(known, F.lit("")), new, why)),
        )
    )
    flags = F.when(new.isNotNull(), F.filter("review_flags", lambda x: x != rules.NO_SERIES)).otherwise(F.col("review_flags"))
    flags = appended(flags, F.when(overridden, F.concat(F.lit("Series was corrected from "), known, F.lit(" to "), new, F.lit("; confirm during review."))))
    old = F.col("log") if "log" in records.columns else F.array().cast("array<struct<kind:string,scope:string,value:string,replacement:string,reason:string>>")
    return r.withColumns({"log": F.concat(old, log), "review_flags": flags, "_new": new}).withColumn("series", F.col("_new")).drop("_clean", "_tkey", "_skey", "_cited", "_known", "_year", "_title", "_book", "_pick", "_new")


def named_lists(records: DataFrame, columns: list[str], aliases: Rules = None, scope: str = "theme") -> DataFrame:
    """Lists of names: cleaned, canonical, unique; alias changes are logged."""
    names, r = alias_table(records.sparkSession, aliases), records
    old = F.col("log") if "log" in records.columns else F.array().cast("array<struct<kind:string,scope:string,value:string,replacement:string,reason:string>>")
    for c in columns:
        r = _apply_to_lists(r.withColumn("_were", F.filter(F.transform(c, normalized_value), lambda x: x != "")), "_were", names, "_are")
        changed = F.filter(F.arrays_zip("_were", "_are"), lambda p: p["_were"] != p["_are"])
        r = r.withColumn("log", F.concat(old, F.transform(changed, lambda p: _change(scope, p["_were"], p["_are"], "configured alias")))).withColumn(c, unique_values("_are")).drop("_were", "_are")
        old = F.col("log")
    return r


def passages(records: DataFrame, aliases: Rules = None) -> DataFrame:
    """Primary references as canonical ones; values that are none are dropped, logged and warned of."""
    names = alias_table(records.sparkSession, aliases)
    r = _apply_to_lists(records.withColumn("_given", F.transform("primary_refs", normalized_value)), "_given", names, "_vals").drop("_given")
    r = r.withColumn("_vals", F.filter("_vals", lambda x: x != ""))
    # one text for all values: each on its own line, so that one read of the row finds the first reference of each
    r = r.withColumn("_firsts", first_citations("_vals"))
    pairs = F.arrays_zip("_vals", "_firsts")
    none = "scripture field did not look like a Bible reference"
    log = let(pairs, lambda ps: F.flatten(F.transform(ps, lambda p: F.when(p["_firsts"].isNull(), F.array(_change("scripture", p["_vals"], F.lit(""), none), _change("scripture", p["_vals"], F.lit(""), none, "warning"))).when(p["_firsts"] != p["_vals"], F.array(_change("scripture", p["_vals"], p["_firsts"], "normalized Bible book name"))).otherwise(F.array().cast("array<struct<kind:string,scope:string,value:string,replacement:string,reason:string>>")))))
    old = F.col("log") if "log" in records.columns else F.array().cast("array<struct<kind:string,scope:string,value:string,replacement:string,reason:string>>")
    return r.withColumn("log", F.concat(old, log)).withColumn("primary_refs", unique_values(F.array_compact("_firsts"))).drop("_vals", "_firsts")


def first_citations(c: str) -> Column:
    """The first reference in each value of an array; null where there is none."""
    from talkloom.functions.passages import Reader

    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        f = Reader()
        return values.map(lambda vs: None if vs is None else [next((x.ref for x in f.citations(v)), None) for v in vs])

    return find.asNondeterministic()(F.col(c))


def naming_log(records: DataFrame) -> DataFrame:
    """The change log in long form."""
    return records.select("archive_id", "record_id", "title", "date", F.explode("log").alias("x")).select("archive_id", "record_id", "title", "date", "x.*")


def naming_summary(log: DataFrame, most: int = 40) -> DataFrame:
    """The most frequent problem values: all warnings, and the changes by alias."""
    chosen = log.where("kind = 'warning' OR reason = 'configured alias'")
    return chosen.groupBy("scope", "value", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope", "value", "reason").limit(most)


def naming_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M / (|a| + |b|) by longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def near_duplicate_names(records: DataFrame, column: str, scope: list[str] = SCOPE, last: float = 0.78, whole: float = 0.92, salts: int = 16) -> DataFrame:
    """scope, value, replacement, n_value, n_replacement: pairs of distinct names that may be one.

    Names of two words or more with an equal first word are compared by their
    last words; others whole. Only names of lengths that could reach the ratio
    are compared, and of those without a common first word only the ones that
    share one of their rarest three letters in a row: as a difference of one
    letter touches three of these at most, the rarest three for each letter that
    may differ, and one more, must hold a common one.
    """
    counts = records.where(F.col(column) != "").groupBy(*scope, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    v = counts.withColumns({"key": normalized_key("value"), "fold": casefold("value")}).where("key <> ''").withColumn("words", F.split("key", " "))
    v = v.withColumns({"first": F.get("words", F.lit(0)), "last": F.element_at("words", -1), "many": F.size("words") >= 2})
    a, b = v.select(*scope, *[F.col(c).alias(f"{c}_a") for c in ("value", "n", "key", "fold", "first", "last", "many")]), v.select(*scope, *[F.col(c).alias(f"{c}_b") for c in ("value", "n", "key", "fold", "first", "last", "many")])
    ordered = (F.struct("fold_a", "value_a") < F.struct("fold_b", "value_b")) & (F.col("key_a") != F.col("key_b"))
    # the first words' rows are dealt by salt on one side and repeated on the other
    left = a.where("many_a").withColumn("salt", F.pmod(F.xxhash64("value_a"), F.lit(salts)))
    right = b.where("many_b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    long_enough = lambda x, y, r: F.least(F.length(x), F.length(y)) * 2 >= r * (F.length(x) + F.length(y))
    same_first = left.join(right, [F.col("first_a") == F.col("first_b"), left["salt"] == right["salt"], *[left[s].eqNullSafe(right[s]) for s in scope]]).where(ordered & long_enough("last_a", "last_b", last))
    same_first = same_first.select(*[left[s].alias(s) for s in scope], "value_a", "n_a", "value_b", "n_b", F.col("last_a").alias("x"), F.col("last_b").alias("y"), F.lit(last).alias("least"))
    grams = lambda k: F.array_distinct(F.when(F.length(k) < 4, F.array(F.col(k))).otherwise(F.transform(F.sequence(F.lit(1), F.length(k) - 2), lambda i: F.substring(F.col(k), i, F.lit(3)))))
    every = v.select(*scope, "value", "key", F.explode(grams("key")).alias("g"))
    often = every.groupBy(*scope, "g").agg(F.count("*").alias("often")).withColumnsRenamed({c: f"_{c}" for c in (*scope, "g")})
    met = F.col("g") == F.col("_g")
    for c in scope:
        met &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rarity = F.row_number().over(Window.partitionBy(*scope, "value").orderBy("often", "g"))
    may_differ = F.floor((1 - whole) * F.length("key") * (1 + (2 - whole) / whole) + F.lit(1e-9))  # letters of both names together, at most
    rare = stored(every.join(often, met).withColumn("k", rarity).where((F.col("k") <= 3 * may_differ + 1) | (F.length("key") < 7)).select(*scope, "value", "g"), "grams")
    with_grams = lambda side: rare.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "value")], "g").join(side, [F.col("_value") == side[f"value_{'a' if side is a else 'b'}"], *[F.col(f"_{c}").eqNullSafe(side[c]) for c in scope]]).drop(*[f"_{c}" for c in (*scope, "value")])
    ga, gb = with_grams(a), with_grams(b)
    fits = long_enough("key_a", "key_b", whole) & ~(F.col("many_a") & F.col("many_b") & (F.col("first_a") == F.col("first_b")))
    shared = ga.join(gb, [ga["g"] == gb["g"], *[ga[s].eqNullSafe(gb[s]) for s in scope]]).where(ordered & fits)
    shared = shared.select(*[ga[s].alias(s) for s in scope], "value_a", "n_a", "value_b", "n_b", F.col("key_a").alias("x"), F.col("key_b").alias("y"), F.lit(whole).alias("least")).distinct()
    return same_first.unionByName(shared).where(ratio("x", "y") >= F.col("least")).select(*scope, F.col("value_a").alias("value"), F.col("value_b").alias("replacement"), F.col("n_a").alias("n_value"), F.col("n_b").alias("n_replacement"))
