"""Records of one talk from several sources: linking by alias keys, and folding.

``mode="transitive"`` links all records that share a key, and whatever these
link; folded records may gain keys, so linking repeats until nothing changes.
It doesn't depend on order. ``mode="ordered"`` replays a sequential pass (the
first known key decides) inside coarse components, on five narrow columns. Texts
move once, in the fold, and only those that stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import casefold, slugify, stripped, unique_values
from talkloom.operators.components import components
from talkloom.operators.positions import running_total
from talkloom.operators.records import SCOPE, unresolved_flags
from talkloom.operators.storage import forgotten, stored

KEYS = ("video-id", "video-url", "date-title", "year-title", "date", "title")
_SCALARS = ("title", "date", "speaker", "series", "transcript_path", "video_url", "video_id", "duration_seconds", "summary", "summary_status", "summary_source", "status", "review_status")
_LISTS = ("primary_refs", "mentioned_refs", "topics", "themes", "related", "source_files", "audio_files", "questionable_claims", "review_flags")


def record_keys(keys: tuple[str, ...] = KEYS) -> Column:
    """A record's alias keys in order of preference; ``unknown`` if it has none."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    slug = slugify("title")
    made = {
        "video-id": F.when(has("video_id"), F.concat(F.lit("video-id:"), F.col("video_id"))),
        "video-url": F.when(has("video_url"), F.concat(F.lit("video-url:"), F.col("video_url"))),
        "date-title": F.when(has("date") & has("title"), F.concat(F.lit("date-title:"), F.col("date"), F.lit(":"), slug)),
        "year-title": F.when(has("date") & has("title"), F.concat(F.lit("year-title:"), F.left("date", F.lit(4)), F.lit(":"), slug)),
        "date": F.when(has("date"), F.concat(F.lit("date:"), F.col("date"))),
        "title": F.when(has("title") & ~has("date"), F.concat(F.lit("title:"), slug)),
    }
    found = F.array_compact(F.array(*[made[k] for k in keys]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def _having(keyed: DataFrame, some: DataFrame, scope: list[str]) -> DataFrame:
    """The rows whose scope and key are among ``some``'s."""
    named = some.withColumnsRenamed({c: f"_{c}" for c in (*scope, "key")})
    same = F.col("key") == F.col("_key")
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keyed.join(named, same, "left_semi")


def _same_keys(keyed: DataFrame, first: DataFrame, scope: list[str], *more: str) -> DataFrame:
    """raw_id, first: every row with the first row of each of its keys (and more columns of both); a null scope is one of its own."""
    f = first.withColumnsRenamed({c: f"_{c}" for c in (*scope, "key")})
    same = F.col("key") == F.col("_key")
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keyed.join(f, same).select("raw_id", "first", *more)


def _keyed(narrow: DataFrame, scope: list[str], keys: tuple[str, ...]) -> DataFrame:
    return narrow.select(*scope, "raw_id", F.explode(record_keys(keys)).alias("key"))


def _linked(keyed: DataFrame, scope: list[str]) -> DataFrame:
    """raw_id, group_id of the rows of scope, raw_id, key that share any key with others, transitively."""
    met = keyed.groupBy(*scope, "key").agg(F.min("raw_id").alias("first"), F.max("raw_id").alias("_last")).where(F.col("first") < F.col("_last")).drop("_last")
    return components(_same_keys(keyed, met, scope), "raw_id", "first").select(F.col("node").alias("raw_id"), F.col("component").alias("group_id"))


def _merged(narrow: DataFrame, scope: list[str], keys: tuple[str, ...]) -> DataFrame:
    """raw_id, group_id of the records that are in groups of several; all others are groups of their own.

    Only a group of several can gain a key by folding, so each round compares
    such groups' new keys with what has them already.
    """
    keyed = stored(_keyed(narrow, scope, keys), "keys")  # made once, read in every round
    member = stored(_linked(keyed, scope), "member")
    while not member.isEmpty():
        first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("raw_id"))).alias(c)
        folded = narrow.join(member, "raw_id").groupBy(*scope, "group_id").agg(*[first(c) for c in ("title", "date", "video_url", "video_id")]).withColumnRenamed("group_id", "raw_id")
        mine = stored(_keyed(folded, scope, keys), "folded")
        known = keyed.join(member, "raw_id").select(F.col("group_id").alias("raw_id"), "key")
        new = stored(mine.join(known, ["raw_id", "key"], "left_anti").select(*scope, "key").distinct(), "new")
        if new.isEmpty():
            break
        having = _having(keyed, new, scope).join(member, "raw_id", "left_anti").unionByName(_having(mine, new, scope))
        again = stored(_linked(having, scope), "again")
        if again.isEmpty():
            break
        moved = again.withColumnsRenamed({"raw_id": "old", "group_id": "to"})
        more = member.join(moved, member["group_id"] == moved["old"], "left").select("raw_id", F.coalesce("to", "group_id").alias("group_id"))
        member = stored(more.unionByName(again.join(member, "raw_id", "left_anti")), "member")
        forgotten(mine)
    forgotten(keyed)
    return member


def link(raw: DataFrame, scope: list[str] = SCOPE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """raw_id, group_id (the least raw_id) of ``raw``, whose ``raw_id`` orders the sources.

    Rounds of folding only merge groups, so they end.
    """
    narrow = stored(raw.select(*scope, "raw_id", "title", "date", "video_url", "video_id"), "narrow")
    return narrow.select("raw_id").join(_merged(narrow, scope, keys), "raw_id", "left").select("raw_id", F.coalesce("group_id", "raw_id").alias("group_id"))


class _Replay:
    """The sequential rule over one component; of names and groups it keeps those that a later record can still meet."""

    def __init__(self):
        self.known: dict[str, object] = {}
        self.groups: dict[object, list] = {}  # a group's (value, last record with it) of date, slug, url, video
        self.held: dict[object, int] = {}  # names that stand for a group
        self.ends: list[tuple] = []

    @staticmethod
    def names(date: tuple, slug: tuple, url: tuple, video: tuple, unknown: object = None) -> dict[str, object]:
        """Names in order of preference, each with the last record that may look it up."""
        found = {f"i:{video[0]}": video[1]} if video[0] else {}
        found |= {f"u:{url[0]}": url[1]} if url[0] else {}
        if date[0] and slug[0]:
            found |= {f"dt:{date[0]}:{slug[0]}": min(date[1], slug[1]), f"yt:{date[0][:4]}:{slug[0]}": slug[1]}
        found |= {f"d:{date[0]}": date[1]} if date[0] else {f"t:{slug[0]}": slug[1]} if slug[0] else {}
        return found or {"unknown": unknown}

    def _let_go(self, name: str) -> None:
        home = self.known.pop(name, None)
        if home is not None:
            self.held[home] -= 1
            if not self.held[home]:
                del self.held[home], self.groups[home]

    def home_of(self, raw_id: object, own: list[tuple], unknown: object) -> object:
        mine = self.names(*own, unknown)
        home = next((self.known[k] for k in mine if k in self.known), raw_id)
        old = self.groups.get(home)
        merged = [a if a[0] else c for a, c in zip(old, own, strict=True)] if old else own
        self.groups[home] = merged
        self.held[home] = self.held.get(home, 0) + 1  # by this call, while names change hands
        for name, end in (mine | self.names(*merged, unknown)).items():
            new = name not in self.known
            self._let_go(name)
            if end is not None and end > raw_id:
                self.known[name] = home
                self.held[home] += 1
                if new:
                    heapq.heappush(self.ends, (end, name))
        while self.ends and self.ends[0][0] <= raw_id:
            self._let_go(heapq.heappop(self.ends)[1])
        self.held[home] -= 1
        if not self.held[home]:
            del self.held[home], self.groups[home]
        return home


def link_in_order(raw: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """raw_id, group_id by the sequential rule: the first of a record's keys that is known picks its group.

    All its keys and the merged record's then name that group. A component's
    narrow rows stream by in order, each with the last rows that share its parts of
    keys, so that a task keeps only names that are still to be looked up.
    """
    slug = F.when(F.coalesce(F.col("title"), F.lit("")) != "", slugify("title"))
    coarse = F.array_compact(F.array(F.concat(F.lit("i:"), F.nullif("video_id", F.lit(""))), F.concat(F.lit("u:"), F.nullif("video_url", F.lit(""))), F.concat(F.lit("d:"), F.nullif("date", F.lit(""))), F.concat(F.lit("t:"), slug)))
    narrow = stored(raw.select(*scope, "raw_id", "title", "date", "video_url", "video_id", slug.alias("slug")), "narrow")
    keyed = narrow.select(*scope, "raw_id", F.explode(F.when(F.size(coarse) > 0, coarse).otherwise(F.array(F.lit("unknown")))).alias("key"))
    ends = keyed.groupBy(*scope, "key").agg(F.min("raw_id").alias("first"), F.max("raw_id").alias("last"))
    met = stored(_same_keys(keyed, ends, scope, "key", "last"), "met")
    parts = components(met, "raw_id", "first").withColumnRenamed("node", "raw_id")
    kinds = ("d", "t", "u", "i", "un")
    lasts = met.groupBy("raw_id").agg(*[F.max(F.when(F.col("key").startswith(f"{k}:" if k != "un" else "unknown"), F.col("last"))).alias(f"last_{k}") for k in kinds])
    placed = narrow.join(lasts, "raw_id").join(parts, "raw_id", "left").withColumn("component", F.coalesce("component", "raw_id"))
    kind = raw.schema["raw_id"].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _Replay()
        for b in batches:
            homes = []
            for component, raw_id, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if component != now:
                    now, state = component, _Replay()
                homes.append(state.home_of(raw_id, list(zip(own[:4], own[4:8], strict=True)), own[8]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(homes, b.schema.field(1).type)], ["raw_id", "group_id"])

    ordered = placed.repartition("component").sortWithinPartitions("component", "raw_id").select("component", "raw_id", "date", "slug", "video_url", "video_id", *[f"last_{k}" for k in kinds])
    return ordered.mapInArrow(replay, f"raw_id {kind}, group_id {kind}")


#: A record's arrays and maps hold so many values of each kind at most; :func:`list_values` has all.
LISTED = 20_000


def list_values(joined: DataFrame) -> DataFrame:
    """archive_id, group_id, kind, key, first, last, n: each group's different list values, counts and extras, a row each.

    ``first`` and ``last`` are (raw_id, place, value) in source order. Lists,
    counts and extras of a group of any size are rows that aggregation combines.
    """
    entry = lambda kind, key, value, n, place: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), n.alias("n"), place.alias("place"))
    none = F.lit(None).cast("int")
    listed = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: entry(c, casefold(stripped(x)), stripped(x), none, i))
    pairs = lambda c, n: F.transform(F.coalesce(F.map_entries(c), F.array().cast(f"array<struct<key:string,value:{n}>>")), lambda e, i: entry(c, e["key"], e["value"].cast("string"), e["value"].cast("int") if n == "int" else none, i))
    every = joined.select("archive_id", "group_id", "raw_id", F.explode(F.concat(*map(listed, _LISTS), pairs("ref_counts", "int"), pairs("extra", "string"))).alias("e")).where(F.coalesce("e.key", F.lit("")) != "").where((F.col("e.kind") != "extra") | (F.coalesce("e.value", F.lit("")) != ""))
    place = F.struct("raw_id", "e.place", "e.value")
    return every.groupBy("archive_id", "group_id", "e.kind", "e.key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.sum("e.n").cast("int").alias("n"))


def _shortened(values: DataFrame, most: int) -> DataFrame:
    """The first ``most`` values of each group and kind; groups with more are numbered in one order by ranges, whatever their size."""
    of = ["archive_id", "group_id", "kind"]
    long = values.groupBy(*of).agg(F.count("*").alias("_all")).where(F.col("_all") > most)
    if long.isEmpty():
        return values
    same = lambda b: F.col("archive_id").eqNullSafe(F.col(f"{b}archive_id")) & (F.col("group_id") == F.col(f"{b}group_id")) & (F.col("kind") == F.col(f"{b}kind"))
    named = long.withColumnsRenamed({c: f"_l{c}" for c in of})
    placed = running_total(values.join(named, same("_l")).select(*values.columns), F.lit(1), [F.col(c).asc_nulls_first() for c in (*of, "first", "key")], "_at")
    start = placed.groupBy(*of).agg(F.min("_at").alias("_from")).withColumnsRenamed({c: f"_s{c}" for c in of})
    kept = placed.join(start, same("_s")).where(F.col("_at") - F.col("_from") < most).select(*values.columns)
    return values.join(named, same("_l"), "left_anti").unionByName(kept)


#: A row that is a group of its own is folded where it stands if its lists hold so many values each at most.
SHORT = 100


def _folded_alone(rows: DataFrame) -> DataFrame:
    """What folding makes of rows that are a group each; their lists are short."""
    named = lambda c: F.coalesce(F.map_filter(c, lambda k, v: F.coalesce(k, F.lit("")) != ""), F.create_map().cast(rows.schema[c].dataType)).alias(c)
    said = F.map_filter("extra", lambda k, v: F.coalesce(v, F.lit("")) != "")
    scalars = [F.when(_filled(c), F.col(c)).alias(c) for c in _SCALARS]
    text = F.when(_filled("transcript_text"), F.col("transcript_text")).alias("transcript_text")
    return rows.withColumn("extra", said).select("archive_id", F.col("raw_id").alias("group_id"), F.lit(1).cast("long").alias("n_sources"), *scalars, *[unique_values(c).alias(c) for c in _LISTS], text, F.coalesce("transcript_status", F.lit("missing")).alias("transcript_status"), named("ref_counts"), named("extra"))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() if c == "duration_seconds" else F.coalesce(F.col(c), F.lit("")) != ""


def fold(raw: DataFrame, member: DataFrame, listed: int = LISTED) -> DataFrame:
    """One record for each group, in source order: first non-blank scalars, ordered unions of lists, sums of counts.

    Rows that ``member`` lacks are a group each, and so are those that it names
    alone: these are folded where they stand and never gathered. Text and status come
    together from the first row with a text, else the first status that isn't
    missing; the last non-blank extra of each key stays. List values, counts and
    extras are merged by value as rows (:func:`list_values`) before a group gathers
    them, the first ``listed`` of each kind, so that no record grows without bound;
    of the texts only those that stay are moved.
    """
    several = member.groupBy("group_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1).select("group_id")
    of_several = stored(member.join(several, "group_id").select("raw_id", "group_id"), "several")
    long = F.lit(False)
    for c in (*_LISTS, "ref_counts", "extra"):
        long |= F.coalesce(F.size(c), F.lit(0)) > min(SHORT, listed)
    placed = raw.join(of_several, "raw_id", "left")
    alone = _folded_alone(placed.where(F.col("group_id").isNull() & ~long).drop("group_id"))
    gathered = placed.where(F.col("group_id").isNotNull() | long).withColumn("group_id", F.coalesce("group_id", "raw_id"))
    return _folded_together(gathered, raw, listed).unionByName(alone)


def _folded_together(joined: DataFrame, raw: DataFrame, listed: int) -> DataFrame:
    """Groups of rows, folded; texts come from ``raw``."""
    r = stored(joined.withColumn("_texted", _filled("transcript_text")).drop("transcript_text"), "folding")
    at = lambda *cond: F.when(cond[0], F.col("raw_id")) if cond else F.col("raw_id")
    g = r.groupBy("archive_id", "group_id").agg(
        *[F.min_by(c, at(_filled(c))).alias(c) for c in _SCALARS], F.min(at(F.col("_texted"))).alias("_text_of"), F.min_by("transcript_status", at(F.col("_texted"))).alias("_texted_status"),
        F.min_by("transcript_status", at(F.coalesce("transcript_status", F.lit("missing")) != "missing")).alias("_status"), F.count("*").alias("n_sources"),
    )
    values = _shortened(stored(list_values(r), "values"), listed)
    of = lambda kind, *what: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("first", *what))))
    lists = values.groupBy("archive_id", "group_id").agg(
        *[F.transform(of(c), lambda x: x["first"]["value"]).alias(c) for c in _LISTS], F.map_from_entries(F.transform(of("ref_counts", "key", "n"), lambda x: F.struct(x["key"], x["n"]))).alias("ref_counts"),
        F.map_from_entries(F.transform(of("extra", "key", F.col("last.value").alias("stays")), lambda x: F.struct(x["key"], x["stays"]))).alias("extra"),
    )
    lists = lists.withColumnsRenamed({"archive_id": "_a", "group_id": "_g"})
    texts = raw.select(F.col("raw_id").alias("_text_of"), "transcript_text").join(r.where("_texted").select(F.col("raw_id").alias("_text_of")), "_text_of", "left_semi")
    out = g.join(lists, (F.col("group_id") == F.col("_g")) & F.col("archive_id").eqNullSafe(F.col("_a")), "left").join(texts, "_text_of", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    out = out.select(
        "archive_id", "group_id", "n_sources", *_SCALARS, *[empty(c) for c in _LISTS], "transcript_text", F.coalesce(F.when(F.col("_text_of").isNotNull(), F.col("_texted_status")), "_status", F.lit("missing")).alias("transcript_status"),
        F.coalesce("ref_counts", F.create_map().cast("map<string,int>")).alias("ref_counts"), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
    )
    return out.withColumn("review_flags", F.when(F.col("n_sources") > 1, unresolved_flags()).otherwise(F.col("review_flags")))


def with_raw_id(raw: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Adds ``raw_id``: scope, source_rank, archive and source_ord as one text, which sorts so and names one row alone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x01"))
    return raw.withColumn("raw_id", F.concat_ws("\t", *map(part, scope), part("source_rank"), *([] if "archive_id" in scope else [part("archive_id")]), part("source_ord")))


def resolved(raw: DataFrame, scope: list[str] = SCOPE, mode: str = "transitive", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Linked and folded records. A given ``raw_id`` must be of one row alone, also across scopes."""
    r = stored(raw if "raw_id" in raw.columns else with_raw_id(raw, scope), "raw")  # read several times, its sources once
    member = _merged(r, scope, keys) if mode == "transitive" else link_in_order(r, scope)
    return fold(r, member)


def first_rule(matches: DataFrame, by: list[str], rule_ord: str, value: str) -> DataFrame:
    """The value of the lowest matching rule for each ``by``."""
    return matches.groupBy(*by).agg(F.min_by(value, rule_ord).alias(value))


def dropped_repeats(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Rows whose line differs from the one before."""
    before = F.lag(line).over(Window.partitionBy(*by).orderBy(order))
    return lines.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(line))).drop("_before")
