"""Tools on items, people, tags and orgs: rankings, profiles, searches. Ties go to the smaller id; every log is summed up before it is joined."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import PLAY_SECONDS, Catalog
from .base import all_of, found_by_name, resolved, tool, top


def _viewed(cat: Catalog, bridge: DataFrame) -> DataFrame:
    """The bridge with the views, plays and peaks of each item; 0 where there are none."""
    return bridge.join(cat.engaged.select(F.col("id").alias("item_id"), "views", "plays", "peaks"), "item_id")


def _names(entities: DataFrame, key: str) -> DataFrame:
    return entities.select(F.col("id").alias(key), "name")


@tool()
def person_tags(cat: Catalog, person_name: str, limit: int = 20, weighted_by_views: bool = True) -> DataFrame:
    """Tags of a person's items by the items' views (at least one each) or by their number."""
    person = resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("person_id"))
    own = cat.item_persons.join(F.broadcast(person), "person_id").select("item_id")  # one row
    weight = F.coalesce(F.nullif("views", F.lit(0)), F.lit(1)) if weighted_by_views else F.lit(1)
    each = cat.shown(_viewed(cat, cat.item_tags.join(own, "item_id"))).groupBy("tag_id").agg(F.sum(weight).alias("weight"))
    return top(each.join(_names(cat.tags, "tag_id"), "tag_id"), limit, F.col("weight").desc(), "tag_id")


@tool()
def tag_persons(cat: Catalog, tag_name: str, limit: int = 20) -> DataFrame:
    """People who have items with a tag, by the number of these items."""
    tag = resolved(cat.tags, tag_name).select(F.col("id").alias("tag_id"))
    items = cat.item_tags.join(F.broadcast(tag), "tag_id").select("item_id")  # one row
    each = cat.item_persons.join(items, "item_id").groupBy("person_id").agg(F.count("*").alias("items"))
    return top(each.join(_names(cat.persons, "person_id"), "person_id"), limit, F.col("items").desc(), "person_id")


@tool(stat_type=("top_items", "top_persons", "top_tags", "recent_views"))
def viewing(cat: Catalog, stat_type: str, limit: int = 10) -> DataFrame:
    """The log of views by item, person or tag, or the latest views with the item's people."""
    if stat_type == "top_items":
        return top(cat.view_counts.select("item_id", "views").join(cat.items.select(F.col("id").alias("item_id"), "title"), "item_id"), limit, F.col("views").desc(), "item_id")
    if stat_type == "recent_views":
        latest = top(cat.views, limit, F.col("ts").desc(), "item_id")
        people = cat.item_persons.join(latest.select("item_id").distinct(), "item_id", "left_semi").join(_names(cat.persons, "person_id"), "person_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("people"))
        return latest.join(people, "item_id", "left").select("item_id", "ts", F.coalesce("people", F.lit("")).alias("people"))
    bridge, entities, key = (cat.item_persons, cat.persons, "person_id") if stat_type == "top_persons" else (cat.shown(cat.item_tags), cat.tags, "tag_id")
    each = bridge.join(cat.view_counts, "item_id").groupBy(key).agg(F.sum("views").alias("views"), F.count("*").alias("items"))
    return top(each.join(_names(entities, key), key), limit, F.col("views").desc(), key)


def _ranked(cat: Catalog, bridge: DataFrame, entities: DataFrame, key: str, sort_by: str, limit: int) -> DataFrame:
    each = _viewed(cat, bridge)
    value = {"views": F.col("views"), "items": F.lit(1), "peaks": F.col("peaks"), "duration": F.col("plays") * PLAY_SECONDS}[sort_by]
    if sort_by != "items":
        each = each.where(value > 0)  # joined to the log: without events there is no row
    return top(each.groupBy(key).agg(F.sum(value).alias("value"), F.count("*").alias("items")).join(_names(entities, key), key), limit, F.col("value").desc(), key)


@tool(sort_by=("views", "items", "peaks", "duration"))
def top_persons(cat: Catalog, sort_by: str = "views", limit: int = 10) -> DataFrame:
    """People by views, items, peaks or play time of their items."""
    return _ranked(cat, cat.item_persons, cat.persons, "person_id", sort_by, limit)


@tool(sort_by=("views", "items", "peaks"))
def top_tags(cat: Catalog, sort_by: str = "views", limit: int = 10, exclude_tags: tuple = ()) -> DataFrame:
    """Tags by views, items or peaks, without the excluded ones and all below them."""
    return _ranked(cat, cat.shown(cat.item_tags, exclude_tags), cat.tags, "tag_id", sort_by, limit)


@tool(sort_by=("views", "items"))
def top_orgs(cat: Catalog, sort_by: str = "items", limit: int = 10) -> DataFrame:
    """Orgs by views or number of their items."""
    own = cat.items.where("org_id IS NOT NULL").select(F.col("id").alias("item_id"), "org_id")
    return _ranked(cat, own, cat.orgs, "org_id", sort_by, limit)


@tool()
def library_totals(cat: Catalog) -> DataFrame:
    """One row of totals; the average length is all hours over all items."""
    items = cat.engaged.agg(F.count("*").alias("items"), F.count_if(F.col("views") > 0).alias("watched"), F.sum("views").alias("views"), F.sum("peaks").alias("peaks"), F.count_if("organized").alias("organized"), F.count("rating").alias("rated"))
    files = cat.primary.agg(F.sum("duration").alias("seconds"), F.sum("size").alias("bytes"))
    parts = [df.agg(F.count("*").alias(n)) for df, n in ((cat.persons, "persons"), (cat.tags, "tags"), (cat.orgs, "orgs"))]
    out = items
    for part in (files, *parts):
        out = out.crossJoin(F.broadcast(part))  # one row each
    hours = F.col("seconds") / 3600
    return out.select("items", "watched", "views", "peaks", "organized", "rated", "persons", "tags", "orgs", F.round(hours, 4).alias("hours"), F.round(F.col("bytes") / 1024**3, 4).alias("gib"), F.round(hours * 60 / F.nullif(F.col("items"), F.lit(0)), 4).alias("average_minutes"))


@tool(pattern_type=("hourly", "weekday", "monthly", "recent"))
def watching_pattern(cat: Catalog, pattern_type: str, limit: int = 30) -> DataFrame:
    """Views by hour, weekday (0 is Sunday), month (the last 12) or day (the last `limit`)."""
    ts = F.col("ts")
    bucket, last = {"hourly": (F.format_string("%02d", F.hour(ts)), None), "weekday": ((F.dayofweek(ts) - 1).cast("string"), None), "monthly": (F.date_format(ts, "yyyy-MM"), 12), "recent": (F.date_format(ts, "yyyy-MM-dd"), limit)}[pattern_type]
    each = cat.views.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("views"), F.count_distinct("item_id").alias("items"))
    return top(each, last, F.col("bucket").desc())


@tool()
def tag_partners(cat: Catalog, tag_name: str, limit: int = 10) -> DataFrame:
    """Tags that share the most items with a tag."""
    tag = resolved(cat.tags, tag_name).select(F.col("id").alias("tag_id"))
    items = cat.item_tags.join(F.broadcast(tag), "tag_id").select("item_id")  # one row
    others = cat.item_tags.join(items, "item_id").join(F.broadcast(tag), "tag_id", "left_anti")
    return top(cat.shown(others).groupBy("tag_id").agg(F.count("*").alias("items")).join(_names(cat.tags, "tag_id"), "tag_id"), limit, F.col("items").desc(), "tag_id")


@tool(sort_by=("views", "items", "peaks"))
def common_tags(cat: Catalog, top_n_persons: int = 5, sort_by: str = "views", min_persons: int = 2, limit: int = 20) -> DataFrame:
    """Tags that at least min_persons of the top people have on items, with their names."""
    people = top_persons(cat, sort_by=sort_by, limit=top_n_persons).select("person_id", F.col("name").alias("person"))
    pairs = cat.item_persons.join(F.broadcast(people), "person_id").join(cat.shown(cat.item_tags), "item_id").select("tag_id", "person_id", "person").distinct()  # top_n_persons rows
    shared = pairs.groupBy("tag_id").agg(F.count("*").alias("persons"), F.array_join(F.array_sort(F.collect_list("person")), ", ").alias("people")).where(F.col("persons") >= min_persons)
    return top(shared.join(_names(cat.tags, "tag_id"), "tag_id"), limit, F.col("persons").desc(), "tag_id")


@tool()
def person_partners(cat: Catalog, person_name: str = "", limit: int = 10) -> DataFrame:
    """Pairs of people by shared items: the partners of one, or all unordered pairs."""
    a, b = cat.item_persons.select("item_id", F.col("person_id").alias("a")), cat.item_persons.select("item_id", F.col("person_id").alias("b"))
    if person_name:
        a = a.join(F.broadcast(resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("a"))), "a")  # one row
        pairs = a.join(b, "item_id").where("a <> b")
    else:
        pairs = a.join(b, "item_id").where("a < b")
    return top(pairs.groupBy("a", "b").agg(F.count("*").alias("items")), limit, F.col("items").desc(), "a", "b")


@tool()
def flagged_items(cat: Catalog, limit: int = 20) -> DataFrame:
    """Items with the flag, their people, and the number of all of them whatever the limit."""
    flagged = cat.items.where("organized").select(F.col("id").alias("item_id"), "title")
    total = flagged.agg(F.count("*").alias("total"))
    first = top(flagged, limit, F.col("item_id").desc())
    people = cat.item_persons.join(first.select("item_id"), "item_id", "left_semi").join(_names(cat.persons, "person_id"), "person_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("people"))
    return first.join(people, "item_id", "left").crossJoin(F.broadcast(total)).select("item_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("people", F.lit("")).alias("people"), "total")  # one row


@tool(filter_type=("all", "person", "tag", "org"), sort_by=("newest", "oldest", "random", "duration"))
def unwatched_items(cat: Catalog, filter_type: str = "all", filter_value: str = "", sort_by: str = "newest", limit: int = 20, seed: int = 42) -> DataFrame:
    """Items without a view, of one person, tag or org if asked for; total counts all of them without the filter. "random" is an order by a seeded hash."""
    left = cat.items.join(cat.views, cat.items["id"] == cat.views["item_id"], "left_anti").select(F.col("id").alias("item_id"), "org_id", "created_at")
    total = left.agg(F.count("*").alias("total"))
    if filter_type == "person":
        left = left.join(cat.item_persons.join(F.broadcast(resolved(cat.persons, filter_value, "disambiguation").select(F.col("id").alias("person_id"))), "person_id"), "item_id", "left_semi")  # one row
    elif filter_type == "tag":
        left = left.join(cat.item_tags.join(F.broadcast(resolved(cat.tags, filter_value).select(F.col("id").alias("tag_id"))), "tag_id"), "item_id", "left_semi")  # one row
    elif filter_type == "org":
        left = left.join(F.broadcast(resolved(cat.orgs, filter_value).select(F.col("id").alias("org_id"))), "org_id", "left_semi")  # one row
    order = {"newest": [F.col("created_at").desc(), F.col("item_id")], "oldest": [F.col("created_at"), F.col("item_id")], "random": [F.xxhash64(F.col("item_id"), F.lit(seed)), F.col("item_id")], "duration": [F.col("item_id").desc()]}[sort_by]
    return top(left, limit, *order).crossJoin(F.broadcast(total)).select("item_id", "total")  # one row


@tool(scoring_mode=("favorites", "recent", "completion", "intensity"))
def ranked_by_engagement(cat: Catalog, scoring_mode: str = "favorites", item_ids: tuple = (), min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """Items by one of four scores, sorted by the rounded score. favorites: peaks * 20 + replays * 2; recent: that halved every 30 days since the last view;
    completion: play time over length in percent, at most 500; intensity: peaks per view."""
    rows = cat.engaged.where(F.col("id").isin(list(item_ids))) if item_ids else cat.engaged
    favorites = F.col("peaks") * 20 + F.greatest(F.col("views") - 1, F.lit(0)) * 2
    days = F.coalesce(F.greatest(F.datediff(cat.today, F.to_date("last_ts")), F.lit(0)), F.lit(0))
    score = {
        "favorites": favorites.cast("double"),
        "recent": favorites * F.pow(F.lit(0.5), days / 30),
        "completion": F.when(F.col("duration") > 0, F.least(F.col("plays") * PLAY_SECONDS * 100 / F.col("duration"), F.lit(500.0))).otherwise(0.0),
        "intensity": F.when(F.col("views") > 0, F.col("peaks") / F.col("views")).otherwise(0.0),
    }[scoring_mode]
    rows = rows.select(F.col("id").alias("item_id"), "views", "peaks", F.round(score, 2).alias("score")).where(F.col("score") >= min_score)
    return top(rows, limit, F.col("score").desc(), "item_id")


@tool(sort_by=("name", "rating", "items"))
def persons_by_attributes(
    cat: Catalog, name: str = "", country: str = "", disambiguation: str = "", min_age: int | None = None, max_age: int | None = None, min_rating: int | None = None, max_rating: int | None = None, favorite: bool | None = None, has_country: bool | None = None, has_birthdate: bool | None = None, min_items: int | None = None, sort_by: str = "name", limit: int = 20
) -> DataFrame:
    """People who meet all the conditions that are given. An age is asked for as a range of full birth dates."""
    holds = lambda c, x: F.contains(F.lower(c), F.lit(x.lower())) if x else None
    born = F.try_to_date(F.col("birthdate"), "yyyy-MM-dd")
    filled = lambda c, want: None if want is None else (F.coalesce(F.trim(c), F.lit("")) != "") == F.lit(want)
    counts = cat.item_persons.groupBy("person_id").agg(F.count("*").alias("items"))
    rows = cat.persons.join(counts, cat.persons["id"] == counts["person_id"], "left").withColumn("items", F.coalesce("items", F.lit(0)))
    rows = rows.where(
        all_of(
            holds("name", name), holds("country", country), holds("disambiguation", disambiguation),
            born <= F.add_months(cat.today, -12 * min_age) if min_age is not None else None,
            born > F.add_months(cat.today, -12 * (max_age + 1)) if max_age is not None else None,
            F.col("rating") >= min_rating if min_rating is not None else None,
            F.col("rating") <= max_rating if max_rating is not None else None,
            F.col("favorite") == favorite if favorite is not None else None,
            filled("country", has_country), filled("birthdate", has_birthdate),
            F.col("items") >= min_items if min_items is not None else None,
        )
    )
    order = {"name": [F.asc_nulls_last("name")], "rating": [F.desc_nulls_last("rating")], "items": [F.col("items").desc()]}[sort_by]
    age = F.floor(F.months_between(cat.today, born) / 12)
    return top(rows.select(F.col("id").alias("person_id"), "name", age.alias("age"), "items"), limit, *order, "person_id") if sort_by != "rating" else top(rows, limit, *order, "id").select(F.col("id").alias("person_id"), "name", age.alias("age"), "items")


@tool(date_type=("created_at", "updated_at", "view_date"), sort_by=("date", "views", "peaks"))
def items_in_period(cat: Catalog, start_date: str, end_date: str, date_type: str = "created_at", sort_by: str = "date", limit: int = 20) -> DataFrame:
    """Items made, changed or viewed from start_date to end_date, both included; viewed ones with their views in that time."""
    inside = lambda c: (F.col(c) >= F.lit(start_date).cast("timestamp_ntz")) & (F.col(c) < F.date_add(F.lit(end_date).cast("date"), 1).cast("timestamp_ntz"))
    if date_type == "view_date":
        log = cat.views.where(inside("ts")).groupBy("item_id").agg(F.count("*").alias("views"), F.max("ts").alias("at"))
        rows = log.join(cat.items.select(F.col("id").alias("item_id"), "peaks"), "item_id")
    else:
        rows = cat.engaged.where(inside(date_type)).select(F.col("id").alias("item_id"), "views", F.col(date_type).alias("at"), "peaks")
    order = {"date": "at", "views": "views", "peaks": "peaks"}[sort_by]
    return top(rows.select("item_id", "at", "views", "peaks"), limit, F.col(order).desc(), "item_id")


@tool(entity_type=("persons", "orgs", "tags"))
def favorite_entities(cat: Catalog, entity_type: str = "persons", limit: int = 20) -> DataFrame:
    """Favourite people, orgs or tags with the items, views and peaks they have."""
    bridge, entities, key = {"persons": (cat.item_persons, cat.persons, "person_id"), "orgs": (cat.items.select(F.col("id").alias("item_id"), "org_id").dropna(), cat.orgs, "org_id"), "tags": (cat.item_tags, cat.tags, "tag_id")}[entity_type]
    loved = entities.where("favorite").select(F.col("id").alias(key), "name")
    sums = _viewed(cat, bridge.join(loved, key, "left_semi")).groupBy(key).agg(F.count("*").alias("items"), F.sum("views").alias("views"), F.sum("peaks").alias("peaks"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "views", "peaks")]
    return top(loved.join(sums, key, "left").select(F.col(key).alias("id"), "name", *zero), limit, F.col("items").desc(), "id")


@tool(sort_by=("rating", "views", "title"))
def items_rated(cat: Catalog, min_rating: int = 80, max_rating: int = 100, include_unrated: bool = False, sort_by: str = "rating", limit: int = 20) -> DataFrame:
    """Items of a range of ratings, unrated ones if asked for, with the numbers of all, of those of 80 or more and of those of 100."""
    fits = F.col("rating").between(min_rating, max_rating)
    rows = cat.engaged.where(fits | F.col("rating").isNull() if include_unrated else fits).select(F.col("id").alias("item_id"), "title", "rating", "views")
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("rating") >= 80).alias("high"), F.count_if(F.col("rating") == 100).alias("best"))
    order = {"rating": F.desc_nulls_last("rating"), "views": F.col("views").desc(), "title": F.asc_nulls_last("title")}[sort_by]
    return top(rows, limit, order, "item_id").crossJoin(F.broadcast(counts)).select("item_id", F.coalesce("rating", F.lit(-1)).alias("rating"), "views", "total", "high", "best")  # one row


@tool(sort_by=("items", "name", "views"))
def tag_list(cat: Catalog, search: str = "", favorites_only: bool = False, min_items: int = 0, sort_by: str = "items", limit: int = 50) -> DataFrame:
    """All tags, those without items too, with items and views."""
    return _entity_list(cat, cat.shown(cat.tags.withColumnRenamed("id", "tag_id")), cat.item_tags, "tag_id", search, favorites_only, min_items, sort_by, limit)


@tool(sort_by=("items", "name", "views", "peaks"))
def person_list(cat: Catalog, search: str = "", favorites_only: bool = False, min_items: int = 0, sort_by: str = "items", limit: int = 50) -> DataFrame:
    """All people, those without items too, with items, views and peaks; total counts all people whatever is asked for."""
    rows = _entity_list(cat, cat.persons.withColumnRenamed("id", "person_id"), cat.item_persons, "person_id", search, favorites_only, min_items, sort_by, limit)
    return rows.crossJoin(F.broadcast(cat.persons.agg(F.count("*").alias("total"))))  # one row


def _entity_list(cat: Catalog, entities: DataFrame, bridge: DataFrame, key: str, search: str, favorites_only: bool, min_items: int, sort_by: str, limit: int) -> DataFrame:
    sums = _viewed(cat, bridge).groupBy(key).agg(F.count("*").alias("items"), F.sum("views").alias("views"), F.sum("peaks").alias("peaks"))
    rows = entities.where(all_of(F.contains(F.lower("name"), F.lit(search.lower())) if search else None, F.col("favorite") if favorites_only else None))
    rows = rows.join(sums, key, "left").select(key, "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "views", "peaks")]).where(F.col("items") >= min_items)
    return top(rows, limit, F.asc_nulls_last("name") if sort_by == "name" else F.col(sort_by).desc(), key)


@tool()
def person_profile(cat: Catalog, person_name: str, top_tags_limit: int = 10, top_partners_limit: int = 5) -> DataFrame:
    """One row: a person's attributes, age, items, play hours, views, peaks, mean rating in stars, most frequent tags and partners. Excluded tags count here."""
    who = resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("person_id"))
    own = cat.item_persons.join(F.broadcast(who), "person_id").select("item_id")  # one row
    sums = cat.engaged.join(own, F.col("id") == F.col("item_id"), "left_semi").agg(F.count("*").alias("items"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.coalesce(F.sum("peaks"), F.lit(0)).alias("peaks"), F.round(F.coalesce(F.sum("plays"), F.lit(0)) * PLAY_SECONDS / 3600, 4).alias("play_hours"), F.round(F.avg("rating") / 20, 4).alias("stars"))
    listed = lambda bridge, key, entities, n: top(bridge.join(own, "item_id", "left_semi").join(F.broadcast(who.select(F.col("person_id").alias(key))), key, "left_anti").groupBy(key).agg(F.count("*").alias("n")) if key == "person_id" else bridge.join(own, "item_id", "left_semi").groupBy(key).agg(F.count("*").alias("n")), n, F.col("n").desc(), key).join(_names(entities, key), key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), key, "name"))), lambda x: x["name"]).alias("l"))
    tags = listed(cat.item_tags, "tag_id", cat.tags, top_tags_limit).select(F.array_join("l", ", ").alias("tags"))
    partners = listed(cat.item_persons, "person_id", cat.persons, top_partners_limit).select(F.array_join("l", ", ").alias("partners"))
    born = F.try_to_date(F.col("birthdate"), "yyyy-MM-dd")
    person = cat.persons.join(F.broadcast(who), cat.persons["id"] == who["person_id"], "left_semi").select(F.col("id").alias("person_id"), "name", F.coalesce("country", F.lit("")).alias("country"), "favorite", F.floor(F.months_between(cat.today, born) / 12).alias("age"))
    out = person
    for part in (sums, tags, partners):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


@tool()
def org_profile_of(cat: Catalog, org_name: str, persons_limit: int = 10, tags_limit: int = 10) -> DataFrame:
    """One row: an org with its parent, items, length, time span, mean rating in stars, orgs below it with their items, and its most frequent people and tags."""
    who = found_by_name(cat.orgs, org_name).select(F.col("id").alias("org_id"))
    own = cat.engaged.join(F.broadcast(who), "org_id", "left_semi")  # one row
    sums = own.agg(F.count("*").alias("items"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 2).alias("seconds"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.round(F.avg("rating") / 20, 4).alias("stars"))
    items = own.select(F.col("id").alias("item_id"))
    counts = cat.items.groupBy("org_id").agg(F.count("*").alias("n"))
    below = cat.orgs.join(F.broadcast(who), cat.orgs["parent_id"] == who["org_id"], "left_semi").join(counts, cat.orgs["id"] == counts["org_id"], "left").select("id", F.concat("name", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")).alias("name"))
    line = lambda df: F.array_join(F.transform(F.array_sort(F.collect_list(df)), lambda x: x["name"]), ", ")
    children = below.agg(line(F.struct("id", "name")).alias("below"))
    most = lambda bridge, key, entities, n: top(bridge.join(items, "item_id", "left_semi").groupBy(key).agg(F.count("*").alias("n")), n, F.col("n").desc(), key).join(_names(entities, key), key).agg(line(F.struct((-F.col("n")).alias("n"), key, "name")).alias("l"))
    people = most(cat.item_persons, "person_id", cat.persons, persons_limit).select(F.col("l").alias("people"))
    tags = most(cat.shown(cat.item_tags), "tag_id", cat.tags, tags_limit).select(F.col("l").alias("tags"))
    parent = cat.orgs.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    out = cat.orgs.join(F.broadcast(who), cat.orgs["id"] == who["org_id"], "left_semi").join(parent, "parent_id", "left").select(F.col("id").alias("org_id"), "name", F.coalesce("parent", F.lit("")).alias("parent"))
    for part in (sums, children, people, tags):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


@tool()
def series_state(cat: Catalog, org_name: str = "") -> DataFrame:
    """Series (the items of an org in order of creation): items, watched ones, percent, and the first one left. Watched: seen, or half of it played."""
    rows = cat.engaged.where("org_id IS NOT NULL")
    if org_name:
        rows = rows.join(F.broadcast(found_by_name(cat.orgs, org_name).select(F.col("id").alias("org_id"))), "org_id", "left_semi")  # one row
    seen = (F.col("views") > 0) | F.coalesce(F.col("plays") * PLAY_SECONDS >= F.col("duration") * 0.5, F.lit(False))
    each = rows.select("org_id", "id", "created_at", seen.alias("seen")).groupBy("org_id").agg(F.count("*").alias("items"), F.count_if("seen").alias("watched"), F.min(F.when(~F.col("seen"), F.struct("created_at", "id"))).alias("next"))
    return each.select("org_id", "items", "watched", F.round(100 * F.col("watched") / F.col("items"), 4).alias("pct"), F.coalesce("next.id", F.lit(-1)).alias("next_item"))


def _history(cat: Catalog, start: str, end: str, person_name: str, tag_name: str) -> DataFrame:
    log = cat.views.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    if person_name:
        log = log.join(cat.item_persons.join(F.broadcast(resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("person_id"))), "person_id"), "item_id", "left_semi")  # one row
    if tag_name:
        log = log.join(cat.item_tags.join(F.broadcast(resolved(cat.tags, tag_name).select(F.col("id").alias("tag_id"))), "tag_id"), "item_id", "left_semi")  # one row
    return log


@tool()
def history(cat: Catalog, start: str, end: str, person_name: str = "", tag_name: str = "", limit: int = 50) -> DataFrame:
    """Views in a period, of items of a person and with a tag if asked for, newest first, with the item's people."""
    rows = top(_history(cat, start, end, person_name, tag_name), limit, F.col("ts").desc(), "item_id")
    people = cat.item_persons.join(rows.select("item_id").distinct(), "item_id", "left_semi").join(_names(cat.persons, "person_id"), "person_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("people"))
    return rows.join(people, "item_id", "left").select("item_id", "ts", F.coalesce("people", F.lit("")).alias("people"))


@tool()
def history_summary(cat: Catalog, start: str, end: str, person_name: str = "", tag_name: str = "") -> DataFrame:
    """The same views summed up: views, items, days, first and last."""
    return _history(cat, start, end, person_name, tag_name).agg(F.count("*").alias("views"), F.count_distinct("item_id").alias("items"), F.count_distinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@tool(group_by=("org", "person", "tag", "resolution", "codec"))
def storage(cat: Catalog, group_by: str = "org", limit: int = 20) -> DataFrame:
    """Bytes by a property of the item, with the share of the library; an item in several groups counts in each. Resolution is told by bits per second, as the tables have no height."""
    files = cat.files
    total = files.agg(F.sum("size").alias("all"))
    rate = F.col("size") * 8 / F.nullif(F.col("duration"), F.lit(0.0)) / 1e6
    if group_by == "org":
        own = cat.items.select(F.col("id").alias("item_id"), "org_id").join(cat.orgs.select(F.col("id").alias("org_id"), F.col("name").alias("label")), "org_id", "left")
        rows = files.join(own.select("item_id", F.coalesce("label", F.lit("(No org)")).alias("label")), "item_id")
    elif group_by in ("person", "tag"):
        bridge, names, key = (cat.item_persons, _names(cat.persons, "person_id"), "person_id") if group_by == "person" else (cat.shown(cat.item_tags), _names(cat.tags, "tag_id"), "tag_id")
        rows = files.join(bridge.join(names, key), "item_id", "left").withColumn("label", F.coalesce("name", F.lit(f"(No {group_by})")))
    elif group_by == "codec":
        rows = files.withColumn("label", F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)), F.lit("")), F.lit("(No codec)")))
    else:
        rows = files.withColumn("label", F.when(rate >= 8, "2160p").when(rate >= 5, "1080p").when(rate >= 2.5, "720p").when(rate >= 1, "480p").when(rate.isNotNull(), "SD").otherwise("(No resolution)"))
    each = rows.groupBy("label").agg(F.sum("size").alias("bytes"), F.count_distinct("item_id").alias("items"), F.count("*").alias("files"))
    each = each.crossJoin(F.broadcast(total)).select("label", "bytes", "items", "files", F.round(F.col("bytes") / F.col("files") / 1024**3, 4).alias("average_gib"), F.round(100 * F.col("bytes") / F.col("all"), 4).alias("pct"))  # one row
    return top(each, limit, F.desc_nulls_last("bytes"), "label")


@tool(group_by=("month", "quarter", "year"), metric=("views", "items"))
def tag_usage(cat: Catalog, tag_names: tuple = (), group_by: str = "month", metric: str = "views", limit_periods: int = 12, top_n: int = 10) -> DataFrame:
    """Views (or items made) of tags in each of the last periods, 0 where there are none, with the trend against the period before:
    new activity, up or down by more than a tenth, stable, none. Without names the tags with the most of it."""
    names = [n.strip().lower() for n in tag_names]
    log = cat.views if metric == "views" else cat.items.select(F.col("id").alias("item_id"), F.col("created_at").alias("ts"))
    text = {"month": F.date_format("ts", "yyyy-MM"), "quarter": F.concat(F.year("ts").cast("string"), F.lit("-Q"), F.quarter("ts").cast("string")), "year": F.year("ts").cast("string")}[group_by]
    per_item = log.where("ts IS NOT NULL").groupBy("item_id", text.alias("period")).agg(F.count("*").alias("n"))
    used = cat.shown(cat.item_tags).join(per_item, "item_id").groupBy("tag_id", "period").agg(F.sum("n").alias("n"))
    if names:
        chosen = cat.tags.where(F.lower(F.trim("name")).isin(names)).select(F.col("id").alias("tag_id"))
    else:
        chosen = top(used.groupBy("tag_id").agg(F.sum("n").alias("s")), top_n, F.col("s").desc(), "tag_id").select("tag_id")
    periods = top(per_item.select("period").distinct(), limit_periods, F.col("period").desc())
    grid = chosen.crossJoin(F.broadcast(periods))  # limit_periods rows
    filled = grid.join(used, ["tag_id", "period"], "left").select("tag_id", "period", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.lag("n").over(_by("tag_id", "period"))
    filled = filled.withColumn("before", before)
    n, b = F.col("n"), F.col("before")
    trend = F.when(b.isNull() | ((b == 0) & (n == 0)), "none").when(b == 0, "new activity").when(n > b * 1.1, "up").when(n < b * 0.9, "down").otherwise("stable")
    return filled.select("tag_id", "period", "n", trend.alias("trend"))


def _by(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)


def _chosen_persons(cat: Catalog, names: tuple) -> DataFrame:
    """(person_id, name): one person for each name that finds one."""
    each = [resolved(cat.persons, n, "disambiguation") for n in names]
    return functools.reduce(DataFrame.unionByName, each).distinct().select(F.col("id").alias("person_id"), "name")


@tool()
def compare_persons(cat: Catalog, person_names: tuple) -> DataFrame:
    """Two to five people side by side: items, views, peaks, stars, how many items and which of their five most frequent tags all of them share, and who leads."""
    from pyspark.sql import Window

    who = _chosen_persons(cat, person_names)
    count = who.agg(F.count("*").alias("k"))
    own = cat.item_persons.join(F.broadcast(who.select("person_id")), "person_id")  # a few names
    sums = own.join(cat.engaged.withColumnRenamed("id", "item_id"), "item_id").groupBy("person_id").agg(F.count("*").alias("items"), F.sum("views").alias("views"), F.sum("peaks").alias("peaks"), F.round(F.avg("rating") / 20, 4).alias("stars"))
    shared = own.groupBy("item_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(count)).where("n = k").agg(F.count("*").alias("shared_items"))  # one row
    used = own.join(cat.item_tags, "item_id").groupBy("person_id", "tag_id").agg(F.count("*").alias("n"))
    five = used.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("n").desc(), "tag_id"))).where("place <= 5")
    tags = five.groupBy("tag_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(count)).where("n = k").join(_names(cat.tags, "tag_id"), "tag_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("shared_tags"))  # one row
    lead = sums.agg(F.max(F.struct("views", (-F.col("person_id")).alias("p"))).alias("v"), F.max(F.struct("items", (-F.col("person_id")).alias("p"))).alias("i")).select((-F.col("v.p")).alias("most_views"), (-F.col("i.p")).alias("most_items"))
    out = who.join(sums, "person_id")
    for part in (shared, tags, lead):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


@tool(method=("fingerprint", "size", "duration"))
def duplicate_files(cat: Catalog, method: str = "fingerprint", limit: int | None = 20) -> DataFrame:
    """Groups of items whose primary files agree: by a hash of the title (high confidence; it stands for a fingerprint), size (medium), or rounded length over 60 s (low)."""
    rows = cat.primary.join(cat.items.select(F.col("id").alias("item_id"), "title"), "item_id")
    key, sure = {"fingerprint": (F.md5(F.lower("title")), "high"), "size": (F.col("size").cast("string"), "medium"), "duration": (F.when(F.col("duration") > 60, F.round("duration").cast("bigint").cast("string")), "low")}[method]
    each = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"), F.sum("size").alias("bytes"))
    return top(each.where("items > 1").withColumn("confidence", F.lit(sure)), limit, F.col("items").desc(), "first_item", "key")


@tool(group_by=("year", "quarter", "month"))
def career(cat: Catalog, person_name: str = "", group_by: str = "year") -> DataFrame:
    """Items of people by period of creation with up to five orgs; all people, or one."""
    rows = cat.item_persons
    if person_name:
        rows = rows.join(F.broadcast(resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("person_id"))), "person_id")  # one row
    made = cat.items.where("created_at IS NOT NULL").join(cat.orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id", "left")
    ts = F.col("created_at")
    text = {"year": F.year(ts).cast("string"), "quarter": F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string")), "month": F.date_format(ts, "yyyy-MM")}[group_by]
    each = rows.join(made.select(F.col("id").alias("item_id"), text.alias("period"), "org"), "item_id").groupBy("person_id", "period").agg(F.count("*").alias("items"), F.array_sort(F.collect_set("org")).alias("o"))
    return each.select("person_id", "period", "items", F.size("o").cast("bigint").alias("orgs"), F.array_join(F.slice("o", 1, 5), ", ").alias("first_orgs"))


@tool()
def career_span(cat: Catalog) -> DataFrame:
    """First and last item of each person, the days between, and these in years of 365.25 days."""
    rows = cat.item_persons.join(cat.items.select(F.col("id").alias("item_id"), "created_at"), "item_id").where("created_at IS NOT NULL")
    each = rows.groupBy("person_id").agg(F.to_date(F.min("created_at")).alias("first"), F.to_date(F.max("created_at")).alias("last"))
    days = F.datediff("last", "first")
    return each.select("person_id", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), days.cast("bigint").alias("days"), F.round(days / 365.25, 4).alias("years"))


@tool(match_mode=("any", "all"))
def items_of_persons(cat: Catalog, person_names: tuple, match_mode: str = "any", limit: int | None = None) -> DataFrame:
    """Items of any, or of all, of the people found by name."""
    who = _chosen_persons(cat, person_names).select("person_id")
    each = cat.item_persons.join(F.broadcast(who), "person_id").groupBy("item_id").agg(F.count("*").alias("matched"))  # a few names
    if match_mode == "all":
        each = each.crossJoin(F.broadcast(who.agg(F.count("*").alias("k")))).where("matched = k").drop("k")  # one row
    return top(each, limit, F.col("matched").desc(), "item_id")


@tool()
def names_not_found(cat: Catalog, person_names: tuple) -> DataFrame:
    """The names that no person has."""
    asked = cat.spark.createDataFrame([(i, n) for i, n in enumerate(person_names)], "place int, asked string")
    found = cat.persons.join(F.broadcast(asked), F.contains(F.lower("name"), F.lower(F.trim("asked"))), "inner").select("place").distinct()  # as many rows as names are given
    return asked.join(found, "place", "left_anti").select("place", F.col("asked").alias("name"))


@tool(match_mode=("any", "all"))
def items_of_tags(cat: Catalog, tag_names: tuple, match_mode: str = "any", include_child_tags: bool = True, limit: int | None = None) -> DataFrame:
    """Items with any of the tags (and those below them, less the excluded ones), or with all of exactly these tags."""
    names = [n.strip().lower() for n in tag_names]
    roots = cat.tags.where(F.lower(F.trim("name")).isin(names)).select(F.col("id").alias("tag_id"), F.lower(F.trim("name")).alias("low"))
    if match_mode == "all":
        hit = cat.item_tags.join(F.broadcast(roots), "tag_id").groupBy("item_id").agg(F.count_distinct("low").alias("matched")).where(F.col("matched") == len(set(names)))  # a few names
    else:
        wanted = cat.tags_below(names) if include_child_tags else roots.select("tag_id")
        hit = cat.item_tags.join(cat.shown(wanted), "tag_id").groupBy("item_id").agg(F.count("*").alias("matched"))
    return top(hit, limit, F.col("matched").desc(), "item_id")


#: The weights of the engagement score (peaks, replays, stars) and the least decay.
PEAK, REPLAY, STAR, FLOOR = 20.0, 2.0, 1.5, 0.1


def engagement(rating="rating", views="views", peaks="peaks"):
    """peaks * 20 + replays * 2 + stars * 1.5 (stars only where rated)."""
    return F.col(peaks) * PEAK + F.greatest(F.col(views) - 1, F.lit(0)) * REPLAY + F.coalesce(F.col(rating), F.lit(0)) / 20.0 * STAR


@tool(sort_by=("input_order", "title", "rating"))
def enriched(cat: Catalog, item_ids: tuple = (), sort_by: str = "input_order") -> DataFrame:
    """Items as documents: org, people, tags, primary file, counts and engagement score; in the order of the ids, or all items."""
    rows = cat.engaged
    if item_ids:
        order = cat.spark.createDataFrame([(i, x) for x, i in enumerate(item_ids)], "id long, place int")
        rows = rows.join(F.broadcast(order), "id")  # as many rows as ids are given
    else:
        rows = rows.withColumn("place", F.lit(0))
    kept = rows.select("id")
    listed = lambda bridge, key, entities, out: bridge.join(kept.withColumnRenamed("id", "item_id"), "item_id", "left_semi").join(_names(entities, key), key).where("name IS NOT NULL").groupBy(F.col("item_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", key))), lambda x: x["name"]).alias(out))
    rows = rows.join(listed(cat.item_persons, "person_id", cat.persons, "people"), "id", "left").join(listed(cat.shown(cat.item_tags), "tag_id", cat.tags, "tags"), "id", "left")
    rows = rows.join(cat.orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id", "left").join(cat.primary.select(F.col("item_id").alias("id"), "path", "size"), "id", "left")
    none = F.array().cast("array<string>")
    file = F.element_at(F.split("path", "/"), -1)
    shown = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.when(F.size("people") > 0, F.concat(F.array_join(F.slice("people", 1, 2), ", "), F.when(F.size("people") > 2, F.concat(F.lit(" + "), (F.size("people") - 2).cast("string"))).otherwise(""), F.coalesce(F.concat(F.lit(" - "), file), F.lit("")))), file, F.concat(F.lit("Item "), F.col("id").cast("string")))
    out = rows.select(F.col("id").alias("item_id"), "place", shown.alias("display"), F.coalesce("org", F.lit("")).alias("org"), F.array_join(F.coalesce("people", none), "; ").alias("people"), F.array_join(F.coalesce("tags", none), "; ").alias("tags"), F.coalesce("path", F.lit("")).alias("path"), "views", "peaks", F.coalesce("rating", F.lit(-1)).alias("rating"), F.round(engagement(), 4).alias("score"))
    if not item_ids:
        return out.drop("place")
    return out.orderBy({"input_order": F.col("place"), "title": F.col("display"), "rating": F.col("rating").desc()}[sort_by], "item_id").drop("place")
