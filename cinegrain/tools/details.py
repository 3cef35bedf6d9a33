"""Hierarchies, markers, and the smaller queries around items: histograms, summaries, texts, propagation, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, newest
from ..operators.vectors import reach
from .base import all_of, found_by_name, resolved, tool, top
from .library import FLOOR, _names, _ranked, engagement


@tool(direction=("parents", "children", "both"))
def tag_hierarchy(cat: Catalog, tag_name: str = "", direction: str = "both", depth: int = 3, limit: int = 20) -> DataFrame:
    """Tags above (depth below 0) and below a tag up to a depth; without a name the roots with the most tags right below them."""
    if not tag_name:
        kids = cat.tag_edges.groupBy(F.col("parent").alias("tag_id")).agg(F.count("*").alias("children"))
        roots = kids.join(cat.tag_edges.select(F.col("child").alias("tag_id")), "tag_id", "left_anti")
        return top(roots.join(_names(cat.tags, "tag_id"), "tag_id"), limit, F.col("children").desc(), "tag_id")
    root = resolved(cat.tags, tag_name).select("id")
    up = cat.tag_edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    parts = []
    if direction in ("children", "both"):
        parts.append(reach(cat.tag_edges, root, [], depth))
    if direction in ("parents", "both"):
        parts.append(reach(up, root, [], depth).withColumn("depth", -F.col("depth")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].where("depth < 0"))
    return rows.select(F.col("id").alias("tag_id"), "depth").join(_names(cat.tags, "tag_id"), "tag_id")


@tool(mode=("below", "above", "totals", "networks"))
def org_hierarchy(cat: Catalog, org_name: str = "", mode: str = "below", limit: int = 20) -> DataFrame:
    """Orgs below or above one (or all of them, as pairs), the items of each org with all below it, or the networks: roots by such items."""
    orgs = cat.orgs.select(F.col("id").alias("org_id"), F.col("id"))
    if org_name:
        orgs = orgs.join(F.broadcast(found_by_name(cat.orgs, org_name).select("id")), "id", "left_semi")  # one row
    edges = cat.org_edges if mode != "above" else cat.org_edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    pairs = reach(edges, orgs, ["org_id"])
    if mode in ("below", "above"):
        return pairs.select("org_id", F.col("id").alias("other_id"), "depth").where("depth > 0")
    own = cat.items.groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("n"))
    totals = pairs.join(own, "id", "left").groupBy("org_id").agg(F.count("*").alias("orgs"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    if mode == "totals":
        return totals
    roots = totals.join(cat.org_edges.select(F.col("child").alias("org_id")), "org_id", "left_anti").where("orgs > 1")
    return top(roots, limit, F.col("items").desc(), "org_id")


@tool(mode=("timeline", "occurrences", "top_tags"))
def markers(cat: Catalog, mode: str, item_id: int | None = None, tag_name: str = "", limit: int = 50) -> DataFrame:
    """Markers (events stand in: item, tag, second): the timeline of an item, the occurrences of a tag with their total, or the most used tags."""
    rows = cat.table("events").select(F.col("event_id").alias("marker_id"), F.col("user_id").alias("item_id"), F.col("event_type").alias("tag"), F.unix_timestamp("ts").alias("second"))
    if mode == "timeline":
        return top(rows.where(F.col("item_id") == item_id), limit, "second", "marker_id")
    if mode == "occurrences":
        hit = rows.where(F.lower("tag") == tag_name.strip().lower())
        return top(hit, limit, "item_id", "second", "marker_id").crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))  # one row
    return top(rows.groupBy("tag").agg(F.count("*").alias("markers"), F.count_distinct("item_id").alias("items")), limit, F.col("markers").desc(), "tag")


#: The rating buckets in the order of display, each with its greatest rating.
RATING_BUCKETS = (("unrated", 0), ("1_star", 20), ("2_star", 40), ("3_star", 60), ("4_star", 80), ("5_star", 100))


def bucketed(value: Column, bounds: tuple) -> Column:
    """The first bucket whose bound the value doesn't pass; nulls go into the first, the rest into the last."""
    out = F.when(value.isNull(), bounds[0][0])
    for name, bound in bounds[:-1]:
        out = out.when(value <= bound, name)
    return out.otherwise(bounds[-1][0])


def densified(counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(place, key, n): one row for each name in the order given, 0 where counts has none."""
    frame = counts.sparkSession.createDataFrame(list(enumerate(names)), f"place int, {key} string")
    return frame.join(counts, key, "left").select("place", key, F.coalesce("n", F.lit(0)).alias("n"))


@tool()
def rating_histogram(cat: Catalog) -> DataFrame:
    """Watched items by six rating buckets with their share in percent; empty buckets have 0."""
    seen = cat.items.join(cat.views, cat.items["id"] == cat.views["item_id"], "left_semi")
    rows = densified(seen.groupBy(bucketed(F.col("rating"), RATING_BUCKETS).alias("bucket")).agg(F.count("*").alias("n")), "bucket", [b for b, _ in RATING_BUCKETS])
    total = seen.agg(F.count("*").alias("all"))
    return rows.crossJoin(F.broadcast(total)).select("place", "bucket", "n", F.round(F.coalesce(100 * F.col("n") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)), 4).alias("pct"))  # one row


@tool()
def length_totals(cat: Catalog) -> DataFrame:
    """Files, seconds and the mean minutes of the primary files."""
    return cat.primary.agg(F.count("duration").alias("files"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 2).alias("seconds"), F.round(F.avg("duration") / 60, 4).alias("minutes"))


@tool()
def rate_histogram(cat: Catalog) -> DataFrame:
    """Primary files by megabits per second, rounded down."""
    rate = F.floor(F.col("size") * 8 / F.nullif(F.col("duration"), F.lit(0.0)) / 1e6)
    return cat.primary.where(rate.isNotNull()).groupBy(rate.alias("rate")).agg(F.count("*").alias("files"))


@tool()
def summary_document(cat: Catalog, limit: int = 5) -> DataFrame:
    """One row that merges totals, watched share, mean plays of the watched, mean minutes, and the names of the top people, tags and orgs by views."""
    base = cat.engaged.agg(F.count("*").alias("items"), F.count_if(F.col("views") > 0).alias("watched"), F.round(F.avg(F.when(F.col("views") > 0, F.col("views"))), 4).alias("average_views"))
    out = base.crossJoin(F.broadcast(cat.primary.agg(F.round(F.avg("duration") / 60, 4).alias("minutes"))))  # one row
    own = cat.items.where("org_id IS NOT NULL").select(F.col("id").alias("item_id"), "org_id")
    for name, bridge, entities, key in (("people", cat.item_persons, cat.persons, "person_id"), ("tags", cat.shown(cat.item_tags), cat.tags, "tag_id"), ("orgs", own, cat.orgs, "org_id")):
        rows = _ranked(cat, bridge, entities, key, "views", limit)
        line = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), key, "name"))), lambda x: x["name"]), ", ").alias(name))
        out = out.crossJoin(F.broadcast(line))  # one row
    return out.withColumn("watched_pct", F.round(100 * F.col("watched") / F.nullif(F.col("items"), F.lit(0)), 4))


@tool()
def top_tags_flat(cat: Catalog, exclude: tuple = (), limit: int = 10) -> DataFrame:
    """Names of the tags with the most items; the excluded ones by name alone, not those below them."""
    gone = [n.strip().lower() for n in exclude]
    names = cat.tags.where(~F.lower(F.trim("name")).isin(gone)) if gone else cat.tags
    return top(cat.item_tags.groupBy("tag_id").agg(F.count("*").alias("items")).join(_names(names, "tag_id"), "tag_id"), limit, F.col("items").desc(), "tag_id")


@tool()
def person_items(cat: Catalog, person_name: str) -> DataFrame:
    """The items of a person with engagement score and tags."""
    who = resolved(cat.persons, person_name, "disambiguation").select(F.col("id").alias("person_id"))
    own = cat.item_persons.join(F.broadcast(who), "person_id").select("item_id")  # one row
    tags = cat.item_tags.join(own, "item_id", "left_semi").join(_names(cat.tags, "tag_id"), "tag_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("tags"))
    rows = cat.engaged.withColumnRenamed("id", "item_id").join(own, "item_id", "left_semi").join(tags, "item_id", "left")
    return rows.select("item_id", "views", "peaks", F.round(engagement(), 4).alias("score"), F.coalesce("tags", F.lit("")).alias("tags"))


@tool()
def person_engagement(cat: Catalog, limit: int = 10) -> DataFrame:
    """Each person's items, views, peaks, mean rating over the rated items, total score, and ten most frequent tags."""
    rows = cat.item_persons.join(cat.engaged.withColumnRenamed("id", "item_id"), "item_id")
    sums = rows.groupBy("person_id").agg(F.count("*").alias("items"), F.sum("views").alias("views"), F.sum("peaks").alias("peaks"), F.round(F.avg("rating"), 4).alias("rating"), F.round(F.sum(engagement()), 4).alias("score"))
    used = cat.item_persons.join(cat.item_tags, "item_id").groupBy("person_id", "tag_id").agg(F.count("*").alias("n"))
    ten = used.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("n").desc(), "tag_id"))).where(F.col("place") <= limit).join(_names(cat.tags, "tag_id"), "tag_id")
    tags = ten.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("tags"))
    return sums.join(tags, "person_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


@tool()
def metadata_text(cat: Catalog) -> DataFrame:
    """Each item as "Title: ... Performers: ... Studio: ... Tags: ...", without the parts that are missing."""
    listed = lambda bridge, key, entities, out: bridge.join(_names(entities, key), key).groupBy(F.col("item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias(out))
    rows = cat.items.join(listed(cat.item_persons, "person_id", cat.persons, "people"), "id", "left").join(listed(cat.item_tags, "tag_id", cat.tags, "tags"), "id", "left").join(cat.orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id", "left")
    part = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(label + ": "), F.trim(c), F.lit(".")))
    return rows.select(F.col("id").alias("item_id"), F.concat_ws(" ", part("Title", "title"), part("Performers", "people"), part("Studio", "org"), part("Tags", "tags")).alias("text"))


@tool()
def primary_paths(cat: Catalog) -> DataFrame:
    """Folder, file name, stem and extension of the primary file, and the path built from them again."""
    file = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return cat.primary.where("path IS NOT NULL").select("item_id", folder.alias("folder"), file.alias("file"), F.regexp_replace(file, r"\.\w+$", "").alias("stem"), F.lower(F.regexp_extract(file, r"\.(\w+)$", 1)).alias("extension"), F.concat(folder, F.lit("/"), file).alias("built"))


@tool()
def tags_by_usage(cat: Catalog, limit: int = 500) -> DataFrame:
    """The most used tags, unused ones with 0, without the excluded ones and those below them."""
    counts = cat.item_tags.groupBy("tag_id").agg(F.count("*").alias("items"))
    return top(cat.shown(_names(cat.tags, "tag_id")).join(counts, "tag_id", "left").select("tag_id", "name", F.coalesce("items", F.lit(0)).alias("items")), limit, F.col("items").desc(), "tag_id")


def propagated_tags(cat: Catalog, neighbours: DataFrame, limit: int = 15) -> DataFrame:
    """From (item_id, other_id, similarity): the tags of an item's neighbours it doesn't have, by summed similarity, with the items they come from; `limit` per item."""
    each = neighbours.join(cat.item_tags.withColumnRenamed("item_id", "other_id"), "other_id").join(cat.item_tags, ["item_id", "tag_id"], "left_anti")
    sums = each.groupBy("item_id", "tag_id").agg(F.round(F.sum("similarity"), 6).alias("score"), F.array_join(F.array_sort(F.collect_list("other_id")).cast("array<string>"), ",").alias("sources"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "tag_id"))).where(F.col("place") <= limit)


@tool()
def orphans_of(cat: Catalog) -> DataFrame:
    """Items that have vectors (of items or of frames) and are not in the catalogue, with the tables they are in."""
    parts = [cat.table(t).select(F.col("scene_id").alias("item_id"), F.lit(t).alias("source")).where("item_id IS NOT NULL").distinct() for t in ("scene_embeddings", "frame_embeddings")]
    gone = parts[0].unionByName(parts[1]).join(cat.items.select(F.col("id").alias("item_id")), "item_id", "left_anti")
    return gone.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@tool()
def orphan_cleanup(cat: Catalog, item_ids: tuple = ()) -> DataFrame:
    """A dry run: how many rows of each vector table deleting these items (or else all orphans) takes out and leaves. sources.tables.without does it."""
    out = None
    gone = orphans_of(cat).select("item_id") if not item_ids else cat.spark.createDataFrame([(i,) for i in item_ids], "item_id long")
    for t in ("scene_embeddings", "frame_embeddings"):
        rows = cat.table(t).select(F.col("scene_id").alias("item_id")).join(gone.withColumn("gone", F.lit(True)), "item_id", "left")
        part = rows.agg(F.count("gone").alias("deleted"), F.count_if(F.col("gone").isNull()).alias("kept")).select(F.lit(t).alias("source"), "deleted", "kept")
        out = part if out is None else out.unionByName(part)
    return out


@tool()
def model_keys(cat: Catalog) -> DataFrame:
    """The models of the vector tables, each once."""
    parts = [cat.table(t).select("model_key") for t in ("scene_embeddings", "frame_embeddings")]
    return parts[0].unionByName(parts[1]).where("model_key IS NOT NULL").distinct()


@tool()
def vector_stats(cat: Catalog) -> DataFrame:
    """Current usable vectors by table and model: number, items, least and greatest length, and the lengths met among all current rows."""
    out = None
    for name, rows, raw, keys, version, vector in (
        ("items", cat.vectors, "scene_embeddings", ["scene_id", "model_key"], "updated_at", "composite_embedding"),
        ("frames", cat.frames, "frame_embeddings", ["scene_id", "frame_index", "model_key"], "created_at", "embedding"),
    ):
        good = rows.groupBy("model_key").agg(F.count("*").alias("vectors"), F.count_distinct("item_id").alias("items"))
        current = newest(cat.table(raw).select(*keys, vector, version), keys, version)
        size = F.when(F.col(vector).isNotNull(), F.size(vector))
        lengths = current.groupBy("model_key").agg(F.count("*").alias("rows"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.min(version).alias("oldest"), F.max(version).alias("newest"))
        part = lengths.join(good, "model_key", "left").select(F.lit(name).alias("source"), "model_key", "rows", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("items", F.lit(0)).alias("items"), "shortest", "longest", "oldest", "newest")
        out = part if out is None else out.unionByName(part)
    return out


@tool()
def frame_counts_checked(cat: Catalog, fps: float = 1.0) -> DataFrame:
    """Items with frames of any model: expected frames by length, stored ones, and what is wrong."""
    stored_rows = cat.table("frame_embeddings").dropna(subset=["scene_id", "frame_index"]).groupBy(F.col("scene_id").alias("item_id")).agg(F.count_distinct("frame_index").alias("stored"), (F.max("frame_index") + 1).cast("bigint").alias("highest"))
    rows = stored_rows.join(cat.primary.select("item_id", "duration"), "item_id", "left")
    expected = F.when(F.col("duration").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("duration") * fps)))
    problems = F.concat_ws("; ", F.when(expected.isNull(), "no length"), F.when(F.col("stored") < expected, "frames missing"), F.when(F.col("stored") > expected, "frames left over"), F.when(F.col("highest") > F.col("stored"), "gaps"))
    return rows.select("item_id", F.coalesce(expected, F.lit(-1)).alias("expected"), "stored", problems.alias("problems"))


@tool()
def frame_counts_summary(cat: Catalog, fps: float = 1.0) -> DataFrame:
    """How many items are right, need work, or can't be judged."""
    p = F.col("problems")
    return frame_counts_checked(cat, fps=fps).groupBy(F.when(p == "", "ok").when(F.contains(p, F.lit("no length")), "error").otherwise("needs work").alias("state")).agg(F.count("*").alias("items"))


@tool()
def item_context(cat: Catalog) -> DataFrame:
    """How many people an item has, how many different tags these people's items have, and how many tags of its own."""
    person_tags = cat.item_persons.join(cat.item_tags, "item_id").select("person_id", "tag_id").distinct()
    # The union is made once for each set of people, not for each item, so a person with many items costs no more.
    casts = cat.item_persons.groupBy("item_id").agg(F.array_sort(F.collect_set("person_id")).alias("set")).withColumn("key", F.struct(F.xxhash64("set").alias("x"), F.xxhash64(F.lit(1), "set").alias("y")))
    sets = casts.groupBy("key").agg(F.first("set").alias("set")).select("key", F.explode("set").alias("person_id"))
    unions = sets.join(person_tags, "person_id").select("key", "tag_id").distinct().groupBy("key").agg(F.count("*").alias("person_tags"))
    union = casts.join(unions, "key", "left").select("item_id", F.size("set").cast("bigint").alias("people"), "person_tags")
    own = cat.item_tags.groupBy("item_id").agg(F.count("*").alias("own_tags"))
    rows = cat.items.select(F.col("id").alias("item_id"))
    for part in (union, own):
        rows = rows.join(part, "item_id", "left")
    return rows.select("item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("people", "person_tags", "own_tags")])


def suggested_tags(texts: DataFrame, key: str, text: str, tags: DataFrame, present: DataFrame) -> DataFrame:
    """(key, tag_id, name): known tags that a "Suggested tags:" section of a text lists and the item doesn't have.

    One per line or comma, bullets and trailing parentheses stripped, case aside; the section ends at an empty line. present: (key, tag_id).
    """
    section = F.regexp_extract(F.col(text), r"(?is)suggested tags:?\s*(.*?)(?:\n\s*\n|$)", 1)
    name = F.regexp_replace(F.regexp_replace(F.col("part"), r"^[\s\-*•\d.)]+", ""), r"\s*(?:\([^()]*\))?\s*$", "")
    parts = texts.select(key, F.explode(F.split(section, r"[\n,]")).alias("part")).select(key, F.lower(name).alias("low")).where("low <> ''").distinct()
    known = tags.select(F.col("id").alias("tag_id"), "name", F.lower(F.trim("name")).alias("low"))
    return parts.join(known, "low").drop("low").join(present, [key, "tag_id"], "left_anti")


def merged_search(posts: DataFrame, topics: DataFrame, limit: int = 25) -> DataFrame:
    """External search results: posts (id, topic_id, likes, query) of several query variants, each once (its first query), with the title of the first topic of that id, by (likes, id)."""
    once = posts.groupBy("id").agg(F.min(F.struct("query", "topic_id", "likes")).alias("p")).select("id", "p.*")
    first = topics.groupBy("topic_id").agg(F.min(F.struct("place", "title")).alias("t")).select("topic_id", "t.title")
    return top(once.join(first, "topic_id", "left").select("id", "topic_id", "likes", F.coalesce("title", F.lit("")).alias("title")), limit, F.col("likes").desc(), F.col("id").desc())


@tool()
def exclusion_names(cat: Catalog, names: tuple) -> DataFrame:
    """The tags that excluding these names leaves out, with their names."""
    return cat.tags_below(names).join(_names(cat.tags, "tag_id"), "tag_id")


def page_of(df: DataFrame, order: list, page: int, per_page: int) -> DataFrame:
    """One page of a result in a total order, each row with total, pages and has_more. Pages count from 1; the order is needed to tell the page."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(total)).select("*", F.ceil(F.col("total") / per_page).alias("pages"), (F.col("total") > page * per_page).alias("has_more"))  # one row


def filtered(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """The rows that meet all the conditions that are given."""
    return df.where(all_of(*conditions.values()))


def without_brackets(name: Column) -> Column:
    """Whether a name has none of []{}()<>."""
    return ~F.coalesce(name, F.lit("")).rlike(r"[\[\](){}<>]")


@tool()
def plain_tags(cat: Catalog) -> DataFrame:
    """Tags whose names have no brackets."""
    return _names(cat.tags, "tag_id").where(without_brackets(F.col("name")))


def watched_items(cat: Catalog) -> DataFrame:
    """item_id of the items with a view."""
    return cat.views.select("item_id").distinct()


def scored_items(cat: Catalog, half_life: float | None = None) -> DataFrame:
    """(item_id, score): the engagement score of the items that have any, halved every half_life days since the last view, to a tenth at least."""
    score = engagement()
    if half_life:
        days = F.greatest(F.unix_timestamp(cat.today.cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp")), F.lit(0)) / 86400.0
        score = score * F.coalesce(F.greatest(F.lit(FLOOR), F.pow(F.lit(0.5), days / half_life)), F.lit(FLOOR))
    return cat.engaged.select(F.col("id").alias("item_id"), score.alias("score")).where("score > 0")

