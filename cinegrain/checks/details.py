"""Registered calls of the hierarchy and detail tools with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..tools import details
from . import library as base
from .library import _person, _tag, below, lib

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(key, run, sql=None, excluded=(), **values):
    QUERIES[key] = lambda spark, d: run(Catalog(spark, d, excluded), **values)
    if sql:
        SQL[key] = sql


_EDGES = "te AS (SELECT id // 8 AS parent, id AS child FROM tg WHERE id > 0 AND id < 300)"
_DOWN = "dn(id, depth) AS (SELECT id, 0 FROM tag UNION SELECT child, depth + 1 FROM dn JOIN te ON parent = dn.id WHERE depth < 3)"
_UP = "up(id, depth) AS (SELECT id, 0 FROM tag UNION SELECT parent, depth + 1 FROM up JOIN te ON child = up.id WHERE depth < 3)"
add("tool_tag_hierarchy", details.tag_hierarchy, lib("SELECT d.id AS tag_id, d.depth::INT AS depth, name FROM (SELECT id, min(depth) AS depth FROM dn GROUP BY 1 UNION ALL SELECT id, -min(depth) FROM up GROUP BY 1 HAVING min(depth) > 0) d JOIN tg ON tg.id = d.id", _tag("ibis travel"), _EDGES, _DOWN, _UP, recursive=True), tag_name="ibis travel")
add("tool_tag_roots", details.tag_hierarchy, lib("SELECT parent AS tag_id, name, count(*) AS children FROM te JOIN tg ON tg.id = parent WHERE parent NOT IN (SELECT child FROM te) GROUP BY 1, 2 ORDER BY children DESC, 1 LIMIT 20", _EDGES))
_PAIRS = "pr(org_id, id, depth) AS (SELECT id, id, 0 FROM og UNION SELECT pr.org_id, o.id, depth + 1 FROM pr JOIN og o ON o.parent_id = pr.id WHERE depth < 60)"
_ABOVE = "pr(org_id, id, depth) AS (SELECT id, id, 0 FROM og UNION SELECT pr.org_id, o.parent_id, depth + 1 FROM pr JOIN og o ON o.id = pr.id WHERE o.parent_id IS NOT NULL AND depth < 60)"
_TOTALS = "tot AS (SELECT org_id, count(*) AS orgs, coalesce(sum(n), 0)::BIGINT AS items FROM (SELECT DISTINCT org_id, id FROM pr) p LEFT JOIN (SELECT org_id AS id, count(*) AS n FROM items GROUP BY 1) c USING (id) GROUP BY 1)"
for _mode, _rec in (("below", _PAIRS), ("above", _ABOVE)):
    add(f"tool_orgs_{_mode}", details.org_hierarchy, lib("SELECT org_id, id AS other_id, min(depth)::INT AS depth FROM pr GROUP BY 1, 2 HAVING min(depth) > 0", _rec, recursive=True), mode=_mode)
add("tool_org_totals", details.org_hierarchy, lib("SELECT * FROM tot", _PAIRS, _TOTALS, recursive=True), mode="totals")
add("tool_org_networks", details.org_hierarchy, lib("SELECT * FROM tot WHERE orgs > 1 AND org_id NOT IN (SELECT id FROM og WHERE parent_id IS NOT NULL) ORDER BY items DESC, org_id LIMIT 20", _PAIRS, _TOTALS, recursive=True), mode="networks")
_MARKS = "m AS (SELECT event_id AS marker_id, user_id AS item_id, event_type AS tag, floor(epoch(ts))::BIGINT AS second FROM events)"
add("tool_markers_timeline", details.markers, f"WITH {_MARKS} SELECT * FROM m WHERE item_id = 3 ORDER BY second, marker_id LIMIT 50", mode="timeline", item_id=3)
add("tool_markers_occurrences", details.markers, f"WITH {_MARKS} SELECT *, count(*) OVER () AS total FROM m WHERE tag = 'view' ORDER BY item_id, second, marker_id LIMIT 50", mode="occurrences", tag_name="View")
add("tool_markers_top", details.markers, f"WITH {_MARKS} SELECT tag, count(*) AS markers, count(DISTINCT item_id) AS items FROM m GROUP BY 1", mode="top_tags")
add("tool_rating_histogram", details.rating_histogram, lib("SELECT place::INT AS place, bucket, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM w), 4) AS pct FROM (VALUES (0, 'unrated'), (1, '1_star'), (2, '2_star'), (3, '3_star'), (4, '4_star'), (5, '5_star')) b(place, bucket) LEFT JOIN (SELECT CASE WHEN rating IS NULL OR rating <= 0 THEN 0 ELSE least(5, ceil(rating / 20)) END AS place, count(*) AS n FROM w GROUP BY 1) c USING (place)", "w AS (SELECT * FROM eng WHERE views > 0)"))
add("tool_length_totals", details.length_totals, lib("SELECT count(duration) AS files, round(coalesce(sum(duration), 0), 2) AS seconds, round(avg(duration) / 60, 4) AS minutes FROM prim"))
add("tool_rate_histogram", details.rate_histogram, lib("SELECT floor(size * 8 / duration / 1e6)::BIGINT AS rate, count(*) AS files FROM prim WHERE size IS NOT NULL AND duration <> 0 GROUP BY 1"))


def _names_by_views(bridge: str, names: str, key: str, more: str = "") -> str:
    return f"(SELECT string_agg(name, ', ' ORDER BY v DESC, id) FROM (SELECT n.id, n.name, sum(views) AS v FROM {bridge} b JOIN eng e ON e.id = b.item_id JOIN {names} n ON n.id = b.{key} WHERE views > 0 {more} GROUP BY 1, 2 ORDER BY v DESC, 1 LIMIT 5))"


add("tool_summary", details.summary_document, lib(f"SELECT count(*) AS items, count(*) FILTER (views > 0) AS watched, round(avg(views) FILTER (views > 0), 4) AS average_views, (SELECT round(avg(duration) / 60, 4) FROM prim) AS minutes, {_names_by_views('item_persons', 'ps', 'person_id')} AS people, {_names_by_views('item_tags', 'tg', 'tag_id')} AS tags, {_names_by_views('(SELECT id AS item_id, org_id FROM items)', 'og', 'org_id')} AS orgs, round(100 * count(*) FILTER (views > 0) / count(*), 4) AS watched_pct FROM eng"))
add("tool_top_tags_flat", details.top_tags_flat, lib("SELECT tag_id, name, count(*) AS items FROM item_tags JOIN tg ON id = tag_id WHERE lower(trim(name)) NOT IN ('loom travel') GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 10"), exclude=("Loom Travel",))
_SCORE = "(peaks * 20 + greatest(views - 1, 0) * 2 + coalesce(eng.rating, 0) / 20 * 1.5)"
add("tool_person_items", details.person_items, lib(f"SELECT eng.id AS item_id, views, peaks, round({_SCORE}, 4)::DOUBLE AS score, coalesce(t.tags, '') AS tags FROM eng JOIN item_persons p ON p.item_id = eng.id JOIN who ON who.id = person_id LEFT JOIN (SELECT item_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS tags FROM item_tags JOIN tg ON id = tag_id GROUP BY 1) t ON t.item_id = eng.id", _person("sel")), person_name="sel")
add("tool_person_engagement", details.person_engagement, lib(f"SELECT p.person_id, count(*) AS items, sum(views)::BIGINT AS views, sum(peaks)::BIGINT AS peaks, round(avg(eng.rating), 4) AS rating, round(sum({_SCORE}), 4)::DOUBLE AS score, coalesce(any_value(t.tags), '') AS tags FROM item_persons p JOIN eng ON eng.id = p.item_id LEFT JOIN t ON t.person_id = p.person_id GROUP BY 1", "t AS (SELECT person_id, string_agg(name, ', ' ORDER BY k) AS tags FROM (SELECT person_id, tag_id, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, tag_id) AS k FROM item_persons JOIN item_tags USING (item_id) GROUP BY 1, 2) JOIN tg ON tg.id = tag_id WHERE k <= 10 GROUP BY 1)"))
_PART = "CASE WHEN trim({1}) <> '' THEN '{0}: ' || trim({1}) || '.' END"
add("tool_metadata_text", details.metadata_text, lib("SELECT i.id AS item_id, concat_ws(' ', " + ", ".join(_PART.format(a, b) for a, b in (("Title", "title"), ("Performers", "people"), ("Studio", "o.name"), ("Tags", "t.tags"))) + ") AS text FROM items i LEFT JOIN people p ON p.item_id = i.id LEFT JOIN og o ON o.id = org_id LEFT JOIN (SELECT item_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS tags FROM item_tags JOIN tg ON id = tag_id GROUP BY 1) t ON t.item_id = i.id", base._PEOPLE))
add("tool_primary_paths", details.primary_paths, lib("SELECT item_id, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS folder, split_part(path, '/', -1) AS file, regexp_replace(split_part(path, '/', -1), '\\.\\w+$', '') AS stem, lower(regexp_extract(path, '\\.(\\w+)$', 1)) AS extension, path AS built FROM prim WHERE path IS NOT NULL"))
add("tool_tags_by_usage", details.tags_by_usage, lib("SELECT t.id AS tag_id, t.name, count(item_id) AS items FROM tg t LEFT JOIN item_tags ON tag_id = t.id WHERE t.id NOT IN (SELECT tag_id FROM below) GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 500", below(["goat sport"]), recursive=True), excluded=("goat sport",))
add("tool_orphans", details.orphans_of, lib("SELECT item_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT scene_id AS item_id, 'scene_embeddings' AS source FROM scene_embeddings UNION ALL SELECT scene_id, 'frame_embeddings' FROM frame_embeddings) WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT id FROM items) GROUP BY 1"))
add("tool_orphan_cleanup", details.orphan_cleanup, " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) FILTER (scene_id IN (1, 2, 3)) AS deleted, count(*) FILTER (coalesce(scene_id NOT IN (1, 2, 3), true)) AS kept FROM {t}" for t in ("scene_embeddings", "frame_embeddings")), item_ids=(1, 2, 3))
add("tool_model_keys", details.model_keys, "SELECT model_key FROM scene_embeddings WHERE model_key IS NOT NULL UNION SELECT model_key FROM frame_embeddings WHERE model_key IS NOT NULL")
_GOOD = "len({0}) = 40 AND len(list_filter({0}, lambda x: x IS NOT NULL AND isfinite(x))) = 40 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_SV = "sv AS (SELECT scene_id AS item_id, model_key, composite_embedding AS v, updated_at AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, model_key ORDER BY updated_at DESC NULLS LAST) AS rn FROM scene_embeddings WHERE scene_id IS NOT NULL AND model_key IS NOT NULL) WHERE rn = 1)"
_FV = "fv AS (SELECT scene_id AS item_id, model_key, frame_index AS frame, timestamp_s AS seconds, embedding AS v, created_at AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_index, model_key ORDER BY created_at DESC NULLS LAST) AS rn FROM frame_embeddings WHERE scene_id IS NOT NULL AND model_key IS NOT NULL AND frame_index IS NOT NULL) WHERE rn = 1)"
add("tool_vector_stats", details.vector_stats, f"WITH {_SV}, {_FV} " + " UNION ALL ".join(f"SELECT '{n}' AS source, model_key, count(*) AS rows, count(*) FILTER ({_GOOD.format('v')}) AS vectors, count(DISTINCT item_id) FILTER ({_GOOD.format('v')}) AS items, min(len(v))::INT AS shortest, max(len(v))::INT AS longest, min(at_) AS oldest, max(at_) AS newest FROM {t} GROUP BY model_key" for n, t in (("items", "sv"), ("frames", "fv"))))
_CHECKED = "ck AS (SELECT item_id, coalesce(e, -1)::BIGINT AS expected, stored, concat_ws('; ', CASE WHEN e IS NULL THEN 'no length' END, CASE WHEN stored < e THEN 'frames missing' END, CASE WHEN stored > e THEN 'frames left over' END, CASE WHEN highest > stored THEN 'gaps' END) AS problems FROM (SELECT item_id, stored, highest, CASE WHEN duration IS NOT NULL THEN greatest(1, floor(duration)) END AS e FROM (SELECT scene_id AS item_id, count(DISTINCT frame_index) AS stored, max(frame_index) + 1 AS highest FROM frame_embeddings WHERE scene_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1) LEFT JOIN prim USING (item_id)))"
add("tool_frame_counts", details.frame_counts_checked, lib("SELECT * FROM ck", _CHECKED))
add("tool_frame_counts_summary", details.frame_counts_summary, lib("SELECT CASE WHEN problems = '' THEN 'ok' WHEN contains(problems, 'no length') THEN 'error' ELSE 'needs work' END AS state, count(*) AS items FROM ck GROUP BY 1", _CHECKED))
add("tool_item_context", details.item_context, lib("SELECT i.id AS item_id, (SELECT count(*) FROM item_persons p WHERE p.item_id = i.id) AS people, coalesce(u.n, 0) AS person_tags, (SELECT count(*) FROM item_tags t WHERE t.item_id = i.id) AS own_tags FROM items i LEFT JOIN (SELECT p.item_id, count(DISTINCT pt.tag_id) AS n FROM item_persons p JOIN (SELECT DISTINCT person_id, tag_id FROM item_persons JOIN item_tags USING (item_id)) pt USING (person_id) GROUP BY 1) u ON u.item_id = i.id"))
add("tool_exclusion_names", details.exclusion_names, lib("SELECT tag_id, name FROM below JOIN tg ON id = tag_id", below(["ibis travel"]), recursive=True), names=("Ibis Travel",))
add("tool_plain_tags", details.plain_tags, lib("SELECT id AS tag_id, name FROM tg WHERE NOT regexp_matches(coalesce(name, ''), '[\\[\\](){}<>]')"))


def tool_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of the items by score."""
    return details.page_of(details.scored_items(Catalog(spark, d)).select("item_id", F.round("score", 4).alias("score")), [F.col("score").desc(), "item_id"], 3, 20)


def tool_page_decayed(spark: SparkSession, d: str) -> DataFrame:
    """The first page by the decayed score."""
    return details.page_of(details.scored_items(Catalog(spark, d), half_life=30).select("item_id", F.round("score", 4).alias("score")), [F.col("score").desc(), "item_id"], 1, 20)


def tool_search_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for posts (customer: topic, price: likes, priority: query), customers for topics."""
    cat = Catalog(spark, d)
    posts = cat.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic_id"), F.col("o_totalprice").alias("likes"), F.col("o_orderpriority").alias("query"))
    topics = cat.table("customer").select(F.col("c_custkey").alias("topic_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("title"))
    return details.merged_search(posts, topics)


for _f in (tool_page, tool_page_decayed, tool_search_merge):
    QUERIES[_f.__name__] = _f
_DECAY = "greatest(0.1, power(0.5, greatest(epoch(TIMESTAMP '2025-11-01')::BIGINT - floor(epoch(last_ts))::BIGINT, 0) / 86400.0 / 30))"
SQL["tool_page"] = lib(f"SELECT item_id, score, total, ceil(total / 20)::BIGINT AS pages, total > 60 AS has_more FROM (SELECT id AS item_id, round({_SCORE}, 4)::DOUBLE AS score, count(*) OVER () AS total FROM eng WHERE {_SCORE} > 0) ORDER BY score DESC, item_id LIMIT 20 OFFSET 40")
SQL["tool_page_decayed"] = lib(f"SELECT item_id, score, total, ceil(total / 20)::BIGINT AS pages, total > 20 AS has_more FROM (SELECT id AS item_id, round({_SCORE} * coalesce({_DECAY}, 0.1), 4)::DOUBLE AS score, count(*) OVER () AS total FROM eng WHERE {_SCORE} > 0) ORDER BY score DESC, item_id LIMIT 20")
SQL["tool_search_merge"] = "SELECT o_orderkey AS id, o_custkey AS topic_id, o_totalprice AS likes, coalesce(c_name, '') AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY likes DESC, id DESC LIMIT 25"
