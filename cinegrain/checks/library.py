"""Registered calls of the library tools, and SQL written from what the tools promise, over the raw tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..tools import library

_BASE = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1),
items AS (SELECT id, title, greatest(coalesce(play_count, 0), 0)::BIGINT AS plays, greatest(coalesce(o_counter, 0), 0)::BIGINT AS peaks, rating100 AS rating, coalesce(organized, false) AS organized, studio_id AS org_id, created_at, updated_at FROM cur),
item_tags AS (SELECT DISTINCT id AS item_id, u.t.id AS tag_id FROM cur, unnest(cur.tags) AS u(t) WHERE u.t.id IS NOT NULL),
item_persons AS (SELECT DISTINCT id AS item_id, u.t.id AS person_id FROM cur, unnest(cur.performers) AS u(t) WHERE u.t.id IS NOT NULL),
files AS (SELECT id AS item_id, n - 1 AS nth, f.path AS path, f.size AS size, f.duration AS duration FROM (SELECT id, unnest(files) AS f, generate_subscripts(files, 1) AS n FROM cur) WHERE f IS NOT NULL),
prim AS (SELECT * FROM files WHERE nth = 0),
tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM tags WHERE id IS NOT NULL) WHERE rn = 1),
ps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM performers WHERE id IS NOT NULL) WHERE rn = 1),
og AS (SELECT DISTINCT ON (id) * FROM studios WHERE id IS NOT NULL),
log AS (SELECT DISTINCT scene_id AS item_id, view_date AS ts FROM scenes_view_dates WHERE scene_id IS NOT NULL AND view_date IS NOT NULL),
vc AS (SELECT item_id, count(*) AS views, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY 1),
eng AS (SELECT i.*, coalesce(v.views, 0) AS views, v.first_ts, v.last_ts, p.duration FROM items i LEFT JOIN vc v ON v.item_id = i.id LEFT JOIN prim p ON p.item_id = i.id)"""


def lib(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{''.join(', ' + m for m in more)} {body}"


def _person(text: str, alias: str = "disambiguation") -> str:
    rank = f"CASE WHEN lower(name) = '{text}' THEN 0 WHEN lower({alias}) = '{text}' THEN 1 WHEN contains(lower(name), '{text}') THEN 2 END"
    return f"who AS (SELECT id FROM (SELECT id, name, {rank} AS r FROM ps) WHERE r IS NOT NULL ORDER BY r, CASE WHEN r = 2 THEN length(name) ELSE 0 END, id LIMIT 1)"


def _tag(text: str) -> str:
    rank = f"CASE WHEN lower(name) = '{text}' THEN 0 WHEN contains(lower(name), '{text}') THEN 2 END"
    return f"tag AS (SELECT id FROM (SELECT id, name, {rank} AS r FROM tg) WHERE r IS NOT NULL ORDER BY r, CASE WHEN r = 2 THEN length(name) ELSE 0 END, id LIMIT 1)"


def below(names: list[str], name: str = "below") -> str:
    """The closure over the tree of tags in which k is below k div 8."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"{name}(tag_id) AS (SELECT id FROM tg WHERE lower(trim(name)) IN ({listed}) UNION SELECT t.id FROM tg t JOIN {name} b ON t.id // 8 = b.tag_id WHERE t.id > 0 AND t.id < 300)"


_PEOPLE = "people AS (SELECT item_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS people FROM item_persons JOIN ps ON ps.id = person_id GROUP BY 1)"
_EXCLUDED = ["loom travel", "goat sport"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(key: str, run: Callable[..., DataFrame], sql: str | None = None, excluded: tuple = (), **values: Any) -> None:
    """Registers a call of a tool with its parameters."""
    QUERIES[key] = lambda spark, d: run(Catalog(spark, d, excluded), **values)
    if sql:
        SQL[key] = sql


def _entity(bridge: str, names: str, key: str, value: str, where: str = "true", limit: int = 10, more: tuple = (), recursive: bool = False) -> str:
    return lib(f"SELECT b.{key}, n.name, sum({value})::BIGINT AS value, count(*) AS items FROM {bridge} b JOIN eng e ON e.id = b.item_id JOIN {names} n ON n.id = b.{key} WHERE {where} GROUP BY 1, 2 ORDER BY value DESC, 1 LIMIT {limit}", *more, recursive=recursive)


add("tool_person_tags", library.person_tags, lib("SELECT t.tag_id, g.name, sum(coalesce(nullif(e.views, 0), 1))::BIGINT AS weight FROM item_persons p JOIN who ON who.id = p.person_id JOIN item_tags t ON t.item_id = p.item_id JOIN eng e ON e.id = p.item_id JOIN tg g ON g.id = t.tag_id WHERE t.tag_id NOT IN (SELECT tag_id FROM below) GROUP BY 1, 2 ORDER BY weight DESC, 1 LIMIT 20", _person("sel"), below(_EXCLUDED), recursive=True), excluded=tuple(_EXCLUDED), person_name="sel")
add("tool_person_tags_unweighted", library.person_tags, lib("SELECT t.tag_id, g.name, count(*) AS weight FROM item_persons p JOIN who ON who.id = p.person_id JOIN item_tags t ON t.item_id = p.item_id JOIN tg g ON g.id = t.tag_id GROUP BY 1, 2 ORDER BY weight DESC, 1 LIMIT 20", _person("sel")), person_name="sel", weighted_by_views=False)
add("tool_tag_persons", library.tag_persons, lib("SELECT person_id, name, count(*) AS items FROM item_tags t JOIN tag ON tag.id = t.tag_id JOIN item_persons p ON p.item_id = t.item_id JOIN ps ON ps.id = person_id GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 20", _tag("ladder")), tag_name="ladder")
add("tool_viewing_top_items", library.viewing, lib("SELECT item_id, views, title FROM vc JOIN items ON id = item_id ORDER BY views DESC, item_id LIMIT 10"), stat_type="top_items")
add("tool_viewing_top_persons", library.viewing, lib("SELECT person_id, name, sum(views)::BIGINT AS views, count(*) AS items FROM item_persons JOIN vc USING (item_id) JOIN ps ON ps.id = person_id GROUP BY 1, 2 ORDER BY views DESC, 1 LIMIT 10"), stat_type="top_persons")
add("tool_viewing_top_tags", library.viewing, lib("SELECT tag_id, name, sum(views)::BIGINT AS views, count(*) AS items FROM item_tags JOIN vc USING (item_id) JOIN tg ON tg.id = tag_id GROUP BY 1, 2 ORDER BY views DESC, 1 LIMIT 10"), stat_type="top_tags")
add("tool_viewing_recent", library.viewing, lib("SELECT item_id, ts, coalesce(people, '') AS people FROM log LEFT JOIN people USING (item_id) ORDER BY ts DESC, item_id LIMIT 10", _PEOPLE), stat_type="recent_views")
for _sort, _value, _where in (("views", "views", "views > 0"), ("items", "1", "true"), ("peaks", "peaks", "peaks > 0"), ("duration", "plays * 600", "plays > 0")):
    add(f"tool_top_persons_{_sort}", library.top_persons, _entity("item_persons", "ps", "person_id", _value, _where), sort_by=_sort)
    if _sort != "duration":
        add(f"tool_top_tags_{_sort}", library.top_tags, _entity("item_tags", "tg", "tag_id", _value, f"{_where} AND b.tag_id NOT IN (SELECT tag_id FROM below)", more=(below(_EXCLUDED),), recursive=True), sort_by=_sort, exclude_tags=tuple(_EXCLUDED))
    if _sort in ("views", "items"):
        add(f"tool_top_orgs_{_sort}", library.top_orgs, _entity("(SELECT id AS item_id, org_id FROM items WHERE org_id IS NOT NULL)", "og", "org_id", _value, _where), sort_by=_sort)
add("tool_library_totals", library.library_totals, lib("SELECT count(*) AS items, count(*) FILTER (views > 0) AS watched, sum(views)::BIGINT AS views, sum(peaks)::BIGINT AS peaks, count(*) FILTER (organized) AS organized, count(rating) AS rated, (SELECT count(*) FROM ps) AS persons, (SELECT count(*) FROM tg) AS tags, (SELECT count(*) FROM og) AS orgs, round((SELECT sum(duration) FROM prim) / 3600, 4) AS hours, round((SELECT sum(size) FROM prim) / 1073741824.0, 4)::DOUBLE AS gib, round((SELECT sum(duration) FROM prim) / 3600 * 60 / count(*), 4) AS average_minutes FROM eng"))
for _kind, _expr, _last in (("hourly", "strftime(ts, '%H')", ""), ("weekday", "dayofweek(ts)::VARCHAR", ""), ("monthly", "strftime(ts, '%Y-%m')", "ORDER BY 1 DESC LIMIT 12"), ("recent", "strftime(ts, '%Y-%m-%d')", "ORDER BY 1 DESC LIMIT 30")):
    add(f"tool_pattern_{_kind}", library.watching_pattern, lib(f"SELECT {_expr} AS bucket, count(*) AS views, count(DISTINCT item_id) AS items FROM log GROUP BY 1 {_last}"), pattern_type=_kind)
add("tool_tag_partners", library.tag_partners, lib("SELECT o.tag_id, g.name, count(*) AS items FROM item_tags t JOIN tag ON tag.id = t.tag_id JOIN item_tags o ON o.item_id = t.item_id AND o.tag_id <> t.tag_id JOIN tg g ON g.id = o.tag_id GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 10", _tag("ladder")), tag_name="ladder")
add("tool_common_tags", library.common_tags, lib("SELECT d.tag_id, g.name, count(*) AS persons, string_agg(person, ', ' ORDER BY person) AS people FROM d JOIN tg g ON g.id = d.tag_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY persons DESC, 1 LIMIT 20", "best AS (SELECT person_id, name AS person, sum(views) AS v FROM item_persons JOIN vc USING (item_id) JOIN ps ON ps.id = person_id GROUP BY 1, 2 ORDER BY v DESC, 1 LIMIT 5)", "d AS (SELECT DISTINCT tag_id, person_id, person FROM best JOIN item_persons USING (person_id) JOIN item_tags USING (item_id))"))
add("tool_person_pairs", library.person_partners, lib("SELECT x.person_id AS a, y.person_id AS b, count(*) AS items FROM item_persons x JOIN item_persons y ON x.item_id = y.item_id AND x.person_id < y.person_id GROUP BY 1, 2 ORDER BY items DESC, 1, 2 LIMIT 10"))
add("tool_person_partners", library.person_partners, lib("SELECT x.person_id AS a, y.person_id AS b, count(*) AS items FROM item_persons x JOIN who ON who.id = x.person_id JOIN item_persons y ON x.item_id = y.item_id AND x.person_id <> y.person_id GROUP BY 1, 2 ORDER BY items DESC, 1, 2 LIMIT 10", _person("sel")), person_name="sel")
add("tool_flagged_items", library.flagged_items, lib("SELECT id AS item_id, coalesce(title, '') AS title, coalesce(people, '') AS people, (SELECT count(*) FROM items WHERE organized) AS total FROM items LEFT JOIN people ON item_id = id WHERE organized ORDER BY id DESC LIMIT 20", _PEOPLE))
_LEFT = "l AS (SELECT i.* FROM items i WHERE id NOT IN (SELECT item_id FROM log))"
for _key, _join, _more, _order, _values in (
    ("all", "", (), "created_at DESC, id", {}),
    ("by_person", "WHERE id IN (SELECT item_id FROM item_persons JOIN who ON who.id = person_id)", (_person("sel"),), "created_at, id", {"filter_type": "person", "filter_value": "sel", "sort_by": "oldest"}),
    ("by_tag", "WHERE id IN (SELECT item_id FROM item_tags JOIN tag ON tag.id = tag_id)", (_tag("ladder"),), "id DESC", {"filter_type": "tag", "filter_value": "ladder", "sort_by": "duration"}),
    ("by_org", "WHERE org_id = (SELECT id FROM og WHERE contains(lower(name), 'films') ORDER BY length(name), id LIMIT 1)", (), "created_at DESC, id", {"filter_type": "org", "filter_value": "films"}),
):
    add(f"tool_unwatched_{_key}", library.unwatched_items, lib(f"SELECT id AS item_id, (SELECT count(*) FROM l) AS total FROM l {_join} ORDER BY {_order} LIMIT 20", _LEFT, *_more), **_values)
add("tool_unwatched_random", library.unwatched_items, None, sort_by="random")
_FAV = "(peaks * 20 + greatest(views - 1, 0) * 2)"
for _mode, _score in (("favorites", f"{_FAV}::DOUBLE"), ("recent", f"{_FAV} * power(0.5, coalesce(greatest(DATE '2025-11-01' - last_ts::DATE, 0), 0) / 30.0)"), ("completion", "CASE WHEN duration > 0 THEN least(plays * 600 * 100 / duration, 500.0) ELSE 0.0 END"), ("intensity", "CASE WHEN views > 0 THEN peaks / views ELSE 0.0 END")):
    add(f"tool_engagement_{_mode}", library.ranked_by_engagement, lib(f"SELECT id AS item_id, views, peaks, round({_score}, 2)::DOUBLE AS score FROM eng ORDER BY score DESC, id LIMIT 50"), scoring_mode=_mode, limit=50)
_ATTR = "SELECT id AS person_id, name, floor(date_diff('day', b, b) + CASE WHEN b IS NULL THEN NULL ELSE datesub('month', b, DATE '2025-11-01') END / 12)::BIGINT AS age, items FROM (SELECT p.*, TRY_CAST(CASE WHEN regexp_full_match(birthdate, '\\d{4}-\\d{2}-\\d{2}') THEN birthdate END AS DATE) AS b, coalesce(n, 0) AS items FROM ps p LEFT JOIN (SELECT person_id, count(*) AS n FROM item_persons GROUP BY 1) ON person_id = p.id)"
add("tool_persons_aged", library.persons_by_attributes, lib(_ATTR + " WHERE b <= DATE '1995-11-01' AND b > DATE '1974-11-01' AND items >= 3 ORDER BY items DESC, id LIMIT 20"), min_age=30, max_age=50, min_items=3, sort_by="items")
add("tool_persons_named", library.persons_by_attributes, lib(_ATTR + " WHERE contains(lower(name), 'sel') AND coalesce(trim(country), '') <> '' ORDER BY name NULLS LAST, id LIMIT 20"), name="sel", has_country=True)
add("tool_persons_rated", library.persons_by_attributes, lib(_ATTR + " WHERE rating BETWEEN 20 AND 90 AND NOT favorite ORDER BY rating DESC NULLS LAST, id LIMIT 20"), min_rating=20, max_rating=90, favorite=False, sort_by="rating")
_IN = ">= TIMESTAMP '2024-03-01' AND {0} < TIMESTAMP '2024-07-01'"
for _date in ("created_at", "updated_at"):
    add(f"tool_items_{_date}", library.items_in_period, lib(f"SELECT id AS item_id, views, {_date} AS at, peaks FROM eng WHERE {_date} {_IN.format(_date)} ORDER BY 3 DESC, id LIMIT 20"), start_date="2024-03-01", end_date="2024-06-30", date_type=_date)
add("tool_items_viewed", library.items_in_period, lib(f"SELECT item_id, max(ts) AS at, count(*) AS views, any_value(peaks) AS peaks FROM log JOIN items ON id = item_id WHERE ts {_IN.format('ts')} GROUP BY 1 ORDER BY views DESC, 1 LIMIT 20"), start_date="2024-03-01", end_date="2024-06-30", date_type="view_date", sort_by="views")
for _kind, _bridge, _names, _id in (("persons", "item_persons", "ps", "person_id"), ("orgs", "(SELECT id AS item_id, org_id FROM items)", "og", "org_id"), ("tags", "item_tags", "tg", "tag_id")):
    add(f"tool_favorite_{_kind}", library.favorite_entities, lib(f"SELECT n.id, n.name, count(e.id) AS items, coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(peaks), 0)::BIGINT AS peaks FROM {_names} n LEFT JOIN {_bridge} b ON b.{_id} = n.id LEFT JOIN eng e ON e.id = b.item_id WHERE n.favorite GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 20"), entity_type=_kind)
add("tool_items_rated", library.items_rated, lib("SELECT id AS item_id, coalesce(rating, -1) AS rating, views, count(*) OVER () AS total, count(*) FILTER (rating >= 80) OVER () AS high, count(*) FILTER (rating = 100) OVER () AS best FROM eng WHERE rating BETWEEN 80 AND 100 OR rating IS NULL ORDER BY eng.rating DESC NULLS LAST, id LIMIT 20"), include_unrated=True)
add("tool_items_rated_by_views", library.items_rated, lib("SELECT id AS item_id, coalesce(rating, -1) AS rating, views, count(*) OVER () AS total, count(*) FILTER (rating >= 80) OVER () AS high, count(*) FILTER (rating = 100) OVER () AS best FROM eng WHERE rating BETWEEN 50 AND 100 ORDER BY views DESC, id LIMIT 20"), min_rating=50, sort_by="views")
_LIST = "SELECT n.id AS {0}, n.name, count(e.id) AS items, coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(peaks), 0)::BIGINT AS peaks{1} FROM {2} n LEFT JOIN {3} b ON b.{0} = n.id LEFT JOIN eng e ON e.id = b.item_id"
add("tool_tag_list", library.tag_list, lib(_LIST.format("tag_id", "", "tg", "item_tags") + " GROUP BY 1, 2 ORDER BY items DESC, 1 LIMIT 50"))
add("tool_tag_list_by_name", library.tag_list, lib(_LIST.format("tag_id", "", "tg", "item_tags") + " WHERE contains(lower(n.name), 'kitchen') GROUP BY 1, 2 HAVING count(e.id) >= 1 ORDER BY name NULLS LAST, 1 LIMIT 50"), search="kitchen", min_items=1, sort_by="name")
add("tool_person_list", library.person_list, lib(_LIST.format("person_id", ", (SELECT count(*) FROM ps) AS total", "ps", "item_persons") + " GROUP BY 1, 2 ORDER BY peaks DESC, 1 LIMIT 50"), sort_by="peaks")
add("tool_person_list_favorites", library.person_list, lib(_LIST.format("person_id", ", (SELECT count(*) FROM ps) AS total", "ps", "item_persons") + " WHERE favorite GROUP BY 1, 2 ORDER BY views DESC, 1 LIMIT 50"), favorites_only=True, sort_by="views")
add(
    "tool_person_profile",
    library.person_profile,
    lib(
        "SELECT p.id AS person_id, p.name, coalesce(country, '') AS country, favorite, datesub('month', TRY_CAST(CASE WHEN regexp_full_match(birthdate, '\\d{4}-\\d{2}-\\d{2}') THEN birthdate END AS DATE), DATE '2025-11-01') // 12 AS age, s.*, (SELECT string_agg(name, ', ' ORDER BY n DESC, tag_id) FROM t) AS tags, (SELECT string_agg(name, ', ' ORDER BY n DESC, person_id) FROM c) AS partners FROM ps p JOIN who ON who.id = p.id, s",
        _person("sel"),
        "own AS (SELECT item_id FROM item_persons JOIN who ON who.id = person_id)",
        "s AS (SELECT count(*) AS items, sum(views)::BIGINT AS views, sum(peaks)::BIGINT AS peaks, round(sum(plays) * 600 / 3600.0, 4)::DOUBLE AS play_hours, round(avg(rating) / 20, 4) AS stars FROM eng WHERE id IN (SELECT item_id FROM own))",
        "t AS (SELECT tag_id, name, count(*) AS n FROM own JOIN item_tags USING (item_id) JOIN tg ON tg.id = tag_id GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 10)",
        "c AS (SELECT person_id, name, count(*) AS n FROM own JOIN item_persons USING (item_id) JOIN ps ON ps.id = person_id WHERE person_id NOT IN (SELECT id FROM who) GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 5)",
    ),
    person_name="sel",
)
add(
    "tool_org_profile",
    library.org_profile_of,
    lib(
        "SELECT o.id AS org_id, o.name, coalesce(p.name, '') AS parent, s.*, coalesce((SELECT string_agg(c.name || ' (' || n || ')', ', ' ORDER BY c.id) FROM (SELECT c.id, c.name, count(i.id) AS n FROM og c LEFT JOIN items i ON i.org_id = c.id WHERE c.parent_id = (SELECT id FROM who) GROUP BY 1, 2) c), '') AS below, coalesce((SELECT string_agg(name, ', ' ORDER BY n DESC, person_id) FROM (SELECT person_id, name, count(*) AS n FROM item_persons JOIN ps ON ps.id = person_id WHERE item_id IN (SELECT id FROM own) GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 10)), '') AS people, coalesce((SELECT string_agg(name, ', ' ORDER BY n DESC, tag_id) FROM (SELECT tag_id, name, count(*) AS n FROM item_tags JOIN tg ON tg.id = tag_id WHERE item_id IN (SELECT id FROM own) GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 10)), '') AS tags FROM og o JOIN who ON who.id = o.id LEFT JOIN og p ON p.id = o.parent_id, s",
        "who AS (SELECT id FROM og WHERE contains(lower(name), 'films') ORDER BY CASE WHEN lower(name) = 'films' THEN 0 ELSE 1 END, name, id LIMIT 1)",
        "own AS (SELECT * FROM eng WHERE org_id = (SELECT id FROM who))",
        "s AS (SELECT count(*) AS items, round(coalesce(sum(duration), 0), 2) AS seconds, min(created_at) AS first, max(created_at) AS last, round(avg(rating) / 20, 4) AS stars FROM own)",
    ),
    org_name="films",
)
add("tool_series_state", library.series_state, lib("SELECT org_id, count(*) AS items, count(*) FILTER (seen) AS watched, round(100 * count(*) FILTER (seen) / count(*), 4) AS pct, coalesce(arg_min(id, (created_at, id)) FILTER (NOT seen), -1) AS next_item FROM (SELECT *, views > 0 OR coalesce(plays * 600 >= duration * 0.5, false) AS seen FROM eng WHERE org_id IS NOT NULL) GROUP BY 1"))
_HIST = "h AS (SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01' AND item_id IN (SELECT item_id FROM item_tags JOIN tag ON tag.id = tag_id))"
add("tool_history", library.history, lib("SELECT item_id, ts, coalesce(people, '') AS people FROM h LEFT JOIN people USING (item_id) ORDER BY ts DESC, item_id LIMIT 50", _tag("ladder"), _HIST, _PEOPLE), start="2024-01-01", end="2024-12-31", tag_name="ladder")
add("tool_history_summary", library.history_summary, lib("SELECT count(*) AS views, count(DISTINCT item_id) AS items, count(DISTINCT ts::DATE) AS days, min(ts) AS first, max(ts) AS last FROM h", _tag("ladder"), _HIST), start="2024-01-01", end="2024-12-31", tag_name="ladder")
_RATE = "(size * 8 / nullif(duration, 0) / 1e6)"
for _kind, _from in (
    ("org", "(SELECT f.*, coalesce(o.name, '(No org)') AS label FROM files f JOIN items i ON i.id = item_id LEFT JOIN og o ON o.id = i.org_id)"),
    ("person", "(SELECT f.*, coalesce(p.name, '(No person)') AS label FROM files f LEFT JOIN (SELECT item_id, name FROM item_persons JOIN ps ON ps.id = person_id) p USING (item_id))"),
    ("tag", "(SELECT f.*, coalesce(p.name, '(No tag)') AS label FROM files f LEFT JOIN (SELECT item_id, name FROM item_tags JOIN tg ON tg.id = tag_id) p USING (item_id))"),
    ("codec", "(SELECT *, coalesce(nullif(lower(regexp_extract(path, '\\.(\\w+)$', 1)), ''), '(No codec)') AS label FROM files)"),
    ("resolution", f"(SELECT *, CASE WHEN {_RATE} >= 8 THEN '2160p' WHEN {_RATE} >= 5 THEN '1080p' WHEN {_RATE} >= 2.5 THEN '720p' WHEN {_RATE} >= 1 THEN '480p' WHEN {_RATE} IS NOT NULL THEN 'SD' ELSE '(No resolution)' END AS label FROM files)"),
):
    add(f"tool_storage_{_kind}", library.storage, lib(f"SELECT label, sum(size)::BIGINT AS bytes, count(DISTINCT item_id) AS items, count(*) AS files, round(sum(size) / count(*) / 1073741824.0, 4)::DOUBLE AS average_gib, round(100 * sum(size) / (SELECT sum(size) FROM files), 4)::DOUBLE AS pct FROM {_from} GROUP BY 1 ORDER BY bytes DESC NULLS LAST, 1 LIMIT 20"), group_by=_kind)
for _kind, _text, _metric in (("month", "strftime(ts, '%Y-%m')", "views"), ("quarter", "year(ts)::VARCHAR || '-Q' || quarter(ts)::VARCHAR", "views"), ("year", "year(ts)::VARCHAR", "items")):
    _src = "log" if _metric == "views" else "(SELECT id AS item_id, created_at AS ts FROM items WHERE created_at IS NOT NULL)"
    add(
        f"tool_tag_usage_{_kind}",
        library.tag_usage,
        lib(
            "SELECT tag_id, period, n, CASE WHEN b IS NULL OR (b = 0 AND n = 0) THEN 'none' WHEN b = 0 THEN 'new activity' WHEN n > b * 1.1 THEN 'up' WHEN n < b * 0.9 THEN 'down' ELSE 'stable' END AS trend FROM (SELECT *, lag(n) OVER (PARTITION BY tag_id ORDER BY period) AS b FROM g)",
            f"u AS (SELECT tag_id, {_text} AS period, count(*) AS n FROM item_tags JOIN {_src} USING (item_id) GROUP BY 1, 2)",
            "c AS (SELECT tag_id, sum(n) AS s FROM u GROUP BY 1 ORDER BY s DESC, 1 LIMIT 10)",
            f"p AS (SELECT DISTINCT {_text} AS period FROM {_src} ORDER BY 1 DESC LIMIT 12)",
            "g AS (SELECT c.tag_id, p.period, coalesce(u.n, 0) AS n FROM c CROSS JOIN p LEFT JOIN u ON u.tag_id = c.tag_id AND u.period = p.period)",
        ),
        group_by=_kind,
        metric=_metric,
    )
for _kind, _conf, _key, _where in (("fingerprint", "high", "md5(lower(title))", "title IS NOT NULL"), ("size", "medium", "size::VARCHAR", "size IS NOT NULL"), ("duration", "low", "round(duration)::BIGINT::VARCHAR", "duration > 60")):
    add(f"tool_duplicates_{_kind}", library.duplicate_files, lib(f"SELECT {_key} AS key, count(*) AS items, min(item_id) AS first_item, sum(size)::BIGINT AS bytes, '{_conf}' AS confidence FROM prim JOIN items ON id = item_id WHERE {_where} GROUP BY 1 HAVING count(*) > 1 ORDER BY items DESC, first_item, key LIMIT 20"), method=_kind)
for _kind, _text in (("year", "year(created_at)::VARCHAR"), ("quarter", "year(created_at)::VARCHAR || '-Q' || quarter(created_at)::VARCHAR")):
    add(f"tool_career_{_kind}", library.career, lib(f"SELECT person_id, {_text} AS period, count(*) AS items, count(DISTINCT o.name) AS orgs, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT o.name) FILTER (o.name IS NOT NULL)), 1, 5), ', '), '') AS first_orgs FROM item_persons JOIN items i ON i.id = item_id LEFT JOIN og o ON o.id = org_id WHERE i.created_at IS NOT NULL GROUP BY 1, 2"), group_by=_kind)
add("tool_career_span", library.career_span, lib("SELECT person_id, strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last, max(created_at)::DATE - min(created_at)::DATE AS days, round((max(created_at)::DATE - min(created_at)::DATE) / 365.25, 4) AS years FROM item_persons JOIN items ON id = item_id WHERE created_at IS NOT NULL GROUP BY 1"))
add("tool_items_of_any_tag", library.items_of_tags, lib("SELECT item_id, count(*) AS matched FROM item_tags WHERE tag_id IN (SELECT tag_id FROM below) AND tag_id NOT IN (SELECT tag_id FROM gone) GROUP BY 1", below(["ibis travel", "patched envelope"]), below(["goat sport"], "gone"), recursive=True), excluded=("Goat Sport",), tag_names=("Ibis Travel", "patched envelope"))
_TWO = "x AS (SELECT low FROM (SELECT lower(trim(name)) AS low, min(id) AS id, count(*) AS n FROM tg JOIN item_tags ON tag_id = id GROUP BY 1) ORDER BY n DESC, id LIMIT 2)"


def _some(*texts: str) -> str:
    """The people that several texts find."""
    out = []
    for i, text in enumerate(texts):
        out.append(_person(text).replace("who AS", f"w{i} AS"))
    return ", ".join(out) + ", who AS (" + " UNION ".join(f"SELECT id FROM w{i}" for i in range(len(texts))) + ")"


add("tool_items_of_all_tags", library.items_of_tags, lib("SELECT item_id, count(DISTINCT lower(trim(name))) AS matched FROM item_tags JOIN tg ON id = tag_id WHERE lower(trim(name)) IN ('loom travel', 'goat sport') GROUP BY 1 HAVING count(DISTINCT lower(trim(name))) = 2"), tag_names=("Loom Travel", "goat sport"), match_mode="all")
add("tool_items_of_any_person", library.items_of_persons, lib("SELECT item_id, count(*) AS matched FROM item_persons JOIN who ON who.id = person_id GROUP BY 1", _some("sel", "mur")), person_names=("sel", "mur"))
add("tool_items_of_all_persons", library.items_of_persons, lib("SELECT item_id, count(*) AS matched FROM item_persons JOIN who ON who.id = person_id GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM who)", _some("ten", "sha")), person_names=("ten", "sha"), match_mode="all")
add("tool_names_not_found", library.names_not_found, lib("SELECT place::INT AS place, asked AS name FROM (VALUES (0, 'sel'), (1, 'nobody of this name')) a(place, asked) WHERE NOT EXISTS (SELECT 1 FROM ps WHERE contains(lower(name), asked))"), person_names=("sel", "nobody of this name"))
add(
    "tool_compare_persons",
    library.compare_persons,
    lib(
        "SELECT s.*, (SELECT count(*) FROM (SELECT item_id FROM own GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM who))) AS shared_items, coalesce((SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM (SELECT tag_id FROM five GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM who)) JOIN tg ON id = tag_id), '') AS shared_tags, (SELECT person_id FROM s ORDER BY views DESC, person_id LIMIT 1) AS most_views, (SELECT person_id FROM s ORDER BY items DESC, person_id LIMIT 1) AS most_items FROM s",
        _some("sel", "mur"),
        "own AS (SELECT item_id, person_id FROM item_persons JOIN who ON who.id = person_id)",
        "s AS (SELECT person_id, name, count(*) AS items, sum(views)::BIGINT AS views, sum(peaks)::BIGINT AS peaks, round(avg(eng.rating) / 20, 4) AS stars FROM own JOIN eng ON eng.id = item_id JOIN ps ON ps.id = person_id GROUP BY 1, 2)",
        "five AS (SELECT * FROM (SELECT person_id, tag_id, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, tag_id) AS k FROM own JOIN item_tags USING (item_id) GROUP BY 1, 2) WHERE k <= 5)",
    ),
    person_names=("sel", "mur"),
)
_ENRICHED = "SELECT i.id AS item_id, coalesce(nullif(trim(title), ''), CASE WHEN n > 0 THEN array_to_string(list_slice(pl, 1, 2), ', ') || CASE WHEN n > 2 THEN ' + ' || (n - 2)::VARCHAR ELSE '' END || coalesce(' - ' || file, '') END, file, 'Item ' || i.id::VARCHAR) AS display, coalesce(o.name, '') AS org, coalesce(array_to_string(pl, '; '), '') AS people, coalesce(array_to_string(tl, '; '), '') AS tags, coalesce(path, '') AS path, views, peaks, coalesce(i.rating, -1) AS rating, round(peaks * 20 + greatest(views - 1, 0) * 2 + coalesce(i.rating, 0) / 20 * 1.5, 4)::DOUBLE AS score FROM eng i LEFT JOIN og o ON o.id = org_id LEFT JOIN (SELECT item_id, list(name ORDER BY name, person_id) AS pl, count(*) AS n FROM item_persons JOIN ps ON ps.id = person_id WHERE name IS NOT NULL GROUP BY 1) p ON p.item_id = i.id LEFT JOIN (SELECT item_id, list(name ORDER BY name, tag_id) AS tl FROM item_tags JOIN tg ON tg.id = tag_id WHERE name IS NOT NULL GROUP BY 1) t ON t.item_id = i.id LEFT JOIN (SELECT item_id, path, size, split_part(path, '/', -1) AS file FROM prim) f ON f.item_id = i.id"
add("tool_enriched", library.enriched, lib(_ENRICHED))
add("tool_enriched_ids", library.enriched, lib(_ENRICHED + " WHERE i.id IN (5, 3, 17, 2)"), item_ids=(5, 3, 17, 2))
