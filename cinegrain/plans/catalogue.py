"""Relational queries as declarative plans: one SQL text for Spark and for the check.

{name} stands for a table. The library's tables give items, tags, people, orgs and
broken by id, doubles rounded, null order written out, and every event log is
aggregated before it is joined.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_LOG = """v AS (SELECT user_id AS id, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS peaks, max(CASE WHEN event_type = 'view' THEN ts END) AS last_ts FROM {events} WHERE event_type IN ('view', 'purchase') GROUP BY user_id),
i AS (SELECT c_custkey AS id, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 100 WHEN 'AUTOMOBILE' THEN 80 WHEN 'MACHINERY' THEN 60 WHEN 'HOUSEHOLD' THEN 40 END AS rating FROM {customer}),
e AS (SELECT i.id, i.c_nationkey, i.rating, coalesce(v.views, 0) AS views, coalesce(v.peaks, 0) AS peaks, v.last_ts FROM i LEFT JOIN v ON v.id = i.id)"""
_SCORE = "peaks * 20 + greatest(views - 1, 0) * 2 + coalesce(rating, 0) / CAST(20 AS DOUBLE) * 1.5"
_DAYS = f"(unix_s({AS_OF}) - unix_s(last_ts)) / CAST(86400 AS DOUBLE)"
_TAGGED = "it AS (SELECT DISTINCT l_orderkey AS item, p_brand AS tag FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)"
_CAST = "ip AS (SELECT DISTINCT l_orderkey AS item, l_suppkey AS person FROM {lineitem})"


def _bucket(expr: str, where: str = "event_type = 'purchase'") -> str:
    return f"SELECT {expr} AS bucket, count(*) AS n, count(DISTINCT user_id) AS items FROM {{events}} WHERE {where} AND ts IS NOT NULL GROUP BY {expr}"


def _storage(label: str, join: str = "") -> str:
    return f"""WITH s AS (SELECT {label} AS label, sum(l_quantity) AS bytes, count(DISTINCT l_orderkey) AS items FROM {{lineitem}} {join} GROUP BY {label}), t AS (SELECT sum(l_quantity) AS total FROM {{lineitem}})
SELECT label, bytes, items, round(bytes / items, 6) AS avg_bytes, round(100 * bytes / total, 6) AS pct FROM s, t"""


PLANS = {
    "engagement_rank": f"WITH {_LOG} SELECT id, views, peaks, coalesce(rating, -1) AS rating, round({_SCORE}, 6) AS score FROM e ORDER BY score DESC, id LIMIT 20",
    "engagement_rank_decayed": f"WITH {_LOG} SELECT id, round(({_SCORE}) * CASE WHEN last_ts IS NULL THEN 0.1 ELSE greatest(CAST(0.1 AS DOUBLE), power(CAST(0.5 AS DOUBLE), {_DAYS} / 30)) END, 6) AS score FROM e ORDER BY score DESC, id LIMIT 20",
    "engagement_modes": f"WITH {_LOG} SELECT id, peaks * 20 + greatest(views - 1, 0) * 2 AS favorites, round((peaks * 20 + greatest(views - 1, 0) * 2) * power(CAST(0.5 AS DOUBLE), floor(coalesce({_DAYS}, 0)) / 30), 6) AS recent, round(CASE WHEN views > 0 THEN peaks / CAST(views AS DOUBLE) END, 6) AS intensity FROM e WHERE views + peaks > 0",
    "top_items_by_views": f"WITH {_LOG} SELECT id, views FROM e WHERE views > 0 ORDER BY views DESC, id LIMIT 10",
    "top_orgs_by_views": f"WITH {_LOG} SELECT n_name, count(*) AS items, CAST(sum(views) AS BIGINT) AS views, CAST(sum(peaks) AS BIGINT) AS peaks FROM e JOIN {{nation}} ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY views DESC, n_name LIMIT 10",
    "top_tags_by_items": f"WITH {_TAGGED} SELECT tag, count(*) AS items FROM it GROUP BY tag ORDER BY items DESC, tag LIMIT 10",
    "top_persons_by_items": f"WITH {_CAST} SELECT person, count(*) AS items FROM ip GROUP BY person ORDER BY items DESC, person LIMIT 10",
    "persons_of_tag": f"WITH {_TAGGED}, {_CAST} SELECT person, count(*) AS items FROM it JOIN ip ON it.item = ip.item WHERE tag = 'Brand#11' GROUP BY person ORDER BY items DESC, person LIMIT 20",
    "tags_of_person": f"WITH {_TAGGED}, {_CAST} SELECT tag, count(*) AS items FROM it JOIN ip ON it.item = ip.item WHERE person = 1 GROUP BY tag ORDER BY items DESC, tag LIMIT 20",
    "library_stats": "SELECT (SELECT count(*) FROM {customer}) AS items, (SELECT count(*) FROM {supplier}) AS persons, (SELECT count(DISTINCT user_id) FROM {events} WHERE event_type = 'view') AS watched, (SELECT count(*) FROM {events} WHERE event_type = 'view') AS views, (SELECT round(sum(l_quantity), 2) FROM {lineitem}) AS bytes",
    "viewing_stats": f"WITH {_LOG} SELECT count(*) AS items, CAST(sum(CASE WHEN views > 0 THEN 1 ELSE 0 END) AS BIGINT) AS watched, round(CAST(100 * sum(CASE WHEN views > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS pct, round(avg(CASE WHEN views > 0 THEN CAST(views AS DOUBLE) END), 6) AS avg_views FROM e",
    "items_by_rating": f"WITH {_LOG} SELECT id, rating FROM e WHERE rating BETWEEN 80 AND 100 ORDER BY rating DESC NULLS LAST, id LIMIT 20",
    "unwatched": f"WITH {_LOG} SELECT id, (SELECT count(*) FROM e WHERE views = 0) AS total FROM e WHERE views = 0 ORDER BY id DESC LIMIT 20",
    "favorites": f"WITH {_LOG} SELECT id, views, peaks FROM e WHERE rating = 100 ORDER BY peaks DESC, views DESC, id LIMIT 20",
    "pattern_hourly": _bucket("CAST(hour(ts) AS INT)", "event_type = 'view'"),
    "pattern_monthly": _bucket("CAST(year(ts) * 100 + month(ts) AS INT)", "event_type = 'view'"),
    "pattern_daily": _bucket("CAST(CAST(ts AS DATE) AS VARCHAR(10))", "event_type = 'view'"),
    "peak_history_day": _bucket("CAST(CAST(ts AS DATE) AS VARCHAR(10))"),
    "peak_history_month": _bucket("CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR(10))"),
    "viewing_history": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, user_id, count(*) AS n FROM {events} WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND user_id IN (SELECT c_custkey FROM {customer} WHERE c_nationkey < 10) GROUP BY CAST(ts AS DATE), user_id ORDER BY day DESC, user_id LIMIT 50",
    "items_by_date": "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-02-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "tag_usage_quarter": f"WITH {_TAGGED}, u AS (SELECT tag, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INT) AS period, count(*) AS n FROM it JOIN {{orders}} ON o_orderkey = item GROUP BY 1, 2) SELECT tag, period, n, coalesce(lag(n) OVER (PARTITION BY tag ORDER BY period), 0) AS previous, CASE WHEN lag(n) OVER (PARTITION BY tag ORDER BY period) IS NULL THEN 'new' WHEN n > 1.1 * lag(n) OVER (PARTITION BY tag ORDER BY period) THEN 'up' WHEN n < 0.9 * lag(n) OVER (PARTITION BY tag ORDER BY period) THEN 'down' ELSE 'stable' END AS trend FROM u",
    "person_timeline": f"WITH {_CAST} SELECT person, CAST(year(o_orderdate) AS INT) AS year, count(*) AS items, min(o_orderdate) AS first, max(o_orderdate) AS last FROM ip JOIN {{orders}} ON o_orderkey = item GROUP BY 1, 2",
    "tag_correlations": f"WITH {_TAGGED} SELECT b.tag AS tag, count(*) AS items FROM it a JOIN it b ON a.item = b.item AND a.tag <> b.tag WHERE a.tag = 'Brand#11' GROUP BY b.tag ORDER BY items DESC, tag LIMIT 10",
    "person_pairs": f"WITH {_CAST} SELECT a.person AS a, b.person AS b, count(*) AS items FROM ip a JOIN ip b ON a.item = b.item AND a.person < b.person GROUP BY a.person, b.person ORDER BY items DESC, a, b LIMIT 10",
    "common_tags_of_top_persons": f"WITH {_TAGGED}, {_CAST}, top AS (SELECT person, count(*) AS n FROM ip GROUP BY person ORDER BY n DESC, person LIMIT 5), pt AS (SELECT DISTINCT ip.person, tag FROM ip JOIN top ON top.person = ip.person JOIN it ON it.item = ip.item) SELECT tag, count(*) AS persons FROM pt GROUP BY tag HAVING count(*) >= 2",
    "items_with_all": f"WITH {_TAGGED} SELECT item FROM it WHERE tag IN ('Brand#11', 'Brand#22') GROUP BY item HAVING count(*) = 2",
    "items_with_any": f"WITH {_TAGGED} SELECT DISTINCT item FROM it WHERE tag IN ('Brand#11', 'Brand#22')",
    "persons_compare": f"WITH {_CAST} SELECT item FROM ip WHERE person IN (1, 2) GROUP BY item HAVING count(*) = 2",
    "persons_by_attribute": "SELECT s_suppkey, s_name, n_name FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey WHERE s_acctbal BETWEEN 0 AND 5000 AND lower(n_name) LIKE '%a%' ORDER BY s_suppkey LIMIT 20",
    "org_profile": "SELECT n_name, r_name, count(c_custkey) AS items, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS average FROM {nation} JOIN {region} ON r_regionkey = n_regionkey LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name, r_name",
    "series_progress": "SELECT o_custkey AS series, count(*) AS items, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS watched, coalesce(min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END), -1) AS next_unwatched FROM {orders} GROUP BY o_custkey",
    "storage_by_codec": _storage("l_returnflag"),
    "storage_by_person": _storage("l_suppkey"),
    "storage_by_tag": _storage("p_brand", "JOIN {part} ON p_partkey = l_partkey"),
    "duplicates_hash": "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM {documents} WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1",
    "duplicates_size": "SELECT n_chars, count(*) AS copies FROM {documents} WHERE n_chars > 60 GROUP BY n_chars HAVING count(*) > 1",
    "markers_by_tag": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS items FROM {events} GROUP BY event_type",
    "marker_index": "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS peak_index FROM {events} WHERE event_type = 'purchase'",
    "org_tree": "SELECT r_name AS parent, n_name AS child, count(c_custkey) AS items FROM {region} JOIN {nation} ON n_regionkey = r_regionkey LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY r_name, n_name",
    "frame_counts": "SELECT scene_id, model_key, count(DISTINCT frame_index) AS frames, min(timestamp_s) AS first_s, max(timestamp_s) AS last_s FROM {frame_embeddings} GROUP BY scene_id, model_key",
    "event_sessions": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN unix_s(ts) - unix_s(lag(ts) OVER w) <= 3600 THEN 0 ELSE 1 END AS start FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, session",
    "series_of_views": "SELECT scene_id, count(*) AS views, max(view_date) AS last FROM (SELECT DISTINCT scene_id, view_date FROM {scenes_view_dates} WHERE view_date IS NOT NULL) GROUP BY scene_id",
    "timing_summary": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS pct FROM {events} GROUP BY event_type",
    "person_attributes": "SELECT id, name, coalesce(country, '') AS country FROM {performers} WHERE favorite AND name IS NOT NULL ORDER BY id LIMIT 20",
    "cost_running": "SELECT event_id, round(sum(value * 0.25 / 1000000) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 9) AS cost FROM (SELECT min(event_id) AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, sum(value) AS value FROM {events} GROUP BY 2)",
    "error_captions": "SELECT doc_id FROM {documents} WHERE text LIKE '[ERROR%'",
    "completion_check": "SELECT scene_id, count(*) AS frames, bool_and(coalesce(text, '') <> '' AND text NOT LIKE '[ERROR%') AS complete FROM {documents} WHERE scene_id IS NOT NULL GROUP BY scene_id",
    "rating_rule": "SELECT user_id, least(100, 50 + 5 * count(*)) AS rating FROM {events} WHERE event_type = 'view' GROUP BY user_id HAVING count(*) > 10",
    "resume_points": "SELECT o_orderkey, round(o_totalprice / 500000, 6) AS progress, (SELECT count(*) FROM {orders} WHERE o_totalprice / 500000 BETWEEN 0.05 AND 0.95) AS total FROM {orders} WHERE o_totalprice / 500000 BETWEEN 0.05 AND 0.95 ORDER BY progress DESC, o_orderkey LIMIT 20",
    "storage_by_org": _storage("n_name", "JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey"),
    "missing_tags": "SELECT t.id, count(l.item) AS uses FROM (SELECT DISTINCT id FROM {tags}) t LEFT JOIN (SELECT l_orderkey AS item, l_suppkey AS tag FROM {lineitem}) l ON l.tag = t.id GROUP BY t.id HAVING count(l.item) = 0",
    "person_leaders": f"WITH {_CAST} SELECT person, count(*) AS items, rank() OVER (ORDER BY count(*) DESC) AS place FROM ip WHERE person IN (1, 2, 3, 4, 5) GROUP BY person",
    "pref_phase": "SELECT user_id, CASE WHEN count(*) < greatest(10, CAST(floor(4 * sqrt(500)) AS INT)) THEN 'broad' WHEN count(*) < greatest(28, CAST(floor(6 * sqrt(500)) AS INT)) THEN 'refine' ELSE 'boundary' END AS phase FROM {events} GROUP BY user_id",
    "probe_selection": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR(20)))) AS k FROM {embeddings}) WHERE k = 1",
    "pagination": "SELECT c_custkey, (SELECT count(*) FROM {customer}) AS total, (SELECT CAST(ceil(count(*) / CAST(20 AS DOUBLE)) AS BIGINT) FROM {customer}) AS pages FROM {customer} ORDER BY c_custkey LIMIT 20 OFFSET 20",
}
