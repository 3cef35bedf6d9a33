"""Registered calls of the vector tools with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..tools import similar
from .details import _FV, _GOOD, _SCORE, _SV
from .library import lib

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(key, run, sql=None, **values):
    QUERIES[key] = lambda spark, d: run(Catalog(spark, d), **values)
    if sql:
        SQL[key] = sql


def cos(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 6)"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def mean(name: str, source: str) -> str:
    """(g, n, v): weighted means scaled to length one of source (g, w, v)."""
    return f"{name}_x AS (SELECT g, w, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {source}), {name}_s AS (SELECT g, p, sum(w * x) AS s, count(*) AS n FROM {name}_x GROUP BY 1, 2), {name} AS (SELECT g, any_value(n) AS n, list(CASE WHEN z > 0 THEN round(s / z, 6) ELSE 0.0 END ORDER BY p) AS v FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY g)) AS z FROM {name}_s) GROUP BY g)"


IV = f"{_SV}, iv AS (SELECT item_id, v::DOUBLE[] AS v FROM sv WHERE model_key = 'siglip' AND {_GOOD.format('v')})"
FR = f"{_FV}, fr AS (SELECT item_id, frame, seconds, v::DOUBLE[] AS v FROM fv WHERE model_key = 'siglip' AND {_GOOD.format('v')})"
TV = mean("tmean", "(SELECT tag_id AS g, 1.0 AS w, v FROM item_tags JOIN iv USING (item_id))") + ", tv AS (SELECT g AS tag_id, n AS items, v FROM tmean WHERE n >= 3)"
_NEAR = f"nr AS (SELECT q.item_id AS query_id, i.item_id, {cos('i.v', 'q.v')} AS similarity FROM iv q, iv i WHERE q.item_id % 100 = 0 AND i.item_id <> q.item_id)"
_TOP = "SELECT query_id, item_id, similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place FROM {0} {1}) WHERE place <= {2}"
add("vec_similar_items", similar.similar_items, lib(_TOP.format("nr", "WHERE similarity >= 0.5", 10), IV, _NEAR))
add("vec_similar_not_shared", similar.similar_without_shared, lib("SELECT query_id, item_id, similarity, place::INT AS place, n > 15 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM nr WHERE similarity >= 0.2 AND NOT EXISTS (SELECT 1 FROM item_persons a JOIN item_persons b ON a.person_id = b.person_id WHERE a.item_id = nr.query_id AND b.item_id = nr.item_id)) WHERE place BETWEEN 6 AND 15", IV, _NEAR), min_similarity=0.2, offset=5)
_BLEND = mean("mm", "(SELECT item_id AS g, 1.0 AS w, tv.v FROM item_tags JOIN tv USING (tag_id))") + f", bv AS (SELECT coalesce(i.item_id, mm.g) AS item_id, CASE WHEN i.v IS NULL THEN mm.v WHEN mm.v IS NULL THEN {unit('i.v')} ELSE list_transform(list_zip({unit('i.v')}, mm.v), lambda z: z[1] * 0.7 + z[2] * 0.3) END AS v FROM iv i FULL JOIN mm ON mm.g = i.item_id)"
add("vec_similar_blended", similar.similar_blended, lib(_TOP.format("nr", "", 10), IV, TV, _BLEND, _NEAR.replace("iv q, iv i", "bv q, bv i")))
add("vec_frames_like_items", similar.frames_like_items, lib("SELECT query_id, item_id, frame, seconds, similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY similarity DESC, frame) AS k FROM (SELECT q.item_id AS query_id, f.item_id, f.frame, f.seconds, " + cos("f.v", "q.v") + " AS similarity FROM iv q, fr f WHERE q.item_id % 100 = 0 AND f.item_id <> q.item_id) WHERE similarity >= 0.3) WHERE k = 1) WHERE place <= 10", IV, FR))
_Q = "qq AS (SELECT v AS q FROM iv WHERE item_id = 0)"
for _mode, _src in (("frame", "fr"), ("scene", "iv")):
    add(f"vec_visual_filter_{_mode}", similar.visual_filter, lib(f"SELECT item_id, max({cos('v', 'q')}) AS similarity FROM {_src}, qq GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", IV, FR, _Q), query_item=0, search_mode=_mode)
add("vec_visual_threshold", similar.visual_filter, lib(f"SELECT item_id, max({cos('v', 'q')}) AS similarity FROM fr, qq GROUP BY 1 HAVING max({cos('v', 'q')}) >= 0.3", IV, FR, _Q), query_item=0, scoring_mode="threshold")
add("vec_visual_all", similar.visual_filter, lib(f"SELECT id AS item_id, similarity FROM items LEFT JOIN (SELECT item_id, max({cos('v', 'q')}) AS similarity FROM iv, qq GROUP BY 1) ON item_id = id", IV, _Q), query_item=0, scoring_mode="all", search_mode="scene")


def vec_best_frames(spark: SparkSession, d: str) -> DataFrame:
    """best_frames with the vector as its sum, for the check."""
    rows = similar.best_frames(Catalog(spark, d))
    return rows.select("item_id", "frame", "similarity", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("v_sum"))


SQL["vec_best_frames"] = lib("SELECT item_id, frame, s AS similarity, round(list_sum(v), 5) AS v_sum FROM (SELECT f.*, s, row_number() OVER (PARTITION BY f.item_id ORDER BY s DESC, frame) AS k FROM (SELECT f.item_id, f.frame, f.v, " + cos("f.v", "i.v") + " AS s FROM fr f JOIN iv i ON i.item_id = f.item_id) f) WHERE k = 1", IV, FR)
add("vec_frame_at", similar.frame_at, lib("SELECT item_id, asked, frame, seconds, away FROM (SELECT *, row_number() OVER (PARTITION BY item_id, asked ORDER BY away, frame) AS k FROM (SELECT item_id, frame, seconds, asked, round(abs(seconds - asked), 6) AS away FROM fr, (SELECT unnest(range(0, 100000, 60))::DOUBLE AS asked) WHERE seconds BETWEEN asked - 3 AND asked + 3) WHERE away <= 2) WHERE k = 1", FR))
add("vec_similar_frames", similar.similar_frames, lib("SELECT frame, seconds, " + cos("v", "q") + " AS similarity FROM fr, (SELECT seconds AS at_, v AS q FROM fr WHERE item_id = 7 AND abs(seconds - 100) <= 20 ORDER BY round(abs(seconds - 100), 6), frame LIMIT 1) WHERE item_id = 7 AND abs(seconds - at_) >= 10 AND " + cos("v", "q") + " >= 0.2 ORDER BY 3 DESC, 1 LIMIT 5", FR), item_id=7, second=100.0, min_similarity=0.2, tolerance=20.0)
add("vec_frame_second", similar.frame_second, lib("SELECT frame, seconds FROM (SELECT *, row_number() OVER (ORDER BY frame) AS k FROM fr WHERE item_id = 7) WHERE k = 3", FR), item_id=7, nth=3)
_CONTENT = f"hit AS (SELECT * FROM (SELECT item_id, frame, seconds, max({cos('f.v', 't.v')}) AS s FROM fr f, tv t WHERE t.tag_id IN (0, 1, 2) GROUP BY 1, 2, 3) WHERE s >= 0.2 AND seconds IS NOT NULL)"
add("vec_content_events", similar.content_events, lib('SELECT item_id, start, "end", frames, peak FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY peak DESC, start) AS k FROM (SELECT item_id, min(seconds) AS start, max(seconds) AS "end", count(*) AS frames, max(s) AS peak FROM (SELECT *, sum(b) OVER (PARTITION BY item_id ORDER BY seconds, frame) AS ev FROM (SELECT *, CASE WHEN seconds - lag(seconds) OVER (PARTITION BY item_id ORDER BY seconds, frame) <= 30 THEN 0 ELSE 1 END AS b FROM hit)) GROUP BY item_id, ev)) WHERE k <= 5', IV, FR, TV, _CONTENT), threshold=0.2)
_SEG = (
    "sg AS (SELECT *, sum(CASE WHEN s >= 0.8 THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY frame) AS segment FROM (SELECT *, " + cos("v", "p") + " AS s FROM (SELECT *, lag(v) OVER (PARTITION BY item_id ORDER BY frame) AS p FROM fr)))",
    mean("gm", f"(SELECT item_id::VARCHAR || ':' || segment::VARCHAR AS g, 1.0 AS w, {unit('v')} AS v FROM sg)"),
    "pt AS (SELECT *, lead(head) OVER (PARTITION BY item_id ORDER BY segment) AS nx, sum(n) OVER (PARTITION BY item_id) AS al FROM (SELECT item_id, segment, count(*) AS n, min(frame) AS first, max(frame) AS last, min(seconds) AS a, max(seconds) AS b, arg_min(v, frame) AS head FROM sg GROUP BY 1, 2))",
)
add("vec_segments", similar.segments_of, lib("SELECT item_id, segment::BIGINT AS segment, first, last, pt.n, coalesce(" + cos("gm.v", "nx") + ", 0.0) AS score FROM pt JOIN gm ON g = item_id::VARCHAR || ':' || segment::VARCHAR WHERE al >= 2 AND (b - a >= 3 OR segment = 1)", FR, *_SEG), least_seconds=3.0)
_N1 = "(SELECT a.item_id, a.frame, avg(list_dot_product(a.u, b.u)) AS m, count(b.k) AS c FROM n0 a LEFT JOIN n0 b ON a.item_id = b.item_id AND a.k <> b.k AND abs(a.k - b.k) <= {0} GROUP BY 1, 2)"
_NV = "CASE WHEN {0}.c > 0 THEN (1 - {0}.m) * least(1.0, {0}.c / {1}) ELSE 0.0 END"
add("vec_novelty", similar.novelty, lib(f"SELECT x.item_id, x.frame, round(({_NV.format('x', '30.0')} + {_NV.format('y', '120.0')}) / 2, 6) AS novelty FROM {_N1.format(15)} x JOIN {_N1.format(60)} y ON x.item_id = y.item_id AND x.frame = y.frame", FR, f"n0 AS (SELECT item_id, frame, {unit('v')} AS u, row_number() OVER (PARTITION BY item_id ORDER BY frame) AS k FROM fr)"))
add("vec_smart_frames", similar.smart_frames)
add("vec_representatives_maximin", similar.representative_frames)
add("vec_representatives_coverage", similar.representative_frames, method="coverage")
add("vec_modulo_frames", similar.modulo_frames, lib("SELECT item_id, frame FROM fr WHERE frame % (SELECT greatest(1, floor(count(*) / count(DISTINCT item_id) / 16))::BIGINT FROM fr) = 0", FR))
add("vec_frames_apart", similar.frames_apart)
add("vec_similarity_matrix", similar.similarity_matrix, lib("SELECT a.frame AS a, b.frame AS b, " + cos("a.v", "b.v") + " AS similarity FROM fr a JOIN fr b ON b.frame <= a.frame WHERE a.item_id = 103 AND b.item_id = 103", FR), item_id=103)
add("vec_near_duplicate_tags", similar.near_duplicate_tags, lib("SELECT a.tag_id, b.tag_id AS other_id, " + cos("a.v", "b.v") + " AS similarity, CASE WHEN nb.n > na.n THEN b.tag_id ELSE a.tag_id END AS keep_id FROM tv a JOIN tv b ON a.tag_id < b.tag_id JOIN (SELECT tag_id, count(*) AS n FROM item_tags GROUP BY 1) na ON na.tag_id = a.tag_id JOIN (SELECT tag_id, count(*) AS n FROM item_tags GROUP BY 1) nb ON nb.tag_id = b.tag_id JOIN tg x ON x.id = a.tag_id JOIN tg y ON y.id = b.tag_id WHERE " + cos("a.v", "b.v") + " >= 0.9", IV, TV))
_BEST = "bt AS (SELECT item_id, frame, tag_id, s AS similarity FROM (SELECT f.item_id, f.frame, t.tag_id, " + cos("f.v", "t.v") + " AS s, row_number() OVER (PARTITION BY f.item_id, f.frame ORDER BY " + cos("f.v", "t.v") + " DESC, t.tag_id) AS k FROM fr f, tv t) WHERE k = 1), th AS (SELECT round(quantile_cont(similarity, 0.05), 6) AS threshold FROM bt), bc AS (SELECT item_id, frame, tag_id, similarity, similarity >= threshold AS covered FROM bt, th)"
add("vec_best_tags", similar.best_tags, lib("SELECT * FROM bc", IV, FR, TV, _BEST))
add("vec_coverage_threshold", similar.coverage_threshold_of, lib("SELECT * FROM th", IV, FR, TV, _BEST))
add("vec_coverage_report", similar.coverage_report, lib("SELECT item_id, count(*) AS frames, count(*) FILTER (NOT covered) AS uncovered, round(1 - count(*) FILTER (NOT covered) / count(*), 6) AS ratio, round(1 - count(*) FILTER (NOT covered) / count(*), 6) < 0.75 AS flagged, coalesce(any_value(nearest), '') AS nearest FROM bc LEFT JOIN (SELECT item_id, string_agg(tag_id::VARCHAR || ':' || n::VARCHAR, ' ' ORDER BY k) AS nearest FROM (SELECT item_id, tag_id, count(*) AS n, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, tag_id) AS k FROM bc WHERE NOT covered GROUP BY 1, 2) WHERE k <= 5 GROUP BY 1) USING (item_id) GROUP BY 1", IV, FR, TV, _BEST))
add("vec_what_if_tag", similar.what_if_tag, lib("SELECT count(*) AS gained, round(avg(s), 6) AS mean, max(s) AS best, round(((SELECT count(*) FILTER (covered) FROM bc) + count(*)) / (SELECT count(*) FROM bc), 6) AS ratio FROM (SELECT " + cos("fr.v", "tv.v") + " AS s FROM bc JOIN fr USING (item_id, frame), tv WHERE NOT covered AND tv.tag_id = 0) WHERE s >= 0.1", IV, FR, TV, _BEST), tag_id=0, least=0.1)
add("vec_similar_uncovered", similar.similar_uncovered, lib("SELECT g AS item_id, n AS frames, " + cos("um.v", "q") + " AS similarity FROM um, qq WHERE g <> 0 AND " + cos("um.v", "q") + " >= -1 ORDER BY 3 DESC, 1 LIMIT 10", IV, FR, TV, _BEST, _Q, mean("um", f"(SELECT item_id AS g, 1.0 AS w, {unit('v')} AS v FROM fr JOIN bc USING (item_id, frame) WHERE NOT covered)")), query_item=0, least=-1.0)
_HITS = "SELECT t.tag_id, count(*) AS frames, max({s}) AS best, round(avg({s}), 6) AS mean FROM {src} f, tv t WHERE {s} >= {least} {more} GROUP BY 1 ORDER BY frames DESC, {order}"
_S = cos("f.v", "t.v")
add("vec_gap_detail", similar.gap_detail, lib("SELECT * FROM (" + _HITS.format(s=_S, src="op", least=0.55, more="AND t.tag_id NOT IN (SELECT tag_id FROM own)", order="1 LIMIT 10") + ")", IV, FR, TV, "own AS (SELECT tag_id FROM item_tags WHERE item_id = 7)", f"op AS (SELECT * FROM fr WHERE item_id = 7 AND frame NOT IN (SELECT f.frame FROM fr f, tv t WHERE f.item_id = 7 AND t.tag_id IN (SELECT tag_id FROM own) AND {_S} >= 0.55))"), item_id=7, threshold=0.55)
add("vec_tag_votes", similar.vote_tags, lib("SELECT v.*, evidence FROM (" + _HITS.format(s=_S, src="(SELECT * FROM fr WHERE item_id = 7)", least=0.2, more="AND t.tag_id NOT IN (SELECT tag_id FROM item_tags WHERE item_id = 7) AND t.tag_id <> 3", order="best DESC, 1 LIMIT 20") + ") v JOIN (SELECT tag_id, string_agg(frame::VARCHAR, ',' ORDER BY k) AS evidence FROM (SELECT t.tag_id, f.frame, row_number() OVER (PARTITION BY t.tag_id ORDER BY " + _S + " DESC, f.frame) AS k FROM fr f, tv t WHERE f.item_id = 7 AND " + _S + " >= 0.2) WHERE k <= 5 GROUP BY 1) USING (tag_id)", IV, FR, TV), item_id=7, least=0.2, dismissed=(3,))
add("vec_tag_votes_all", similar.tag_votes_all, lib(_HITS.format(s=_S, src="fr", least=0.3, more="", order="1"), IV, FR, TV))
add("vec_uncertain_frames", similar.uncertain_frames, lib("SELECT item_id, frame, count(*) FILTER (" + _S + " BETWEEN 0.25 AND 0.35) AS n FROM fr f, tv t WHERE item_id NOT IN (1, 2) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50", IV, FR, TV), done_items=(1, 2))
PV = mean("pmean", f"(SELECT person_id AS g, w, v FROM (SELECT p.person_id, iv.v, w, row_number() OVER (PARTITION BY p.person_id ORDER BY w DESC, p.item_id) AS k FROM item_persons p JOIN iv USING (item_id) JOIN (SELECT id, CASE WHEN {_SCORE} > 0 THEN round({_SCORE}, 6) ELSE 1.0 END::DOUBLE AS w FROM eng) e ON e.id = p.item_id) WHERE k <= 50)") + ", pv AS (SELECT g AS person_id, n, v FROM pmean WHERE n >= 2)"
add("vec_similar_persons", similar.similar_persons, lib(_TOP.format("pp", "WHERE similarity >= 0.2", 5).replace("item_id", "person_id"), IV, PV, "pp AS (SELECT q.person_id AS query_id, p.person_id, " + cos("p.v", "q.v") + " AS similarity FROM pv q JOIN pv p ON p.person_id <> q.person_id)"), min_similarity=0.2)


def _item_and_frames(spark: SparkSession, d: str) -> DataFrame:
    """Items with their vector and the mean of their frames' vectors, the two sides of the retrieval metrics."""
    from ..operators import kernels

    cat = Catalog(spark, d)
    means = kernels.weighted_means(similar.frame_vectors(cat), "item_id", "v").select("item_id", F.col("v").alias("t"))
    return similar.item_vectors(cat).join(means, "item_id")


def vec_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall between items and their frames, both ways."""
    return similar.retrieval_metrics(_item_and_frames(spark, d), "item_id", "v", "t")


def vec_contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss between items and their frames."""
    return similar.contrastive_loss(_item_and_frames(spark, d), "item_id", "v", "t", 10.0)


_PAIRS = mean("fm", "(SELECT item_id AS g, 1.0 AS w, v FROM fr)") + ", pa AS (SELECT item_id AS id, iv.v AS i, fm.v AS t FROM iv JOIN fm ON g = item_id), al AS (SELECT a.id AS a, b.id AS b, " + cos("a.i", "b.t") + " AS s FROM pa a, pa b)"
SQL["vec_recall_at_k"] = lib("SELECT k::INT AS k, round(avg((ri <= k)::INT), 6) AS image_to_text, round(avg((rt <= k)::INT), 6) AS text_to_image FROM (SELECT o.a, 1 + count(*) FILTER (x.s > o.s AND x.a = o.a) AS ri, 1 + count(*) FILTER (x.s > o.s AND x.b = o.a) AS rt FROM al o JOIN al x ON (x.a = o.a OR x.b = o.a) AND x.a <> x.b WHERE o.a = o.b GROUP BY 1), (VALUES (1), (5), (10)) ks(k) WHERE k <= (SELECT count(*) FROM pa) GROUP BY 1", IV, FR, _PAIRS)
SQL["vec_contrastive_loss"] = lib("SELECT round(avg((ln(si) + ln(st)) / 2 + 10 - 10 * own), 6) AS loss FROM (SELECT a, sum(exp(10 * (s - 1))) AS si FROM al GROUP BY 1) JOIN (SELECT b AS a, sum(exp(10 * (s - 1))) AS st FROM al GROUP BY 1) USING (a) JOIN (SELECT a, s AS own FROM al WHERE a = b) USING (a)", IV, FR, _PAIRS)
def vec_window_vectors(spark: SparkSession, d: str) -> DataFrame:
    """window_vectors with the vector as its sum, for the check."""
    rows = similar.window_vectors(Catalog(spark, d))
    return rows.select("item_id", "at", "n", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("v_sum"))


def vec_search_text(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a search by an embedder that takes each text as the first coordinate."""
    from ..functions.udf import register_embedder

    register_embedder("first", lambda texts: [[1.0] + [0.0] * 39 for _ in texts])
    return similar.search_text(Catalog(spark, d), query="anything", embedder="first", limit=10, page=2)


SQL["vec_search_text"] = lib("SELECT item_id, similarity, total, ceil(total / 10)::BIGINT AS pages, total > 20 AS has_more FROM (SELECT item_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS similarity, count(*) OVER () AS total FROM iv) ORDER BY similarity DESC, item_id LIMIT 10 OFFSET 10", IV)
_WINDOW = "mk AS (SELECT item_id, seconds AS at_, coalesce(duration, seconds + 5) AS len FROM (SELECT f.item_id, f.seconds, row_number() OVER (PARTITION BY f.item_id ORDER BY " + cos("f.v", "i.v") + " DESC, frame) AS k FROM fr f JOIN iv i ON i.item_id = f.item_id) LEFT JOIN prim USING (item_id) WHERE k = 1)"
SQL["vec_window_vectors"] = lib("SELECT item_id, at_ AS at, wm.n, round(list_sum(wm.v), 5) AS v_sum FROM mk JOIN wm ON wm.g = item_id", IV, FR, _WINDOW, mean("wm", f"(SELECT item_id AS g, 1.0 AS w, {unit('v')} AS v FROM fr JOIN mk USING (item_id) WHERE seconds >= greatest(0, at_ - 5) AND seconds < least(at_ + 5, len))"))
add("vec_similarity_drops", similar.similarity_drops, lib("SELECT item_id, frame, s AS similarity, before FROM (SELECT *, round(avg(s) OVER (PARTITION BY item_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 8) AS before FROM (SELECT *, " + cos("v", "p") + " AS s FROM (SELECT *, lag(v) OVER (PARTITION BY item_id ORDER BY frame) AS p FROM fr))) WHERE round(before - s, 6) >= 0.2", FR))
for _f in (vec_search_text, vec_window_vectors, vec_best_frames, vec_recall_at_k, vec_contrastive_loss):
    QUERIES[_f.__name__] = _f
