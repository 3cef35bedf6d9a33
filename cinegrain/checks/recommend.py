"""Registered calls of the recommendation and preference tools with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..tools import recommend, similar
from .details import _DECAY, _SCORE
from .library import lib
from .similar import FR, IV, TV, cos, mean, unit

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(key, run, sql=None, **values):
    QUERIES[key] = lambda spark, d: run(Catalog(spark, d), **values)
    if sql:
        SQL[key] = sql


SC = f"sc AS (SELECT id AS item_id, {_SCORE}::DOUBLE AS score, {_SCORE} * coalesce({_DECAY}, 0.1) AS fresh FROM eng WHERE {_SCORE} > 0)"
_CHOSEN = "{0} AS (SELECT * FROM (SELECT item_id, round({1}, 6) AS score FROM sc WHERE {2} ORDER BY 2 DESC, 1 LIMIT 40) WHERE item_id IN (SELECT item_id FROM iv) ORDER BY score DESC, item_id LIMIT 20)"
PI = _CHOSEN.format("pi", "score", "true")
PF = PI.replace("pi AS", "p0 AS") + ", " + _CHOSEN.format("p1", "fresh", "fresh >= 1.5") + ", pi AS (SELECT * FROM p1 WHERE (SELECT count(*) FROM p1) >= 3 UNION ALL SELECT * FROM p0 WHERE (SELECT count(*) FROM p1) < 3)"
PQ = mean("pr", "(SELECT 1 AS g, score AS w, v FROM iv JOIN pi USING (item_id))") + ", pq AS (SELECT v AS q FROM pr WHERE n >= 3)"
_S = cos("v", "q")
_UNSEEN = "item_id NOT IN (SELECT item_id FROM log)"
_KNOWN = "item_id IN (SELECT id FROM items)"
_OUT = "SELECT item_id, score FROM ({0}) WHERE {1} ORDER BY score DESC, item_id LIMIT 24"
add("rec_discover_items", recommend.discover, lib(_OUT.format(f"SELECT item_id, {_S} AS score FROM iv, pq WHERE {_KNOWN} AND item_id NOT IN (SELECT item_id FROM pi)", _UNSEEN), IV, SC, PI, PQ))
add("rec_discover_decayed", recommend.discover, lib(_OUT.format(f"SELECT item_id, {_S} AS score FROM iv, pq WHERE {_KNOWN} AND item_id NOT IN (SELECT item_id FROM pi)", _UNSEEN), IV, SC, PF, PQ), half_life=30)
_SEED = "(SELECT v AS z FROM iv WHERE item_id = 9)"
add("rec_seed", recommend.discover_from_seed, lib(_OUT.format(f"SELECT item_id, round(0.7 * {_S} + 0.3 * {cos('v', 'z')}, 7) AS score FROM iv, pq, {_SEED} WHERE {_KNOWN} AND item_id NOT IN (SELECT item_id FROM pi) AND item_id <> 9", _UNSEEN), IV, SC, PI, PQ), seed_item=9)
add("rec_rewatch_items", recommend.rewatch, lib(_OUT.format(f"SELECT item_id, round({_S} * 0.4 + score / max(score) OVER () * 0.6, 7) AS score FROM iv JOIN sc USING (item_id), pq WHERE {_KNOWN}", "true"), IV, SC, PI, PQ))
_BF = "bf AS (SELECT item_id, v FROM (SELECT f.item_id, f.v, row_number() OVER (PARTITION BY f.item_id ORDER BY " + cos("f.v", "i.v") + " DESC, frame) AS k FROM fr f JOIN iv i ON i.item_id = f.item_id) WHERE k = 1 AND item_id IN (SELECT id FROM items WHERE peaks > 0))"
add("rec_peaks", recommend.from_peaks, lib(_OUT.format(f"SELECT item_id, {cos('iv.v', 'kk.v')} AS score FROM iv, kk WHERE {_KNOWN} AND item_id NOT IN (SELECT item_id FROM bf)", _UNSEEN), IV, FR, SC, _BF, mean("kk", "(SELECT 1 AS g, round(coalesce(score, 1.0), 6) AS w, v FROM bf LEFT JOIN sc USING (item_id))")))
from .similar import PV  # noqa: E402

_LV = mean("lv", "(SELECT 1 AS g, CASE WHEN sum(score) OVER () > 0 THEN score ELSE 1.0 END AS w, v FROM (SELECT p.id, coalesce(round(s, 6), 0.0) AS score, pv.v FROM ps p JOIN pv ON pv.person_id = p.id LEFT JOIN (SELECT person_id, sum(score) AS s FROM item_persons JOIN sc USING (item_id) GROUP BY 1) x ON x.person_id = p.id WHERE favorite ORDER BY 2 DESC, 1 LIMIT 5))")
add("rec_persons", recommend.for_persons, lib(_OUT.format(f"SELECT item_id, {cos('iv.v', 'lv.v')} AS score FROM iv, lv WHERE {_KNOWN}", _UNSEEN), IV, SC, PV, _LV))
add("rec_session", recommend.for_session, lib(_OUT.format(f"SELECT item_id, {cos('iv.v', 'ss.v')} AS score FROM iv, ss WHERE {_KNOWN} AND item_id NOT IN (1, 2, 3, 4, 5, 6)", "true"), IV, mean("ss", "(SELECT 1 AS g, 1.0 AS w, v FROM iv WHERE item_id IN (1, 2, 3, 4, 5, 6))")), item_ids=(1, 2, 3, 4, 5, 6))
add("rec_mode_rewatch", recommend.recommendations, SQL["rec_rewatch_items"], mode="rewatch")
add("rec_mode_seed", recommend.recommendations, SQL["rec_seed"], mode="discover", seed_item=9)
GC = "gc AS (SELECT item_id, score, org_id AS cluster FROM sc JOIN items ON id = item_id WHERE org_id IS NOT NULL)"
BC = mean("cm", "(SELECT cluster AS g, round(CASE WHEN score > 0 THEN score ELSE 1.0 END, 6) AS w, v FROM gc JOIN iv USING (item_id))") + ", bk AS (SELECT row_number() OVER (ORDER BY share DESC, cluster) - 1 AS place, * FROM (SELECT cluster, items, round(s / sum(s) OVER (), 6) AS share, v FROM (SELECT cluster, sum(score) AS s, count(*) AS items FROM gc JOIN iv USING (item_id) GROUP BY 1) JOIN cm ON g = cluster))"


def rec_cluster_build(spark: SparkSession, d: str) -> DataFrame:
    """The clusters by org, with the sum of their vectors for the check."""
    cat = Catalog(spark, d)
    return recommend.built_clusters(cat, recommend.given_clusters(cat)).select("place", "cluster", "items", "share", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("v_sum"))


def rec_cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of these clusters."""
    cat = Catalog(spark, d)
    return recommend.labelled_clusters(cat, recommend.built_clusters(cat, recommend.given_clusters(cat)))


def rec_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """The three members nearest to each of these clusters' vectors."""
    cat = Catalog(spark, d)
    members = recommend.given_clusters(cat)
    return recommend.cluster_members_shown(cat, recommend.built_clusters(cat, members), members)


def rec_taste_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means of the engaged items with the number of clusters chosen by silhouette: items and share of score of each."""
    members = recommend.taste_clusters(Catalog(spark, d), restarts=2, counts=range(2, 7))
    return members.groupBy("cluster").agg(F.count("*").alias("items"), F.round(F.sum("score"), 2).alias("score"))


def rec_propagated_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags that the five nearest items of each query item suggest."""
    from ..tools import details

    cat = Catalog(spark, d)
    near = similar.similar_items(cat, limit=5, min_similarity=-1.0)
    return details.propagated_tags(cat, near.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("other_id"), "similarity"))


def rec_swipe_weights(spark: SparkSession, d: str) -> DataFrame:
    """Events stand in for swipes."""
    e = Catalog(spark, d).table("events")
    action = F.when(F.col("event_type") == "purchase", "super").when(F.col("event_type") == "view", "like").when(F.col("event_type") == "error", "dislike").otherwise("skip")
    return recommend.swipe_weights(e.select("event_id", action.alias("action"), (F.col("value") / 2).alias("seconds"), (F.col("value") / 10 - 1).alias("z")), "action", "seconds", "z").select("event_id", "sign", "weight", "surprise")


def rec_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Parts ranked by price within their brand, merged by weights that fall with the brand's number."""
    from pyspark.sql import Window

    p = Catalog(spark, d).table("part")
    rows = p.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("place"), (1 / F.length("p_brand")).alias("w"))
    return recommend.interleaved(rows, "p_brand", "p_partkey", "place", "w", 40)


def pref_blend(spark: SparkSession, d: str) -> DataFrame:
    """The blend of model and profile, a row per coordinate."""
    return recommend.preference_blend(Catalog(spark, d))


for _f in (rec_cluster_build, rec_cluster_labels, rec_cluster_members, rec_taste_clusters, rec_propagated_tags, rec_swipe_weights, rec_interleaved, pref_blend):
    QUERIES[_f.__name__] = _f
SQL["rec_cluster_build"] = lib("SELECT place::INT AS place, cluster::INT AS cluster, items, share, round(list_sum(v), 5) AS v_sum FROM bk", IV, SC, GC, BC)
SQL["rec_cluster_members"] = lib("SELECT cluster::INT AS cluster, item_id, similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, item_id) AS place FROM (SELECT gc.cluster, item_id, " + cos("iv.v", "bk.v") + " AS similarity FROM gc JOIN iv USING (item_id) JOIN bk ON bk.cluster = gc.cluster)) WHERE place <= 3", IV, SC, GC, BC)
SQL["rec_cluster_labels"] = lib("SELECT cluster::INT AS cluster, array_to_string(list_slice(l, 1, 2), ' / ') AS label, array_to_string(l, ', ') AS tags FROM (SELECT cluster, list(name ORDER BY dd DESC, tag_id) AS l FROM (SELECT cluster, tag_id, round(s - b, 4) AS dd FROM (SELECT bk.cluster, tv.tag_id, " + cos("tv.v", "bk.v") + " AS s, row_number() OVER (PARTITION BY bk.cluster ORDER BY " + cos("tv.v", "bk.v") + " DESC, tv.tag_id) AS k FROM bk, tv) JOIN (SELECT tag_id, " + cos("tv.v", "mid.v") + " AS b FROM tv, mid) USING (tag_id) WHERE k <= 8) JOIN tg ON tg.id = tag_id GROUP BY 1)", IV, SC, GC, BC, TV, mean("mid", "(SELECT 1 AS g, 1.0 AS w, v FROM bk)"))
_NB = "(SELECT * FROM (SELECT q.item_id, i.item_id AS other_id, " + cos("i.v", "q.v") + " AS similarity, row_number() OVER (PARTITION BY q.item_id ORDER BY " + cos("i.v", "q.v") + " DESC, i.item_id) AS k FROM iv q, iv i WHERE q.item_id % 100 = 0 AND i.item_id <> q.item_id) WHERE k <= 5)"
SQL["rec_propagated_tags"] = lib("SELECT item_id, tag_id, score, sources, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag_id) AS place FROM (SELECT n.item_id, t.tag_id, round(sum(similarity), 6) AS score, string_agg(other_id::VARCHAR, ',' ORDER BY other_id) AS sources FROM " + _NB + " n JOIN item_tags t ON t.item_id = other_id WHERE NOT EXISTS (SELECT 1 FROM item_tags o WHERE o.item_id = n.item_id AND o.tag_id = t.tag_id) GROUP BY 1, 2)) WHERE place <= 15", IV)
SQL["rec_swipe_weights"] = "SELECT event_id, sign::INT AS sign, round(base * speed, 4)::DOUBLE AS weight, round(1 / (1 + exp(1.5 * sign * z)), 6) AS surprise FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS sign, CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS base, CASE WHEN value / 2 < 1 THEN 1.5 WHEN value / 2 < 3 THEN 1.0 WHEN value / 2 < 8 THEN 0.7 ELSE 0.5 END AS speed, value / 10 - 1 AS z FROM events)"
SQL["rec_interleaved"] = "SELECT p_partkey, turn, p_brand AS source FROM (SELECT p_partkey, p_brand, round((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 0.5) * length(p_brand), 6)::DOUBLE AS turn FROM part) ORDER BY turn, p_brand, p_partkey LIMIT 40"
SQL["pref_blend"] = lib("SELECT (p - 1)::INT AS pos, round(x / sqrt(sum(x * x) OVER ()), 6) AS value FROM (SELECT unnest(list_transform(list_zip(lv.v, q), lambda z: a * z[1] + (1 - a) * z[2])) AS x, unnest(range(1, 41)) AS p FROM lv, pq, (SELECT 1 / (1 + exp(-5.0)) AS a))", IV, SC, PV, _LV, PI, PQ)
_TURN = "SELECT *, round((place - 0.5) / w, 6) AS turn FROM (SELECT c.cluster, c.w, i.item_id, {s} AS score, row_number() OVER (PARTITION BY c.cluster ORDER BY {s} DESC, i.item_id) AS place FROM (SELECT cluster, v, w0 / sum(w0) OVER () AS w FROM (SELECT cluster, v, {w0} AS w0 FROM bk {active}) WHERE w0 > 0) c, iv i WHERE i.item_id IN (SELECT id FROM items) AND i.item_id {seen} (SELECT item_id FROM log) AND {s} >= {least}) WHERE place <= greatest(10, floor(24 * w * 2))"
for _key, _vals, _values in (
    ("rec_clusters_discover", {"w0": "share", "active": "", "seen": "NOT IN", "least": 0.0}, {}),
    ("rec_clusters_rewatch", {"w0": "CASE WHEN cluster = 1 THEN 2.0 ELSE share END", "active": "WHERE cluster IN (0, 1, 2)", "seen": "IN", "least": 0.3}, {"mode": "rewatch", "active": (0, 1, 2), "weights": ((1, 2.0),)}),
):
    add(_key, recommend.for_clusters, lib("SELECT item_id, cluster::INT AS cluster, score, turn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn, cluster) AS k FROM (" + _TURN.format(s=cos("i.v", "c.v"), **_vals) + ")) WHERE k = 1 ORDER BY turn, cluster, item_id LIMIT 24", IV, SC, GC, BC), **_values)
_PS = f"sx AS (SELECT item_id, u, round(list_dot_product(u, q), 6) AS score, round(sqrt(4.0 * list_dot_product(u, u)), 6) AS sigma FROM (SELECT item_id, {unit('v')} AS u FROM iv), pq)"


def pref_item_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and uncertainties of all items."""
    return recommend.preference_scores(Catalog(spark, d))


QUERIES["pref_item_scores"] = pref_item_scores
SQL["pref_item_scores"] = lib("SELECT item_id, score, sigma FROM sx", IV, SC, PI, PQ, _PS)
add("pref_pair_probabilities", recommend.pair_probabilities, lib("SELECT item_id, other_id, round(1 / (1 + exp(o - score)), 6) AS probability, round(abs(1 / (1 + exp(o - score)) - 0.5) * 2, 6) AS confidence, round(0.5 * ln(1 + 4 * list_sum(list_transform(list_zip(u, ou), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS gain FROM (SELECT *, lead(item_id) OVER w AS other_id, lead(score) OVER w AS o, lead(u) OVER w AS ou FROM sx WINDOW w AS (PARTITION BY item_id // 100 ORDER BY item_id)) WHERE other_id IS NOT NULL", IV, SC, PI, PQ, _PS))
add("pref_convergence", recommend.preference_convergence, lib("SELECT round(m, 6) AS mean_sigma, t AS top_sigma, round(least(greatest((3 - m) / 2.9, 0), 1) * 0.8 * 100, 4) AS confidence, m < 1.5 AND t < 2.5 AS converged FROM (SELECT avg(sigma) AS m, (SELECT max(sigma) FROM (SELECT sigma FROM sx ORDER BY score DESC, item_id LIMIT 50)) AS t FROM sx)", IV, SC, PI, PQ, _PS))
for _phase in ("broad", "refine", "boundary"):
    add(f"pref_pairs_{_phase}", recommend.preference_pairs, phase=_phase)
for _strategy in ("clusters", "softmax", "uncertain", "negative", "random"):
    add(f"pref_swipe_{_strategy}", recommend.swipe_candidates, strategy=_strategy)
add("pref_taste_labels", recommend.taste_labels, lib(f"(SELECT tag_id, {cos('v', 'q')} AS s, 'likes' AS side FROM tv, pq ORDER BY 2 DESC, 1 LIMIT 5) UNION ALL (SELECT tag_id, {cos('v', 'q')}, 'dislikes' FROM tv, pq ORDER BY 2, 1 LIMIT 5)", IV, SC, PI, PQ, TV))
add("pref_recommendations", recommend.for_preferences, lib(f"SELECT item_id, round(CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (s - lo) / (hi - lo) END, 7) AS score FROM (SELECT *, min(s) OVER () AS lo, max(s) OVER () AS hi FROM (SELECT item_id, coalesce(f, {_S}) AS s FROM (SELECT iv.item_id, iv.v, f FROM iv LEFT JOIN (SELECT item_id, max({_S}) AS f FROM fr, pq GROUP BY 1) x ON x.item_id = iv.item_id), pq WHERE {_KNOWN} AND {_UNSEEN})) ORDER BY score DESC, item_id LIMIT 24", IV, FR, SC, PI, PQ))
