"""The engine's registered queries and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import datasets as data_checks
from .checks import details, library, similar
from .checks import recommend as recommend_checks
from .operators import datasets, frames, preference, recommend, taste, vectors
from .plans.catalogue import PLANS
from .shared import table
from .streaming import events as event_ops


def _spark_text(text: str) -> str:
    return re.sub(r"unix_s\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"unix_timestamp(\1)", text)


def _check_text(text: str) -> str:
    text = re.sub(r"unix_s\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def planned(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs a plan's text over a data directory, without registering views."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        return spark.sql(_spark_text(text), **{n: table(spark, d, n) for n in names})

    return run


def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return vectors.similar_to(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_key"), F.col("embedding").alias("q")), 10)


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")


def consecutive_similarity(spark: SparkSession, d: str) -> DataFrame:
    return vectors.consecutive(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")


def tag_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "part").where("p_partkey > 1").select(F.expr("p_partkey div 8").alias("parent"), F.col("p_partkey").alias("child"))
    return vectors.closure(edges, spark.createDataFrame([(1,)], "id long"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def frame_segments(spark: SparkSession, d: str) -> DataFrame:
    return frames.segments(_embeddings(spark, d), ["label"], "vec_id", "embedding", 0.0, 2).select("label", F.col("segment").cast("bigint").alias("segment"), "first", "last", "n")


def frame_novelty(spark: SparkSession, d: str) -> DataFrame:
    return frames.novelty(_embeddings(spark, d), "label", "vec_id", "embedding", 2)


def frame_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1))
    scored = e.where("vec_id <> 1").crossJoin(q).select("label", "vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return frames.best_per_group(scored, "label", "vec_id", F.col("s"), 20)


def detection_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'").select("user_id", F.unix_timestamp("ts").cast("double").alias("t"), "value")
    return frames.sessions(e.groupBy("user_id", "t").agg(F.max("value").alias("value")), "user_id", "t", 86400.0, "value")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("vec_id")).agg(F.count("*").alias("score"))


def rec_discover(spark: SparkSession, d: str) -> DataFrame:
    scores, e = _scores(spark, d), _embeddings(spark, d)
    return recommend.recommend(recommend.profile(scores, e, "vec_id", "embedding", "score"), e, "vec_id", "embedding", scores, 20)


def rec_rewatch(spark: SparkSession, d: str) -> DataFrame:
    scores, e = _scores(spark, d), _embeddings(spark, d)
    return recommend.recommend(recommend.profile(scores, e, "vec_id", "embedding", "score"), e, "vec_id", "embedding", scores, 20, only=True)


def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    bridge = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return datasets.merge_tags(bridge, "l_orderkey", "l_suppkey", 1, [2, 3])


def events_per_day(spark: SparkSession, d: str) -> DataFrame:
    return event_ops.windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def rec_rewatch_blend(spark: SparkSession, d: str) -> DataFrame:
    """Similarity to the profile and share of the greatest score, 0.4 to 0.6, over the items that were seen."""
    scores, e = _scores(spark, d), _embeddings(spark, d)
    near = recommend.recommend(recommend.profile(scores, e, "vec_id", "embedding", "score"), e, "vec_id", "embedding", scores, None, only=True)
    top = scores.join(e.select("vec_id"), "vec_id", "left_semi").agg(F.max("score").alias("top"))
    mixed = near.join(scores, "vec_id").crossJoin(F.broadcast(top))
    return mixed.select("vec_id", F.round(F.col("similarity") * 0.4 + F.col("score") / F.col("top") * 0.6, 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(20)


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return taste.representatives(_embeddings(spark, d), "label", "vec_id", "embedding")


def cluster_share(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).join(_scores(spark, d), "vec_id", "left").select("label", F.coalesce("score", F.lit(0)).alias("score"))
    return taste.shares(e, "label", "score")


def pref_warm_start(spark: SparkSession, d: str) -> DataFrame:
    return preference.warm_start(_scores(spark, d).join(_embeddings(spark, d), "vec_id"), "embedding", F.col("score")).select("pos", "mean")


def pref_session_start(spark: SparkSession, d: str) -> DataFrame:
    """The session version of the warm start."""
    return preference.warm_start(_scores(spark, d).join(_embeddings(spark, d), "vec_id"), "embedding", F.col("score"), session=True)


def pref_scores(spark: SparkSession, d: str) -> DataFrame:
    """All items by the warm start's model."""
    model = preference.warm_start(_scores(spark, d).join(_embeddings(spark, d), "vec_id"), "embedding", F.col("score"))
    return preference.scores(_embeddings(spark, d), "vec_id", "embedding", model)


def pref_fold(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons of neighbours by id within a label: the even one wins."""
    e = _embeddings(spark, d)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("l"))
    pairs = e.where("vec_id % 2 = 0").join(other, "vec_id").select(F.col("label").alias("model"), "vec_id", F.col("embedding").alias("w"), "l")
    return preference.fold(pairs, "model", "vec_id", "w", "l")


def item_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of each item vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _embeddings(spark, d).select("vec_id", array_to_vector("embedding").alias("v"))
    if rows.isEmpty():
        return spark.createDataFrame([], "vec_id long, x double, y double")
    xy = PCA(k=2, inputCol="v", outputCol="c").fit(rows).transform(rows).select("vec_id", vector_to_array("c").alias("c"))
    return xy.select("vec_id", F.round(F.col("c")[0], 4).alias("x"), F.round(F.col("c")[1], 4).alias("y"))


QUERIES = {name: planned(text) for name, text in PLANS.items()} | {f.__name__: f for f in (similar_topk, label_centroids, consecutive_similarity, tag_closure, frame_segments, frame_novelty, frame_best_per_group, detection_sessions, rec_discover, rec_rewatch, tag_merge, events_per_day, rec_rewatch_blend, item_coordinates, cluster_representatives, cluster_share, pref_warm_start, pref_session_start, pref_scores, pref_fold)}

_COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 6)"
_LAG = "l AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)"
_PROFILE = "s AS (SELECT user_id AS vec_id, count(*) AS score FROM events WHERE event_type = 'view' GROUP BY 1), x AS (SELECT score, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings JOIN s USING (vec_id)), c AS (SELECT pos, sum(score * v) AS v FROM x GROUP BY pos), q AS (SELECT list(round(v / n, 6) ORDER BY pos) AS q FROM c, (SELECT sqrt(sum(v * v)) AS n FROM c))"
_WARM = "s AS (SELECT user_id AS vec_id, count(*) AS score FROM events WHERE event_type = 'view' GROUP BY 1), i AS (SELECT score, embedding FROM s JOIN embeddings USING (vec_id)), z AS (SELECT (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS y, embedding FROM i), x AS (SELECT y, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM z), b AS (SELECT pos, sum(v * y) / (sum(v * v) + 1) AS b, sum(v * v) AS xx FROM x GROUP BY pos), m AS (SELECT pos, round(b / sqrt(sum(b * b) OVER ()), 6) AS mean, round(1 / (xx + 1), 6) AS variance FROM b)"
SQL = {name: _check_text(text) for name, text in PLANS.items()} | {
    "label_centroids": "WITH x AS (SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, pos, sum(v) AS s FROM x GROUP BY 1, 2) SELECT label, pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS value FROM s",
    "consecutive_similarity": "WITH l AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT label, vec_id, " + _COS.format(a="e", b="p") + " AS similarity FROM l",
    "tag_closure": "WITH RECURSIVE t(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 8 = t.id AND p_partkey > 1) SELECT id, min(depth)::INT AS depth FROM t GROUP BY id",
    "frame_segments": "WITH " + _LAG + ", n AS (SELECT label, vec_id, sum(CASE WHEN " + _COS.format(a="e", b="p") + " >= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS segment FROM l) SELECT label, segment::BIGINT AS segment, min(vec_id) AS first, max(vec_id) AS last, count(*) AS n FROM n GROUP BY label, segment HAVING count(*) >= 2 OR segment = 1",
    "frame_novelty": "WITH f AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), n AS (SELECT a.label, a.vec_id, avg(list_dot_product(a.e, b.e)) AS m, count(b.k) AS c FROM f a LEFT JOIN f b ON a.label = b.label AND a.k <> b.k AND abs(a.k - b.k) <= 2 GROUP BY 1, 2) SELECT label, vec_id, CASE WHEN c > 0 THEN round((1 - m) * least(1.0, c / 4.0), 6) ELSE 0.0 END::DOUBLE AS novelty FROM n",
    "rec_rewatch_blend": "WITH " + _PROFILE + ", m AS (SELECT vec_id, score, " + _COS.format(a="embedding", b="q") + " AS similarity FROM embeddings JOIN s USING (vec_id), q) SELECT vec_id, round(similarity * 0.4 + score / (SELECT max(score) FROM m) * 0.6, 6) AS score FROM m ORDER BY score DESC, vec_id LIMIT 20",
    "frame_best_per_group": "WITH s AS (SELECT a.label, a.vec_id, " + _COS.format(a="a.embedding", b="q.embedding") + " AS score FROM embeddings a, embeddings q WHERE q.vec_id = 1 AND a.vec_id <> 1) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s) WHERE k = 1 ORDER BY score DESC, label LIMIT 20",
    "detection_sessions": "WITH e AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 86400 THEN 0 ELSE 1 END AS b FROM e), n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, max(t) AS end, count(*) AS n, max(value) AS peak FROM n GROUP BY user_id, k",
    "rec_discover": "WITH " + _PROFILE + " SELECT vec_id, " + _COS.format(a="embedding", b="q") + " AS similarity FROM embeddings, q WHERE vec_id NOT IN (SELECT vec_id FROM s) ORDER BY similarity DESC, vec_id LIMIT 20",
    "rec_rewatch": "WITH " + _PROFILE + " SELECT vec_id, " + _COS.format(a="embedding", b="q") + " AS similarity FROM embeddings, q WHERE vec_id IN (SELECT vec_id FROM s) ORDER BY similarity DESC, vec_id LIMIT 20",
    "tag_merge": "SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey IN (2, 3) THEN 1 ELSE l_suppkey END AS l_suppkey FROM lineitem",
    "events_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "cluster_share": "WITH s AS (SELECT user_id AS vec_id, count(*) AS score FROM events WHERE event_type = 'view' GROUP BY 1), g AS (SELECT label, count(*) AS items, sum(coalesce(score, 0)) AS s FROM embeddings LEFT JOIN s USING (vec_id) GROUP BY label) SELECT label, items, round(s / sum(s) OVER (), 6) AS share FROM g",
    "cluster_representatives": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), t AS (SELECT label, pos, sum(v) AS s FROM x GROUP BY 1, 2), u AS (SELECT label, pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS v FROM t), c AS (SELECT label, list(v ORDER BY pos) AS c FROM u GROUP BY label), r AS (SELECT label, vec_id, " + _COS.format(a="embedding", b="c") + " AS similarity FROM embeddings JOIN c USING (label)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS place FROM r) WHERE place <= 3",
    "pref_warm_start": "WITH " + _WARM + " SELECT pos, mean FROM m",
    "pref_session_start": "WITH " + _WARM + " SELECT pos, mean, variance FROM m",
    "pref_scores": "WITH " + _WARM + ", e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(sum(v * mean), 6) AS score, round(sqrt(sum(4 * v * v)), 6) AS sigma FROM e JOIN m USING (pos) GROUP BY 1",
    "similar_topk": "SELECT q_key, vec_id, similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY similarity DESC, vec_id) AS place FROM (SELECT b.vec_id AS q_key, a.vec_id, " + _COS.format(a="a.embedding", b="b.embedding") + " AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE place <= 10",
}
# The flagship's scores once more in SQL of their own: event by event, with correlated counts in place of a joined log.
_PER_ITEM = """WITH m(segment, rating) AS (VALUES ('BUILDING', 100), ('AUTOMOBILE', 80), ('MACHINERY', 60), ('HOUSEHOLD', 40)),
i AS (SELECT c_custkey AS id, rating, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'view') AS views, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS peaks,
 (SELECT max(ts) FROM events WHERE user_id = c_custkey AND event_type = 'view') AS seen FROM customer LEFT JOIN m ON segment = c_mktsegment),
x AS (SELECT *, 20 * peaks + CASE WHEN views > 1 THEN 2 * (views - 1) ELSE 0 END AS plain, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(seen))) / 86400 AS days FROM i),
y AS (SELECT *, plain + CASE WHEN rating IS NOT NULL THEN rating / 20 * 1.5 ELSE 0 END AS score FROM x) """
SQL |= {
    "engagement_rank": _PER_ITEM + "SELECT id, views, peaks, coalesce(rating, -1) AS rating, round(score, 6)::DOUBLE AS score FROM y ORDER BY score DESC, id LIMIT 20",
    "engagement_rank_decayed": _PER_ITEM + "SELECT id, round(score * CASE WHEN seen IS NULL THEN 0.1 WHEN power(0.5, days / 30) < 0.1 THEN 0.1 ELSE power(0.5, days / 30) END, 6)::DOUBLE AS score FROM y ORDER BY score DESC, id LIMIT 20",
    "engagement_modes": _PER_ITEM + "SELECT id, plain::BIGINT AS favorites, round(plain * power(0.5, CASE WHEN seen IS NULL THEN 0 ELSE floor(days) / 30 END), 6)::DOUBLE AS recent, CASE WHEN views > 0 THEN round(peaks / views, 6) END AS intensity FROM y WHERE views > 0 OR peaks > 0",
}
for _module in (library, details, similar, recommend_checks, data_checks):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
