"""The pN_ queries over the library's tables, and their SQL where SQL can do them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored, table
from . import baskets, byte_bpe, clusters, leaks, nearest, runs, set_join, shells, tables, top_items, vector_rows


def _library(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return tables.current_rows(table(spark, d, "sample_library"), ["id"], "updated_at", list(columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most played scenes of each tag name."""
    scenes = _library(spark, d, "play_count", "tags").where(F.col("play_count") >= 0)
    rows = scenes.select(F.explode(tables.tag_names(F.col("tags"))).alias("tag_name"), F.col("id").alias("scene_id"), "play_count")
    return top_items.top_items(rows, "tag_name", "play_count", ["scene_id"], 5).select("tag_name", "scene_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of scenes whose tags and performers agree to 0.8 or more. Tags are even numbers, performers odd ones."""
    ids = lambda c, odd: F.transform(F.filter(c, lambda t: t["id"].isNotNull()), lambda t: t["id"] * 2 + odd)
    none = F.array().cast("array<bigint>")
    scenes = _library(spark, d, "tags", "performers").select(
        F.col("id").alias("scene"), F.concat(F.coalesce(ids(F.col("tags"), 0), none), F.coalesce(ids(F.col("performers"), 1), none)).alias("members")
    )
    return set_join.similar_records(scenes, "scene", "members", threshold=0.8, least_size=4).select(F.col("a").alias("scene_a"), F.col("b").alias("scene_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tag names that share at least 5 scenes, at least 3 times as many as chance would give."""
    return p4_pairs(spark, d).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, ratio and conviction."""
    scenes = _library(spark, d, "tags").select(tables.tag_names(F.col("tags")).alias("names"))
    pairs = baskets.item_pairs(scenes, "names", min_count=5, min_ratio=3.0)
    return pairs.withColumns({"ratio": F.round("ratio", 6), "conviction": F.round("conviction", 6)})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Still stretches of at least 3 frames."""
    return p3_runs(spark, d).where(F.col("n") >= 3).select("scene_id", "model_key", F.col("first").alias("first_frame_index"), F.col("last").alias("last_frame_index"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same stretches with their frame count and duration."""
    return runs.find_runs(table(spark, d, "frame_embeddings"), ["scene_id", "model_key"], "frame_index", "timestamp_s", "embedding", "created_at", 0.95, 10.0, least=3).withColumn("duration", F.round("duration", 6))


def _siglip(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "scene_embeddings").where(F.col("model_key") == "siglip")
    scenes = tables.current_rows(scenes, ["scene_id", "model_key"], "updated_at", ["composite_embedding"])
    return stored(vector_rows.usable(scenes.select(F.col("scene_id").cast("bigint").alias("id"), F.col("composite_embedding").alias("v")), "v"), "scene-vectors")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 3 scenes that are all close to each other and to no other."""
    return clusters.similar_groups(_siglip(spark, d), least=0.9, smallest=3).select("cluster_id", F.col("id").alias("scene_id"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same groups with their size and three most typical scenes."""
    rows = _siglip(spark, d)
    return clusters.describe(clusters.similar_groups(rows, least=0.9, smallest=3), rows, typical=3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near scenes of each model, and of near frames of openclip in different scenes."""
    kind, model = F.split("g", ":", 2)[0], F.split("g", ":", 2)[1]
    n = p6_nearest(spark, d)
    a, b = F.struct(F.col("a").alias("s"), F.col("b").alias("f")), F.struct(F.col("ca").alias("s"), F.col("cb").alias("f"))
    pairs = n.select(kind.alias("kind"), model.alias("model_key"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct()
    return pairs.select("kind", "model_key", F.col("p.s").alias("scene_a"), F.col("p.f").alias("frame_a"), F.col("q.s").alias("scene_b"), F.col("q.f").alias("frame_b"))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The up to 5 neighbours of each scene and each openclip frame; g is kind:model."""
    scenes = tables.current_rows(table(spark, d, "scene_embeddings"), ["scene_id", "model_key"], "updated_at", ["composite_embedding"])
    scenes = scenes.select(F.concat(F.lit("scene:"), "model_key").alias("g"), "scene_id", F.lit(-1).alias("frame"), F.col("composite_embedding").alias("v"))
    frames = table(spark, d, "frame_embeddings").where(F.col("model_key") == "openclip")
    frames = tables.current_rows(frames, ["scene_id", "frame_index", "model_key"], "created_at", ["embedding"])
    frames = frames.select(F.concat(F.lit("frame:"), "model_key").alias("g"), "scene_id", F.col("frame_index").alias("frame"), F.col("embedding").alias("v"))
    return nearest.nearest(scenes.unionByName(frames), "g", "scene_id", "frame", "v", k=5, least=0.9)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return byte_bpe.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item or a long passage of one."""
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the alignment's score and its number of equal words."""
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are empty shells."""
    return p9_shells(spark, d).select("doc_id")


def p9_shells(spark: SparkSession, d: str) -> DataFrame:
    """The same with the reasons."""
    return shells.find_shells(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_runs, p4_found, p4_pairs, p5_found, p5_groups, p6_found, p6_nearest, p7_ids, p8_found, p8_leaks, p9_found, p9_shells)}

_CURRENT = """
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1
),
names AS (
  SELECT DISTINCT id, play_count, lower(trim(regexp_replace(u.t.name, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]+', ' ', 'g'))) AS name
  FROM cur, unnest(cur.tags) AS u(t) WHERE u.t.name IS NOT NULL
)"""

_STILL = """WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_index, model_key ORDER BY created_at DESC) AS rn FROM frame_embeddings
    WHERE scene_id IS NOT NULL AND frame_index IS NOT NULL AND model_key IS NOT NULL) WHERE rn = 1
),
u AS (
  SELECT scene_id, model_key, frame_index::BIGINT AS i, timestamp_s AS t, embedding::DOUBLE[] AS v FROM cur
  WHERE len(embedding) = 40 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 40 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM u WINDOW w AS (PARTITION BY scene_id, model_key ORDER BY i)
),
s AS (
  SELECT *, CASE WHEN t - pt <= 10 AND list_dot_product(v, pv) / sqrt(list_dot_product(v, v) * list_dot_product(pv, pv)) >= 0.95 THEN 0 ELSE 1 END AS b FROM l
),
r AS (SELECT *, sum(b) OVER (PARTITION BY scene_id, model_key ORDER BY i) AS run FROM s),
g AS (
  SELECT scene_id, model_key, min(i) AS first, max(i) AS last, count(*) AS n, min_by(t, i) AS t_first, max_by(t, i) AS t_last
  FROM r GROUP BY scene_id, model_key, run HAVING count(*) >= 3
)
"""

SQL = {
    "p3_found": _STILL + "SELECT scene_id, model_key, first AS first_frame_index, last AS last_frame_index FROM g",
    "p3_runs": _STILL + "SELECT scene_id, model_key, first, last, n, t_first, t_last, round(t_last - t_first, 6) AS duration FROM g",
    "p1_found": f"""WITH {_CURRENT}
SELECT tag_name, scene_id FROM (
  SELECT name AS tag_name, id AS scene_id, row_number() OVER (PARTITION BY name ORDER BY play_count DESC, id) AS k
  FROM names WHERE play_count >= 0 AND name <> '') WHERE k <= 5""",
    "p2_found": """WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1
),
m AS (
  SELECT DISTINCT id, u.t.id * 2 AS x FROM cur, unnest(cur.tags) AS u(t) WHERE u.t.id IS NOT NULL
  UNION SELECT DISTINCT id, u.t.id * 2 + 1 AS x FROM cur, unnest(cur.performers) AS u(t) WHERE u.t.id IS NOT NULL
),
s AS (SELECT id, count(*) AS n FROM m GROUP BY id HAVING count(*) >= 4),
o AS (
  SELECT a.id AS ia, b.id AS ib, count(*) AS shared FROM m a JOIN m b ON a.x = b.x AND a.id < b.id
  WHERE a.id IN (SELECT id FROM s) AND b.id IN (SELECT id FROM s) GROUP BY 1, 2
)
SELECT o.ia AS scene_a, o.ib AS scene_b FROM o JOIN s sa ON sa.id = o.ia JOIN s sb ON sb.id = o.ib
WHERE 5 * o.shared >= 4 * (sa.n + sb.n - o.shared)""",
    "p4_found": f"""WITH {_CURRENT},
f AS (SELECT DISTINCT id, name FROM names WHERE name <> ''),
c AS (SELECT name, count(*) AS n FROM f GROUP BY name),
t AS (SELECT count(DISTINCT id) AS total FROM f),
p AS (SELECT a.name AS tag_a, b.name AS tag_b, count(*) AS n FROM f a JOIN f b ON a.id = b.id AND a.name < b.name GROUP BY 1, 2)
SELECT tag_a, tag_b FROM p JOIN c ca ON ca.name = tag_a JOIN c cb ON cb.name = tag_b, t
WHERE p.n >= 5 AND p.n * t.total >= 3 * ca.n * cb.n""",
    "p4_pairs": f"""WITH {_CURRENT},
f AS (SELECT DISTINCT id, name FROM names WHERE name <> ''),
c AS (SELECT name, count(*) AS n FROM f GROUP BY name),
t AS (SELECT count(DISTINCT id) AS total FROM f),
p AS (SELECT a.name AS item_a, b.name AS item_b, count(*) AS n FROM f a JOIN f b ON a.id = b.id AND a.name < b.name GROUP BY 1, 2)
SELECT item_a, item_b, p.n, ca.n AS n_a, cb.n AS n_b, t.total, round(p.n * t.total / (ca.n * cb.n)::DOUBLE, 6) AS ratio,
  CASE WHEN p.n < ca.n THEN round((1 - cb.n / t.total::DOUBLE) / (1 - p.n / ca.n::DOUBLE), 6) END AS conviction
FROM p JOIN c ca ON ca.name = item_a JOIN c cb ON cb.name = item_b, t
WHERE p.n >= 5 AND p.n * t.total >= 3 * ca.n * cb.n""",
}
