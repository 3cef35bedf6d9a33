"""Vector operators as column expressions: they stay in the JVM and shuffle ids and scores only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine rounded to six decimals; null for a zero vector."""
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, F.round(dot(a, b) / length, 6))


def similar_to(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(q_key, key, similarity, place): for each query (columns q_key, q) the k most similar other rows, ties by key. A batch of rows is one product with all queries and sends at most k rows for each."""
    from . import kernels

    kinds = df.schema[key].dataType.simpleString(), queries.schema["q_key"].dataType.simpleString()
    near = kernels.scored(df, [key], vector, queries, "q_key", "q", kernels.top_rows(k, least), f"q_key {kinds[1]}, {key} {kinds[0]}, similarity double")
    place = F.row_number().over(Window.partitionBy("q_key").orderBy(F.col("similarity").desc(), key))
    return near.withColumn("place", place).where(F.col("place") <= k)


def centroids(df: DataFrame, group: str, vector: str, weight: Column | None = None, width: int | None = None) -> DataFrame:
    """(group, pos, value): the weighted mean of each group's vectors, scaled to length one, a row per coordinate; see kernels.weighted_means."""
    from .kernels import weighted_means

    return weighted_means(df, group, vector, weight, width).select(group, F.posexplode("v").alias("pos", "value"))


def consecutive(df: DataFrame, entity: list[str], position: str, vector: str) -> DataFrame:
    """Each row of an ordered sequence with its similarity to the one before; null for the first."""
    before = F.lag(vector).over(Window.partitionBy(*entity).orderBy(position))
    return df.select(*entity, position, cosine(F.col(vector), before).alias("similarity"))


def reach(edges: DataFrame, starts: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """Rows of starts (keys and id) with depth 0, and below each key all nodes under its ids by (parent, child) edges, each at its least depth.

    Level by level the frontier is joined and what was seen taken out, with a reliable checkpoint of
    the frontier alone at each level: cycles end by themselves and a graph with many paths is no problem.
    Ends when nothing new comes, or at `depth` levels.
    """
    from ..shared import checkpointed

    frontier = checkpointed(starts.select(*keys, "id").where(F.col("id").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    seen, level = frontier, 0
    links = edges.select(F.col("parent").alias("id"), "child")
    while depth is None or level < depth:
        level += 1
        step = frontier.join(links, "id").select(*keys, F.col("child").alias("id")).distinct()
        frontier = checkpointed(step.join(seen, [*keys, "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth) of all nodes under the roots (column id), the roots included; see reach."""
    return reach(edges, roots, [], depth)
