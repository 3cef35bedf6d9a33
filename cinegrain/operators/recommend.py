"""Recommendations: a profile from engagement, then the most similar items that were not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import centroids, cosine


def profile(scores: DataFrame, vectors: DataFrame, key: str, vector: str, score: str) -> DataFrame:
    """One row: the mean of the items' vectors weighted by score, scaled to length one, as an array q; no row without scored items."""
    rows = scores.select(key, score).join(vectors.select(key, vector), key).where(F.col(score) > 0).withColumn("_one", F.lit(1))
    parts = centroids(rows, "_one", vector, F.col(score).cast("double"))
    return parts.groupBy("_one").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("q")).select("q")


def recommend(profile_row: DataFrame, vectors: DataFrame, key: str, vector: str, seen: DataFrame | None, k: int | None, least: float = -1.0, only: bool = False) -> DataFrame:
    """(key, similarity): the k items nearest to the profile, without those in `seen` (or only those: rewatch). Filters come before the top k; k None gives all items, unordered."""
    pool = vectors.select(key, vector)
    if seen is not None:
        pool = pool.join(seen.select(key).distinct(), key, "left_semi" if only else "left_anti")
    scored = pool.crossJoin(F.broadcast(profile_row.limit(1))).select(key, cosine(F.col(vector), F.col("q")).alias("similarity"))  # one row
    scored = scored.where(F.col("similarity") >= least)
    return scored if k is None else scored.orderBy(F.col("similarity").desc(), key).limit(k)
