"""Taste clusters that are given: their share of engagement, label and representatives; blends of two vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import centroids, cosine, dot


def blended(a: Column, b: Column, weight: float) -> Column:
    """The weighted sum of two vectors scaled to length one; if one is null the other; of different length the first."""
    w = min(1.0, max(0.0, weight))
    mixed = F.zip_with(a, b, lambda x, y: x.cast("double") * w + y.cast("double") * (1 - w))
    length = F.sqrt(dot(mixed, mixed))
    # The length stands in an array, so it is computed once and not for each coordinate.
    unit = F.when(length > 0, F.zip_with(mixed, F.array_repeat(length, F.size(mixed)), lambda x, n: x / n)).otherwise(mixed)
    return F.when(a.isNull(), b.cast("array<double>")).when(b.isNull() | (F.size(a) != F.size(b)), a.cast("array<double>")).otherwise(unit)


def shares(items: DataFrame, cluster: str, score: str) -> DataFrame:
    """(cluster, items, share): each cluster's share of the summed score; equal shares if there is none."""
    sums = items.groupBy(cluster).agg(F.count("*").alias("items"), F.sum(score).alias("s"))
    total = sums.agg(F.sum("s").alias("t"), F.count("*").alias("k"))
    return sums.crossJoin(F.broadcast(total)).select(cluster, "items", F.round(F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(1 / F.col("k")), 6).alias("share"))  # one row


def representatives(items: DataFrame, cluster: str, key: str, vector: str, k: int = 3) -> DataFrame:
    """(cluster, key, similarity, place): the k items nearest to each cluster's centroid; ties by key."""
    parts = centroids(items, cluster, vector)
    centre = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("c"))
    scored = items.join(centre, cluster).select(cluster, key, cosine(F.col(vector), F.col("c")).alias("similarity"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("similarity").desc(), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)
