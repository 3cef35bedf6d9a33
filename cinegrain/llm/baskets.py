"""Problem 4: items that appear together, by collapsing equal baskets.

Equal baskets become one row with a weight before any pair is made; pairs are
made once per distinct basket and their weights summed, with a partial sum in
every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Items of a basket whose pairs are made by one row; a longer basket is spread over several.
SLICE = 64


def collapsed(df: DataFrame, items: str) -> DataFrame:
    """(basket, weight): the distinct sorted item arrays and in how many records each occurs; empty ones are left out."""
    sets = df.select(F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("basket"))
    return sets.where(F.size("basket") > 0).groupBy("basket").agg(F.count("*").alias("weight"))


def item_pairs(df: DataFrame, items: str, min_count: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """How often two items share a record, against what chance would give.

    df has one row per record and an array of items. Returns item_a < item_b,
    n (records with both), n_a, n_b (records with the one), total (records with
    any item), ratio = n * total / (n_a * n_b) and conviction of a -> b
    ((1 - n_b/total) / (1 - n/n_a), null where b is in every record with a), for
    n >= min_count and ratio >= min_ratio.

    Null items and repeated items of a record don't count; a null or empty array
    is no record; an empty table gives no rows; equal records count as often as they occur.

    Items that cannot be in any pair that is asked for are left out before pairs
    are made: n is at most the smaller count, so both counts reach min_count, and
    ratio <= total / (the greater count), so neither passes total / min_ratio.
    Both bounds are exact, and the second takes out the commonest items.
    """
    baskets = stored(collapsed(df, items), "baskets")
    total = baskets.agg(F.sum("weight").alias("total"))
    counts = baskets.select(F.explode("basket").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("count"))
    possible = counts.where(F.col("count") >= min_count).crossJoin(F.broadcast(total))  # one row
    if min_ratio > 0:
        possible = possible.where(F.col("count") * F.lit(min_ratio) <= F.col("total"))
    possible = stored(possible, "possible-items")
    # Back to baskets of possible items, which may collapse further.
    # Two hashes with different seeds: 128 bits stand for the basket.
    numbered = baskets.select(F.struct(F.xxhash64("basket").alias("x"), F.xxhash64(F.lit(1), "basket").alias("y")).alias("key"), "basket", "weight")
    left = (
        numbered.select("key", "weight", F.explode("basket").alias("item"))
        .join(possible.select("item"), "item", "left_semi")
        .groupBy("key", "weight")
        .agg(F.array_sort(F.collect_set("item")).alias("basket"))
        .where(F.size("basket") > 1)
        .groupBy("basket")
        .agg(F.sum("weight").alias("weight"))
    )
    left = stored(left, "left-baskets")
    short = left.where(F.size("basket") <= SLICE).select("weight", "basket", F.explode("basket").alias("item_a"))
    # A long basket is spread over as many tasks as it has slices.
    slices = F.explode(F.sequence(F.lit(0), F.floor((F.size("basket") - 1) / F.lit(SLICE)).cast("int"))).alias("block")
    long = left.where(F.size("basket") > SLICE).select("weight", "basket", slices).repartition(F.xxhash64("basket"), "block")
    anchored = short.unionByName(long.select("weight", "basket", F.explode(F.slice("basket", F.col("block") * SLICE + 1, F.lit(SLICE))).alias("item_a")))
    pairs = (
        anchored.select("weight", "item_a", F.explode(F.filter("basket", lambda x: x > F.col("item_a"))).alias("item_b"))
        .groupBy("item_a", "item_b")
        .agg(F.sum("weight").alias("n"))
        .where(F.col("n") >= min_count)
    )
    a = possible.select(F.col("item").alias("item_a"), F.col("count").alias("n_a"), "total")
    b = possible.select(F.col("item").alias("item_b"), F.col("count").alias("n_b"))
    scored = pairs.join(a, "item_a").join(b, "item_b")
    ratio = F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))
    missing = 1 - F.col("n") / F.col("n_a")
    return scored.select(
        "item_a",
        "item_b",
        "n",
        "n_a",
        "n_b",
        "total",
        ratio.alias("ratio"),
        F.when(missing > 0, (1 - F.col("n_b") / F.col("total")) / missing).alias("conviction"),
    ).where(F.col("n") * F.col("total") >= F.lit(min_ratio) * F.col("n_a") * F.col("n_b"))
