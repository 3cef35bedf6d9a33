"""Recommendations and preferences over a catalog: profiles, modes, clusters, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import kernels
from ..operators.vectors import cosine, dot
from .base import tool, top
from .details import scored_items, watched_items
from .similar import _first, _unit, best_frames, favourites_vector, item_vectors, tag_vectors

#: Items of a profile, items it takes at least, greatest half life in days with the least decayed score asked for.
PROFILE_ITEMS, PROFILE_LEAST = 20, 3
THRESHOLDS = ((7, 5.0), (14, 3.0), (30, 1.5), (math.inf, 0.5))


def least_score(half_life: float | None) -> float:
    """The decayed score an item must have to be in a profile; the shorter the half life the higher. 0 without decay."""
    return 0.0 if half_life is None else next(t for days, t in THRESHOLDS if half_life <= days)


def profile_items(cat: Catalog, half_life: float | None = None) -> DataFrame:
    """(item_id, score): the first 20, of the 40 highest scored items, that have a vector. With a half life only those above the least score; if fewer than 3 are left, the plain scores."""
    has = item_vectors(cat).select("item_id")

    def chosen(scores: DataFrame) -> DataFrame:
        best = top(scores.withColumn("score", F.round("score", 6)), 2 * PROFILE_ITEMS, F.col("score").desc(), "item_id")
        return top(best.join(has, "item_id", "left_semi"), PROFILE_ITEMS, F.col("score").desc(), "item_id")

    plain = chosen(scored_items(cat))
    if half_life is None:
        return plain
    fresh = chosen(scored_items(cat, half_life).where(F.col("score") >= least_score(half_life)))
    n = F.broadcast(fresh.agg(F.count("*").alias("n")))  # one row
    return fresh.crossJoin(n).where(F.col("n") >= PROFILE_LEAST).drop("n").unionByName(plain.crossJoin(n).where(F.col("n") < PROFILE_LEAST).drop("n"))


def profile(cat: Catalog, half_life: float | None = None) -> DataFrame:
    """One row (q): the mean vector of the profile's items weighted by score; no row for fewer than 3 items."""
    rows = item_vectors(cat).join(F.broadcast(profile_items(cat, half_life)), "item_id").withColumn("one", F.lit(1).cast("bigint"))  # 20 rows
    return kernels.weighted_means(rows, "one", "v", F.col("score")).where(F.col("n") >= PROFILE_LEAST).select(F.col("v").alias("q"))


def session_profile(cat: Catalog, item_ids: tuple) -> DataFrame:
    """One row (q): the plain mean vector of some items; no row if none of them has a vector."""
    rows = item_vectors(cat).where(F.col("item_id").isin(list(item_ids))).withColumn("one", F.lit(1).cast("bigint"))
    return kernels.weighted_means(rows, "one", "v").select(F.col("v").alias("q"))


def _against(cat: Catalog, q: DataFrame) -> DataFrame:
    """(item_id, s) of the catalogue's items against the one row q."""
    known = item_vectors(cat).join(cat.items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return known.crossJoin(F.broadcast(q.limit(1))).select("item_id", cosine(F.col("v"), F.col("q")).alias("s"))  # one row


def _unseen(cat: Catalog, rows: DataFrame, contributing: DataFrame | None = None) -> DataFrame:
    rows = rows.join(watched_items(cat), "item_id", "left_anti")
    return rows if contributing is None else rows.join(F.broadcast(contributing.select("item_id")), "item_id", "left_anti")  # 20 rows


def _ranked(rows: DataFrame, limit: int, least: float = -1.0) -> DataFrame:
    return top(rows.withColumn("score", F.round("score", 7)).where(F.col("score") >= least), limit, F.col("score").desc(), "item_id").select("item_id", "score")


@tool()
def discover(cat: Catalog, limit: int = 24, min_similarity: float = -1.0, half_life: float | None = None) -> DataFrame:
    """Items like the profile that were neither watched nor part of it."""
    return _ranked(_unseen(cat, _against(cat, profile(cat, half_life)).withColumnRenamed("s", "score"), profile_items(cat, half_life)), limit, min_similarity)


@tool()
def discover_from_seed(cat: Catalog, seed_item: int, weight: float = 0.3, limit: int = 24, min_similarity: float = -1.0) -> DataFrame:
    """Items by (1 - weight) * similarity to the profile + weight * similarity to a seed, the threshold on the sum; without a seed vector as discover."""
    seed = item_vectors(cat).where(F.col("item_id") == seed_item).select(F.col("v").alias("q"))
    to_seed = _against(cat, seed).withColumnRenamed("s", "z")
    rows = _against(cat, profile(cat)).join(to_seed, "item_id", "left")
    score = F.when(F.col("z").isNull(), F.col("s")).otherwise((1 - weight) * F.col("s") + weight * F.col("z"))
    return _ranked(_unseen(cat, rows.where(F.col("item_id") != seed_item).select("item_id", score.alias("score")), profile_items(cat)), limit, min_similarity)


@tool()
def rewatch(cat: Catalog, engagement_weight: float = 0.6, limit: int = 24) -> DataFrame:
    """All engaged items with vectors by similarity * (1 - e) + score / greatest score * e."""
    rows = _against(cat, profile(cat)).join(scored_items(cat), "item_id")
    best = rows.agg(F.max("score").alias("best"))
    return _ranked(rows.crossJoin(F.broadcast(best)).select("item_id", (F.col("s") * (1 - engagement_weight) + F.col("score") / F.col("best") * engagement_weight).alias("score")), limit)  # one row


@tool()
def from_peaks(cat: Catalog, limit: int = 24, min_similarity: float = -1.0) -> DataFrame:
    """Items like the weighted mean of the peak windows: of each item with peaks its most typical frame, weighted by score (alike if none has one)."""
    peaks = best_frames(cat).join(cat.items.where("peaks > 0").select(F.col("id").alias("item_id")), "item_id", "left_semi")
    rows = peaks.join(scored_items(cat), "item_id", "left").where(F.coalesce("score", F.lit(1.0)) > 0).withColumn("one", F.lit(1).cast("bigint")).withColumn("w", F.round(F.coalesce("score", F.lit(1.0)), 6))
    q = kernels.weighted_means(rows, "one", "v", F.col("w")).select(F.col("v").alias("q"))
    unseen = _against(cat, q).join(peaks.select("item_id"), "item_id", "left_anti").withColumnRenamed("s", "score")
    return _ranked(_unseen(cat, unseen), limit, min_similarity)


@tool()
def for_persons(cat: Catalog, limit: int = 24, seed_item: int | None = None, weight: float = 0.3) -> DataFrame:
    """Unwatched items like the favourite people's vector, blended with a seed if one is given."""
    rows = _against(cat, favourites_vector(cat))
    if seed_item is not None:
        seed = item_vectors(cat).where(F.col("item_id") == seed_item).select(F.col("v").alias("q"))
        rows = rows.join(_against(cat, seed).withColumnRenamed("s", "z"), "item_id", "left").where(F.col("item_id") != seed_item)
        rows = rows.withColumn("s", F.when(F.col("z").isNull(), F.col("s")).otherwise((1 - weight) * F.col("s") + weight * F.col("z")))
    return _ranked(_unseen(cat, rows.withColumnRenamed("s", "score")), limit)


@tool()
def for_session(cat: Catalog, item_ids: tuple, limit: int = 24) -> DataFrame:
    """Items like the mean of some items, these aside."""
    return _ranked(_against(cat, session_profile(cat, item_ids)).where(~F.col("item_id").isin(list(item_ids))).withColumnRenamed("s", "score"), limit)


@tool(mode=("discover", "rewatch", "peaks", "persons"))
def recommendations(cat: Catalog, mode: str = "discover", seed_item: int | None = None, limit: int = 24) -> DataFrame:
    """One of the modes by its name; discover goes by the taste clusters unless there is a seed."""
    if mode == "discover":
        return for_clusters(cat, limit=limit) if seed_item is None else discover_from_seed(cat, seed_item=seed_item, limit=limit)
    return {"rewatch": rewatch, "peaks": from_peaks}[mode](cat, limit=limit) if mode != "persons" else for_persons(cat, limit=limit, seed_item=seed_item)


# ---- clusters of taste


def cluster_counts(n: int) -> range:
    """The numbers of clusters that are tried for n items."""
    return range(2, min(max(8, int(1.5 * math.log2(max(n, 2)))), 25, n - 1) + 1)


def taste_clusters(cat: Catalog, restarts: int = 10, seed: int = 42, sample: int = 2000, counts: range | None = None) -> DataFrame:
    """(item_id, score, cluster): engaged items with vectors by k-means, the number of clusters with the best silhouette. Fewer than 6 items are one cluster, 3 clusters if no number does.

    The k-means runs over all items. The silhouette is measured on a sample of at most about `sample` items, as the only purpose
    is to choose among a few numbers; everything else covers all items. restarts are different starts by seed, the least cost wins.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from ..shared import stored

    rows = stored(scored_items(cat).join(item_vectors(cat), "item_id").select("item_id", "score", _unit("v").alias("v")), "engaged-vectors")
    n = rows.count()
    if n < 6:
        return rows.select("item_id", "score", F.lit(0).alias("cluster"))
    data = rows.select("item_id", "score", array_to_vector("v").alias("features")).cache()
    judged = data if n <= sample else data.where(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(n)) < sample)
    found = {}
    for k in counts or cluster_counts(n):
        models = [KMeans(k=k, seed=seed + r, maxIter=20).fit(data) for r in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        placed = best.transform(judged)
        if placed.select("prediction").distinct().count() > 1:
            found[k] = (ClusteringEvaluator().evaluate(placed), best)
    best = max(found.items(), key=lambda x: (x[1][0], -x[0]))[1][1] if found else KMeans(k=min(3, n - 1), seed=seed).fit(data)
    return best.transform(data).select("item_id", "score", F.col("prediction").alias("cluster"))


def given_clusters(cat: Catalog) -> DataFrame:
    """(item_id, score, cluster): the engaged items by their org, clusters that are the same on every engine."""
    return scored_items(cat).join(cat.items.select(F.col("id").alias("item_id"), F.col("org_id").cast("int").alias("cluster")), "item_id").where("cluster IS NOT NULL")


def built_clusters(cat: Catalog, members: DataFrame) -> DataFrame:
    """(place, cluster, items, share, v): each cluster's vector weighted by score (1 for items without), its share of all scores (alike if there are none), the largest share first."""
    rows = members.join(item_vectors(cat), "item_id").withColumn("w", F.round(F.when(F.col("score") > 0, F.col("score")).otherwise(1.0), 6))
    means = kernels.weighted_means(rows, "cluster", "v", F.col("w"))
    sums = rows.groupBy("cluster").agg(F.sum("score").alias("s"), F.count("*").alias("items"))
    total = sums.agg(F.sum("s").alias("t"), F.count("*").alias("k"))
    shares = sums.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(1 / F.col("k")), 6))  # one row
    # One row per cluster, of which there are at most a few dozen.
    place = F.row_number().over(Window.orderBy(F.col("share").desc(), "cluster")) - 1
    return means.select("cluster", "v").join(shares, "cluster").select(place.alias("place"), "cluster", "items", "share", "v")


def labelled_clusters(cat: Catalog, clusters: DataFrame, k: int = 8) -> DataFrame:
    """(cluster, label, tags): of each cluster the tags by how much nearer its vector is to them than the mean of all clusters' vectors is, among the k nearest; the label is the first two names."""
    side = tag_vectors(cat).select("tag_id", F.col("v").alias("t"))
    middle = kernels.weighted_means(clusters.withColumn("one", F.lit(1).cast("bigint")), "one", "v").select(F.col("v").alias("m"))
    base = side.crossJoin(F.broadcast(middle)).select("tag_id", cosine(F.col("t"), F.col("m")).alias("b"))  # one row
    near = kernels.scored(side, ["tag_id"], "t", clusters.select(F.col("cluster").cast("bigint").alias("c"), "v"), "c", "v", kernels.top_rows(k, -1.0, itself=True), "c long, tag_id long, s double")
    near = _first(near, "c", k, F.col("s").desc(), "tag_id").join(base, "tag_id").withColumn("d", F.round(F.col("s") - F.col("b"), 4))
    named = near.join(cat.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    lists = named.groupBy(F.col("c").cast("int").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "tag_id", "name"))), lambda x: x["name"]).alias("l"))
    return lists.select("cluster", F.array_join(F.slice("l", 1, 2), " / ").alias("label"), F.array_join("l", ", ").alias("tags"))


def cluster_members_shown(cat: Catalog, clusters: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """(cluster, item_id, similarity, place): the k members nearest to each cluster's vector."""
    rows = members.select("item_id", "cluster").join(item_vectors(cat), "item_id").join(F.broadcast(clusters.select("cluster", F.col("v").alias("c"))), "cluster")  # a few dozen
    return _first(rows.select("cluster", "item_id", cosine(F.col("v"), F.col("c")).alias("similarity")), "cluster", k, F.col("similarity").desc(), "item_id")


@tool(mode=("discover", "rewatch"))
def for_clusters(cat: Catalog, mode: str = "discover", limit: int = 24, active: tuple = (), weights: tuple = (), min_similarity: float = 0.0) -> DataFrame:
    """Items for each taste cluster, as many as its weight asks for (an override, else its share), merged: the nth item of a cluster of weight w stands at (n - 0.5) / w, an item counts once, where it comes first.
    rewatch takes only watched items and a similarity of at least 0.3, discover only others."""
    clusters = built_clusters(cat, given_clusters(cat))
    if active:
        clusters = clusters.where(F.col("cluster").isin(list(active)))
    override = F.create_map(*[F.lit(x) for pair in weights for x in pair])[F.col("cluster")] if weights else F.lit(None).cast("double")
    weighed = clusters.withColumn("w0", F.coalesce(override.cast("double"), F.col("share"))).where("w0 > 0")
    total = weighed.agg(F.sum("w0").alias("t"))
    weighed = weighed.crossJoin(F.broadcast(total)).select("cluster", "v", (F.col("w0") / F.col("t")).alias("w"))  # one row
    known = item_vectors(cat).join(cat.items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    pool = known.join(watched_items(cat), "item_id", "left_semi" if mode == "rewatch" else "left_anti")
    least = max(min_similarity, 0.3) if mode == "rewatch" else min_similarity
    most = max(10, 2 * limit) * 3
    near = kernels.scored(pool, ["item_id"], "v", weighed.select(F.col("cluster").cast("bigint").alias("c"), "v"), "c", "v", kernels.top_rows(most, least, itself=True), "c long, item_id long, s double")
    placed = _first(near, "c", most, F.col("s").desc(), "item_id").join(F.broadcast(weighed.select(F.col("cluster").cast("bigint").alias("c"), "w")), "c")  # a few dozen
    placed = placed.where(F.col("place") <= F.greatest(F.lit(10), F.floor(limit * F.col("w") * 2)))
    turn = F.round((F.col("place") - 0.5) / F.col("w"), 6)
    once = placed.groupBy("item_id").agg(F.min(F.struct(turn.alias("turn"), F.col("c").alias("cluster"), F.col("s").alias("score"))).alias("b"))
    return top(once.select("item_id", "b.*"), limit, "turn", "cluster", "item_id").select("item_id", F.col("cluster").cast("int").alias("cluster"), "score", "turn")


# ---- preferences from comparisons; a model is (v: mean, s2: variance per coordinate)


def preference_model(cat: Catalog) -> DataFrame:
    """One row (q, comparisons): a warm start, the profile's direction with a variance of 4."""
    return profile(cat).withColumn("comparisons", F.lit(40))


def preference_blend(cat: Catalog) -> DataFrame:
    """(pos, value): normalise(a * model + (1 - a) * profile) with a = sigmoid((comparisons - 15) / 5); the model here is the favourites' vector."""
    a = 1 / (1 + F.exp(-(F.lit(40) - 15) / 5))
    both = favourites_vector(cat).select(F.col("q").alias("m")).crossJoin(profile(cat))  # one row each
    mixed = both.select(F.zip_with("m", "q", lambda x, y: a * x + (1 - a) * y).alias("v"))
    return mixed.select(F.posexplode(_unit("v")).alias("pos", "value")).select("pos", F.round("value", 6).alias("value"))


def preference_scores(cat: Catalog, variance: float = 4.0) -> DataFrame:
    """(item_id, score, sigma): product with the model and its uncertainty sqrt(sum of variance * x squared), for every item with a vector."""
    rows = item_vectors(cat).select("item_id", _unit("v").alias("v")).crossJoin(F.broadcast(profile(cat).limit(1)))  # one row
    return rows.select("item_id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score"), F.round(F.sqrt(variance * dot(F.col("v"), F.col("v"))), 6).alias("sigma"))


def sigmoid(x: Column) -> Column:
    """The logistic function in the form that doesn't overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


@tool()
def pair_probabilities(cat: Catalog) -> DataFrame:
    """For each item and the next one by id: the probability that the first is preferred, the confidence in it, and what asking would tell, 1/2 ln(1 + variance * squared distance)."""
    w = Window.partitionBy(F.floor(F.col("item_id") / 100)).orderBy("item_id")
    rows = item_vectors(cat).select("item_id", _unit("v").alias("v")).join(preference_scores(cat), "item_id")
    pairs = rows.withColumn("other_id", F.lead("item_id").over(w)).withColumn("other", F.lead("score").over(w)).withColumn("u", F.lead("v").over(w)).where("other_id IS NOT NULL")
    p = sigmoid(F.col("score") - F.col("other"))
    d = F.zip_with("v", "u", lambda x, y: x - y)
    return pairs.select("item_id", "other_id", F.round(p, 6).alias("probability"), F.round(F.abs(p - 0.5) * 2, 6).alias("confidence"), F.round(0.5 * F.log1p(4.0 * dot(d, d)), 6).alias("gain"))


@tool()
def preference_convergence(cat: Catalog, comparisons: int = 40) -> DataFrame:
    """Mean uncertainty, the greatest among the 50 best items, confidence in percent, and whether it is enough."""
    scores = preference_scores(cat)
    fifty = top(scores, 50, F.col("score").desc(), "item_id").agg(F.max("sigma").alias("top_sigma"))
    mean = scores.agg(F.avg("sigma").alias("mean_sigma"))
    confidence = F.least(F.greatest((3 - F.col("mean_sigma")) / 2.9, F.lit(0.0)), F.lit(1.0)) * min(1.0, comparisons / 50) * 100
    return mean.crossJoin(F.broadcast(fifty)).select(F.round("mean_sigma", 6).alias("mean_sigma"), "top_sigma", F.round(confidence, 4).alias("confidence"), ((F.col("mean_sigma") < 1.5) & (F.col("top_sigma") < 2.5)).alias("converged"))  # one row


def _uniform(*keys: Column | str, seed: int) -> Column:
    """A number in (0, 1) by a hash of the keys: the same on every run."""
    return (F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


@tool(phase=("broad", "refine", "boundary"))
def preference_pairs(cat: Catalog, phase: str = "boundary", limit: int = 10, seed: int = 42, explore: float = 0.2) -> DataFrame:
    """Pairs to ask about. broad: the members nearest to the centres of two clusters; refine: of the better half, pairs with a similarity of .75 to .95;
    with items whose id is divisible by 10; boundary: those that tell most, of neighbours in a seeded order of all items. A share `explore` of the pairs goes first by a seeded hash alone."""
    rows = item_vectors(cat).select("item_id", _unit("v").alias("v")).join(preference_scores(cat), "item_id")
    if phase == "refine":
        half = rows.agg(F.percentile("score", 0.5).alias("m"))
        rows = rows.crossJoin(F.broadcast(half)).where("score >= m").select("item_id", "v")  # one row
        asked = rows.where(F.col("item_id") % 10 == 0).select(F.col("item_id").alias("other_id"), F.col("v").alias("o"))
        pairs = kernels.scored(rows, ["item_id"], "v", asked, "other_id", "o", kernels.pairs_from(0.75, ordered=False), "item_id long, other_id long, similarity double").where("similarity <= 0.95")
    else:
        if phase == "broad":
            members = given_clusters(cat)
            rows = rows.join(cluster_members_shown(cat, built_clusters(cat, members), members, 1).select("item_id"), "item_id", "left_semi")
        best = rows.withColumn("u", _uniform("item_id", seed=seed))
        # Of the centres there is one row per cluster; all items are taken in 64 parts of the seeded order.
        w = Window.orderBy("u", "item_id") if phase == "broad" else Window.partitionBy(F.floor(F.col("u") * 64)).orderBy("u", "item_id")
        pairs = best.withColumn("other_id", F.lead("item_id").over(w)).withColumn("o", F.lead("v").over(w)).where("other_id IS NOT NULL")
        pairs = pairs.withColumn("similarity", F.round(dot(F.col("v"), F.col("o")), 6))
    pairs = pairs.withColumn("gain", F.round(0.5 * F.log1p(4.0 * (2 - 2 * F.col("similarity"))), 6))
    by_chance = F.when(_uniform("item_id", "other_id", seed=seed + 1) < explore, 1.0).otherwise(0.0)
    return top(pairs.select("item_id", "other_id", "similarity", "gain", by_chance.alias("explored")), limit, F.col("explored").desc(), F.col("gain").desc(), "item_id", "other_id")


@tool(strategy=("clusters", "softmax", "uncertain", "negative", "random"))
def swipe_candidates(cat: Catalog, strategy: str = "softmax", limit: int = 20, seed: int = 42, temperature: float = 0.5) -> DataFrame:
    """Items to show next. clusters: in turn from each; softmax: of the better half with a chance that grows with the score; uncertain: by sigma; negative: the same with a chance that falls; random.
    A chance is drawn by the largest of score / temperature less the log of an exponential number made from a seeded hash, so it is one ordered scan."""
    rows = preference_scores(cat)
    draw = -F.log(-F.log(_uniform("item_id", seed=seed)))
    if strategy == "clusters":
        rows = rows.join(given_clusters(cat).select("item_id", "cluster"), "item_id")
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc(), "item_id")))
        return top(rows.select("item_id", "score", "turn"), limit, "turn", F.col("score").desc(), "item_id").select("item_id", "score")
    if strategy in ("softmax", "negative"):
        if strategy == "softmax":
            half = rows.agg(F.percentile("score", 0.5).alias("m"))
            rows = rows.crossJoin(F.broadcast(half)).where("score >= m")  # one row
        sign = 1 if strategy == "softmax" else -1
        return top(rows.withColumn("draw", sign * F.col("score") / temperature + draw), limit, F.col("draw").desc(), "item_id").select("item_id", "score")
    if strategy == "uncertain":
        return top(rows, limit, F.col("sigma").desc(), "item_id").select("item_id", "score")
    return top(rows.withColumn("u", _uniform("item_id", seed=seed)), limit, "u", "item_id").select("item_id", "score")


def swipe_weights(swipes: DataFrame, action: str, seconds: str, z: str) -> DataFrame:
    """Adds sign, weight and surprise. super like, like, dislike, skip weigh 3, 1, 2, 0; times 1.5 under one second, 1 under 3, .7 under 8, else .5; surprise: sigmoid(1.5 z), for dislikes of -z."""
    base = F.when(F.col(action) == "super", 3.0).when(F.col(action) == "like", 1.0).when(F.col(action) == "dislike", 2.0).otherwise(0.0)
    speed = F.when(F.col(seconds) < 1, 1.5).when(F.col(seconds) < 3, 1.0).when(F.col(seconds) < 8, 0.7).otherwise(0.5)
    sign = F.when(F.col(action).isin("super", "like"), 1).when(F.col(action) == "dislike", -1).otherwise(0)
    return swipes.select("*", sign.alias("sign"), F.round(base * speed, 4).alias("weight"), F.round(sigmoid(-1.5 * sign * F.col(z)), 6).alias("surprise"))


@tool()
def taste_labels(cat: Catalog, k: int = 5) -> DataFrame:
    """The k tags nearest to the profile and the k furthest from it."""
    near = tag_vectors(cat).crossJoin(F.broadcast(profile(cat).limit(1))).select("tag_id", cosine(F.col("v"), F.col("q")).alias("s"))  # one row
    likes = top(near, k, F.col("s").desc(), "tag_id").withColumn("side", F.lit("likes"))
    return likes.unionByName(top(near, k, "s", "tag_id").withColumn("side", F.lit("dislikes")))


@tool()
def for_preferences(cat: Catalog, limit: int = 24) -> DataFrame:
    """Items by the model: the best frame's product with it, else the item's own, scaled over all candidates to 0..1 (0.5 if all are alike)."""
    q = F.broadcast(profile(cat).limit(1))  # one row
    frames = cat.frames.where(F.col("model_key") == "siglip").crossJoin(q).groupBy("item_id").agg(F.max(cosine(F.col("v"), F.col("q"))).alias("f"))
    rows = _unseen(cat, _against(cat, profile(cat)).join(frames, "item_id", "left").select("item_id", F.coalesce("f", "s").alias("s")))
    bounds = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = F.when(F.col("hi") - F.col("lo") < 1e-8, 0.5).otherwise((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return _ranked(rows.crossJoin(F.broadcast(bounds)).select("item_id", scaled.alias("score")), limit)  # one row


def interleaved(lists: DataFrame, source: str, key: str, place: str, weight: str, limit: int) -> DataFrame:
    """Ranked lists merged by weight: the nth of a list of weight w stands at (n - 0.5) / w; a key counts once, where it comes first."""
    turn = F.round((F.col(place) - 0.5) / F.col(weight), 6)
    once = lists.where(F.col(weight) > 0).groupBy(key).agg(F.min(F.struct(turn.alias("turn"), F.col(source).alias("source"))).alias("b"))
    return top(once.select(key, "b.*"), limit, "turn", "source", key)

