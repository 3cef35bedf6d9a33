"""Tools on vectors: searches, coverage of frames by tags, segments and choices of frames, people and clusters.

Vectors are those of one model. A search takes as queries every item whose id is divisible by `every`, against all items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import kernels
from ..operators.frames import deduplicated
from ..operators.taste import blended
from ..operators.vectors import cosine
from ..shared import stored
from .base import tool, top
from .details import scored_items

MODEL = "siglip"


def item_vectors(cat: Catalog, model: str = MODEL) -> DataFrame:
    return cat.vectors.where(F.col("model_key") == model).select("item_id", "v")


def frame_vectors(cat: Catalog, model: str = MODEL) -> DataFrame:
    return cat.frames.where(F.col("model_key") == model).select("item_id", "frame", "seconds", "v")


def tag_vectors(cat: Catalog, least: int = 3) -> DataFrame:
    """(tag_id, items, v): the mean vector of the items of each tag with at least `least` of them; it stands for the vector of the tag's name."""
    rows = cat.item_tags.join(item_vectors(cat), "item_id")
    return kernels.weighted_means(rows, "tag_id", "v").where(F.col("n") >= least).select("tag_id", F.col("n").alias("items"), "v")


def _queries(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


def _first(df: DataFrame, group: str | list[str], k: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_items(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, item_id, similarity, place): the k most similar other items of each query; each batch sends at most k rows a query."""
    near = kernels.scored(vectors, ["item_id"], "v", queries, "query_id", "q", kernels.top_rows(k, least), "query_id long, item_id long, similarity double")
    return _first(near, "query_id", k, F.col("similarity").desc(), "item_id")


@tool()
def similar_items(cat: Catalog, every: int = 100, limit: int = 10, min_similarity: float = 0.5) -> DataFrame:
    """The most similar items of each query item."""
    rows = item_vectors(cat)
    return nearest_items(rows, _queries(rows, every), limit, min_similarity)


@tool()
def similar_without_shared(cat: Catalog, every: int = 100, limit: int = 10, min_similarity: float = 0.5, offset: int = 0) -> DataFrame:
    """The same without items that share a person with the query; these leave before the ranking, and a page of it is taken. has_more: whether the query has further rows."""
    rows = item_vectors(cat)
    people = cat.item_persons.groupBy("item_id").agg(F.collect_list("person_id").alias("persons"))
    rows = rows.join(people, "item_id", "left")
    queries = rows.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"), F.col("persons").alias("own"))
    # Who shares a person is told where the products are made; one row beyond the page says whether there are more.
    near = kernels.scored(rows, ["item_id", "persons"], "v", queries, "query_id", "q", kernels.TopRows(offset + limit + 1, min_similarity, apart=True), "query_id long, item_id long, similarity double", ["own"])
    placed = _first(near, "query_id", offset + limit + 1, F.col("similarity").desc(), "item_id").withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return placed.where(F.col("place").between(offset + 1, offset + limit)).select("query_id", "item_id", "similarity", "place", (F.col("n") > offset + limit).alias("has_more"))


def blended_vectors(cat: Catalog, weight: float = 0.7) -> DataFrame:
    """(item_id, v): visual and metadata vectors (the mean of the item's tag vectors) blended; one alone stands for both."""
    meta = kernels.weighted_means(cat.item_tags.join(tag_vectors(cat).select("tag_id", F.col("v").alias("t")), "tag_id"), "item_id", "t").select("item_id", F.col("v").alias("m"))
    rows = item_vectors(cat).join(meta, "item_id", "full")
    return rows.select("item_id", blended(_unit("v"), F.col("m"), weight).alias("v"))


@tool()
def similar_blended(cat: Catalog, weight: float = 0.7, every: int = 100, limit: int = 10) -> DataFrame:
    """The most similar items by blended vectors, on both sides."""
    rows = blended_vectors(cat, weight)
    return nearest_items(rows, _queries(rows, every), limit, -1.0)


@tool()
def frames_like_items(cat: Catalog, every: int = 100, limit: int = 10, min_similarity: float = 0.3) -> DataFrame:
    """For each query item the items with the most similar frame, its frame and second; the item itself aside."""
    near = kernels.scored(frame_vectors(cat), ["item_id", "frame", "seconds"], "v", _queries(item_vectors(cat), every), "query_id", "q", kernels.TopRows(limit, min_similarity, nth=True), "query_id long, item_id long, frame int, seconds double, similarity double")
    best = near.groupBy("query_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "frame", "seconds")).alias("b"))
    return _first(best.select("query_id", "item_id", "b.frame", "b.seconds", (-F.col("b.s")).alias("similarity")), "query_id", limit, F.col("similarity").desc(), "item_id")


@tool(scoring_mode=("ranked", "threshold", "all"), search_mode=("frame", "scene"))
def visual_filter(cat: Catalog, query_item: int, scoring_mode: str = "ranked", min_similarity: float = 0.3, limit: int = 20, search_mode: str = "frame", item_ids: tuple = ()) -> DataFrame:
    """Items by their best frame (or their own vector) against the vector of one item, which stands for the vector of a text. threshold: only from min_similarity on; all: also items without vectors, with null."""
    rows = frame_vectors(cat) if search_mode == "frame" else item_vectors(cat)
    wanted = cat.items.select(F.col("id").alias("item_id"))
    if item_ids:
        wanted = wanted.where(F.col("item_id").isin(list(item_ids)))
        rows = rows.join(wanted, "item_id", "left_semi")
    q = item_vectors(cat).where(F.col("item_id") == query_item).select(F.col("v").alias("q"))
    best = rows.crossJoin(F.broadcast(q.limit(1))).select("item_id", cosine(F.col("v"), F.col("q")).alias("s")).groupBy("item_id").agg(F.max("s").alias("similarity"))  # one row
    if scoring_mode == "threshold":
        return best.where(F.col("similarity") >= min_similarity)
    if scoring_mode == "all":
        return wanted.join(best, "item_id", "left")
    return top(best, limit, F.col("similarity").desc(), "item_id")


@tool()
def search_text(cat: Catalog, query: str, embedder: str = "default", limit: int = 10, page: int = 1) -> DataFrame:
    """A page of the items most like a text, by the vector that a registered embedder gives it; no threshold. total and has_more tell of further pages."""
    from ..functions.udf import EMBEDDERS
    from .details import page_of

    q = cat.spark.createDataFrame([([float(x) for x in EMBEDDERS[embedder]([query])[0]],)], "q array<double>")
    rows = item_vectors(cat).crossJoin(F.broadcast(q)).select("item_id", cosine(F.col("v"), F.col("q")).alias("similarity"))  # one row
    return page_of(rows.where("similarity IS NOT NULL"), [F.col("similarity").desc(), "item_id"], page, limit)


@tool()
def window_vectors(cat: Catalog, markers: DataFrame | None = None, half: float = 5.0) -> DataFrame:
    """(item_id, at, n, v): the mean vector of the frames in a window round each marker (item_id, at), from at - half on and before at + half, clamped to the item's length.
    Without markers the second of each item's most typical frame. A range join on equal items: only the item's own frames are paired with its markers."""
    frames = frame_vectors(cat)
    if markers is None:
        markers = best_frames(cat).select("item_id", "frame").join(frames.select("item_id", "frame", F.col("seconds").alias("at")), ["item_id", "frame"]).select("item_id", "at")
    spans = markers.join(cat.primary.select("item_id", "duration"), "item_id", "left").select("item_id", "at", F.greatest(F.lit(0.0), F.col("at") - half).alias("lo"), F.least(F.col("at") + half, F.coalesce("duration", F.col("at") + half)).alias("hi"))
    inside = frames.join(spans, "item_id").where((F.col("seconds") >= F.col("lo")) & (F.col("seconds") < F.col("hi")))
    keyed = inside.select(F.concat_ws(":", "item_id", "at").alias("key"), _unit("v").alias("v"))
    return kernels.weighted_means(keyed, "key", "v").select(F.split("key", ":")[0].cast("bigint").alias("item_id"), F.split("key", ":")[1].cast("double").alias("at"), "n", "v")


@tool()
def similarity_drops(cat: Catalog, least: float = 0.2) -> DataFrame:
    """Frames whose similarity to the frame before is at least `least` below the mean of the up to three similarities before that."""
    w = Window.partitionBy("item_id").orderBy("frame")
    f = frame_vectors(cat).withColumn("s", cosine(F.col("v"), F.lag("v").over(w)))
    f = f.withColumn("before", F.round(F.avg("s").over(w.rowsBetween(-3, -1)), 8))
    return f.where(F.round(F.col("before") - F.col("s"), 6) >= least).select("item_id", "frame", F.col("s").alias("similarity"), "before")


@tool()
def best_frames(cat: Catalog) -> DataFrame:
    """Of each item the frame most like the item's vector, with the frame's vector."""
    rows = frame_vectors(cat).join(item_vectors(cat).withColumnRenamed("v", "q"), "item_id").select("item_id", "frame", "v", cosine(F.col("v"), F.col("q")).alias("s"))
    best = rows.groupBy("item_id").agg(F.min_by(F.struct("frame", "v", "s"), F.struct((-F.col("s")).alias("s"), "frame")).alias("b"))
    return best.select("item_id", "b.frame", F.col("b.s").alias("similarity"), F.col("b.v").alias("v"))


@tool()
def frame_at(cat: Catalog, every_seconds: float = 60.0, tolerance: float = 2.0) -> DataFrame:
    """As-of: for each full minute of an item the stored frame whose second is nearest, at most `tolerance` away; ties to the earlier frame."""
    f = frame_vectors(cat)
    # The marks that a frame can be near are the two around it, so no range join is needed.
    mark = F.floor(F.col("seconds") / every_seconds)
    near = f.where("seconds IS NOT NULL").select("item_id", "frame", "seconds", F.explode(F.array(mark, mark + 1)).alias("mark"))
    near = near.withColumn("away", F.round(F.abs(F.col("seconds") - F.col("mark") * every_seconds), 6)).where(F.col("away") <= tolerance)
    best = near.groupBy("item_id", "mark").agg(F.min(F.struct("away", "frame", "seconds")).alias("b"))
    return best.select("item_id", (F.col("mark") * every_seconds).alias("asked"), "b.frame", "b.seconds", "b.away")


@tool()
def similar_frames(cat: Catalog, item_id: int, second: float, min_similarity: float = 0.8, limit: int = 5, exclude_nearby: float = 10.0, tolerance: float = 2.0) -> DataFrame:
    """In one item the frames most like that nearest to a second (at most `tolerance` away), those less than exclude_nearby seconds from it left out."""
    f = frame_vectors(cat).where(F.col("item_id") == item_id)
    away = F.round(F.abs(F.col("seconds") - second), 6)
    ref = f.where(away <= tolerance).orderBy(away, "frame").limit(1).select(F.col("seconds").alias("at"), F.col("v").alias("q"))
    rows = f.crossJoin(F.broadcast(ref)).where(F.abs(F.col("seconds") - F.col("at")) >= exclude_nearby).select("frame", "seconds", cosine(F.col("v"), F.col("q")).alias("similarity"))  # one row
    return top(rows.where(F.col("similarity") >= min_similarity), limit, F.col("similarity").desc(), "frame")


@tool()
def frame_second(cat: Catalog, item_id: int, nth: int) -> DataFrame:
    """The nth frame (from 1) of an item in order, and its second."""
    f = frame_vectors(cat).where(F.col("item_id") == item_id)
    return f.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("frame"))).where(F.col("place") == nth).select("frame", "seconds")


@tool()
def content_events(cat: Catalog, phrases: tuple = (0, 1, 2), threshold: float = 0.3, gap: float = 30.0, limit: int = 5) -> DataFrame:
    """Stretches of frames that reach the threshold for any phrase (tag vectors stand for phrases), at most `gap` seconds apart; the `limit` best of each item by peak."""
    side = tag_vectors(cat).where(F.col("tag_id").isin(list(phrases))).select("tag_id", "v")
    hit = kernels.scored(frame_vectors(cat), ["item_id", "frame", "seconds"], "v", side, "tag_id", "v", kernels.best, "item_id long, frame int, seconds double, tag_id long, s double")
    hit = hit.groupBy("item_id", "frame", "seconds").agg(F.max("s").alias("s")).where((F.col("s") >= threshold) & F.col("seconds").isNotNull())
    w = Window.partitionBy("item_id").orderBy("seconds", "frame")
    new = F.when(F.col("seconds") - F.lag("seconds").over(w) <= gap, 0).otherwise(1)
    numbered = hit.withColumn("new", new).withColumn("event", F.sum("new").over(w))
    events = numbered.groupBy("item_id", "event").agg(F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.count("*").alias("frames"), F.max("s").alias("peak"))
    return _first(events, "item_id", limit, F.col("peak").desc(), "start").select("item_id", "start", "end", "frames", "peak")


# ---- frames of an item in order


@tool()
def segments_of(cat: Catalog, boundary: float = 0.8, least_seconds: float = 30.0) -> DataFrame:
    """Segments of an item's frames: a new one begins where the similarity to the frame before is below `boundary`. Segments shorter than
    least_seconds are dropped, but for the first. score: the segment's mean vector against the first frame of the next boundary, 0 for the last."""
    f = frame_vectors(cat)
    w = Window.partitionBy("item_id").orderBy("frame")
    f = f.withColumn("s", cosine(F.col("v"), F.lag("v").over(w)))
    f = f.withColumn("segment", F.sum(F.when(F.col("s") >= boundary, 0).otherwise(1)).over(w))
    parts = f.groupBy("item_id", "segment").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.min_by("v", "frame").alias("head"))
    means = kernels.weighted_means(f.select(F.concat_ws(":", "item_id", "segment").alias("key"), _unit("v").alias("v")), "key", "v")
    means = means.select(F.split("key", ":")[0].cast("bigint").alias("item_id"), F.split("key", ":")[1].cast("bigint").alias("segment"), F.col("v").alias("mean"))
    parts = parts.withColumn("next", F.lead("head").over(Window.partitionBy("item_id").orderBy("segment"))).withColumn("all", F.sum("n").over(Window.partitionBy("item_id")))
    parts = parts.where("all >= 2").join(means, ["item_id", "segment"]).where(((F.col("end") - F.col("start")) >= least_seconds) | (F.col("segment") == 1))
    return parts.select("item_id", F.col("segment").cast("bigint").alias("segment"), "first", "last", "n", F.coalesce(cosine(F.col("mean"), F.col("next")), F.lit(0.0)).alias("score"))


def _unit(name: str) -> Column:
    v = F.col(name)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # The length stands in an array, so it is computed once and not for each coordinate.
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x.cast("double") / n)


def novelty_of(x: np.ndarray, windows: tuple = (2, 15, 60), weights: tuple = (0.0, 1.0, 1.0)) -> np.ndarray:
    """Of each row of unit vectors: (1 - mean similarity to the up to w rows on each side) * min(1, their number / 2w), a weighted mean over the windows; all weights 0 count alike.

    The mean of the products is one product with the sum of the neighbours, taken from a running sum.
    """
    w = np.array(weights, dtype=float)
    w = np.ones(len(windows)) if w.sum() == 0 else w
    total, n = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)]), len(x)
    out = np.zeros(n)
    at = np.arange(n)
    for width, weight in zip(windows, w / w.sum()):
        lo, hi = np.maximum(at - width, 0), np.minimum(at + width + 1, n)
        count = hi - lo - 1
        near = np.einsum("ij,ij->i", x, total[hi] - total[lo] - x) / np.maximum(count, 1)
        out += weight * np.where(count > 0, (1 - near) * np.minimum(1, count / (2 * width)), 0)
    return out


def _frames(columns: dict, width: int = 40) -> np.ndarray:
    return kernels.unit_rows(columns["v"], width)[1]


@tool()
def novelty(cat: Catalog, windows: tuple = (2, 15, 60), weights: tuple = (0.0, 1.0, 1.0)) -> DataFrame:
    """The novelty of each frame over several windows; one pass over the frames in order that holds as many neighbours as the widest window."""
    run = lambda c, begin, end: [pa.array(np.round(novelty_of(_frames(c), windows, weights)[begin:end], 6) + 0.0)]
    return kernels.sliding(frame_vectors(cat), "item_id", "frame", ["v"], max(windows), run, "novelty double")


def chosen_frames(x: np.ndarray, seconds: np.ndarray, most: int, close: float = 0.9) -> np.ndarray:
    """Places of up to `most` frames: half of them evenly in time, the rest from four quarters by novelty (remainders to the later ones), none with a similarity above `close` to one taken before."""
    n = len(x)
    if n <= most:
        return np.arange(n)
    even = np.unique(np.round(np.linspace(0, n - 1, max(1, most // 2))).astype(int)).tolist()
    taken = even[:]
    value, left = novelty_of(x), most - len(taken)
    quota = [left // 4 + (1 if q >= 4 - left % 4 else 0) for q in range(4)]
    for q in range(4):
        own = np.arange(q * n // 4, (q + 1) * n // 4)
        for i in own[np.lexsort((own, -value[own]))]:
            if quota[q] == 0:
                break
            if i not in taken and (x[taken] @ x[i]).max() <= close:
                taken.append(int(i))
                quota[q] -= 1
    return np.array(sorted(taken))


@tool()
def smart_frames(cat: Catalog, most: int = 16) -> DataFrame:
    """Up to `most` frames of each item, spread in time and by novelty (see chosen_frames)."""

    def run(_, c):
        at = chosen_frames(_frames(c), c["seconds"].to_numpy(zero_copy_only=False), most)
        return [c["frame"].take(pa.array(at)), c["seconds"].take(pa.array(at))]

    return kernels.per_entity(frame_vectors(cat), "item_id", ["frame"], ["seconds", "v"], run, "frame int, seconds double")


def _runs(x: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of like rows: their first rows, centres of length one, and the greatest angle of a row to the centre."""
    new = np.append(True, np.einsum("ij,ij->i", x[1:], x[:-1]) < 0.98)
    first = np.flatnonzero(new)
    new |= (np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))) % most == 0
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(x)))
        centre = np.add.reduceat(x, first)
        centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-300)[:, None]
        angle = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(centre, size, axis=0)), first), -1, 1)) + 1e-6
        wide = (angle > 0.2) & (size > 1)
        if not wide.any():
            return first, centre, angle
        new[(first + size // 2)[wide]] = True


def _reached(x: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """How many of `others` each row of x is at least so similar to (six decimals).

    Stretches of like rows are compared by their centres first: two stretches of which no rows can be so similar are
    passed over, two of which all rows are count as a whole, and only the rows of others are compared.
    """
    out = np.zeros(len(x), dtype=np.int64)
    if not len(x) or not len(others):
        return out
    far = np.arccos(np.clip(least - 1e-6, -1, 1))
    dense = lambda a, b: np.round(a @ b.T, 6) >= least
    if far > 1.7 or len(x) * len(others) < 250_000:  # nothing to pass over, or not worth it
        step = max(1, 4_000_000 // len(others))
        for s in range(0, len(x), step):
            out[s : s + step] = dense(x[s : s + step], others).sum(axis=1)
        return out
    (fa, ca, ra), (fb, cb, rb) = _runs(x), _runs(others)
    na, nb = np.diff(np.append(fa, len(x))), np.diff(np.append(fb, len(others)))
    # cos(far + ra + rb) is the sum of two products, so one product of matrices tells which centres are near enough.
    wide_a = np.hstack([ca, -np.cos(far + ra)[:, None], np.sin(far + ra)[:, None]]).astype(np.float32)
    wide_b = np.hstack([cb, np.cos(rb)[:, None], np.sin(rb)[:, None]]).astype(np.float32)
    for s in range(0, len(fa), 512):
        for t in range(0, len(fb), 2048):
            p, q = np.divmod(np.flatnonzero(wide_a[s : s + 512] @ wide_b[t : t + 2048].T >= -1e-4), len(wide_b[t : t + 2048]))
            p, q = p + s, q + t
            whole = np.empty(len(p), dtype=bool)
            for i in range(0, len(p), 100_000):
                e = slice(i, i + 100_000)
                whole[e] = np.arccos(np.clip(np.einsum("ij,ij->i", ca[p[e]], cb[q[e]]), -1, 1)) + ra[p[e]] + rb[q[e]] <= far - 1e-5
            sure = np.bincount(p[whole] - s, weights=nb[q[whole]], minlength=len(fa[s : s + 512])).astype(np.int64)
            a0, a1 = fa[s], fa[s + 512] if s + 512 < len(fa) else len(x)
            out[a0:a1] += np.repeat(sure, na[s : s + 512])
            p, q = p[~whole], q[~whole]
            b0, b1 = fb[t], fb[t + 2048] if t + 2048 < len(fb) else len(others)
            pairs = na[p] * nb[q]
            if pairs.sum() > 0.04 * (a1 - a0) * (b1 - b0):
                open_ = np.zeros((len(fa[s : s + 512]), len(fb[t : t + 2048])), dtype=bool)
                open_[p - s, q - t] = True
                step, of_a = max(1, 1_000_000 // (b1 - b0)), np.repeat(np.arange(len(open_)), na[s : s + 512])
                for i in range(a0, a1, step):
                    hit = dense(x[i : min(i + step, a1)], others[b0:b1]) & np.repeat(open_[of_a[i - a0 : i - a0 + step]], nb[t : t + 2048], axis=1)
                    out[i : i + len(hit)] += hit.sum(axis=1)
                continue
            cut = np.flatnonzero(np.diff(np.cumsum(pairs) // 100_000, prepend=-1)) if len(p) else []
            for i, j in zip(cut, [*cut[1:], len(p)]):
                at = np.repeat(np.arange(i, j), pairs[i:j])
                nth = np.arange(len(at)) - np.repeat(np.cumsum(pairs[i:j]) - pairs[i:j], pairs[i:j])
                r, c = fa[p[at]] + nth // nb[q[at]], fb[q[at]] + nth % nb[q[at]]
                hit = r[np.round(np.einsum("ij,ij->i", x[r], others[c]), 6) >= least]
                out[a0:a1] += np.bincount(hit - a0, minlength=a1 - a0)
    return out


def spread_frames(x: np.ndarray, k: int, method: str, radius: float = 0.2) -> np.ndarray:
    """Places of k representatives: "maximin" starts nearest to the centre and takes what is furthest from all taken; "coverage" takes what has the most uncovered rows within 1 - radius.
    No matrix of all pairs is held or made: maximin needs one row a step, coverage counts by stretches of like rows and takes off what each step covers."""
    k, taken = min(k, len(x)), []
    if method == "maximin":
        near = np.full(len(x), -2.0)
        at = int(np.argmax(np.round(x @ x.mean(axis=0), 6)))
        while True:
            taken.append(at)
            if len(taken) == k:
                return np.array(taken)
            near = np.maximum(near, np.round(x @ x[at], 6))
            near[taken] = 2
            at = int(np.argmin(near))
    open_, n = np.ones(len(x), dtype=bool), _reached(x, x, 1 - radius)
    while len(taken) < k and open_.any():
        at = int(np.argmax(n))
        taken.append(at)
        fresh = open_ & (np.round(x @ x[at], 6) >= 1 - radius)
        open_ &= ~fresh
        if len(taken) < k and open_.any():
            n = n - _reached(x, x[fresh], 1 - radius) if fresh.sum() <= open_.sum() else _reached(x, x[open_], 1 - radius)
    return np.array(taken)


@tool(method=("maximin", "coverage"))
def representative_frames(cat: Catalog, k: int = 8, method: str = "maximin", radius: float = 0.2) -> DataFrame:
    """Representatives of each item with three measures and their sum by .4, .35 and .25: diversity (1 - mean similarity), spread in time (1 - variation of the gaps), share of frames within 1 - radius of one."""

    def run(_, c):
        x, seconds = _frames(c), c["seconds"].to_numpy(zero_copy_only=False)
        at = np.sort(spread_frames(x, k, method, radius))
        s, m = x[at] @ x.T, len(at)
        diverse = 1 - ((s[:, at].sum() - m) / (m * (m - 1)) if m > 1 else 1.0)
        gaps = np.diff(seconds[at])
        spread = max(0.0, 1 - gaps.std() / gaps.mean()) if len(gaps) > 1 and gaps.mean() > 0 else 0.0
        covered = float((s.max(axis=0) >= 1 - radius).mean())
        scores = np.round([diverse, spread, covered, 0.4 * diverse + 0.35 * spread + 0.25 * covered], 6) + 0.0
        return [c["frame"].take(pa.array(at)), *[pa.array(np.full(m, v)) for v in scores]]

    return kernels.per_entity(frame_vectors(cat), "item_id", ["frame"], ["seconds", "v"], run, "frame int, diversity double, spread double, coverage double, score double")


@tool()
def modulo_frames(cat: Catalog, k: int = 16) -> DataFrame:
    """About k representatives of each item by one step for all: the frames whose number is divisible by max(1, floor(mean number of frames / k))."""
    f = frame_vectors(cat).select("item_id", "frame")
    step = f.agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.nullif(F.count_distinct("item_id"), F.lit(0)) / k)).alias("step"))
    return f.crossJoin(F.broadcast(step)).where("frame % step = 0").select("item_id", "frame")  # one row


@tool()
def frames_apart(cat: Catalog, most: float = 0.99, keep_first: int = 10) -> DataFrame:
    """Drops a frame that is as similar as `most` to the last one kept; the first keep_first frames stay."""
    return deduplicated(frame_vectors(cat), "item_id", "frame", "v", most, keep_first)


@tool()
def similarity_matrix(cat: Catalog, item_id: int) -> DataFrame:
    """Similarities of all frames of one item, the lower half and the diagonal."""
    f = frame_vectors(cat).where(F.col("item_id") == item_id).select("frame", "v")

    def half(keys, s, labels):
        r, c = np.nonzero(keys[0].to_numpy()[:, None] >= labels.to_numpy()[None, :])
        return [keys[0].take(pa.array(r)), labels.take(pa.array(c)), pa.array(s[r, c])]

    return kernels.scored(f, ["frame"], "v", f.select(F.col("frame").alias("b"), F.col("v").alias("w")), "b", "w", half, "a int, b int, similarity double")


@tool()
def near_duplicate_tags(cat: Catalog, least: float = 0.9, dismissed: tuple = ()) -> DataFrame:
    """Pairs of tags with near vectors, less the dismissed pairs of names (in either order, case aside); keep: the one with more items, of equal ones the first."""
    rows = tag_vectors(cat).select("tag_id", "items", "v")
    pairs = kernels.scored(rows, ["tag_id"], "v", rows.select(F.col("tag_id").alias("other_id"), F.col("v").alias("w")), "other_id", "w", kernels.pairs_from(least), "tag_id long, other_id long, similarity double")
    name = cat.tags.select(F.col("id"), F.lower(F.trim("name")).alias("low"))
    count = cat.item_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("n"))
    info = name.join(count, "id")
    full = pairs.join(info.select(F.col("id").alias("tag_id"), F.col("low").alias("la"), F.col("n").alias("na")), "tag_id").join(info.select(F.col("id").alias("other_id"), F.col("low").alias("lb"), F.col("n").alias("nb")), "other_id")
    if dismissed:
        gone = ["\x00".join(sorted(x.strip().lower() for x in pair)) for pair in dismissed]
        full = full.where(~F.concat(F.least("la", "lb"), F.lit("\x00"), F.greatest("la", "lb")).isin(gone))
    return full.select("tag_id", "other_id", "similarity", F.when(F.col("nb") > F.col("na"), F.col("other_id")).otherwise(F.col("tag_id")).alias("keep_id"))


# ---- coverage of frames by tags


def _best(cat: Catalog, vectors: bool = False) -> DataFrame:
    """(item_id, frame, tag_id, similarity), with vectors also v."""
    side = stored(tag_vectors(cat).select("tag_id", F.col("v").alias("tv")), "tag_vectors")
    more, kind = (["v"], ", v array<float>") if vectors else ([], "")
    # More than one lot of labels gives a row for each.
    one = lambda rows: rows.groupBy("item_id", "frame").agg(F.min_by(F.struct("s", "tag_id", *more), F.struct(-F.col("s"), F.col("tag_id"))).alias("b")).select("item_id", "frame", "b.*")
    rows = kernels.scored(frame_vectors(cat), ["item_id", "frame", *more], "v", side, "tag_id", "tv", kernels.TopLabels(), f"item_id long, frame int{kind}, tag_id long, s double", merge=one)
    return rows.select("item_id", "frame", "tag_id", F.col("s").alias("similarity"), *more)


def _covered(cat: Catalog, share: float, vectors: bool = False) -> DataFrame:
    """(item_id, frame, tag_id, similarity, covered), with vectors also v. The products with all tags are made once: the threshold and what reads the rows then read them from a table."""
    best = stored(_best(cat, vectors), "best_tags")
    return best.crossJoin(F.broadcast(_threshold(best, share))).select(*best.columns, (F.col("similarity") >= F.col("threshold")).alias("covered"))  # one row


def _threshold(best: DataFrame, share: float) -> DataFrame:
    return best.agg(F.round(F.percentile("similarity", share), 6).alias("threshold"))


@tool()
def best_tags(cat: Catalog, share: float = 0.05) -> DataFrame:
    """The most similar tag of every frame of every item, and whether it reaches the threshold: the percentile of all best similarities."""
    return _covered(cat, share)


@tool()
def coverage_threshold_of(cat: Catalog, share: float = 0.05) -> DataFrame:
    """The similarity that all but a share of the frames' best tags reach."""
    return _threshold(_best(cat), share)


@tool()
def coverage_report(cat: Catalog, share: float = 0.05, flag_below: float = 0.75, labels: int = 5) -> DataFrame:
    """Of each item: frames, uncovered ones, covered share, whether it is flagged, and the tags that are nearest to its uncovered frames with number and mean similarity."""
    best = best_tags(cat, share=share)
    each = best.groupBy("item_id").agg(F.count("*").alias("frames"), F.count_if(~F.col("covered")).alias("uncovered"))
    weak = best.where(~F.col("covered")).groupBy("item_id", "tag_id").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 4).alias("mean"))
    five = _first(weak, "item_id", labels, F.col("n").desc(), "tag_id").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "tag_id", "n").alias("t")))), lambda x: x["t"]), " ").alias("nearest"))
    ratio = F.round(1 - F.col("uncovered") / F.col("frames"), 6)
    return each.join(five, "item_id", "left").select("item_id", "frames", "uncovered", ratio.alias("ratio"), (ratio < flag_below).alias("flagged"), F.coalesce("nearest", F.lit("")).alias("nearest"))


@tool()
def gap_detail(cat: Catalog, item_id: int, threshold: float = 0.6, limit: int = 10) -> DataFrame:
    """The tags nearest to the uncovered frames of one item that it doesn't have: number of frames, mean similarity, whether tags of the item cover as much."""
    f = frame_vectors(cat).where(F.col("item_id") == item_id)
    side = tag_vectors(cat).select("tag_id", F.col("v").alias("tv"))
    own = cat.item_tags.where(F.col("item_id") == item_id).select("tag_id")
    by_own = kernels.scored(f, ["item_id", "frame"], "v", side.join(own, "tag_id", "left_semi"), "tag_id", "tv", kernels.best, "item_id long, frame int, tag_id long, s double")
    covered = by_own.groupBy("frame").agg(F.max("s").alias("s")).where(F.col("s") >= threshold).select("frame")
    open_frames = f.join(covered, "frame", "left_anti")
    hits = kernels.scored(open_frames, ["item_id"], "v", side.join(own, "tag_id", "left_anti"), "tag_id", "tv", kernels.hits_per_label(threshold), "tag_id long, n long, best double, total double")
    each = hits.groupBy("tag_id").agg(F.sum("n").alias("frames"), F.max("best").alias("best"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))
    return top(each, limit, F.col("frames").desc(), "tag_id")


@tool()
def what_if_tag(cat: Catalog, tag_id: int, share: float = 0.05, least: float = 0.3) -> DataFrame:
    """What a tag would add: the uncovered frames it reaches, the new share of covered frames, mean and greatest similarity."""
    best = _covered(cat, share, vectors=True)
    counts = best.agg(F.count("*").alias("frames"), F.count_if("covered").alias("covered"))
    q = tag_vectors(cat).where(F.col("tag_id") == tag_id).select(F.col("v").alias("q")).limit(1)
    left = best.where(~F.col("covered")).select("v").crossJoin(F.broadcast(q))  # one row
    hit = left.select(cosine(F.col("v"), F.col("q")).alias("s")).where(F.col("s") >= least).agg(F.count("*").alias("gained"), F.round(F.avg("s"), 6).alias("mean"), F.max("s").alias("best"))
    return hit.crossJoin(F.broadcast(counts)).select("gained", "mean", "best", F.round((F.col("covered") + F.col("gained")) / F.nullif(F.col("frames"), F.lit(0)), 6).alias("ratio"))  # one row


@tool()
def similar_uncovered(cat: Catalog, query_item: int, share: float = 0.05, least: float = 0.3, limit: int = 10) -> DataFrame:
    """Items whose uncovered frames' mean vector is like the item's vector that is asked for."""
    left = _covered(cat, share, vectors=True).where(~F.col("covered"))
    means = kernels.weighted_means(left.select("item_id", _unit("v").alias("v")), "item_id", "v")
    q = item_vectors(cat).where(F.col("item_id") == query_item).select(F.col("v").alias("q")).limit(1)
    near = means.crossJoin(F.broadcast(q)).select("item_id", F.col("n").alias("frames"), cosine(F.col("v"), F.col("q")).alias("similarity"))  # one row
    return top(near.where((F.col("similarity") >= least) & (F.col("item_id") != query_item)), limit, F.col("similarity").desc(), "item_id")


@tool()
def vote_tags(cat: Catalog, item_id: int, least: float = 0.3, limit: int = 20, dismissed: tuple = (), evidence: int = 5) -> DataFrame:
    """Tags that frames of an item vote for (similarity of at least `least`), without those it has and the dismissed ones, with the best frames as evidence."""
    f = frame_vectors(cat).where(F.col("item_id") == item_id)
    own = cat.item_tags.where(F.col("item_id") == item_id).select("tag_id")
    side = tag_vectors(cat).where(~F.col("tag_id").isin(list(dismissed))).join(own, "tag_id", "left_anti").select("tag_id", F.col("v").alias("tv"))
    hits = kernels.scored(f, ["item_id"], "v", side, "tag_id", "tv", kernels.hits_per_label(least), "tag_id long, n long, best double, total double")
    each = top(hits.groupBy("tag_id").agg(F.sum("n").alias("frames"), F.max("best").alias("best"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean")), limit, F.col("frames").desc(), F.col("best").desc(), "tag_id")
    seen = kernels.scored(f, ["frame"], "v", side, "tag_id", "tv", kernels.top_rows(evidence, least, itself=True), "tag_id long, frame int, s double")
    seen = _first(seen, "tag_id", evidence, F.col("s").desc(), "frame").groupBy("tag_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "frame"))), lambda x: x["frame"].cast("string")), ",").alias("evidence"))
    return each.join(seen, "tag_id")


@tool()
def tag_votes_all(cat: Catalog, least: float = 0.3, limit: int | None = None) -> DataFrame:
    """The votes of all frames of all items for every tag."""
    side = tag_vectors(cat).select("tag_id", F.col("v").alias("tv"))
    hits = kernels.scored(frame_vectors(cat), ["item_id"], "v", side, "tag_id", "tv", kernels.hits_per_label(least), "tag_id long, n long, best double, total double")
    each = hits.groupBy("tag_id").agg(F.sum("n").alias("frames"), F.max("best").alias("best"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))
    return top(each, limit, F.col("frames").desc(), "tag_id")


@tool()
def uncertain_frames(cat: Catalog, low: float = 0.25, high: float = 0.35, limit: int = 50, done_items: tuple = ()) -> DataFrame:
    """The frames with the most tags of a similarity from low to high, of items that aren't done."""
    f = frame_vectors(cat)
    f = f.where(~F.col("item_id").isin(list(done_items))) if done_items else f
    side = tag_vectors(cat).select("tag_id", F.col("v").alias("tv"))
    rows = kernels.scored(f, ["item_id", "frame"], "v", side, "tag_id", "tv", kernels.labels_between(low, high), "item_id long, frame int, n long")
    return top(rows.groupBy("item_id", "frame").agg(F.sum("n").alias("n")), limit, F.col("n").desc(), "item_id", "frame")


# ---- people


def person_vectors(cat: Catalog, most: int = 50, least: int = 2) -> DataFrame:
    """(person_id, n, v): the mean vector of a person's up to `most` highest scored items, weighted by score (1 without one); people with at least `least` such items."""
    rows = cat.item_persons.join(item_vectors(cat), "item_id").join(scored_items(cat), "item_id", "left").withColumn("w", F.coalesce("score", F.lit(1.0)))
    rows = _first(rows.withColumn("w", F.round("w", 6)), "person_id", most, F.col("w").desc(), "item_id")
    return kernels.weighted_means(rows, "person_id", "v", F.col("w")).where(F.col("n") >= least)


@tool()
def similar_persons(cat: Catalog, limit: int = 5, min_similarity: float = 0.5) -> DataFrame:
    """The people most like each person by their vectors."""
    p = stored(person_vectors(cat), "person_vectors")
    near = kernels.scored(p.select(F.col("person_id").alias("query_id"), F.col("v").alias("q")), ["query_id"], "q", p, "person_id", "v", kernels.TopLabels(limit, min_similarity, itself=False), "query_id long, person_id long, similarity double")
    return _first(near, "query_id", limit, F.col("similarity").desc(), "person_id")


def favourites_vector(cat: Catalog, most: int = 5) -> DataFrame:
    """One row (q): the mean vector of the favourite people, the `most` with the highest total scores, weighted by them; alike if all are 0; no row without favourites."""
    total = cat.item_persons.join(scored_items(cat), "item_id").groupBy("person_id").agg(F.sum("score").alias("score"))
    loved = cat.persons.where("favorite").select(F.col("id").alias("person_id")).join(total, "person_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    best = top(loved.join(person_vectors(cat), "person_id"), most, F.col("score").desc(), "person_id")
    weighed = best.crossJoin(F.broadcast(best.agg(F.sum("score").alias("all")))).withColumn("w", F.when(F.col("all") > 0, F.col("score")).otherwise(1.0))  # one row
    return kernels.weighted_means(weighed.withColumn("one", F.lit(1).cast("bigint")), "one", "v", F.col("w")).select(F.col("v").alias("q"))


# ---- evaluation


class _BothWays:
    """Sums over the similarities of all pairs of a row and a label: one of each row (way 0), one of each label (way 1) when the task ends. part(s, ids, names, keys, more) gives the matrix of what is summed for rows, and that for labels."""

    def __init__(self, part):
        self.part = part

    def begin(self, labels: pa.Array, t: np.ndarray, more: list) -> _BothWays:
        new = _BothWays(self.part)
        new.labels, new.names, new.t, new.total = labels, labels.to_numpy(zero_copy_only=False), t, 0
        new.more = [m.to_numpy(zero_copy_only=False) for m in more]
        new.rows = max(1, kernels.CELLS // len(t))
        return new

    def add(self, keys: list[pa.Array], x: np.ndarray) -> list:
        known, sums = [k.to_numpy(zero_copy_only=False) for k in keys], []
        for i in range(0, len(x), self.rows):
            e = slice(i, i + self.rows)
            across, down = self.part(np.round(x[e] @ self.t.T, 6), known[0][e], self.names, [k[e] for k in known[1:]], self.more)
            sums.append(across.sum(axis=1))
            self.total = self.total + down.sum(axis=0)
        return [keys[0], pa.array(np.concatenate(sums).astype(np.float64)), pa.array(np.zeros(len(x), dtype=np.int32))]

    def end(self) -> list | None:
        if np.isscalar(self.total):
            return None
        return [self.labels, pa.array(self.total.astype(np.float64)), pa.array(np.ones(len(self.labels), dtype=np.int32))]


def retrieval_metrics(pairs: DataFrame, key: str, image: str, text: str, ks: tuple = (1, 5, 10)) -> DataFrame:
    """(k, image_to_text, text_to_image): the share of rows whose own counterpart is among the k most similar, both ways; k beyond the number of rows are left out.

    The rank of a row is one more than the counterparts that are more similar, counted inside the products of matrices; one pass counts both ways.
    """

    def above(s, ids, names, keys, more):
        s[ids[:, None] == names[None, :]] = -9
        return s > keys[0][:, None], s > more[0][None, :]

    own = stored(pairs.select(F.col(key).alias("id"), F.col(image).alias("i"), F.col(text).alias("t"), cosine(F.col(image), F.col(text)).alias("own")), "pairs")
    n = own.agg(F.count("*").alias("n"))
    side = own.select(F.col("id").alias("other"), F.col("t").alias("w"), F.col("own").alias("theirs"))
    rows = kernels.scored(own, ["id", "own"], "i", side, "other", "w", _BothWays(above), "id long, above double, way int", ["theirs"])
    ranks = rows.groupBy("id", "way").agg((F.sum("above") + 1).alias("rank"))
    hit = lambda way: F.count_if((F.col("way") == way) & (F.col("rank") <= F.col("k")))
    out = ranks.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank", "way").groupBy("k").agg(hit(0).alias("image_to_text"), hit(1).alias("text_to_image"))
    return out.crossJoin(F.broadcast(n)).where(F.col("k") <= F.col("n")).select("k", F.round(F.col("image_to_text") / F.col("n"), 6).alias("image_to_text"), F.round(F.col("text_to_image") / F.col("n"), 6).alias("text_to_image"))  # one row


def contrastive_loss(pairs: DataFrame, key: str, image: str, text: str, scale: float = 100.0) -> DataFrame:
    """(loss): the symmetric cross entropy of the scaled similarities, each row against all counterparts both ways; sums of exponentials are taken inside the products, both ways in one pass."""

    def powers(s, ids, names, keys, more):
        e = np.exp(scale * (s - 1))
        return e, e

    own = stored(pairs.select(F.col(key).alias("id"), F.col(image).alias("i"), F.col(text).alias("t"), cosine(F.col(image), F.col(text)).alias("own")), "pairs")
    rows = kernels.scored(own, ["id"], "i", own.select(F.col("id").alias("other"), F.col("t").alias("w")), "other", "w", _BothWays(powers), "id long, s double, way int")
    sums = rows.groupBy("id").agg(F.sum(F.when(F.col("way") == 0, F.col("s"))).alias("si"), F.sum(F.when(F.col("way") == 1, F.col("s"))).alias("st"))
    each = (F.log("si") + F.log("st")) / 2 + scale - scale * F.col("own")
    return own.select("id", "own").join(sums, "id").agg(F.round(F.avg(each), 6).alias("loss"))
