"""Operators on ordered vectors and on labels of vectors (frames, tags, coverage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import consecutive


def segments(df: DataFrame, entity: list[str], position: str, vector: str, boundary: float, least: int = 1) -> DataFrame:
    """entity, segment, first, last, n: a new segment begins where the similarity to the frame before is below `boundary`.

    Segments of fewer than `least` frames are dropped, except the first of an entity.
    """
    w = Window.partitionBy(*entity).orderBy(position)
    start = F.when(F.col("similarity") >= boundary, 0).otherwise(1)
    numbered = consecutive(df, entity, position, vector).withColumn("segment", F.sum(start).over(w))
    out = numbered.groupBy(*entity, "segment").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) | (F.col("segment") == 1))


def novelty(df: DataFrame, entity: str, position: str, vector: str, width: int) -> DataFrame:
    """(1 - mean similarity to the up to width frames on each side) * min(1, their number / (2 * width)); 0 for a frame alone. Null, empty and zero vectors are left out; the others must have one length."""
    import numpy as np
    import pyarrow as pa

    from ..tools.similar import novelty_of
    from .kernels import sliding, unit_rows

    def run(c, begin, end):
        x = unit_rows(c[vector], len(c[vector][0]))[1]
        return [pa.array(np.round(novelty_of(x, (width,), (1.0,))[begin:end], 6) + 0.0)]

    return sliding(df.where((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0)), entity, position, [vector], width, run, "novelty double")


def best_per_group(scored: DataFrame, group: str, key: str, score: Column, k: int) -> DataFrame:
    """The best row of each group by score, ties by key, and of these the first k groups."""
    best = scored.groupBy(group).agg(F.min(F.struct((-score).alias("s"), F.col(key).alias("k"))).alias("o"))
    return best.select(group, F.col("o.k").alias(key), (-F.col("o.s")).alias("score")).orderBy(F.col("score").desc(), group).limit(k)


def sessions(df: DataFrame, entity: str, seconds: str, gap: float, score: str) -> DataFrame:
    """Detections not more than `gap` seconds apart as one event: entity, start, end, n, peak."""
    w = Window.partitionBy(entity).orderBy(seconds)
    new = F.when(F.col(seconds) - F.lag(seconds).over(w) <= gap, 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("_event", F.sum("_new").over(w))
    return numbered.groupBy(entity, "_event").agg(F.min(seconds).alias("start"), F.max(seconds).alias("end"), F.count("*").alias("n"), F.max(score).alias("peak")).drop("_event")


def deduplicated(df: DataFrame, entity: str, position: str, vector: str, most: float, keep_first: int) -> DataFrame:
    """(entity, position): drops a frame that is as similar as `most` to the last one kept; the first keep_first frames of an entity stay.

    One pass over sorted rows that holds the last kept frame only, however long an
    entity is; the next frame to keep is looked for in a product with many rows at a time. Null, zero and ill-sized vectors are dropped.
    """
    import numpy as np
    import pyarrow as pa

    from .kernels import unit_rows

    rows = df.select(entity, position, vector).where((F.size(vector) > 0) & F.col(entity).isNotNull())

    def keep(batches):
        owner, n, last = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            good, x = unit_rows(b.column(vector), len(b.column(vector)[0]) if last is None else len(last))
            names = b.column(entity).take(pa.array(good, pa.int64())).dictionary_encode()
            at = names.indices.to_numpy()
            kept = []
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            for s, e in zip(starts, [*starts[1:], len(at)]):
                name = names.dictionary[int(at[s])].as_py()
                if name != owner:
                    owner, n, last = name, 0, None
                i = int(s)
                while i < e:
                    if n < keep_first or last is None:
                        kept.append(i)
                        last, n, i = x[i], n + 1, i + 1
                        continue
                    near = np.round(x[i : min(e, i + 512)] @ last, 6)
                    far = np.flatnonzero(near < most)
                    step = int(far[0]) if len(far) else len(near)
                    n, i = n + step, i + step
                    if len(far):
                        kept.append(i)
                        last, n, i = x[i], n + 1, i + 1
            yield b.select([entity, position]).take(pa.array(good[kept], pa.int64()))

    ordered = rows.repartition(entity).sortWithinPartitions(entity, position)
    return ordered.mapInArrow(keep, rows.select(entity, position).schema)
