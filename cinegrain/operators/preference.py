"""Preference learning from comparisons: warm start, scores, ordered updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(mean, var, d, noise: float = 1.0, weight: float = 1.0):
    """One Bradley-Terry update by a difference of vectors: the precision grows by p (1 - p) d squared, the mean moves along d and is scaled to length one."""
    import numpy as np

    p = 1 / (1 + np.exp(-np.clip(mean @ d, -50, 50)))
    var = 1 / (1 / var + p * (1 - p) * d * d / noise * weight)
    mean = mean + var * (1 - p) * weight / noise * d
    length = np.linalg.norm(mean)
    return (mean / length if length > 0 else mean), var


def warm_start(items: DataFrame, vector: str, score: Column, session: bool = False, noise: float = 1.0) -> DataFrame:
    """(pos, mean, variance): a diagonal ridge fit of standardised scores, scaled to length one, a row per coordinate.

    The model version needs 3 items and has a variance of 4; the session version takes only items with a score above 0, needs 5
    and has noise / (sum of x squared + 1). With fewer items there are no rows. The sums of a batch are one
    row each, so no coordinate of an item is a row.
    """
    import numpy as np
    import pyarrow as pa

    items = items.where(score > 0) if session else items
    stats = items.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("sd"), F.count(score).alias("n"))
    y = F.when(F.col("sd") > 0, (score - F.col("m")) / F.col("sd")).otherwise(0.0)
    rows = items.crossJoin(F.broadcast(stats)).where(F.col("n") >= (5 if session else 3)).select(y.cast("double").alias("y"), F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL AND y IS NOT NULL")  # one row

    def sums(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = b.column("y").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(y @ x), pa.array(np.einsum("ij,ij->j", x, x))], names=["pos", "xy", "xx"])

    fit = rows.mapInArrow(sums, "pos int, xy double, xx double").groupBy("pos").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"))
    fit = fit.select("pos", (F.col("xy") / (F.col("xx") + 1)).alias("b"), (noise / (F.col("xx") + 1) if session else F.lit(4.0)).alias("variance"))
    length = fit.agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("n"))
    return fit.crossJoin(F.broadcast(length)).select("pos", F.when(F.col("n") > 0, F.round(F.col("b") / F.col("n"), 6)).otherwise(0.0).alias("mean"), F.round("variance", 6).alias("variance"))  # one row


def scores(items: DataFrame, key: str, vector: str, model: DataFrame) -> DataFrame:
    """(key, score, sigma) from a model of a row per coordinate (pos, mean, variance): the model is one row of two arrays beside each item, no shuffle."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda p: p[c])
    one = model.agg(ordered("mean").alias("_m"), ordered("variance").alias("_s"))
    x = F.col(vector)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    squares = F.transform(x, lambda v: v.cast("double") * v.cast("double"))
    return items.crossJoin(F.broadcast(one)).select(key, F.round(product(x, F.col("_m")), 6).alias("score"), F.round(F.sqrt(product(squares, F.col("_s"))), 6).alias("sigma"))  # one row


def fold(comparisons: DataFrame, model_key: str, order: str, winner: str, loser: str, noise: float = 1.0, variance: float = 4.0) -> DataFrame:
    """(model_key, n, mean, variance): the Bradley-Terry updates of each model in their order.

    The state is one vector pair; rows are read in sorted batches, so a model with
    many comparisons needs no more memory than one with few.
    """
    import numpy as np
    import pandas as pd

    rows = comparisons.select(model_key, order, winner, loser)

    def run(batches):
        owner = mean = var = None
        n = 0

        def out():
            return pd.DataFrame({model_key: [owner], "n": [n], "mean": [mean.round(6).tolist()], "variance": [var.round(6).tolist()]})

        for pdf in batches:
            for m, w, l in zip(pdf[model_key], pdf[winner], pdf[loser]):
                d = np.asarray(w, dtype=float) - np.asarray(l, dtype=float)
                if owner is None or m != owner:
                    if owner is not None:
                        yield out()
                    owner, n, mean, var = m, 0, np.zeros(len(d)), np.full(len(d), variance)
                mean, var = update(mean, var, d, noise)
                n += 1
        if owner is not None:
            yield out()

    kind = comparisons.schema[model_key].dataType.simpleString()
    return rows.repartition(model_key).sortWithinPartitions(model_key, order).mapInPandas(run, f"{model_key} {kind}, n long, mean array<double>, variance array<double>")
