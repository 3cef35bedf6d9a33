"""Event streams: windowed counts with late data, gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts per window and kind; batch or stream. On a stream rows later than `late` are dropped and closed windows are appended."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late) if events.isStreaming else events.withColumn("_t", F.col(time).cast("timestamp"))
    return rows.groupBy(F.window("_t", width, slide or width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def gap_sessions(events: DataFrame, time: str, entity: str, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of an entity: events at most `gap` apart; batch or stream."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("_t", gap), entity).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), entity, "n")


def sliding_rates(events: DataFrame, time: str, client: str, seconds: int = 60, slide: int = 1, late: str = "10 minutes") -> DataFrame:
    """Requests of each client in every window of `seconds` that begins each `slide` seconds; batch or stream."""
    return windowed_counts(events, time, client, f"{seconds} seconds", f"{slide} seconds", late)


def incremental(stream: DataFrame, path: str, keys: list[str], work, checkpoint: str):
    """Runs work(rows) once for each key and appends what it gives to a parquet table: of every micro-batch only the keys that the table doesn't have.

    The table must have the keys among its columns. A batch that is run again finds its keys written and adds nothing. Returns the query.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if _has_data(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        work(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _has_data(spark, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def change_feed(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Applies a stream of changes (keys, seq, deleted and the other columns): every micro-batch's newest change of each key is appended as a version. current() reads the table."""

    def write(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_row")).select(*keys, "_row.*")
        newest.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key that isn't deleted."""
    rest = [c for c in versions.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_row")).select(*keys, "_row.*")
    return newest.where("NOT deleted").drop("deleted")


def online_preferences(comparisons: DataFrame, model: str, winner: str, loser: str, noise: float = 1.0, variance: float = 4.0) -> DataFrame:
    """(model, n, mean, variance) after each micro-batch of comparisons (with a seq): the Bradley-Terry updates of each model, its mean and variances kept as state."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.preference import update

    def run(key, batches, state):
        n, mean, var = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for w, l in zip(rows[winner], rows[loser]):
            d = np.asarray(w, dtype=float) - np.asarray(l, dtype=float)
            mean, var = (np.zeros(len(d)), np.full(len(d), variance)) if mean is None else (np.asarray(mean), np.asarray(var))
            mean, var = update(mean, var, d, noise)
            n += 1
        state.update((n, list(map(float, mean)), list(map(float, var))))
        yield pd.DataFrame({model: [key[0]], "n": [n], "mean": [np.round(mean, 6).tolist()], "variance": [np.round(var, 6).tolist()]})

    kind = comparisons.schema[model].dataType.simpleString()
    out = f"{model} {kind}, n long, mean array<double>, variance array<double>"
    return comparisons.groupBy(model).applyInPandasWithState(run, out, "n long, mean array<double>, variance array<double>", "update", GroupStateTimeout.NoTimeout)


def progress_listener(report):
    """A listener that calls report(name, batch, rows) after each micro-batch; add it with spark.streams.addListener."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            report(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    return Listener()
