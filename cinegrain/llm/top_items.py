"""Problem 1: the N best items of every group, by merging sorted runs in a loser tree.

Each task sorts its rows by group and score and keeps the first N rows of every
group: a run. The runs are shuffled into buckets by a hash of the group, and each
bucket merges its runs in a tournament tree of losers; after N outputs of a group
every run seeks to its next group. A group that holds a third of all rows sends
N rows per run, so no bucket gets more of it than N times the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN, SUB = "_run", "_sub"
#: Parts of a bucket by a hash of the group, and rows of whole parts that are merged at a time.
SUBS, LOT = 4096, 200_000


class LoserTree:
    """A tournament over the heads of sorted runs; the loser of each match stays in the tree.

    A run's head is replaced or moved forward, and only the matches on its path
    are played again: log2(runs) comparisons for each output.
    """

    def __init__(self, keys: list):
        self.n = len(keys)
        self.keys = keys
        self.losers = [0] * max(1, self.n)
        winners = [0] * (2 * self.n)
        for i in range(self.n):
            winners[self.n + i] = i
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if ka is None or kb is None:
            return kb is None and (ka is not None or a < b)
        return (ka, a) < (kb, b)

    def replace(self, run: int, key) -> None:
        """The head of a run becomes key, None when the run is at its end. Only for the current winner."""
        self.keys[run] = key
        node, best = (run + self.n) // 2, run
        while node >= 1:
            if self._before(self.losers[node], best):
                self.losers[node], best = best, self.losers[node]
            node //= 2
        self.winner = best


def merge_runs(group: np.ndarray, order: list[np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of the first n rows of each group over all runs, in the order of group, then order.

    group: codes that keep the groups' order; order: the columns that decide
    within a group, ascending; starts: where each run begins, and the end of the last.
    """
    runs = len(starts) - 1
    at, end = starts[:-1].tolist(), starts[1:].tolist()

    def head(r: int):
        i = at[r]
        return (group[i], *[o[i] for o in order]) if i < end[r] else None

    tree = LoserTree([head(r) for r in range(runs)])
    out: list[int] = []
    current, taken = None, 0
    while runs and tree.keys[tree.winner] is not None:
        r = tree.winner
        g = group[at[r]]
        if current is None or g != current:
            current, taken = g, 0
        if taken < n:
            out.append(at[r])
            taken += 1
            at[r] += 1
        else:  # seek: this run's rows of the finished group are passed over at once
            at[r] += int(np.searchsorted(group[at[r] : end[r]], current, side="right"))
        tree.replace(r, head(r))
    return np.array(out, dtype=np.int64)


def top_items(df: DataFrame, group: str, score: str, ties: list[str], n: int, lot: int = LOT) -> DataFrame:
    """Of every group the n rows with the greatest score; ties by the smaller values of the tie columns.

    Returns the columns group, score and ties, one row per kept row. Rows with a
    null group or a null or NaN score take no part, negative scores do; rows that
    are equal in all columns are separate rows; a group with fewer than n rows
    comes out whole; an empty table gives no rows. A null in a tie column sorts
    before any other value. The other columns of df, whatever their names, are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    columns = [group, score, *ties]
    kept = df.select(*columns).where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    within = [F.col(score).desc(), *[F.col(t).asc_nulls_first() for t in ties]]
    schema = T.StructType([*kept.schema.fields, T.StructField(RUN, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first n of each group of a sorted partition; the count goes on over batches."""
        number, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not len(b):
                continue
            g = b[group].to_numpy()
            new = np.ones(len(b), dtype=bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = last is None or g[0] != last
            first = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            position = np.where(first >= 0, np.arange(len(b)) - first, np.arange(len(b)) + seen)
            last, seen = g[-1], int(position[-1]) + 1
            yield b[position < n].assign(**{RUN: number})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merges a bucket's runs, some sub-buckets of whole groups at a time."""
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if sum(map(len, held)) >= lot:
                rows = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(rows[SUB].to_numpy(), rows[SUB].iat[-1]))  # the last sub-bucket may go on
                if last:
                    yield merged(rows.iloc[:last])
                held = [rows.iloc[last:]]
        if held:
            yield merged(pd.concat(held, ignore_index=True))

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort(rows[RUN].to_numpy(), kind="stable")]
        runs = rows[RUN].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
        codes, names = pd.factorize(rows[group], sort=True)
        codes = rows[SUB].to_numpy().astype(np.int64) * len(names) + codes
        # Dense ranks: descending for the score, ascending with null first for the ties.
        order = [-pd.factorize(rows[score], sort=True)[0], *[pd.factorize(rows[t], sort=True, use_na_sentinel=True)[0] for t in ties]]
        return rows.iloc[merge_runs(codes, order, starts, n)][columns]

    runs = kept.sortWithinPartitions(F.col(group), *within).mapInPandas(run, schema)
    sub = F.pmod(F.xxhash64(F.col(group)), F.lit(SUBS)).cast("int")
    bucketed = runs.repartition(group).withColumn(SUB, sub).sortWithinPartitions(SUB, RUN, F.col(group), *within)
    return bucketed.mapInPandas(merge, kept.schema)
