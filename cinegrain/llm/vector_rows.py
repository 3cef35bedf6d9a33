"""Usable vectors with a group, an id pair and a 128-bit key of the vector; equal vectors as one class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import DIMENSIONS, usable_rows


def usable(df: DataFrame, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of df whose vector is usable, see tables.usable_rows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, _ = usable_rows(b.column(vector), dimensions)
                yield b.take(pa.array(rows))

    return df.where(F.size(vector) == dimensions).mapInArrow(keep, df.schema)


def vector_key(vector: str) -> list:
    """Two hashes of a vector with different seeds."""
    return [F.xxhash64(vector).alias("x"), F.xxhash64(F.lit(1), vector).alias("y")]


def group_sums(df: DataFrame, group: str, vector: str, dimensions: int = DIMENSIONS) -> dict:
    """{group: (rows, mean of the unit vectors)}, summed in every task first; there are few groups, such as models."""
    from .tables import unit

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            rows, matrix = usable_rows(b.column(vector), dimensions)
            g = b.column(group).take(pa.array(rows)).to_numpy(zero_copy_only=False)
            x = unit(matrix)
            for v in pd.unique(g):
                own = x[g == v]
                n, s = total.get(v, (0, 0.0))
                total[v] = (n + len(own), s + own.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.float64()))],
            names=["g", "n", "s"],
        )

    out: dict = {}
    for r in df.select(group, vector).mapInArrow(sums, "g string, n long, s array<double>").toLocalIterator():
        n, s = out.get(r.g, (0, np.zeros(dimensions)))
        out[r.g] = (n + r.n, s + np.array(r.s))
    return {g: (n, s / n) for g, (n, s) in out.items()}


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where any of the columns differs from the row before; the first row counts as different."""
    new = np.ones(batch.num_rows, dtype=bool)
    new[1:] = False
    for n in names:
        col = batch.column(n)
        new[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), True).to_numpy(zero_copy_only=False)
    return new


def first_members(per_owner: int, most: int):
    """Filters a stream sorted by class (g, x, y), a, b: the first `most` rows of each class, counting at most per_owner of one a.

    What it drops can't be among the first `most` of the whole class either, so
    it may run before and after a shuffle. The state is four values.
    """

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        of_owner = of_class = 0  # rows of the last owner, kept rows of the last class
        for b in batches:
            if not b.num_rows:
                continue
            cls = _changes(b, ["g", "x", "y"])
            own = cls | _changes(b, ["a"])
            ends = lambda i: tuple(b.column(n)[i].as_py() for n in ("g", "x", "y", "a"))  # noqa: B023, E731
            first = ends(0)
            cls[0] = last is None or first[:3] != last[:3]
            own[0] = cls[0] or first != last
            i = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(own, i, -1))
            rank = np.where(start >= 0, i - start, i + of_owner)
            kept = rank < per_owner
            total = np.cumsum(kept)
            begin = np.maximum.accumulate(np.where(cls, i, -1))
            before = np.where(begin >= 0, np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0), -of_class)
            place = total - before
            last, of_owner, of_class = ends(b.num_rows - 1), int(rank[-1]) + 1, int(place[-1])
            yield b.filter(pa.array(kept & (place <= most)))

    return trim


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a class as one: (g, x, y, a list, b list, v). A class is held back until its last row has come."""
    held: pa.Table | None = None

    def pack(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.append(starts, t.num_rows).astype(np.int32))
        one = t.take(pa.array(starts))
        col = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        arrays = [col(one.column(n)) for n in ("g", "x", "y")]
        arrays += [pa.ListArray.from_arrays(offsets, col(t.column(n))) for n in ("a", "b")]
        return pa.RecordBatch.from_arrays([*arrays, col(one.column("v"))], names=["g", "x", "y", "a", "b", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        starts = np.flatnonzero(_changes(t.to_batches()[0], ["g", "x", "y"]))
        held = t.slice(int(starts[-1]))
        if len(starts) > 1:
            yield pack(t.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
    if held is not None and held.num_rows:
        yield pack(held.combine_chunks(), np.array([0]))


def vector_classes(rows: DataFrame, per_owner: int, most: int) -> DataFrame:
    """(g, x, y, a, b, v): a row per group and distinct vector, with its first members' ids as lists.

    rows has g, x, y, a, b, v: the group, the key of the vector, two ids and the
    vector. A class that holds a third of all rows sends `most` rows per task.
    """
    order = ["g", "x", "y", "a", "b"]
    rows = rows.select(*order, "v")
    trim = first_members(per_owner, most)
    part = rows.sortWithinPartitions(*order).mapInArrow(trim, rows.schema)
    whole = part.repartition("g", "x", "y").sortWithinPartitions(*order)
    return whole.mapInArrow(lambda it: listed(trim(it)), "g string, x long, y long, a array<long>, b array<long>, v array<float>")
