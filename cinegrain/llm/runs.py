"""Problem 3: runs of near-identical consecutive events, by a state machine over sorted rows.

One shuffle sorts the rows into ranges of entity and position that a sample of all
rows makes equally large, so an entity that holds a third of all rows is spread over
a third of the tasks, however far apart its positions lie. What an entity has in
one range is a chunk. Each task reads its rows in order, batch by batch, and keeps only the
run that is open. Runs that touch the border of a chunk carry the vector there and
are stitched in a second, small pass; all others go past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import unit, usable_rows

_FIELDS = "first long, last long, n long, t_first double, t_last double, chunk long, at_start boolean, at_end boolean, v_first array<float>, v_last array<float>"


class RunMachine:
    """The state of one sorted stream: the open run, its anchor and the last frame."""

    def __init__(self, similarity: float, gap: float, anchor: str):
        self.similarity, self.gap, self.anchor = similarity, gap, anchor
        self.open: dict | None = None

    def breaks(self, new: np.ndarray, t: np.ndarray, x: np.ndarray, held: int) -> np.ndarray:
        """True where a run begins: against the frame before, or against the first frame of the run.

        new: rows that begin an entity's chunk; held: rows in front that belong to the open run.
        """
        close = np.zeros(len(t), dtype=bool)
        near = (t[1:] - t[:-1] <= self.gap) & ~new[1:]
        near[: max(0, held - 1)] = True
        # The threshold holds for the exact value; 1e-12 is the error of the sum in double precision.
        close[1:] = near & (np.einsum("ij,ij->i", x[1:], x[:-1]) >= self.similarity - 1e-12)
        if self.anchor == "previous":
            return ~close
        start = np.ones(len(t), dtype=bool)
        start[1:] = ~near
        at = 0
        while at < len(t):
            ends = np.flatnonzero(start[at + 1 :])
            end = at + 1 + int(ends[0]) if len(ends) else len(t)
            far = np.flatnonzero(x[at + 1 : end] @ x[at] < self.similarity - 1e-12)
            at = at + 1 + int(far[0]) if len(far) else end
            if at < len(t):
                start[at] = True
        return start


def find_runs(
    df: DataFrame,
    entity: list[str],
    position: str,
    time: str,
    vector: str,
    version: str,
    similarity: float,
    gap: float,
    least: int = 1,
    anchor: str = "previous",
    ranges: int | None = None,
) -> DataFrame:
    """Each longest run of events that hardly change: entity, first, last, n, t_first, t_last, duration.

    Of the rows with one (entity, position) only the one with the greatest
    version counts; if its vector isn't usable (see tables.usable_rows) the
    event is left out and its neighbours are consecutive. An event goes on with the run
    if its cosine to the anchor is at least `similarity` and its time is at most
    `gap` after the event before it. The anchor is the event just before
    ("previous") or the first event of the run ("first"). Runs of fewer than
    `least` events are left out.

    ranges: how many ranges the rows are cut into, by default the session's shuffle
    partitions; with anchor "first" a task holds an entity's whole stream.

    A null in an entity column or the position drops the row; a null time begins
    a new run there and right after it; a null version is older than any other;
    equal rows count once; an empty table gives no rows; other columns are not read.
    """
    if anchor not in ("previous", "first"):
        raise ValueError("anchor is 'previous' or 'first'")
    size = anchor == "previous"
    keys = [f"k{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(e).alias(k) for e, k in zip(entity, keys)], F.col(position).cast("bigint").alias("p"), F.col(time).cast("double").alias("t"), F.col(version).alias("ver"), F.col(vector).alias("v"))
    rows = rows.where(F.col("p").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if size:
        cut = [*([ranges] if ranges else []), *keys, "p"]
        rows = rows.repartitionByRange(*cut).withColumn("c", F.spark_partition_id().cast("bigint"))
    else:
        rows = rows.repartition(*keys).withColumn("c", F.lit(0).cast("bigint"))
    sorted_rows = rows.sortWithinPartitions(*keys, "c", "p", F.col("ver").desc_nulls_last()).drop("ver")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _FIELDS

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RunMachine(similarity, gap, anchor)
        last_key = None  # of the last row read, usable or not
        held: dict | None = None  # the last usable frame and, for "first", the anchor of the open run
        pending: list | None = None  # the open run: key, first, last, n, t0, t1, at_start, v_first
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            c, p = b.column("c").to_numpy(), b.column("p").to_numpy()
            t = b.column("t").to_numpy(zero_copy_only=False).astype(np.float64)
            # The first row of a position is the newest.
            same = np.zeros(b.num_rows, dtype=bool)
            same[1:] = (p[1:] == p[:-1]) & (c[1:] == c[:-1])
            for col in cols:
                same[1:] &= col[1:] == col[:-1]
            ident = (*[col[0] for col in cols], c[0], p[0])
            same[0] = last_key is not None and ident == last_key
            last_key = (*[col[-1] for col in cols], c[-1], p[-1])
            good, matrix = usable_rows(b.column("v"))
            fresh = ~same[good]
            good, matrix = good[fresh], matrix[fresh]
            if not len(good):
                continue
            x = unit(matrix)
            cols, c, p, t = [col[good] for col in cols], c[good], p[good], t[good]
            if held is not None:  # the frame before, so that the first row has something to be compared with
                k0 = 1 if anchor == "previous" else held["n"]
                cols = [np.concatenate([h, col]) for h, col in zip(held["cols"], cols)]
                c, p, t, x, matrix = (np.concatenate([held[f], y]) for f, y in (("c", c), ("p", p), ("t", t), ("x", x), ("matrix", matrix)))
            else:
                k0 = 0
            new = np.ones(len(c), dtype=bool)
            new[1:] = c[1:] != c[:-1]
            for col in cols:
                new[1:] |= col[1:] != col[:-1]
            start = m.breaks(new, t, x, k0)
            start[:k0] = False
            if k0 == 0:
                start[0] = True
            if pending is not None and not start[k0:].any():  # the open run takes it all
                pending["n"] += len(c) - k0
                pending["p1"], pending["t1"] = p[-1], t[-1]
                out = []
            else:
                at = np.flatnonzero(start)
                ends = np.append(at[1:], len(c))
                out = []
                if pending is not None:
                    if at[0] > k0:
                        pending["n"] += int(at[0]) - k0
                        pending["p1"], pending["t1"] = p[at[0] - 1], t[at[0] - 1]
                    pending |= {"at_end": bool(new[at[0]]), "v1": matrix[at[0] - 1]}
                    out.append(pending)
                for a, e in zip(at, ends):
                    out.append({"key": tuple(col[a] for col in cols), "c": c[a], "p0": p[a], "p1": p[e - 1], "n": int(e - a), "t0": t[a], "t1": t[e - 1], "at_start": bool(new[a]), "v0": matrix[a], "v1": matrix[e - 1], "at_end": bool(e < len(c) and new[e])})
                pending = out.pop()
            if anchor == "previous":
                keep = slice(len(c) - 1, len(c))
            else:  # the anchor, then the frame before
                a = int(np.flatnonzero(start)[-1]) if start.any() else 0
                keep = np.unique([a, len(c) - 1])
            held = {"cols": [col[keep] for col in cols], "c": c[keep], "p": p[keep], "t": t[keep], "x": x[keep], "matrix": matrix[keep]}
            held["n"] = len(held["c"])
            yield from packed(out)
        if pending is not None:
            pending["at_end"] = True
            pending["v1"] = held["matrix"][-1]
            yield from packed([pending])

    def packed(out: list[dict]) -> Iterator[pa.RecordBatch]:
        out = [r for r in out if r["n"] >= least or size and (r["at_start"] or r["at_end"])]
        if not out:
            return
        vec = lambda r, f, border: r[f] if size and r[border] else None
        arrays = [pa.array([r["key"][i] for r in out]) for i in range(len(keys))]
        arrays += [pa.array([r[f] for r in out], kind) for f, kind in (("p0", pa.int64()), ("p1", pa.int64()), ("n", pa.int64()), ("t0", pa.float64()), ("t1", pa.float64()), ("c", pa.int64()), ("at_start", pa.bool_()), ("at_end", pa.bool_()))]
        arrays += [pa.array([vec(r, "v0", "at_start") for r in out], pa.list_(pa.float32())), pa.array([vec(r, "v1", "at_end") for r in out], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "first", "last", "n", "t_first", "t_last", "chunk", "at_start", "at_end", "v_first", "v_last"])

    found = sorted_rows.mapInArrow(machine, schema)
    if size:
        border = F.col("at_start") | F.col("at_end")
        # Runs inside a chunk are spread; those at a border meet in the order of the chunks.
        salt = F.when(border, F.lit(-1)).otherwise(F.pmod(F.col("first"), F.lit(997)).cast("int"))
        found = found.withColumn("salt", salt).repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", "chunk", "first")
        found = found.mapInArrow(_stitcher(keys, similarity, gap), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", first long, last long, n long, t_first double, t_last double")
    return found.where(F.col("n") >= least).select(*[F.col(k).alias(e) for k, e in zip(keys, entity)], "first", "last", "n", "t_first", "t_last", (F.col("t_last") - F.col("t_first")).alias("duration"))


def _stitcher(keys: list[str], similarity: float, gap: float):
    """Joins the runs on both sides of a chunk border if the last frame of the one and the first of the other go on."""
    names = [*keys, "first", "last", "n", "t_first", "t_last"]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held: dict | None = None
        for b in batches:
            if not b.num_rows:
                continue
            kinds = kinds or [b.schema.field(n).type for n in names]
            inner = pc.greater_equal(b.column("salt"), 0)
            yield pa.RecordBatch.from_arrays([b.column(n).filter(inner) for n in names], names=names)
            done: list[dict] = []
            for r in b.filter(pc.less(b.column("salt"), 0)).to_pylist():
                if held is not None and held["at_end"] and r["at_start"] and held["chunk"] != r["chunk"] and all(held[k] == r[k] for k in keys) and r["t_first"] is not None and held["t_last"] is not None and r["t_first"] - held["t_last"] <= gap:
                    pair = unit(np.array([held["v_last"], r["v_first"]], dtype=np.float32))
                    if float(pair[0] @ pair[1]) >= similarity - 1e-12:
                        held |= {"last": r["last"], "n": held["n"] + r["n"], "t_last": r["t_last"], "at_end": r["at_end"], "v_last": r["v_last"], "chunk": r["chunk"]}
                        continue
                if held is not None:
                    done.append(held)
                held = r
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], k) for n, k in zip(names, kinds)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[n]], k) for n, k in zip(names, kinds)], names=names)

    return stitch
