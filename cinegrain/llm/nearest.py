"""Problem 6: the most similar vectors of every vector, by cross-polytope hashing.

Vectors are centred on the mean of their group, padded to a power of two and turned
by pseudo-rotations: three times random signs and a fast Hadamard transform. The
largest coordinate and its sign, the nearest signed axis, is the hash; several
tables of several hashes each give the buckets. Each vector is kept in its home
bucket of every table and also looks into the bucket that it misses by the least.
The cosines of what meets in a bucket are computed exactly.

Equal vectors are one class, so copies don't fill buckets; a bucket that is still
larger than a bound is cut into blocks that all its visitors see. A task holds one
block at a time; its visitors come batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import parallelism, stored
from .tables import DIMENSIONS, unit, usable_rows
from .vector_rows import group_sums, usable, vector_classes, vector_key

#: Tables, probes besides the home bucket, vectors that a bucket holds on the average, and at most as one block.
TABLES = 4
PROBES = 1
OCCUPANCY = 96
BLOCK = 8192
#: Rows in buckets of one task, about.
PART = 500_000


class CrossPolytope:
    """Hash functions of one group of vectors; equal on every machine for equal arguments."""

    def __init__(self, dimensions: int, mean: np.ndarray, count: int, tables: int = TABLES, occupancy: int = OCCUPANCY, seed: int = 11):
        self.dimensions, self.mean, self.tables = dimensions, mean, tables
        self.padded = 1 << max(1, (dimensions - 1).bit_length())
        # As many cells as give the wanted occupancy: full hashes of 2 * padded cells, the last one of fewer axes.
        cells, self.axes = max(2, count // occupancy), []
        while cells > 2 * self.padded:
            self.axes.append(self.padded)
            cells = math.ceil(cells / (2 * self.padded))
        self.axes.append(max(1, cells // 2))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=(tables, len(self.axes), 3, self.padded))

    def _hadamard(self, a: np.ndarray) -> np.ndarray:
        """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
        n, step = self.padded, 1
        while step < n:
            a = a.reshape(-1, n // (2 * step), 2, step)
            a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(-1, n)
            step *= 2
        return a / np.float32(math.sqrt(n))

    def buckets(self, x: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Bucket numbers of unit vectors as (tables, 1 + probes, rows): home first, then the nearest misses."""
        c = (x - self.mean).astype(np.float32)
        c = np.pad(c, ((0, 0), (0, self.padded - self.dimensions)))
        rows = np.arange(len(c))
        out = np.empty((self.tables, 1 + probes, len(c)), dtype=np.int64)
        for t in range(self.tables):
            hashes, codes, misses = len(self.axes), [], []
            for k, axes in enumerate(self.axes):
                r = c
                for s in self.signs[t, k]:
                    r = self._hadamard(r * s)
                r = r[:, :axes]
                size = np.abs(r)
                best = size.argmax(axis=1)
                code = 2 * best + (r[rows, best] < 0)
                # The alternatives: the next axes, or with a single axis its other sign.
                top = size[rows, best]
                if axes == 1:
                    alternatives, loss = [code ^ 1], [2 * top]
                else:
                    alternatives, loss = [], []
                    rest = size.copy()
                    rest[rows, best] = -1
                    for _ in range(min(probes, axes - 1)):
                        nxt = rest.argmax(axis=1)
                        alternatives.append(2 * nxt + (r[rows, nxt] < 0))
                        loss.append(top - size[rows, nxt])
                        rest[rows, nxt] = -1
                codes.append(code)
                misses.append((alternatives, loss))
            weights = [1] * hashes
            for k in range(hashes - 2, -1, -1):
                weights[k] = weights[k + 1] * 2 * self.axes[k + 1]
            home = sum(w * c_ for w, c_ in zip(weights, codes))
            out[t, 0] = home
            options, losses = [], []
            for k, (alternatives, loss) in enumerate(misses):
                for a, m in zip(alternatives, loss):
                    options.append(home + weights[k] * (a - codes[k]))
                    losses.append(m)
            order = np.argsort(np.array(losses), axis=0, kind="stable")
            for p in range(probes):
                out[t, 1 + p] = np.array(options)[order[min(p, len(options) - 1)], rows]
        return out


def _bucket_rows(hashers: dict, probes: int):
    """Rows for the buckets: at home or as a visitor."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, matrix = usable_rows(b.column("v"))
            b = b.take(pa.array(rows))
            groups = b.column("g").to_pylist()
            for g in dict.fromkeys(groups):
                own = np.array([i for i, v in enumerate(groups) if v == g])
                keys = hashers[g].buckets(unit(matrix[own]), probes)
                whose, table_no, bucket, home = [], [], [], []
                for t in range(keys.shape[0]):
                    for p in range(keys.shape[1]):
                        whose.append(own)
                        table_no.append(np.full(len(own), t, dtype=np.int32))
                        bucket.append(keys[t, p])
                        home.append(np.full(len(own), p == 0))
                whose = np.concatenate(whose)
                taken = b.take(pa.array(whose))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(table_no)), pa.array(np.concatenate(bucket)), pa.array(np.concatenate(home)), *taken.columns],
                    names=["t", "h", "home", *taken.schema.names],
                )

    return place


def _counts(hashers: dict):
    """Home rows of each bucket of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, matrix = usable_rows(b.column("v"))
            groups = np.array(b.column("g").take(pa.array(rows)).to_pylist(), dtype=object)
            for g in dict.fromkeys(groups.tolist()):
                keys = hashers[g].buckets(unit(matrix[groups == g]), 0)
                for t in range(keys.shape[0]):
                    cell, n = np.unique(keys[t, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(cell), pa.string()), pa.array(np.full(len(cell), t, dtype=np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], names=["g", "t", "h", "n"])

    return count


def _meet(least: float, per_owner: int, most: int):
    """Exact cosines of each bucket's visitors to its stored classes; the best `most` members for each visitor."""

    class Block:
        """The stored classes of a block; asking rows come batch by batch, the block's own among them."""

        def __init__(self, key: tuple):
            self.key, self.parts, self.x = key, [], None

        def opened(self) -> list[pa.RecordBatch]:
            """Once all stored rows are there: what they find among each other."""
            if self.x is not None or not self.parts:
                return []
            t = pa.Table.from_batches(self.parts).combine_chunks()
            self.parts = []
            self.x = unit(usable_rows(t.column("v"))[1])
            self.x32 = self.x.astype(np.float32)
            a, b = t.column("a").combine_chunks(), t.column("b").combine_chunks()
            offsets = a.offsets.to_numpy()
            self.offsets = offsets - offsets[0]
            self.ids_a, self.ids_b = a.flatten().to_numpy(), b.flatten().to_numpy()
            return [r for r in (self.asked(p) for p in t.to_batches()) if r is not None]

        def asked(self, part: pa.RecordBatch) -> pa.RecordBatch | None:
            return _found(self, unit(usable_rows(part.column("v"))[1]), part)

    def _found(block: Block, x: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch | None:
        x32, offsets, ids_a, ids_b = x.astype(np.float32), block.offsets, block.ids_a, block.ids_b
        found: list[tuple] = []
        step = max(1, 4_000_000 // len(block.x))
        for s in range(0, len(x), step):
            near = x32[s : s + step] @ block.x32.T
            q, h = np.divmod(np.flatnonzero(near.ravel() >= least - 1e-5), len(block.x))
            if not len(q):
                continue
            q += s
            # Rounded to six decimals, as the similarity is; recomputed in double precision.
            exact = np.round(np.einsum("ij,ij->i", x[q], block.x[h]), 6)
            ok = exact >= least
            q, h, exact = q[ok], h[ok], exact[ok]
            members = offsets[h + 1] - offsets[h]
            q2, e2 = np.repeat(q, members), np.repeat(exact, members)
            place = np.arange(len(q2)) - np.repeat(np.cumsum(members) - members, members) + np.repeat(offsets[h], members)
            ca, cb = ids_a[place], ids_b[place]
            order = np.lexsort((cb, ca, -e2, q2))
            q2, e2, ca, cb = q2[order], e2[order], ca[order], cb[order]
            # At most per_owner of one a, then at most `most` of one visitor, both in that order.
            by = np.lexsort((np.arange(len(q2)), ca, q2))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (q2[by][1:] != q2[by][:-1]) | (ca[by][1:] != ca[by][:-1])
            rank = np.empty(len(by), dtype=np.int64)
            i = np.arange(len(by))
            rank[by] = i - np.maximum.accumulate(np.where(new, i, 0))
            keep = rank < per_owner
            q2, e2, ca, cb = q2[keep], e2[keep], ca[keep], cb[keep]
            new = np.ones(len(q2), dtype=bool)
            new[1:] = q2[1:] != q2[:-1]
            i = np.arange(len(q2))
            keep = i - np.maximum.accumulate(np.where(new, i, 0)) < most
            found.append((q2[keep], e2[keep], ca[keep], cb[keep]))
        if not found:
            return None
        q, e, ca, cb = (np.concatenate(f) for f in zip(*found))
        of = pa.array(q)
        return pa.RecordBatch.from_arrays([*[part.column(n).take(of) for n in ("g", "x", "y")], pa.array(ca), pa.array(cb), pa.array(e)], names=["g", "x", "y", "ca", "cb", "cos"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Block | None = None
        for b in batches:
            if not b.num_rows:
                continue
            ready: list[pa.RecordBatch] = []
            change = np.zeros(b.num_rows, dtype=bool)
            for n in ("g", "t", "h", "blk", "asks"):
                col = b.column(n)
                change[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(change).tolist()]
            groups, tables, cells, blocks, asks = (b.column(n).take(pa.array(starts)).to_pylist() for n in ("g", "t", "h", "blk", "asks"))
            for i, (s, e) in enumerate(zip(starts, [*starts[1:], b.num_rows])):
                key, part = (groups[i], tables[i], cells[i], blocks[i]), b.slice(s, e - s)
                if here is None or here.key != key:
                    if here is not None:
                        ready += here.opened()
                    here = Block(key)
                if not asks[i]:
                    here.parts.append(part)
                    continue
                ready += here.opened()
                if here.x is not None and (r := here.asked(part)) is not None:  # else nobody is at home
                    ready.append(r)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if here is not None:
            yield from here.opened()

    return meet


def nearest(
    df: DataFrame,
    group: str,
    owner: str,
    part: str,
    vector: str,
    k: int = 5,
    least: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    occupancy: int = OCCUPANCY,
    block: int = BLOCK,
) -> DataFrame:
    """(g, a, b, ca, cb, cos, place): for every vector up to k others of its group with the greatest cosine of at least `least`.

    df has one current row per (group, owner, part); (ca, cb) are the neighbour's
    owner and part. Vectors of one owner are no neighbours of each other. The
    cosine is rounded to six decimals; ties go to the smaller (owner, part).

    Rows with a null group, owner or part or an unusable vector are left out; a
    vector without neighbours gives no rows; an empty table gives none; other
    columns are not read. The search is approximate: what meets in no bucket is
    missed. The cosines and the order of what is found are exact.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(owner).cast("bigint").alias("a"), F.col(part).cast("bigint").alias("b"), F.col(vector).cast("array<float>").alias("v"))
    rows = usable(rows.where(F.col("g").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()), "v")
    rows = stored(rows.select("g", "a", "b", "v", *vector_key("v")), "vectors")
    sums = group_sums(rows, "g", "v")
    hashers = {g: CrossPolytope(DIMENSIONS, mean, n, tables, occupancy) for g, (n, mean) in sums.items()}
    # The best k of a vector are among the first 2k of its class's candidates that count at most k per owner.
    most = 2 * k
    classes = stored(vector_classes(rows, k, most), "vector-classes")
    full = classes.select("g", "v").mapInArrow(_counts(hashers), "g string, t int, h long, n long").groupBy("g", "t", "h").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    hot = stored(full.select("g", "t", "h", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-buckets")  # at most one for each `block` rows
    placed = classes.mapInArrow(_bucket_rows(hashers, probes), "t int, h long, home boolean, g string, x long, y long, a array<long>, b array<long>, v array<float>")
    placed = placed.join(hot, ["g", "t", "h"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A row is stored in one block of its home bucket and asks in all others.
    placed = placed.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("asks", ~(F.col("home") & (F.col("blk") == F.pmod(F.col("x"), F.col("blocks"))))).drop("home", "blocks")
    # As many parts as keep a task small, where the session's number doesn't.
    parts = sum(n for n, _ in sums.values()) * tables * (1 + probes) // PART
    cut = ["g", "t", "h", "blk"]
    placed = placed.repartition(parts, *cut) if parts > parallelism(df.sparkSession) else placed.repartition(*cut)
    met = placed.sortWithinPartitions(*cut, "asks").mapInArrow(_meet(least, k, most), "g string, x long, y long, ca long, cb long, cos double")
    best = met.groupBy("g", "x", "y", "ca", "cb").agg(F.max("cos").alias("cos"))
    order = [F.col("cos").desc(), F.col("ca"), F.col("cb")]
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "x", "y", "ca").orderBy(*order))).where(F.col("r") <= k)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "x", "y").orderBy(*order))).where(F.col("r") <= most)
    lists = best.groupBy("g", "x", "y").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("c"), "ca", "cb"))).alias("near"))
    own = rows.select("g", "a", "b", "x", "y").join(lists, ["g", "x", "y"])
    chosen = own.select("g", "a", "b", F.slice(F.filter("near", lambda c: c["ca"] != F.col("a")), 1, k).alias("near"))
    return chosen.select("g", "a", "b", F.posexplode("near").alias("place", "c")).select("g", "a", "b", F.col("c.ca").alias("ca"), F.col("c.cb").alias("cb"), (-F.col("c.c")).alias("cos"), (F.col("place") + 1).alias("place"))
