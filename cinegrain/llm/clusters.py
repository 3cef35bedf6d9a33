"""Problem 5: groups of mutually similar vectors, by bisecting k-means.

Every node that isn't compact is split in two by k-means (a start along its widest
axis, then Lloyd steps) until the compactness limit holds: each two rows of a leaf
are similar. Nodes of many rows are split across the cluster, level by level, those
with the largest dispersion first: each step is one pass over the rows that sums per
node and side in every task before the shuffle. Once a node fits a task, its rows meet there
and the splitting goes on inside, all nodes of a level at once, down to the compact
leaves. The leaves are the candidates for groups.

A split may cut through a group, so the leaves only say which rows stand for one: every two
blocks of rows are compared exactly, by the centres of their compact leaves first. The blocks
are stored once and read by the tasks that compare them, so the disk doesn't grow faster than the rows.
There each row learns the number, the smallest id and a fingerprint of the rows that are similar to
it. A leaf whose rows know each other and nobody else is a group; of the leaves that
a plane cut from each other, rows with the same neighbours, as many as there are, are one.

Rows near the centre of a compact node of many rows, within half of the allowed angle, are all
similar to each other without being compared, so a group that holds a third of all
rows is linear work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .tables import DIMENSIONS, unit, usable_rows

#: Rows of a node that isn't compact up to which one task goes on splitting it: least and most, Lloyd steps, axes that are compared first, the cell of a row that doesn't tell.
LEAST_LEAF, LEAF = 4_096, 65_536
STEPS = 2
HEAD = 24
NO_CELL = -(1 << 62)


def leaf_rows(rows: int) -> int:
    """An eighth of the rows within LEAST_LEAF and LEAF."""
    return max(LEAST_LEAF, min(LEAF, rows // 8))


class Tree:
    """Planes of a bisecting k-means tree; node 0 is the root, a leaf has no children."""

    def __init__(self) -> None:
        self.plane = np.zeros((1, DIMENSIONS))
        self.offset = np.zeros(1)
        self.child = np.full((1, 2), -1, dtype=np.int64)
        self.count = np.zeros(1, dtype=np.int64)
        self.mean = np.zeros((1, DIMENSIONS))

    def grow(self, nodes: list[int], cuts: list[tuple], sides: list[tuple]) -> int:
        """Two children for each of the nodes, cut by (plane, offset); sides: (n, sum) of the children. The first child's number."""
        first, more = len(self.offset), 2 * len(nodes)
        if nodes:
            self.plane[nodes], self.offset[nodes] = np.array([c[0] for c in cuts]), [c[1] for c in cuts]
            self.child[nodes] = first + np.arange(more).reshape(-1, 2)
            self.plane, self.offset = np.vstack([self.plane, np.zeros((more, DIMENSIONS))]), np.append(self.offset, np.zeros(more))
            self.child = np.vstack([self.child, np.full((more, 2), -1)])
            self.count = np.append(self.count, [n for n, _ in sides])
            self.mean = np.vstack([self.mean, [s / n for n, s in sides]])
        return first

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            todo = todo[self.child[node[todo], 0] >= 0]
            if len(todo):
                at = node[todo]
                side = np.einsum("ij,ij->i", x[todo], self.plane[at]) > self.offset[at]
                node[todo] = self.child[at, side.astype(np.int64)]
        return node


def _node_sums(rows: DataFrame, tree: Tree, split: dict[int, tuple[np.ndarray, float]]) -> dict[tuple[int, int], tuple]:
    """{(node, side): (n, sum, sum of squares)} of the rows in the nodes of `split`, each cut by its plane."""
    nodes = np.array(sorted(split), dtype=np.int64)
    planes, offsets = np.array([split[n][0] for n in nodes.tolist()]), np.array([split[n][1] for n in nodes.tolist()])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2 * len(nodes), dtype=np.int64), np.zeros((2 * len(nodes), DIMENSIONS)), np.zeros((2 * len(nodes), DIMENSIONS))
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(usable_rows(b.column("v"))[1])
            at = tree.leaf_of(x)
            place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            live = nodes[place] == at
            x, place = x[live], place[live]
            if not len(x):
                continue
            key = 2 * place + (np.einsum("ij,ij->i", x, planes[place]) > offsets[place])
            order = np.argsort(key, kind="stable")
            key, x = key[order], x[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n[key[first]] += np.diff(np.append(first, len(key)))
            s[key[first]] += np.add.reduceat(x, first)
            q[key[first]] += np.add.reduceat(x * x, first)
        any_row = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(any_row), pa.array(n[any_row]), pa.array(np.hstack([s, q])[any_row].tolist(), pa.list_(pa.float64()))], names=["key", "n", "s"])

    parts = rows.select("v").mapInArrow(part, "key long, n long, s array<double>")
    out = {}
    for r in summed(parts, 2 * DIMENSIONS).toLocalIterator():  # two rows per node, however many tasks there were
        s = np.array(r.s)
        out[int(nodes[r.key // 2]), int(r.key % 2)] = (r.n, s[:DIMENSIONS], s[DIMENSIONS:])
    return out


def summed(parts: DataFrame, width: int) -> DataFrame:
    """(key, n, s) with one row per key: the sums of the tasks' partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if b.num_rows:
                keys, n = b.column("key").to_numpy(), b.column("n").to_numpy()
                s = b.column("s").flatten().to_numpy().reshape(-1, width)
                for k, c, v in zip(keys.tolist(), n.tolist(), s):
                    have = total.get(k)
                    total[k] = (c, v) if have is None else (have[0] + c, have[1] + v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c for c, _ in total.values()], pa.int64()), pa.array([v.tolist() for _, v in total.values()], pa.list_(pa.float64()))], names=["key", "n", "s"])

    return parts.repartition("key").mapInArrow(add, "key long, n long, s array<double>")


def bisect(rows: DataFrame, least: float, leaf: int | None = None, steps: int = STEPS) -> Tree:
    """The upper tree over all rows' unit vectors (column v). Only planes and sums come to the driver: some 40 numbers for each `leaf` rows.

    A node is split while it has more than `leaf` rows and isn't compact: its mean
    is shorter than the cosine of half the angle that `least` allows. What is left
    of nodes that aren't compact is split inside the tasks (see compact_leaves).
    """
    tree, compact = Tree(), math.cos(math.acos(least) / 2)
    start = _node_sums(rows, tree, {0: (np.zeros(DIMENSIONS), 0.0)})
    if not start:
        return tree
    n, s, q = (sum(x) for x in zip(*start.values()))
    tree.count[0], tree.mean[0] = n, s / n
    leaf = leaf_rows(int(n)) if leaf is None else leaf
    stats = {0: (n, s, q)}
    active = [0]
    while active:
        wide = lambda i: stats[i][0] - stats[i][1] @ stats[i][1] / stats[i][0]  # noqa: B023, E731
        active = [i for i in active if stats[i][0] > leaf and np.linalg.norm(tree.mean[i]) < compact]
        active = sorted(active, key=wide, reverse=True)
        if not active:
            break
        cut = {}
        for i in active:
            n, s, q = stats[i]
            axis = int(np.argmax(q / n - (s / n) ** 2))
            plane = np.zeros(DIMENSIONS)
            plane[axis] = 1
            cut[i] = (plane, s[axis] / n)
        for _ in range(steps):
            sides = _node_sums(rows, tree, cut)
            for i in list(cut):
                if (i, 0) not in sides or (i, 1) not in sides:
                    del cut[i]  # nothing to tell apart
                    continue
                a, b = (sides[i, k][1] / sides[i, k][0] for k in (0, 1))
                if not np.linalg.norm(b - a) > 1e-9:
                    del cut[i]
                    continue
                plane = (b - a) / np.linalg.norm(b - a)
                cut[i] = (plane, float(plane @ (a + b) / 2))
            if not cut:
                break
        sides = _node_sums(rows, tree, cut) if cut else {}
        fresh = [i for i in cut if (i, 0) in sides and (i, 1) in sides]
        first = tree.grow(fresh, [cut[i] for i in fresh], [sides[i, k][:2] for i in fresh for k in (0, 1)])
        stats = {first + 2 * j + k: sides[i, k] for j, i in enumerate(fresh) for k in (0, 1)}
        active = list(stats)
    return tree


def compact_leaves(x: np.ndarray, least: float, steps: int = STEPS) -> np.ndarray:
    """The leaf of each row: the rows (unit vectors) split on until each two rows of a leaf have a cosine of at least `least`.

    All nodes of a level are split at once. A node is compact if its rows lie within
    half the allowed angle of its centre, or else if its least cosine says so.
    """
    leaf = np.zeros(len(x), dtype=np.int64)
    near, todo, last = math.cos(math.acos(least) / 2) + 1e-9, np.arange(len(x)), 0
    while len(todo):
        node = np.unique(leaf[todo], return_inverse=True)[1].ravel()
        order = np.argsort(node, kind="stable")
        todo, node = todo[order], node[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        n = np.diff(np.append(first, len(node)))
        y = x[todo]
        mean = np.add.reduceat(y, first) / n[:, None]
        long = np.sqrt(np.einsum("ij,ij->i", mean, mean))
        to_centre = np.einsum("ij,ij->i", y, mean[node]) / np.maximum(long[node], 1e-300)
        compact = (n == 1) | (np.minimum.reduceat(to_centre, first) >= near)
        # The squared length of the mean is the mean cosine of all pairs: if that is too small, some pair's is.
        for i in np.flatnonzero(~compact & (long * long >= least)):
            own = y[first[i] : first[i] + n[i]]
            compact[i] = all((own[s : s + 1024] @ own.T).min() >= least for s in range(0, n[i], 1024))
        go = ~compact[node]
        todo, y = todo[go], y[go]
        if not len(todo):
            break
        node = np.unique(node[go], return_inverse=True)[1].ravel()
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        n, mean = np.diff(np.append(first, len(node))), mean[~compact]
        axis = np.argmax(np.add.reduceat(y * y, first) / n[:, None] - mean**2, axis=1)
        side = y[np.arange(len(y)), axis[node]] > mean[np.arange(len(n)), axis][node]
        for _ in range(steps):
            a = np.add.reduceat(y * side[:, None], first)
            na = np.add.reduceat(side.astype(np.int64), first)
            b, nb = mean * n[:, None] - a, n - na
            ca, cb = a / np.maximum(na, 1)[:, None], b / np.maximum(nb, 1)[:, None]
            plane = ca - cb
            again = np.einsum("ij,ij->i", y, plane[node]) > (np.einsum("ij,ij->i", plane, ca + cb) / 2)[node]
            kept = np.add.reduceat(again.astype(np.int64), first)
            side = np.where(((kept > 0) & (kept < n))[node], again, side)
        na = np.add.reduceat(side.astype(np.int64), first)
        # Rows that no plane tells apart are halved by their order.
        side = np.where(((na > 0) & (na < n))[node], side, (np.arange(len(y)) - first[node]) * 2 < n[node])
        leaf[todo] = last + 1 + 2 * node + side
        last += 2 * len(n)
    return np.unique(leaf, return_inverse=True)[1].ravel()


def _mix(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of ids (the finaliser of a public mixing function), for fingerprints by exclusive or."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).astype(np.int64)


class Blocks:
    """The blocks of at most some `block` rows: neighbouring small leaves share one, a large leaf has several."""

    def __init__(self, tree: Tree, block: int):
        self.first, self.several = np.zeros(len(tree.offset), dtype=np.int64), np.ones(len(tree.offset), dtype=np.int64)
        self.number = filled = 0
        todo = [0]
        while todo:  # the leaves from left to right
            node = todo.pop()
            if tree.child[node, 0] >= 0:
                todo += tree.child[node, ::-1].tolist()
                continue
            n = int(tree.count[node])
            if not self.number or filled + n > block:
                self.first[node], self.several[node] = self.number, max(1, -(-n // block))
                self.number += int(self.several[node])
                filled = n if n <= block else block
            else:
                self.first[node], filled = self.number - 1, filled + n


def _core_of(tree: Tree, x: np.ndarray, leaf: np.ndarray, least: float, block: int) -> np.ndarray:
    """Whether each row is in a leaf of more than `block` rows, within half the allowed angle of its centre: such rows are all similar."""
    near = math.cos(math.acos(least) / 2) + 1e-9
    core = tree.count[leaf] > block
    if core.any():
        centre = tree.mean[leaf[core]]
        long = np.sqrt(np.einsum("ij,ij->i", centre, centre))
        core[core] = np.einsum("ij,ij->i", x[core], centre) >= near * np.where(long > 0, long, np.inf)
    return core


def _spread(tree: Tree, least: float, block: int):
    """Each row's block and, for a core row, its leaf, else -1."""
    blocks = Blocks(tree, block)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(usable_rows(b.column("v"))[1])
                leaf = tree.leaf_of(x)
                blk = blocks.first[leaf] + (_mix(b.column("id").to_numpy()) & 0x7FFFFFFF) % blocks.several[leaf]
                core = np.where(_core_of(tree, x, leaf, least, block), leaf, -1)
                yield pa.RecordBatch.from_arrays([pa.array(blk), pa.array(core), b.column("id"), b.column("v")], names=["blk", "core", "id", "v"])

    return spread


def _packed(least: float):
    """One row for each block: its rows by cell, as bytes. A cell is one core or a compact leaf of the other rows."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        core, ids, v = t.column("core").to_numpy(), t.column("id").to_numpy(), usable_rows(t.column("v"))[1]
        cell, own = -1 - core, np.flatnonzero(core < 0)
        cell[own] = compact_leaves(unit(v[own]), least)
        order = np.argsort(cell, kind="stable")
        values = (t.column("blk").to_numpy()[:1], *([x[order].tobytes()] for x in (ids, v, cell, core)))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, (pa.int64(), *[pa.binary()] * 4))], names=["blk", "ids", "v", "cell", "core"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            blk = b.column("blk").to_numpy()
            starts = np.flatnonzero(np.append(True, blk[1:] != blk[:-1]))
            for s, e in zip(starts.tolist(), np.append(starts[1:], b.num_rows).tolist()):
                if parts and last != blk[s]:
                    yield pack(parts)
                    parts = []
                parts, last = [*parts, b.slice(s, e - s)], blk[s]
        if parts:
            yield pack(parts)

    return run


class Block:
    """A block's rows, its cells by their angle from the centre to the furthest row, and what is found of the rows."""

    def __init__(self, number: int, ids: bytes, v: bytes, cell: bytes, core: bytes):
        self.number, self.ids = number, np.frombuffer(ids, dtype=np.int64)
        self.v, self.cell = np.frombuffer(v, dtype=np.float32).reshape(-1, DIMENSIONS), np.frombuffer(cell, dtype=np.int64)
        self.hash = _mix(self.ids)
        x = self.v / np.abs(self.v).max(axis=1, keepdims=True)  # single precision is enough for centres
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        first = np.flatnonzero(np.append(True, self.cell[1:] != self.cell[:-1]))
        n = np.diff(np.append(first, len(self.ids)))
        mean = np.add.reduceat(x, first)
        mean /= np.maximum(np.sqrt(np.einsum("ij,ij->i", mean, mean)), 1e-30)[:, None]
        cos = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(mean, n, axis=0)), first)
        wide = np.where(n == 1, 0, np.arccos(np.clip(cos.astype(np.float64) - 5e-6, -1, 1)))
        order = np.argsort(wide, kind="stable")
        self.start, self.size, self.wide = first[order], n[order], wide[order]
        self.core = np.frombuffer(core, dtype=np.int64)[self.start]
        self.centre = mean[order]
        self.forget()

    def forget(self) -> None:
        self.n, self.print = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=np.int64)
        self.least = np.full(len(self.ids), np.iinfo(np.int64).max)

    def hears(self, rows: np.ndarray, other: Block, hit: np.ndarray) -> None:
        """The rows find the other block's rows `hit`."""
        order = np.argsort(rows, kind="stable")
        rows, hit = rows[order], hit[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        at = rows[first]
        self.n[at] += np.diff(np.append(first, len(rows)))
        self.least[at] = np.minimum(self.least[at], np.minimum.reduceat(other.ids[hit], first))
        self.print[at] ^= np.bitwise_xor.reduceat(other.hash[hit], first)

    def itself(self) -> None:
        """Rows of one cell find each other and themselves, but for cores: those are summed over all blocks of a leaf."""
        first, n = self.start, self.size
        order = np.argsort(first)
        first, n, core = first[order], n[order], self.core[order]
        own = np.repeat(core < 0, n)
        self.n += np.where(own, np.repeat(n, n), 0)
        self.least = np.where(own, np.minimum(self.least, np.repeat(np.minimum.reduceat(self.ids, first), n)), self.least)
        self.print ^= np.where(own, np.repeat(np.bitwise_xor.reduceat(self.hash, first), n), 0)

    def found(self, whole: bool) -> pa.RecordBatch:
        """(id, n, least, print, cell) of the rows that found any, of all if whole; only then with their cell."""
        at = np.arange(len(self.ids)) if whole else np.flatnonzero(self.n)
        cell = np.where(self.cell[at] < 0, self.cell[at], (self.number << 32) + self.cell[at]) if whole else np.full(len(at), NO_CELL)
        return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (self.ids, self.n, self.least, self.print)] + [pa.array(cell)], names=["id", "n", "least", "print", "cell"])


def _meet(a: Block, b: Block, least: float, angle: float, rows: int = 1024) -> None:
    """Each two similar rows of the blocks, or of two cells of one, find each other.

    Rows of two cells can be within `angle` only if the centres are within that and
    the cells' own angles, so the centres are compared first; of these the coordinates
    along the widest axes, where the rest counts as its lengths' product, the most it can add.
    """
    same = a is b

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.einsum("ij,ij->i", unit(a.v[i]), unit(b.v[j])) >= least - 1e-12
        i, j = i[ok], j[ok]
        if len(i):
            a.hears(i, b, j)
            b.hears(j, a, i)

    def large(q: int, h: int) -> None:
        """All rows of two cells of many rows."""
        right = slice(b.start[h], b.start[h] + b.size[h])
        y, step = unit(b.v[right]).astype(np.float32).T, max(1, 2_000_000 // int(b.size[h]))
        for s in range(int(a.start[q]), int(a.start[q] + a.size[q]), step):
            e = min(s + step, int(a.start[q] + a.size[q]))
            near = unit(a.v[s:e]).astype(np.float32) @ y
            i, j = np.divmod(np.flatnonzero(near.ravel() >= least - 1e-5), near.shape[1])
            for k in range(0, len(i), 100_000):
                pairs(i[k : k + 100_000] + s, j[k : k + 100_000] + right.start)

    basis = np.linalg.eigh((a.centre.T @ a.centre + b.centre.T @ b.centre).astype(np.float64))[1][:, ::-1].astype(np.float32)
    heads = []
    for c in (a.centre, b.centre):
        y = c @ basis
        y[:, HEAD] = np.sqrt(np.einsum("ij,ij->i", y[:, HEAD:], y[:, HEAD:]))
        heads.append(np.ascontiguousarray(y[:, : HEAD + 1]))
    room = np.empty(rows * rows, dtype=np.float32)
    for s in range(0, len(a.start), rows):
        left, wide = heads[0][s : s + rows], a.wide[s : s + rows][-1] + angle
        for t in range(s if same else 0, len(b.start), rows):
            right = heads[1][t : t + rows]
            near = np.matmul(left, right.T, out=room[: len(left) * len(right)].reshape(len(left), len(right)))
            least_near = math.cos(min(math.pi, wide + b.wide[t : t + rows][-1])) - 1e-5
            some = np.flatnonzero(near.max(axis=1) >= least_near)
            if not len(some):
                continue
            q, h = np.divmod(np.flatnonzero((near if len(some) == len(near) else near[some]).ravel() >= least_near), near.shape[1])
            q, h = some[q] + s, h + t
            ok = np.einsum("ij,ij->i", a.centre[q], b.centre[h]) >= np.cos(np.minimum(np.pi, angle + a.wide[q] + b.wide[h])) - 1e-5
            q, h = q[ok], h[ok]
            if same:
                q, h = q[q < h], h[q < h]
            ok = (a.core[q] < 0) | (a.core[q] != b.core[h])
            q, h = q[ok], h[ok]
            n = a.size[q] * b.size[h]
            for k in np.flatnonzero(n > 65_536).tolist():
                large(int(q[k]), int(h[k]))
            q, h = q[n <= 65_536], h[n <= 65_536]
            n = a.size[q] * b.size[h]
            done = np.cumsum(n)
            cuts = np.searchsorted(done, np.arange(0, int(done[-1]) if len(n) else 0, 65_536), side="left")
            for u, w in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)]):
                if u < w:
                    many = n[u:w]
                    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    across = np.repeat(b.size[h[u:w]], many)
                    pairs(np.repeat(a.start[q[u:w]], many) + nth // across, np.repeat(b.start[h[u:w]], many) + nth % across)


def _neighbours(least: float, angle: float):
    """What the rows of two blocks find of each other, of a block and itself what they find in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Block | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                one = [batch.column(i)[k] for i in range(10)]
                own = one[0].as_py() == one[5].as_py()
                made = [None if number.as_py() is None else (number.as_py(), *(x.as_buffer() for x in rest)) for number, *rest in (one[:5], one[5:])]
                if a is None or a.number != made[0][0]:
                    a = Block(*made[0])
                a.forget()
                if own:
                    a.itself()
                b = a if own else Block(*made[1])
                _meet(a, b, least, angle)
                yield a.found(own)
                if not own:
                    yield b.found(False)

    return run


def similar_groups(rows: DataFrame, least: float = 0.9, smallest: int = 3, leaf: int | None = None, margin: float | None = None, block: int | None = None, tree: Tree | None = None) -> DataFrame:
    """(cluster_id, id): the groups of at least `smallest` rows, each two similar by cosine >= least, that no other row reaches.

    rows has a unique id and a usable vector v per row (see vector_rows.usable);
    cluster_id is the smallest id of the group. Rows in no such group don't come
    out; equal vectors are similar; an empty table gives no rows.

    The default margin, sqrt((1 - least) / 2), is half the greatest distance of two similar
    rows and finds every similar pair; a smaller one may miss some. leaf is the tree's, block the most rows that are packed as one;
    both are by default an eighth of the rows within bounds.
    """
    margin = math.sqrt((1 - least) / 2) + 1e-9 if margin is None else margin
    tree = bisect(rows, least, leaf) if tree is None else tree
    block = leaf_rows(int(tree.count[0])) if block is None else block
    placed = rows.select("id", "v").mapInArrow(_spread(tree, least, block), "blk long, core long, id long, v array<float>")
    parts = placed.repartition("blk").sortWithinPartitions("blk").mapInArrow(_packed(least), "blk long, ids binary, v binary, cell binary, core binary")
    left = stored(parts, "blocks", maxRecordsPerFile=1)
    right = left.select(*[F.col(c).alias(f"{c}_b") for c in left.columns])
    # Each two blocks once, as often from the left as from the right: no shuffle, each task reads some blocks of either side.
    even, order = (F.col("blk") + F.col("blk_b")) % 2 == 0, F.col("blk") < F.col("blk_b")
    two = left.join(right.hint("shuffle_replicate_nl"), (F.col("blk") == F.col("blk_b")) | ((F.col("blk") != F.col("blk_b")) & (even == order)))
    each = two.mapInArrow(_neighbours(least, 2 * math.asin(min(1, margin))), "id long, n long, least long, print long, cell long")
    if (tree.count[tree.child[:, 0] < 0] > block).any():
        core = rows.select("id", "v").mapInArrow(_core(tree, least, block), "id long, leaf long, h long")
        cores = core.groupBy("leaf").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.bit_xor("h").alias("print"))
        each = each.unionByName(core.select("id", "leaf").join(cores, "leaf").select("id", "n", "least", "print", F.lit(NO_CELL).cast("bigint").alias("cell")))
    each = each.groupBy("id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.bit_xor("print").alias("print"), F.max("cell").alias("cell"))
    each = stored(each, "neighbours")
    # A leaf is a group if all its rows have the same neighbours, as many as the leaf has rows.
    key = ["least", "n", "print"]
    same = [F.min(c) == F.max(c) for c in key]
    leaves = each.groupBy("cell").agg(F.count("*").alias("size"), F.min("n").alias("n"), (same[0] & same[1] & same[2]).alias("same"))
    whole_leaves = leaves.where(F.col("same") & (F.col("size") == F.col("n"))).select("cell", "size")
    from_leaves = each.join(whole_leaves.where(F.col("size") >= smallest), "cell", "left_semi")
    # The leaves that a plane cut from others: their rows are a group if they are all that have these neighbours.
    cut = each.where(F.col("n") >= smallest).join(whole_leaves, "cell", "left_anti")
    whole = cut.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") == F.col("n")).select(*key)
    found = from_leaves.select("least", "id").unionByName(cut.join(whole, key, "left_semi").select("least", "id"))
    return found.select(F.col("least").alias("cluster_id"), "id")


def _core(tree: Tree, least: float, block: int):
    """The core rows with their leaf, see _core_of."""

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids = unit(usable_rows(b.column("v"))[1]), b.column("id").to_numpy()
                leaf = tree.leaf_of(x)
                own = _core_of(tree, x, leaf, least, block)
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (ids, leaf, _mix(ids))], names=["id", "leaf", "h"])

    return core


def describe(groups: DataFrame, rows: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each group with its size and the members nearest to its centre, ties by the smaller id.

    The centre is the mean of the members' unit vectors; cosines to it are compared after rounding to six decimals.
    """
    member = stored(groups.join(rows.select("id", "v"), "id").select("cluster_id", "id", "v"), "members")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, key = unit(usable_rows(b.column("v"))[1]), b.column("cluster_id").to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(key[order][first]), pa.array(np.diff(np.append(first, len(key)))), pa.array(np.add.reduceat(x[order], first).tolist(), pa.list_(pa.float64()))], names=["key", "n", "s"])

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(usable_rows(b.column("v"))[1])
                c = b.column("s").flatten().to_numpy().reshape(-1, DIMENSIONS)
                cos = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
                yield pa.RecordBatch.from_arrays([b.column("cluster_id"), b.column("id"), b.column("n"), pa.array(np.round(cos, 6))], names=["cluster_id", "id", "size", "cos"])

    centres = summed(member.mapInArrow(part, "key long, n long, s array<double>"), DIMENSIONS).withColumnRenamed("key", "cluster_id")
    near = member.join(centres, "cluster_id").mapInArrow(closeness, "cluster_id long, id long, size long, cos double")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("cos").desc(), "id"))).where(F.col("place") <= typical)
    return best.groupBy("cluster_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda m: m["id"]).alias("typical"))
