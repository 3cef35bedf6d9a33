"""Vector kernels over Arrow batches: products of matrices that are reduced inside the batch, sums of vectors, passes over sorted rows.

Nothing that grows as rows times labels leaves a batch: what goes on is one row per row (argmax, counts) or one per label.
A product of a batch with all labels is made in pieces of CELLS numbers, however many labels there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of label vectors that are sent to every task at a time; more labels go in several lots. Rows of a batch that are scored at a time, numbers of a product that are held at a time.
SIDE_BYTES = 64 << 20
ROWS = 2048
CELLS = 1 << 20
#: What a product in single precision of vectors of length one may be wrong by, with room to spare for the rounding to six decimals.
DOUBT = 2e-5


def unit_rows(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of `width` finite numbers, not all zero, and these scaled to length one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    import pyarrow.compute as pc

    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == width)
    flat = lists.take(pa.array(rows, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    size = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    good = np.isfinite(size) & (size > 0)
    return rows[good], flat[good] / size[good][:, None]


def scored(rows: DataFrame, keys: list[str], vector: str, side: DataFrame, label: str, label_vector: str, reduce: Callable | type, schema: str, more: Sequence[str] = (), merge: Callable | None = None) -> DataFrame:
    """What `reduce` makes of the cosines (six decimals) of each batch of rows to the labels.

    reduce(keys as Arrow columns, s as a matrix, labels) gives the columns of schema. The labels are
    counted first; up to SIDE_BYTES of them are sent to the tasks as one table, more as several
    by a hash, each against all rows, so the result of a reduce must be one that can be merged.
    A reduce with a method `begin` makes its products itself and may keep a state for the task: begin(labels, their vectors of
    length one, the columns `more` of the labels) gives an object with add(keys, vectors of length one) and end(), each giving columns or None.
    merge: makes one row of those that several lots give; it isn't called where there is one lot.
    """
    side = side.select(F.col(label).alias("_label"), F.col(label_vector).cast("array<double>").alias("_v"), *more).where(F.col("_label").isNotNull() & (F.size("_v") > 0))
    stats = side.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("w")).first()
    lots = max(1, -(-(stats.n * (8 * (stats.w or 0) + 16)) // SIDE_BYTES))
    kind = rows.schema[vector].dataType.simpleString()
    given = rows.select(*keys, (F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")).alias("_x"))
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    out = None
    for lot in range(lots):
        part = side if lots == 1 else side.where(F.pmod(F.xxhash64("_label"), F.lit(lots)) == lot)
        sent = rows.sparkSession.sparkContext.broadcast(part.toArrow().combine_chunks())
        one = given.mapInArrow(_scorer(sent, keys, reduce, names, list(more)), schema)
        out = one if out is None else out.unionByName(one)
    return merge(out) if merge and lots > 1 else out


class _Each:
    """The state of a plain reduce: none."""

    def __init__(self, reduce: Callable, labels: pa.Array, t: np.ndarray):
        self.reduce, self.labels, self.t = reduce, labels, t
        self.rows = max(1, min(ROWS, CELLS // len(t)))

    def add(self, keys: list[pa.Array], x: np.ndarray) -> list | None:
        parts = [self.reduce([k.slice(s, self.rows) for k in keys], np.round(x[s : s + self.rows] @ self.t.T, 6), self.labels) for s in range(0, len(x), self.rows)]
        return parts[0] if len(parts) == 1 else [pa.concat_arrays(c) for c in zip(*parts)]

    def end(self) -> None:
        return None


def _scorer(sent, keys: list[str], reduce: Callable | type, names: list[str], more: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if not table.num_rows:
            return
        vectors = table.column("_v").combine_chunks()
        width = max((len(v) for v in vectors[:100]), default=0)
        which, t = unit_rows(vectors, width)
        if not len(which):
            return
        at = pa.array(which, pa.int64())
        labels, columns = table.column("_label").combine_chunks().take(at), [table.column(c).combine_chunks().take(at) for c in more]
        state = reduce.begin(labels, t, columns) if hasattr(reduce, "begin") else _Each(reduce, labels, t)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                own, x = unit_rows(b.column("_x"), width)
                if len(own):
                    at = pa.array(own, pa.int64())
                    yield from _packed(state.add([b.column(k).take(at) for k in keys], x), names)
        yield from _packed(state.end(), names)

    return run


def _packed(columns: list | None, names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    if columns is not None:
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for s in range(0, whole.num_rows, most):
            yield whole.slice(s, most)


class TopLabels:
    """Of each row: the up to k labels with the greatest similarity of at least `least`, ties by the smaller label; a label that is the first key only if itself. Gives the keys, label and similarity.

    Products are made in single precision, in pieces; what can be among the first k is computed again in double precision.
    """

    def __init__(self, k: int = 1, least: float = -2.0, itself: bool = True):
        self.k, self.least, self.itself = k, least, itself

    def begin(self, labels: pa.Array, t: np.ndarray, more: list) -> TopLabels:
        new = TopLabels(self.k, self.least, self.itself)
        order = labels.to_numpy(zero_copy_only=False).argsort(kind="stable")
        new.labels, new.t = labels.take(pa.array(order)), t[order]
        new.names, new.t32 = new.labels.to_numpy(zero_copy_only=False), new.t.astype(np.float32)
        new.width = 2048
        new.rows = max(1, CELLS // new.width)
        return new

    def add(self, keys: list[pa.Array], x: np.ndarray) -> list:
        rows, at, s = (np.concatenate(c) for c in zip(*[self._piece(keys[0].slice(i, self.rows), x[i : i + self.rows], i) for i in range(0, len(x), self.rows)]))
        return [*[key.take(pa.array(rows)) for key in keys], self.labels.take(pa.array(at)), pa.array(s)]

    def end(self) -> None:
        return None

    def _piece(self, first: pa.Array, x: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, ids, x32 = self.k, None if self.itself else first.to_numpy(zero_copy_only=False), x.astype(np.float32)
        top = np.full((len(x), k), -9, dtype=np.float32)  # of each row k values that are reached by as many labels, ascending
        rows, at = [], []
        for c in range(0, len(self.t), self.width):
            s = x32 @ self.t32[c : c + self.width].T
            if ids is not None:
                own = np.searchsorted(self.names, ids)
                own_row = np.flatnonzero((own >= c) & (own < c + s.shape[1]))
                own_row = own_row[self.names[own[own_row]] == ids[own_row]]
                s[own_row, own[own_row] - c] = -9
            most = s.max(axis=1)
            go = np.flatnonzero((most >= top[:, 0] - DOUBT) & (most >= self.least - DOUBT))
            if not len(go):
                continue
            s = s if len(go) == len(s) else s[go]
            if k == 1:
                top[go, 0] = np.maximum(top[go, 0], most[go])
            else:
                parts = max(k, s.shape[1] // 64)
                whole = s.shape[1] // parts * parts
                # Each of the labels' parts has a label that reaches the part's greatest value, so the k greatest of these are values that k labels reach.
                tops = np.hstack([s[:, :whole].reshape(len(s), -1, parts).max(axis=1), s[:, whole:]]) if whole else s
                have = np.hstack([top[go], tops])
                top[go] = np.sort(np.partition(have, have.shape[1] - k, axis=1)[:, -k:], axis=1)
            r, j = np.divmod(np.flatnonzero(s >= (np.maximum(top[go, :1], self.least) - DOUBT).astype(np.float32)), s.shape[1])
            rows.append(go[r])
            at.append(j + c)
        r, j = (np.concatenate(v) if v else np.empty(0, dtype=np.int64) for v in (rows, at))
        exact = np.round(np.einsum("ij,ij->i", x[r], self.t[j]), 6)
        good = exact >= self.least
        if ids is not None:
            good &= self.names[j] != ids[r]
        r, j, exact = r[good], j[good], exact[good]
        order = np.lexsort((j, -exact, r))
        r, j, exact = r[order], j[order], exact[order]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, dtype=np.int64)
        place = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
        kept = place < k
        return r[kept] + start, j[kept], exact[kept]


class TopRows:
    """Of each label: the up to k rows of a task with the greatest similarity of at least `least`, ties by the first key; a row whose first key is the label only if itself. Gives label, the keys and the similarity.

    nth: several rows have the same first key and only the best counts, ties by the second key. apart: the last key and the column `more` of the
    labels are lists of numbers, and a row and a label that share one aren't paired; the list isn't given.
    A task keeps k rows a label, and what a further row must reach grows with them. Products as in TopLabels.
    """

    def __init__(self, k: int, least: float, itself: bool = False, nth: bool = False, apart: bool = False):
        self.k, self.least, self.itself, self.nth, self.apart = k, least, itself, nth, apart

    def begin(self, labels: pa.Array, t: np.ndarray, more: list) -> TopRows:
        new = TopRows(self.k, self.least, self.itself, self.nth, self.apart)
        new.labels, new.names, new.t, new.t32 = labels, labels.to_numpy(zero_copy_only=False), t, t.astype(np.float32)
        new.enough = np.full(len(t), self.least)
        new.held, new.fresh, new.waiting = None, [], 0
        if self.apart:
            owner, value = _unnested(more[0])
            new.known = np.unique(value)
            new.pairs = np.unique(owner * max(1, len(new.known)) + np.searchsorted(new.known, value))
        new.rows = max(1, min(512, CELLS // len(t)))
        return new

    def add(self, keys: list[pa.Array], x: np.ndarray) -> None:
        names, x32 = keys[0].to_numpy(zero_copy_only=False), x.astype(np.float32)
        for s in range(0, len(x), self.rows):
            near = x32[s : s + self.rows] @ self.t32.T
            r, c = np.divmod(np.flatnonzero(near >= (self.enough - DOUBT).astype(np.float32)), len(self.t))
            r += s
            exact = np.empty(len(r))
            for i in range(0, len(r), 100_000):
                exact[i : i + 100_000] = np.einsum("ij,ij->i", x[r[i : i + 100_000]], self.t[c[i : i + 100_000]])
            exact = np.round(exact, 6)
            good = exact >= self.enough[c]
            if not self.itself:
                good &= names[r] != self.names[c]
            r, c, exact = r[good], c[good], exact[good]
            if self.apart and len(r):
                alone = ~self._sharing(keys[-1], r, c)
                r, c, exact = r[alone], c[alone], exact[alone]
            if len(r):
                at = pa.array(r)
                self.fresh.append((c, exact, [k.take(at) for k in (keys[:-1] if self.apart else keys)]))
                self.waiting += len(r)
                if self.waiting > max(200_000, 0 if self.held is None else len(self.held[0])):
                    self._merge()

    def _sharing(self, lists: pa.Array, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the row and the label of each pair have a number in common."""
        owner, value = _unnested(lists)
        count = np.bincount(owner, minlength=len(lists))
        first = np.cumsum(count) - count
        times = count[r]
        pair = np.repeat(np.arange(len(r)), times)
        value = value[np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[r], times)]
        shared = np.zeros(len(r), dtype=bool)
        if len(self.known) and len(pair):
            place = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
            code = c[pair] * len(self.known) + place
            found = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            shared[pair[(self.known[place] == value) & (self.pairs[found] == code)]] = True
        return shared

    def _merge(self) -> None:
        if not self.fresh:
            return
        parts = self.fresh if self.held is None else [self.held, *self.fresh]
        c, s, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [pa.concat_arrays(k) for k in zip(*[p[2] for p in parts])]
        first = keys[0].to_numpy(zero_copy_only=False)
        order = np.lexsort((*((keys[1].to_numpy(zero_copy_only=False),) if self.nth else ()), first, -s, c))
        if self.nth:
            again = order[np.lexsort((first[order], c[order]))]  # stable: of one label and first key the best comes first
            new = np.append(True, (c[again][1:] != c[again][:-1]) | (first[again][1:] != first[again][:-1]))
            one = np.zeros(len(c), dtype=bool)
            one[again[new]] = True
            order = order[one[order]]
        at = c[order]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.enough[c[full]] = s[full]
        self.held, self.fresh, self.waiting = (c[kept], s[kept], [k.take(pa.array(kept)) for k in keys]), [], 0

    def end(self) -> list | None:
        self._merge()
        return None if self.held is None else [self.labels.take(pa.array(self.held[0])), *self.held[2], pa.array(self.held[1])]


def _unnested(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(list, number) of the numbers in lists; a null list has none."""
    import pyarrow.compute as pc

    return pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)


def best(keys, s, labels):
    """The most similar label of each row; ties by the smaller label."""
    order = labels.to_numpy(zero_copy_only=False).argsort(kind="stable")
    at = order[s[:, order].argmax(axis=1)]
    return [*keys, labels.take(pa.array(at)), pa.array(s[np.arange(len(s)), at])]


def hits_per_label(least: float):
    """Of each label: how many rows reach `least`, the greatest and the summed similarity of these."""

    def reduce(keys, s, labels):
        hit = s >= least
        n = hit.sum(axis=0)
        at = np.flatnonzero(n)
        return [labels.take(pa.array(at)), pa.array(n[at].astype(np.int64)), pa.array(np.where(hit, s, -2).max(axis=0)[at]), pa.array(np.where(hit, s, 0).sum(axis=0)[at])]

    return reduce


def labels_between(low: float, high: float):
    """Of each row: how many labels lie from low to high."""
    return lambda keys, s, labels: [*keys, pa.array(((s >= low) & (s <= high)).sum(axis=1).astype(np.int64))]


def top_rows(k: int, least: float, itself: bool = False):
    """Of each label: the up to k rows of the batch with the greatest similarity of at least `least`, ties by the first key; a row whose first key is the label only if itself."""

    def reduce(keys, s, labels):
        ids, names = keys[0].to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
        if not itself:
            s = np.where(ids[:, None] == names[None, :], -2, s)
        rows, cols = [], []
        cut = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
        for j in np.flatnonzero(s.max(axis=0) >= least):
            near = np.flatnonzero(s[:, j] >= max(cut[j], least))
            near = near[np.lexsort((ids[near], -s[near, j]))][:k]
            rows.append(near)
            cols.append(np.full(len(near), j))
        r, c = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (rows, cols))
        return [labels.take(pa.array(c, pa.int64())), *[key.take(pa.array(r, pa.int64())) for key in keys], pa.array(s[r, c])]

    return reduce


def pairs_from(least: float, ordered: bool = True):
    """Rows and labels with a similarity of at least `least`; ordered: the first key below the label, else different from it."""

    def reduce(keys, s, labels):
        ids, names = keys[0].to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
        r, c = np.nonzero(s >= least)
        r, c = (x[ids[r] < names[c] if ordered else ids[r] != names[c]] for x in (r, c))
        return [*[k.take(pa.array(r)) for k in keys], labels.take(pa.array(c)), pa.array(s[r, c])]

    return reduce


def weighted_means(df: DataFrame, group: str, vector: str, weight: Column | None = None, width: int | None = None) -> DataFrame:
    """(group, n, v): the number of vectors of each group and their weighted mean scaled to length one, six decimals; zero sums stay zero.

    Vectors are taken as they are. Every batch sends one sum per group; a second pass over rows sorted by group adds
    them, holding one sum at a time. Rows with a null group or vector are left out, and, where width is given,
    vectors of other length; without it all must have the same.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("g").isNotNull() & F.col("w").isNotNull() & (F.size("x") == width if width else F.size("x") > 0))
    schema = f"g {kind}, n long, s array<double>"

    def listed(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = b.column("g").dictionary_encode()
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) * b.column("w").to_numpy()[:, None]
                at = code.indices.to_numpy()
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at[order][first])), pa.array(np.diff(np.append(first, len(at)))), listed(np.add.reduceat(x[order], first))], names=["g", "n", "s"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # group, n, sum
        for b in batches:
            if not b.num_rows:
                continue
            code, kind_of = b.column("g").dictionary_encode(), b.column("g").type
            at, s, n = code.indices.to_numpy(), b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("n").to_numpy()
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            sums, counts = np.add.reduceat(s, first), np.add.reduceat(n, first)
            names = code.dictionary.take(pa.array(at[first])).to_pylist()
            if held is not None and held[0] == names[0]:
                sums[0] += held[2]
                counts[0] += held[1]
            elif held is not None:
                yield out([held[0]], np.array([held[1]]), held[2][None], kind_of)
            if len(names) > 1:
                yield out(names[:-1], counts[:-1], sums[:-1], kind_of)
            held = names[-1], int(counts[-1]), sums[-1]
        if held is not None:
            yield out([held[0]], np.array([held[1]]), held[2][None], kind_of)

    def out(names: list, n: np.ndarray, s: np.ndarray, kind_of: pa.DataType) -> pa.RecordBatch:
        size = np.sqrt(np.einsum("ij,ij->i", s, s))[:, None]
        return pa.RecordBatch.from_arrays([pa.array(names, kind_of), pa.array(n), listed(np.round(s / np.where(size > 0, size, 1), 6) + 0.0)], names=["g", "n", "s"])

    sums = rows.mapInArrow(part, schema).repartition("g").sortWithinPartitions("g").mapInArrow(whole, schema)
    return sums.select(F.col("g").alias(group), "n", F.col("s").alias("v"))


def per_entity(df: DataFrame, entity: str, order: list[str], columns: list[str], run: Callable, schema: str) -> DataFrame:
    """run(entity, {column: array}) for the whole sequence of each entity, rows in order; gives lists of columns of schema (without the entity).

    One task holds one entity's sequence at a time: for sequences that are bounded by what they are, such as
    the frames of one video.
    """
    kind = df.schema[entity].dataType.simpleString()
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    types = df.sparkSession.createDataFrame([], f"{entity} {kind}, {schema}")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        owner = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                got = run(owner, {c: t.column(c).combine_chunks() for c in [*order, *columns]})
                if got is not None and len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([owner] * len(got[0]), t.column(entity).type), *[g if isinstance(g, pa.Array) else pa.array(g) for g in got]], names=[entity, *names])

        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(entity).dictionary_encode()
            at = code.indices.to_numpy()
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            for s, e in zip(first, np.append(first[1:], b.num_rows)):
                name = code.dictionary[int(at[s])].as_py()
                if held and name != owner:
                    yield from done()
                    held = []
                owner = name
                held.append(b.slice(int(s), int(e - s)))
        yield from done()

    rows = df.select(entity, *order, *columns).dropna(subset=[entity]).repartition(entity).sortWithinPartitions(entity, *order)
    return rows.mapInArrow(go, types.schema)


def sliding(df: DataFrame, entity: str, order: str, columns: list[str], width: int, run: Callable, schema: str) -> DataFrame:
    """(entity, order, ...): run({column: array}, begin, end) gives the columns of schema for the rows begin to end of a stretch of an entity's sequence that has up to `width` further rows on each side.

    A task reads its entities in order and holds one batch and 2 * width rows, however long an entity is.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (entity, order)}
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # of one entity: rows that are done but still neighbours, then rows that wait
        done, owner = 0, None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, done
            if held is None:
                return
            end = held.num_rows if last else held.num_rows - width
            if end > done:
                t = held.combine_chunks()
                got = run({c: t.column(c).combine_chunks() for c in columns}, done, end)
                part = t.slice(done, end - done)
                yield pa.RecordBatch.from_arrays([part.column(entity).combine_chunks(), part.column(order).combine_chunks(), *got], names=[entity, order, *names])
                keep = max(0, end - width)
                held, done = t.slice(keep), end - keep
            if last:
                held, done = None, 0

        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(entity).dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            for s, e in zip(first, np.append(first[1:], b.num_rows)):
                name = b.column(entity)[int(s)].as_py()
                if held is not None and name != owner:
                    yield from flush(True)
                owner, part = name, pa.Table.from_batches([b.slice(int(s), int(e - s))])
                held = part if held is None else pa.concat_tables([held, part])
            yield from flush(False)
        yield from flush(True)

    rows = df.select(entity, order, *columns).dropna(subset=[entity]).repartition(entity).sortWithinPartitions(entity, order)
    return rows.mapInArrow(go, f"{entity} {kinds[entity]}, {order} {kinds[order]}, {schema}")
