"""Problem 8: evaluation texts in training text, by rare n-gram seeds and local alignment.

A seed is the shortest run of 3, 5 or 7 words from a place of an item that few
items hold; how many hold it is counted once over all items. Where even the
longest is held by many, it is a seed all the same, so variants of one item lose
no place. Where seeds of one item that lie close together in a document, in the
item's order, cover enough of its words, the two stretches are aligned word by word
(Smith-Waterman, linear gaps). The alignment
counts altered, added and dropped words against the shared ones, so a copy with one
word in eight changed passes and any number of short shared phrases doesn't.

The documents are never shuffled: what is found in a document depends on the
document and the items alone, so neither a hot item nor a copied document makes a
hot task, and into how many indexes the items are cut changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .words import words

#: Words of a seed, shortest first, and the different items that may hold one before it grows (the longest may be held by any number).
SEEDS = (3, 5, 7)
RARE = 8
#: Words of an item within a window of it that seeds must cover, so that it is a candidate; places of one diagonal band.
#: 17 equal words of 20 are at worst runs of 2, 2, 2 and 11 words; less, as where many items share a stretch its seeds are longer.
COVER, WINDOW, BAND = 8, 20, 16
#: A leak: words of the alignment that agree, and its score (agreeing words less altered, added and dropped ones).
AGREE, SCORE = 17, 14
#: Words of a passage; a shorter item must be there as a whole, and one under the least can't be told from a phrase.
PASSAGE, LEAST = 20, 8
#: Words of items that one index may hold; more items are handled as several indexes, one after the other.
INDEX_WORDS = 4_000_000


def needed(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(equal words, score, words covered by seeds) that an item of so many words must reach."""
    short = length < PASSAGE
    agree = np.where(short, np.ceil(length * 7 / 8), AGREE)
    score = np.where(short, np.ceil(length * SCORE / PASSAGE), SCORE)
    cover = np.clip(length - 3 * np.ceil(length / 8), SEEDS[0], COVER)
    return agree.astype(np.int64), score.astype(np.int64), cover.astype(np.int64)


def _rolled(tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of n numbers, and whether all of a run's are known (not negative)."""
    m = max(0, len(tokens) - n + 1)
    h, known = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
    x = (tokens + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(n):
        h = h * np.uint64(0x94D049BB133111EB) + x[k : k + m]
        known &= tokens[k : k + m] >= 0
    return h, known


@dataclass
class ItemIndex:
    """The items' words as numbers and, for each length, where each seed occurs."""

    vocabulary: dict[str, int]
    texts: list[np.ndarray]
    ids: list
    places: dict[int, tuple]  # length: sorted seeds, where the places of each begin and the end, item, place


def build_index(items: Iterable[tuple]) -> ItemIndex:
    """The index of (id, words, {length: places whose seed of that length many items hold}); items under LEAST words can't leak."""
    vocabulary: dict[str, int] = {}
    texts, ids, common = [], [], []
    for i, w, many in items:
        if len(w) >= LEAST:
            texts.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], dtype=np.int64))
            ids.append(i)
            common.append(many)
    places = {}
    open_at = [np.ones(len(t), dtype=bool) for t in texts]  # places without a seed so far
    for n in SEEDS:
        keys, item, at = [], [], []
        for k, t in enumerate(texts):
            h, _ = _rolled(t, n)
            take = open_at[k][: len(h)].copy()
            if n < SEEDS[-1]:
                take[[p for p in common[k].get(n, ()) if p < len(h)]] = False
            own = np.flatnonzero(take)
            open_at[k][own] = False
            keys.append(h[own])
            item.append(np.full(len(own), k))
            at.append(own)
        if texts:
            key, item, at = np.concatenate(keys), np.concatenate(item), np.concatenate(at)
            order = np.argsort(key, kind="stable")
            sorted_keys, start = np.unique(key[order], return_index=True)
            if len(sorted_keys):
                places[n] = sorted_keys, np.append(start, len(key)), item[order], at[order]
    return ItemIndex(vocabulary, texts, ids, places)


def candidates(index: ItemIndex, tokens: np.ndarray, doc: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Rows (document, item, place in the document, place in the item): one for each band of the diagonal in which seeds crowd.

    tokens: the words of several documents, each followed by as many -1 as the longest seed has words; doc: whose they are.
    """
    parts = []
    for n, (keys, first, items, places) in index.places.items():
        key, known = _rolled(tokens, n)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        q = np.flatnonzero((keys[place] == key) & known)
        count = first[place[q] + 1] - first[place[q]]
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[place[q]], count)
        q = np.repeat(q, count)
        parts.append((doc[q], items[j], places[j], q, np.full(len(q), n)))
    none = np.empty((0, 4), dtype=np.int64)
    if not parts:
        return none
    d, item, p, q, size = (np.concatenate(c) for c in zip(*parts))
    if not len(d):
        return none
    out = []
    for shift in (0, BAND // 2):  # two overlapping sets of bands
        band = (q - p + shift) // BAND
        order = np.lexsort((q, -size, p, band, item, d))
        d_, i_, b_, p_, q_, w_ = (c[order] for c in (d, item, band, p, q, size))
        new = np.ones(len(d_), dtype=bool)
        new[1:] = (d_[1:] != d_[:-1]) | (i_[1:] != i_[:-1]) | (b_[1:] != b_[:-1])
        group = np.cumsum(new)
        line = group * (int(p_.max()) + WINDOW + SEEDS[-1] + 1) + p_
        # Words that a seed adds to those that the seeds before it in its group cover.
        reach = np.maximum.accumulate(np.append(0, line + w_))
        added = np.clip(line + w_ - np.maximum(reach[:-1], line), 0, None)
        total = np.append(0, np.cumsum(added))
        begin = np.maximum(np.searchsorted(line, line - WINDOW + 1), np.searchsorted(group, group))
        c = np.flatnonzero(total[1:] - total[begin] + w_[begin] - added[begin] >= cover[i_])
        c = c[np.append(True, group[c][1:] != group[c][:-1])] if len(c) else c
        out.append(np.stack([d_[c], i_[c], q_[c], p_[c]], axis=1))
    return np.concatenate(out)


def alignments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, equal words) of the best local alignment of each row of a with the row of b: +1 for an equal word, -1 for any change.

    Of several alignments of one score that with the most equal words. A cell is
    score * unit + equal words. A row of cells at a time: gaps along the row are a
    running maximum of the cells with the gap's cost added back.
    """
    small = max(a.shape[1], b.shape[1]) < 1 << 15
    kind, unit = (np.int32, 1 << 15) if small else (np.int64, 1 << 24)
    cost = np.arange(b.shape[1], dtype=kind) * kind(unit)
    above, best = np.zeros(b.shape, dtype=kind), np.zeros(len(a), dtype=kind)
    for i in range(a.shape[1]):
        step = np.where(b == a[:, i : i + 1], kind(unit + 1), kind(-unit))
        step[:, 1:] += above[:, :-1]
        cell = np.maximum(above - kind(unit), step)
        cell += cost
        np.maximum.accumulate(cell, axis=1, out=cell)
        cell -= cost
        cell[cell < unit] = 0
        best = np.maximum(best, cell.max(axis=1))
        above = cell
    return best // unit, best % unit


def leaks_of(index: ItemIndex, texts: list[str]) -> list[tuple]:
    """(text number, item id, score, equal words) of every leak in the texts."""
    if not index.texts:
        return []
    known, pad = index.vocabulary, SEEDS[-1]
    split = [[known.get(w, -1) for w in words(t)] for t in texts]
    starts = np.cumsum([0, *[len(s) + pad for s in split]])
    tokens = np.full(int(starts[-1]), -1, dtype=np.int64)
    for s, at in zip(split, starts.tolist()):
        tokens[at : at + len(s)] = s
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    length = np.array([len(t) for t in index.texts])
    agree, least, cover = needed(length)
    found = candidates(index, tokens, doc, cover)
    if not len(found):
        return []
    # The stretch of the document: as long as the item on both sides of the seed, and some more for what was added.
    own = length[found[:, 1]]
    low = np.maximum(found[:, 2] - found[:, 3] - own // 2 - BAND, starts[found[:, 0]])
    high = np.minimum(found[:, 2] + (own - found[:, 3]) + own // 2 + BAND, starts[found[:, 0] + 1] - pad)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    order = np.argsort(own, kind="stable")
    for s in range(0, len(order), 256):
        rows = order[s : s + 256]
        # Rows of like length together; very long items go in smaller lots.
        lot = max(1, 1_000_000 // max(1, int((high - low)[rows].max())))
        for r in (rows[k : k + lot] for k in range(0, len(rows), lot)):
            a = np.full((len(r), int(own[r].max())), -3, dtype=np.int32)
            b = np.full((len(r), int((high - low)[r].max())), -2, dtype=np.int32)
            for k, i in enumerate(r.tolist()):
                t = index.texts[found[i, 1]]
                a[k, : len(t)] = t
                b[k, : high[i] - low[i]] = tokens[low[i] : high[i]]
            score, equal = alignments(a, b)
            for k in np.flatnonzero((score >= least[found[r, 1]]) & (equal >= agree[found[r, 1]])).tolist():
                key = (int(found[r[k], 0]), int(found[r[k], 1]))
                out[key] = max(out.get(key, (0, 0)), (int(score[k]), int(equal[k])))
    return [(d, index.ids[i], s, e) for (d, i), (s, e) in sorted(out.items())]


def _split(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(i, x, y, w): the items with at least LEAST words, and two hashes that stand for the words."""
    kind = items.schema[item_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([words(t.decode(errors="replace")) for t in b.column("t").to_pylist()], pa.list_(pa.string()))], names=["i", "w"])

    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("t")).where(F.col("i").isNotNull() & (F.length("t") > 0))
    rows = rows.mapInArrow(split, f"i {kind}, w array<string>").where(F.size("w") >= LEAST)
    return rows.select("i", F.xxhash64("w").alias("x"), F.xxhash64(F.lit(1), "w").alias("y"), "w")


def _indexed(texts: DataFrame) -> DataFrame:
    """(x, y, w, many): each different text once, with the places of each length whose seed more than RARE texts hold."""
    texts = texts.groupBy("x", "y").agg(F.first("w").alias("w"))
    size = F.size("w")
    grams = None
    for n in SEEDS[:-1]:
        runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda p: F.xxhash64(F.slice("w", p, n)))  # noqa: B023
        own = texts.where(size >= n).select("x", "y", F.lit(n).alias("n"), F.posexplode(runs).alias("p", "h"))
        grams = own if grams is None else grams.unionByName(own)
    held = grams.groupBy("n", "h", "x", "y").agg(F.lit(1).alias("one")).groupBy("n", "h").agg(F.count("*").alias("texts"))
    many = grams.join(held.where(F.col("texts") > RARE), ["n", "h"], "left_semi").groupBy("x", "y").agg(F.collect_list(F.struct("n", "p")).alias("many"))
    return texts.join(many, ["x", "y"], "left")


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, score, words): documents that hold an item's text or a passage of about 20 of its words or more.

    Words are compared as words.words gives them, so markup, escapes, accents, case
    and invisible characters don't matter. score is that of the best local
    alignment that was found, words how many of its words agree.

    Null, empty and wordless texts on either side match nothing; equal items are
    all reported; one row per document and item however often it occurs; an item of
    fewer than 20 words counts if seven eighths of it are there, one of fewer than 8
    can't be told from a phrase and is never reported; an empty table gives no rows;
    other columns are not read. How many items hold a seed is counted over all items.
    Up to index_words words of them are sent to the executors as one index, more as
    several by a hash of the text, each of which reads the documents again; which
    leaks are found doesn't depend on their number.
    """
    members = stored(_split(items, item_id, item_text), "eval-words")
    texts = stored(_indexed(members), "eval-index")
    total = texts.agg(F.sum(F.size("w")).alias("n")).first().n or 0
    shards = max(1, -(-int(total) // index_words))
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t")).where(F.length("t") > 0)
    found = None
    for shard in range(shards):
        own = texts if shards == 1 else texts.where(F.pmod(F.col("x"), F.lit(shards)) == shard)
        # One shard's words pass the driver at a time; the index itself is kept by the block manager.
        sent = spark.sparkContext.broadcast(build_index(((r.x, r.y), r.w, _by_length(r.many)) for r in own.toLocalIterator()))
        part = rows.mapInArrow(_reader(sent), f"d {kind}, x long, y long, score long, n long")
        found = part if found is None else found.unionByName(part)
    found = found.join(members.select("x", "y", "i"), ["x", "y"])
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "score", F.col("n").alias("words"))


def _by_length(many: list | None) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for m in many or []:
        out.setdefault(m.n, []).append(m.p)
    return out


def _reader(sent):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                found = leaks_of(index, [t.decode(errors="replace") for t in part.column("t").to_pylist()])
                if found:
                    d, i, score, equal = zip(*found)
                    x, y = zip(*i)
                    yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(d)), *[pa.array(c, pa.int64()) for c in (x, y, score, equal)]], names=["d", "x", "y", "score", "n"])

    return read
