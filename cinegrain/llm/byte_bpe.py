"""Problem 7: token ids of a public byte-level BPE, by speculation and verification.

A greedy longest match proposes tokens for every new word. A sequence of tokens is
what the merges would give if and only if each pair of neighbours, taken alone,
stays apart; all distinct pairs of a batch are tested at once with array
operations. Only the words with a pair that fails are merged step by step.

Why a pair fails: while both tokens are built up by merges of rising rank, the
piece at the end of the left one and the piece at the start of the right one meet
in every state; if at some time their own merge comes before both of the merges
that would absorb them, they join across the border.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is, and the published pattern that splits a text into words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words that a Python worker remembers; a memory bound, the results don't depend on it.
REMEMBERED = 200_000


class ByteBpe:
    """One vocabulary of ranks: {bytes: id}, where a smaller id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.longest = {}  # the longest token for each first two bytes
        for token in ranks:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))
        # The merges that exist, as sorted keys left * size + right, with the rank of each.
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.rank = size, keys[order], np.array(rank, dtype=np.int64)[order]
        # The last merge of each token; a token that its own bytes don't lead to is never proposed.
        parts = np.full((size, 2), -1, dtype=np.int64)
        self.proposed = dict(ranks)
        for token, r in ranks.items():
            if len(token) > 1:
                ends = self.merge(token, r)
                if len(ends) == 2:
                    parts[r] = ends
                else:
                    del self.proposed[token]
        self.ends = self._spine(parts[:, 1])
        self.starts = self._spine(parts[:, 0])
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_text(cls, lines: bytes) -> ByteBpe:
        """From the lines of a rank file: base64 of the token, a space, the rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a})

    def _spine(self, child: np.ndarray) -> np.ndarray:
        """Row d: the piece of each token that is d steps down on one side, -1 where there is none."""
        rows = [np.arange(self.size)]
        while True:
            down = np.where(rows[-1] >= 0, child[np.maximum(rows[-1], 0)], -1)
            if (down < 0).all():
                return np.array(rows)
            rows.append(down)

    def merge(self, word: bytes, limit: int | None = None) -> list[int]:
        """The ids by merging step by step: always the smallest rank, the leftmost first; only ranks below limit."""
        ranks, n = self.ranks, len(word)
        start, nxt, prev = list(range(n)), [*range(1, n), -1], list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        top = self.size if limit is None else limit
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None and r < top]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or end[j] != stop or ranks.get(word[start[i] : stop]) != r:
                continue
            end[i], alive[j], nxt[i] = stop, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
                s = end[nxt[i]]
                if (r2 := ranks.get(word[start[i] : s])) is not None and r2 < top:
                    heapq.heappush(heap, (r2, i, s))
            if prev[i] >= 0 and (r2 := ranks.get(word[start[prev[i]] : stop])) is not None and r2 < top:
                heapq.heappush(heap, (r2, prev[i], stop))
        out, i = [], 0
        while i >= 0 and n:
            out.append(ranks[word[start[i] : end[i]]])
            i = nxt[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        known, out, at, n = self.proposed, [], 0, len(word)
        while at < n:
            for stop in range(min(n, at + self.longest.get(word[at : at + 2], 1)), at, -1):
                token = known.get(word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays a pair when its bytes are merged."""
        good = np.ones(len(left), dtype=bool)
        never = np.int64(1) << 60
        for i in range(len(self.ends)):
            x = self.ends[i][left]
            absorbed_x = self.ends[i - 1][left] if i else np.full(len(left), never)
            for j in range(len(self.starts)):
                y = self.starts[j][right]
                live = np.flatnonzero(good & (x >= 0) & (y >= 0))
                if not len(live):
                    break
                key = x[live] * self.size + y[live]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                absorbed_y = self.starts[j - 1][right[live]] if j else np.full(len(live), never)
                # Equal ranks: the leftmost merge comes first.
                joins = there & (self.rank[at] < absorbed_x[live]) & (self.rank[at] <= absorbed_y)
                good[live[joins]] = False
        return good

    def learn(self, words: list[str]) -> None:
        """Find the ids of new words, all at once."""
        raw = [w.encode() for w in words]
        tokens = [self.propose(w) for w in raw]
        several = [i for i, t in enumerate(tokens) if len(t) > 1]
        if several:
            left = np.fromiter(chain.from_iterable(tokens[i][:-1] for i in several), dtype=np.int64)
            right = np.fromiter(chain.from_iterable(tokens[i][1:] for i in several), dtype=np.int64)
            of = np.repeat(np.array(several), [len(tokens[i]) - 1 for i in several])
            pair, back = np.unique(left * self.size + right, return_inverse=True)
            bad = ~self.apart(pair // self.size, pair % self.size)[back]
            for i in np.unique(of[bad]).tolist():
                tokens[i] = self.merge(raw[i])
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        self.words.update(zip(words, map(tuple, tokens)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.split.findall(t) for t in texts]
        out = []
        for s in range(0, len(split), 256):
            block = split[s : s + 256]
            new = {w for words in block for w in words if w not in self.words}
            if new and len(self.words) + len(new) > REMEMBERED:  # the memory is emptied: what the block needs is found again
                self.words.clear()
                new = {w for words in block for w in words}
            if new:
                self.learn(sorted(new))
            known = self.words
            out += [list(chain.from_iterable([known[w] for w in words])) for words in block]
        return out


_LOADED: dict[int, ByteBpe] = {}


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    A null or empty text has an empty list; their strings in a text make special
    tokens ordinary text; bytes that are no UTF-8 are read as the replacement
    character. One row per row of df, in no order; no shuffle; an empty table
    gives no rows; other columns are not read. The vocabulary file is read by the
    driver and sent to the executors once (under 1 MB).
    """
    with open(vocabulary, "rb") as f:
        lines = f.read()
    sent = df.sparkSession.sparkContext.broadcast(lines)
    mark = hash(lines)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _LOADED:
            _LOADED[mark] = ByteBpe.from_text(sent.value)
        bpe = _LOADED[mark]
        for b in batches:
            raw = b.column("t")
            for s in range(0, b.num_rows, 2048):
                texts = [t.decode(errors="replace") if t else "" for t in raw.slice(s, 2048).to_pylist()]
                ids = bpe.encode(texts)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column("k").slice(s, 2048), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(encode, f"k {kind}, ids array<int>")
    return rows.select(F.col("k").alias(key), "ids")
