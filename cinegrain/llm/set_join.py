"""Problem 2: all pairs of similar sets, by an extended-prefix join.

Tokens are ordered from rare to frequent. Two sets that share at least t tokens
share at least l tokens of their l-prefixes, which are the first size - t + l
tokens of each. With l = 1 this is the usual prefix filter; each longer prefix asks for
one shared token more. The join adapts key by key: it starts with single tokens,
and every key that too many sets hold is replaced by its combinations with one
further token of the next longer prefix, until the keys are rare or the longest
combination is reached. What is still frequent then is joined in blocks, so no
task ever gets an unbounded bucket. Every candidate is verified by its overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Sets of a key from which the key is extended by one more token, and the most tokens of a key.
FREQUENT = 200
LONGEST = 4


def _least(threshold: float, size: Column) -> Column:
    """The overlap a set must have with any partner: ceil(threshold * size), safe against rounding."""
    return F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int")


def keyed_sets(df: DataFrame, key: str, members: str, least_size: int) -> DataFrame:
    """(record, set_key, members): each record's sorted members, nulls and repeats taken out, if there are at least least_size of them."""
    sets = df.select(F.col(key).alias("record"), F.array_sort(F.array_distinct(F.filter(F.col(members), lambda m: m.isNotNull()))).alias("members")).where(F.size("members") >= least_size)
    return sets.select("record", F.struct(F.xxhash64("members").alias("x"), F.xxhash64(F.lit(1), "members").alias("y")).alias("set_key"), "members")


def distinct_sets(df: DataFrame, key: str, members: str, least_size: int) -> DataFrame:
    """The distinct sets of keyed_sets, see distinct."""
    return distinct(keyed_sets(df, key, members, least_size))


def distinct(sets: DataFrame) -> DataFrame:
    """(set_key, rep, copies, tokens): one row per distinct set; tokens sorted by rising frequency.

    rep is the smallest key of the rows that hold the set, copies their number.
    Frequencies are counted over all distinct sets. Two hashes with different
    seeds stand for the set.
    """
    whole = sets.groupBy("set_key").agg(F.min("record").alias("rep"), F.count("*").alias("copies"), F.first("members").alias("members"))
    tokens = whole.select("set_key", "rep", "copies", F.explode("members").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("f"))
    ranked = (
        tokens.join(frequency, "token")
        .groupBy("set_key", "rep", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ranked"))
    )
    return ranked.select("set_key", "rep", "copies", F.transform("ranked", lambda r: r["token"]).alias("tokens"))


def _candidates(keyed: DataFrame, threshold: float, other: DataFrame | None = None) -> DataFrame:
    """Verified pairs (rep_a < rep_b, or a of the one table and b of the other) of rows with one key."""
    left = keyed.select("key", F.col("rep").alias("rep_a"), F.col("tokens").alias("tokens_a"))
    right = (keyed if other is None else other).select("key", F.col("rep").alias("rep_b"), F.col("tokens").alias("tokens_b"))
    size_a, size_b = F.size("tokens_a"), F.size("tokens_b")
    near = (F.least(size_a, size_b) >= _least(threshold, F.greatest(size_a, size_b)))
    if other is None:
        near = (F.col("rep_a") < F.col("rep_b")) & near
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    pairs = left.join(right, "key").where(near).select("rep_a", "rep_b", shared.alias("shared"), (size_a + size_b - shared).alias("united"))
    return pairs.where(F.col("shared") >= F.lit(threshold) * F.col("united") - F.lit(1e-9))


def similar_sets(sets: DataFrame, threshold: float, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(rep_a, rep_b, shared, united): the pairs of distinct sets with shared / united >= threshold, rep_a < rep_b.

    sets comes from distinct_sets. Exact: no pair is lost, no partner list is
    capped. An empty table gives no pairs.
    """
    rows = stored(sets.select("rep", "tokens"), "sets")
    size = F.size("tokens")
    spare = size - _least(threshold, size)  # tokens that a partner may miss
    # chosen: the positions of the key's tokens in the set, ascending; key: its tokens.
    level = rows.select("rep", "tokens", F.posexplode(F.slice("tokens", F.lit(1), spare + 1)).alias("at", "token"))
    level = level.select("rep", "tokens", F.array(F.col("at")).alias("chosen"), F.array("token").alias("key"))
    found = None
    for length in range(1, longest + 1):
        # Counted with a partial sum; the frequent keys are few: at most rows / frequent.
        hot = level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > frequent).withColumn("hot", F.lit(True))
        marked = stored(level.join(hot, "key", "left"), f"keys{length}")
        cold = _candidates(marked.where(F.col("hot").isNull()), threshold)
        found = cold if found is None else found.unionByName(cold)
        rest = marked.where(F.col("hot"))
        if length == longest:
            found = found.unionByName(_blocked(rest, threshold, frequent))
            break
        # A pair that shares this key shares one further token of the next longer prefix.
        # Where the key already holds all tokens that a partner must share, it can't grow: blocks.
        full = rest.where(_least(threshold, size) <= length)
        grown = rest.where(_least(threshold, size) > length)
        found = found.unionByName(_blocked_mixed(full, rest, threshold, frequent))
        more = grown.select("rep", "tokens", "chosen", F.posexplode(F.slice("tokens", F.lit(1), spare + length + 1)).alias("at", "token"))
        more = more.where(~F.array_contains("chosen", F.col("at")))
        level = (
            more.select("rep", "tokens", F.array_sort(F.concat("chosen", F.array("at"))).alias("chosen"))
            .select("rep", "tokens", "chosen", F.array_sort(F.transform("chosen", lambda i: F.element_at("tokens", i + 1))).alias("key"))
            .dropDuplicates(["rep", "key"])
        )
    return found.distinct()


def _blocks(n: Column, frequent: int) -> Column:
    return F.ceil(n / F.lit(frequent)).cast("int")


def _blocked(rows: DataFrame, threshold: float, frequent: int) -> DataFrame:
    """All pairs of each key's rows, by pairs of blocks of about `frequent` rows; a row goes to as many tasks as its key has blocks."""
    blocks = _blocks(F.col("n"), frequent)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint")).cast("int")
    placed = rows.select("rep", "tokens", "key", blocks.alias("blocks")).withColumn("own", own)
    spread = placed.select("rep", "tokens", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left = spread.select(F.struct("key", F.col("own").alias("i"), F.col("block").alias("j")).alias("key"), "rep", "tokens")
    right = spread.select(F.struct("key", F.col("block").alias("i"), F.col("own").alias("j")).alias("key"), "rep", "tokens")
    return _candidates(left, threshold, right).where(F.col("rep_a") < F.col("rep_b"))


def _blocked_mixed(full: DataFrame, rest: DataFrame, threshold: float, frequent: int) -> DataFrame:
    """Pairs of which one set is as small as its key: those with any set of the key, in blocks."""
    blocks = _blocks(F.col("n"), frequent)
    left = full.select("rep", "tokens", F.struct("key", F.pmod(F.xxhash64("rep"), blocks.cast("bigint")).cast("int").alias("i")).alias("key"))
    right = rest.select("rep", "tokens", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i")).select("rep", "tokens", F.struct("key", "i").alias("key"))
    pairs = _candidates(left, threshold, right).where(F.col("rep_a") != F.col("rep_b"))
    swap = F.col("rep_a") > F.col("rep_b")
    return pairs.select(
        F.when(swap, F.col("rep_b")).otherwise(F.col("rep_a")).alias("rep_a"),
        F.when(swap, F.col("rep_a")).otherwise(F.col("rep_b")).alias("rep_b"),
        "shared",
        "united",
    )


def similar_records(df: DataFrame, key: str, members: str, threshold: float = 0.8, least_size: int = 1, copies: int = 64) -> DataFrame:
    """(a, b): pairs of records, a < b, whose sets overlap by shared / united >= threshold.

    df has one row per record: a unique key and an array. Null members and
    repeats don't count; sets with fewer than least_size members, and so empty
    and null ones, are in no pair; equal sets have the overlap 1. An empty table
    gives no rows; other columns are not read.

    Equal sets are joined once. A group of equal sets is written out as all its
    pairs, and in its pairs with other groups by each member; a group of more
    than `copies` records in blocks of about so many, a task per pair of blocks.
    """
    sets = stored(keyed_sets(df, key, members, least_size), "keyed-sets")
    classes = stored(distinct(sets), "set-classes")
    member = sets.select("record", "set_key").join(classes.where(F.col("copies") > 1).select("set_key", "rep", "copies"), "set_key").select("record", "rep", "copies")
    member = stored(member, "set-members")
    blocks = _blocks(F.col("copies"), copies)
    placed = member.select("record", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("record"), blocks.cast("bigint")).cast("int").alias("own"))
    spread = placed.select("record", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one = spread.select("rep", F.col("own").alias("i"), F.col("block").alias("j"), F.col("record").alias("a"))
    other = spread.select("rep", F.col("block").alias("i"), F.col("own").alias("j"), F.col("record").alias("b"))
    equal = one.join(other, ["rep", "i", "j"]).where(F.col("a") < F.col("b")).select("a", "b")
    pairs = similar_sets(classes, threshold).select("rep_a", "rep_b")
    a = member.select(F.col("rep").alias("rep_a"), F.col("record").alias("x"))
    b = member.select(F.col("rep").alias("rep_b"), F.col("record").alias("y"))
    crossed = pairs.join(a, "rep_a", "left").join(b, "rep_b", "left").select(F.coalesce("x", "rep_a").alias("x"), F.coalesce("y", "rep_b").alias("y"))
    crossed = crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return crossed.unionByName(equal)
