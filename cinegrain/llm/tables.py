"""Current rows, normalised tag names and usable vectors of the library's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vector length of the library and the oldest time a null one counts as.
DIMENSIONS = 40
OLDEST = "0001-01-01 00:00:00"

#: Every character that Unicode calls white space, and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def current_rows(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """One row per key: that with the greatest version.

    A partial aggregate runs before the shuffle, so a key that holds a third of
    all rows sends one row per task. Rows with a null key have no identity and
    are dropped; a null version is older than any other; between unequal rows of
    one version the greater hash wins, so the choice is the same on every run.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    order = F.struct(F.coalesce(F.col(version).cast("timestamp_ntz"), F.lit(OLDEST).cast("timestamp_ntz")).alias("v"), F.xxhash64(payload).alias("h"))
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(F.max_by(payload, order).alias("_row")).select(*keys, "_row.*")


def tag_name(name: Column) -> Column:
    """White space stripped at both ends, each inner run one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, SPACE, " ")))


def tag_names(tags: Column) -> Column:
    """The distinct normalised names of an array of (id, name); null lists and elements give none."""
    names = F.transform(F.filter(tags, lambda t: t["name"].isNotNull()), lambda t: tag_name(t["name"]))
    return F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != ""))


def usable_rows(vectors: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of an Arrow list column, and their values as a matrix.

    Usable: not null, of the right length, finite numbers only, not all zero.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    flat = vectors.take(pa.array(rows)).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return rows[good], matrix[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, computed in double precision."""
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # else tiny or huge values under- or overflow
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def as_list_array(matrix: np.ndarray) -> pa.Array:
    """A float matrix as an Arrow list column."""
    n, d = matrix.shape
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), flat)
