"""Python functions where built-in ones can't do: an aggregate of vectors, embedders that are plugged in by name, detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


@F.pandas_udf(ArrayType(DoubleType()))
def l2_weighted_mean(vectors: pd.Series, weights: pd.Series) -> list:
    """The weighted mean of vectors scaled to length one; null without vectors. For groups that fit a task; see kernels.weighted_means for others."""
    kept = [(np.asarray(v, dtype=float), float(w)) for v, w in zip(vectors, weights) if v is not None and w is not None]
    if not kept:
        return None
    total = sum(v * w for v, w in kept)
    length = float(np.sqrt(total @ total))
    return (total / length if length > 0 else total).tolist()


EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def register_embedder(name: str, embed: Callable[[list[str]], list[list[float]]]) -> None:
    """Plugs in a function from texts to vectors under a name; it gets a batch at a time."""
    EMBEDDERS[name] = embed


def embedded(name: str, text: Column) -> Column:
    """The vectors of a text column by a registered embedder; null texts give nulls."""
    embed = EMBEDDERS[name]

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        vectors = embed(known.tolist()) if len(known) else []
        return pd.Series([None] * len(texts), index=texts.index, dtype=object).where(texts.isna(), pd.Series([list(map(float, v)) for v in vectors], index=known.index, dtype=object))

    return run(text)


@dataclass(frozen=True)
class Detector:
    """What to look for: tags whose vectors stand for phrases, the least similarity, the gap within one event, events of an item, tags an item must have."""

    phrases: tuple[int, ...]
    threshold: float = 0.3
    gap: float = 30.0
    limit: int = 5
    needs_tags: tuple[int, ...] = ()


DETECTORS: dict[str, Detector] = {}


def detect(cat, name: str) -> DataFrame:
    """The events that a detector finds; only in items that have one of its tags, if it names any."""
    from ..tools.similar import content_events

    d = DETECTORS[name]
    found = content_events(cat, phrases=d.phrases, threshold=d.threshold, gap=d.gap, limit=d.limit)
    if not d.needs_tags:
        return found
    return found.join(cat.item_tags.where(F.col("tag_id").isin(list(d.needs_tags))).select("item_id").distinct(), "item_id", "left_semi")
