"""The library as tables: current items, their tags, people, files, views and vectors, and what the tools leave out.

Each property is a lazy DataFrame over the tables of a data directory; nothing is read before a query
runs, and only the columns that a query uses reach the scan. Of the rows with one key only the newest counts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.vectors import closure
from .shared import table

#: Seconds that one view stands for, as the tables have no play time; the day the tools count ages and decay from.
PLAY_SECONDS = 600
AS_OF = "2025-11-01"


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: that with the greatest version, nulls last; a partial aggregate runs before the shuffle. Rows with a null key are dropped."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct(F.coalesce(F.col(version).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("v"), F.xxhash64(row).alias("h"))
    kept = df.dropna(subset=keys)
    return kept.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select(*keys, "_row.*")


def counted(c: Column) -> Column:
    """A counter of which null and negative values mean none."""
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint")


class Catalog:
    """Tables of one data directory. excluded: names of tags that tools leave out with all tags below them."""

    def __init__(self, spark: SparkSession, data_dir: str, excluded: tuple[str, ...] = (), as_of: str = AS_OF):
        self.spark, self.data_dir, self.excluded, self.as_of = spark, data_dir, tuple(excluded), as_of

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.data_dir, name)

    @property
    def today(self) -> Column:
        return F.lit(self.as_of).cast("date")

    def _current(self, *columns: str) -> DataFrame:
        """id, the columns and updated_at of the current items; no other column is read."""
        return newest(self.table("sample_library").select("id", *columns, "updated_at"), ["id"], "updated_at")

    @cached_property
    def items(self) -> DataFrame:
        """id, title, plays, peaks, rating, organized, org_id, created_at, updated_at."""
        rows = self._current("title", "play_count", "o_counter", "rating100", "organized", "studio_id", "created_at")
        return rows.select("id", "title", counted(F.col("play_count")).alias("plays"), counted(F.col("o_counter")).alias("peaks"), F.col("rating100").alias("rating"), F.coalesce("organized", F.lit(False)).alias("organized"), F.col("studio_id").alias("org_id"), "created_at", "updated_at")

    def _bridge(self, column: str, name: str) -> DataFrame:
        each = self._current(column).select(F.col("id").alias("item_id"), F.explode(column).alias("x"))
        return each.select("item_id", F.col("x.id").alias(name)).where(F.col(name).isNotNull()).distinct()

    @cached_property
    def item_tags(self) -> DataFrame:
        """item_id, tag_id; each pair once."""
        return self._bridge("tags", "tag_id")

    @cached_property
    def item_persons(self) -> DataFrame:
        """item_id, person_id; each pair once."""
        return self._bridge("performers", "person_id")

    @cached_property
    def files(self) -> DataFrame:
        """item_id, nth (0 is the primary file), path, size, duration."""
        return self._current("files").select(F.col("id").alias("item_id"), F.posexplode("files").alias("nth", "f")).where(F.col("f").isNotNull()).select("item_id", "nth", "f.path", "f.size", "f.duration")

    @cached_property
    def primary(self) -> DataFrame:
        return self.files.where("nth = 0").drop("nth")

    @cached_property
    def tags(self) -> DataFrame:
        return newest(self.table("tags").select("id", "name", "favorite", "updated_at"), ["id"], "updated_at")

    @cached_property
    def persons(self) -> DataFrame:
        return newest(self.table("performers").select("id", "name", "disambiguation", "birthdate", "country", "favorite", "rating", "updated_at"), ["id"], "updated_at")

    @cached_property
    def orgs(self) -> DataFrame:
        return self.table("studios").dropna(subset=["id"]).dropDuplicates(["id"])

    @cached_property
    def views(self) -> DataFrame:
        """item_id, ts: the log of views; repeated and late rows once."""
        return self.table("scenes_view_dates").select(F.col("scene_id").alias("item_id"), F.col("view_date").alias("ts")).dropna().distinct()

    @cached_property
    def view_counts(self) -> DataFrame:
        """item_id, views, first_ts, last_ts: the log summed up before it is joined."""
        return self.views.groupBy("item_id").agg(F.count("*").alias("views"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    @cached_property
    def engaged(self) -> DataFrame:
        """Items with views, first_ts, last_ts and the duration of the primary file; items without a view have 0."""
        logged = self.items.join(self.view_counts, self.items["id"] == self.view_counts["item_id"], "left").drop("item_id")
        length = self.primary.select(F.col("item_id").alias("id"), "duration")
        return logged.withColumn("views", F.coalesce("views", F.lit(0))).join(length, "id", "left")

    @cached_property
    def tag_edges(self) -> DataFrame:
        """parent, child: the tags have no relations of their own, so tag k is below tag k div 8 (300 and above below none)."""
        return self.tags.where("id > 0 AND id < 300").select(F.expr("id div 8").alias("parent"), F.col("id").alias("child"))

    @cached_property
    def org_edges(self) -> DataFrame:
        return self.orgs.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))

    def tags_below(self, names: tuple[str, ...] | list[str]) -> DataFrame:
        """tag_id of the tags with these names (case aside) and of all tags below them."""
        roots = self.tags.where(F.lower(F.trim("name")).isin([n.strip().lower() for n in names])).select("id")
        return closure(self.tag_edges, roots).select(F.col("id").alias("tag_id"))

    def shown(self, bridge: DataFrame, more: tuple[str, ...] | list[str] = ()) -> DataFrame:
        """Rows of a frame with tag_id less the excluded tags, those below them, and `more`."""
        names = [*self.excluded, *more]
        return bridge.join(self.tags_below(names), "tag_id", "left_anti") if names else bridge

    @cached_property
    def vectors(self) -> DataFrame:
        """item_id, model_key, v: the newest usable vector of each item and model."""
        rows = self.table("scene_embeddings").select("scene_id", "model_key", "composite_embedding", "updated_at")
        return usable(newest(rows, ["scene_id", "model_key"], "updated_at").select(F.col("scene_id").alias("item_id"), "model_key", F.col("composite_embedding").alias("v")), "v")

    @cached_property
    def frames(self) -> DataFrame:
        """item_id, model_key, frame, seconds, v: the newest usable vector of each frame."""
        rows = self.table("frame_embeddings").select("scene_id", "frame_index", "model_key", "timestamp_s", "embedding", "created_at")
        return usable(newest(rows, ["scene_id", "frame_index", "model_key"], "created_at").select(F.col("scene_id").alias("item_id"), "model_key", F.col("frame_index").alias("frame"), F.col("timestamp_s").alias("seconds"), F.col("embedding").alias("v")), "v")


def usable(df: DataFrame, vector: str, dimensions: int = 40) -> DataFrame:
    """Rows whose vector has the right length, finite numbers only and not all of them zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where((F.size(v) == dimensions) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
