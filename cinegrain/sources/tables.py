"""Reading and writing tables: parquet, JSON lines, CSV, and upserts that keep the newest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of filepath and caption with a header."""
    return spark.read.schema("filepath string, caption string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_captions(df: DataFrame, path: str) -> None:
    df.select("filepath", "caption").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """Rows of new replace those of old with the same keys; the first creation time stays. One shuffle on the keys."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    value = [c for c in old.columns if c not in keys and c != created]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "_gen").alias("_row"), F.min_by(created, "_gen").alias(created))
    return best.select(*keys, "_row.*", created).select(*old.columns)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Delete-then-insert of the values of one column that occur in df; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without(df: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """df less the rows whose key is in deleted."""
    return df.join(deleted.select(key).distinct(), key, "left_anti")


def last_lines(df: DataFrame, order: str, n: int, samples: int = 16) -> tuple[DataFrame, DataFrame]:
    """The n newest rows, newest first, and up to `samples` of them evenly spread: places round(i * (n - 1) / (samples - 1))."""
    from pyspark.sql import Window

    newest = df.orderBy(F.col(order).desc()).limit(n)
    places = sorted({round(i * (n - 1) / max(1, samples - 1)) for i in range(samples)})
    # n rows at most
    placed = newest.withColumn("_place", F.row_number().over(Window.orderBy(F.col(order).desc())) - 1)
    return newest, placed.where(F.col("_place").isin(places)).orderBy("_place").drop("_place")


def write_results(df: DataFrame, path: str) -> None:
    """A result as JSON, one object per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(df: DataFrame, path: str, by: str = "model_key") -> None:
    """Vectors as a parquet table with a folder for each model, each model's rows replaced as a whole. It takes the place of a flat index: a search is a scan of one folder."""
    replace_partitions(df, path, by)


def read_npy(spark: SparkSession, path: str, vector: str = "v") -> DataFrame:
    """(file, row, vector) of the two-dimensional float .npy files under a path; each file is read by one task, in slices."""
    import numpy as np
    import pandas as pd

    def rows(batches):
        import io

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                matrix = np.load(io.BytesIO(data), allow_pickle=False)
                for s in range(0, len(matrix), 4096):
                    part = matrix[s : s + 4096].astype(np.float32)
                    yield pd.DataFrame({"file": name, "row": np.arange(s, s + len(part)), vector: list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(rows, f"file string, row long, {vector} array<float>")


def write_npy(df: DataFrame, key: str, vector: str, folder: str) -> None:
    """Each partition as a matrix part-N.npy and its keys part-N.ids.npy, rows in the order of the key; folder must be one all executors share."""
    import os

    import numpy as np

    def write(part):
        from pyspark import TaskContext

        rows = list(part)
        if rows:
            base = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}")
            for suffix, value in ((".npy", np.array([r[vector] for r in rows], dtype=np.float32)), (".ids.npy", np.array([r[key] for r in rows]))):
                temporary = f"{base}{suffix}.{TaskContext.get().taskAttemptId()}.tmp"
                with open(temporary, "wb") as f:
                    np.save(f, value)
                os.replace(temporary, base + suffix)

    os.makedirs(folder, exist_ok=True)
    df.select(key, vector).sortWithinPartitions(key).foreachPartition(write)
