"""Reading tables, cutting lineage in the cluster's shared folder, session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none a temporary folder is set, once per
    application; on a cluster that is an error, as other machines couldn't read it.
    """
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    if set_dir:
        return set_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="cinegrain-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write to a parquet table in the shared folder, with the writer's options, and read it back.

    Columnar and compressed, so better than a checkpoint for wide rows that are
    read several times with different columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
