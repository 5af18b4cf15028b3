"""The folder every executor can reach, for checkpoints and staged tables."""

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, the
    session's warehouse, which every executor can reach as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "staged")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    and survives the loss of an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core, so that slow ones are evened out.
WAVES = 3


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over some tasks for every core, for steps that work long on
    each row. The adaptive planner joins partitions by their bytes, and a reader cuts
    files no finer than their row groups, so a few megabytes would otherwise be one
    task's work; a number that is asked for stays as it is."""
    return df.repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism)
