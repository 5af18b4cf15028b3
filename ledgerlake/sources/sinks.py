"""Append and keyed-upsert sinks over partitioned files."""

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.shared import materialise


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key as a partial aggregate, so a hot key is reduced
    before the shuffle instead of being sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                            F.struct(*rest).alias("_row")))
    return (
        df.groupBy(*keys)
        .agg(newest.alias("_newest"))
        .select(*keys, "_newest._row.*")
        .select(*df.columns)
    )


def upsert(
    target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """``target`` with ``updates`` applied: of each key the row with the
    highest ``order`` stays, stored or new; an update wins a tie."""
    columns = target.columns
    order = order or []
    tagged = target.withColumn("_new", F.lit(0)).unionByName(
        updates.select(*columns).withColumn("_new", F.lit(1))
    )
    ranked = [F.col(c) for c in order] + [F.col("_new")]
    return latest_by_key(tagged, keys, ranked).select(*columns)


def write_append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, partition_by: str) -> DataFrame:
    """Replace exactly the partitions that ``df`` has rows for; returns its
    staged copy.

    ``df`` may read ``path``: it is first written to the shared folder and
    copied from there, so the files being replaced are never being read, and
    a lost executor only repeats the task.
    """
    staged = materialise(df, "staging")
    (
        staged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )
    return staged


def replace_partitions(
    df: DataFrame, path: str, partition_by: str, touched: list
) -> None:
    """Make the ``touched`` partitions hold exactly the rows of ``df``; those
    without a row are emptied. ``touched``: partition values, a bounded list
    such as the months of a batch."""
    staged = overwrite_partitions(df, path, partition_by)
    left = {r[0] for r in staged.select(partition_by).distinct().collect()}
    nothing = staged.drop(partition_by).limit(0)
    for value in touched:
        if value not in left:
            nothing.write.mode("overwrite").parquet(posixpath.join(path, f"{partition_by}={value}"))


def write_upsert(
    updates: DataFrame,
    path: str,
    keys: list[str],
    partition_by: str,
    order: list[str] | None = None,
) -> None:
    """Upsert into the files at ``path``; only touched partitions are rewritten.

    ``partition_by`` must be one of the keys. The set of touched partitions
    is at most the number of partitions, so it is broadcast-sized and prunes
    the read of the target.
    """
    spark = updates.sparkSession
    target = read_or_empty(spark, path, updates.schema)
    touched = target.join(updates.select(partition_by).distinct(), partition_by, "left_semi")
    merged = upsert(touched.select(*updates.columns), updates, keys, order)
    overwrite_partitions(merged, path, partition_by)
