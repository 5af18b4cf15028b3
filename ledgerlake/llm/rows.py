"""Helpers for the operators that use DataFrame functions alone."""

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions.blocks import let
from ledgerlake.llm.text import whole

_PART_BIT = 33  # monotonically_increasing_id counts rows below it and partitions above


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, also if the driver
    found it by its own search path. A Connect session ships its files itself."""
    root = str(Path(__file__).resolve().parents[2])
    try:
        environment = spark.sparkContext.environment
    except AttributeError:  # a Connect session has no context
        return spark
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` (null: empty) and a key that is never null: hashes
    of the text (``_a``) and of the id (``_b``). Rows with equal id and text
    have equal keys."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    return rows.select("_id", F.xxhash64("_text").alias("_a"), F.xxhash64("_id").alias("_b"), "_text")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt and sorted by ``order``, with ``_place``, a number that
    ascends in that order, and ``_part``, the partition it lies in. To be
    written before it is used twice."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_place", F.monotonically_increasing_id())
    return dealt.withColumn("_part", F.shiftright("_place", _PART_BIT))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (written, from ``placed``) with ``next``, a struct of
    ``columns`` of the next row; after the last comes the first. Rows meet
    their followers within a part; of each part only the first row is looked
    at across parts."""
    own = F.struct(*columns)
    inside = F.lead(own).over(W.partitionBy("_part").orderBy("_place"))
    firsts = rows.groupBy("_part").agg(F.min_by(own, "_place").alias("_first"))
    across = W.orderBy("_part")
    everywhere = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = F.coalesce(F.lead("_first").over(across), F.first("_first").over(everywhere))
    firsts = firsts.select("_part", follows.alias("_follows"))
    joined = rows.withColumn("_inside", inside).join(firsts, "_part")
    return joined.withColumn("next", F.coalesce("_inside", "_follows")).drop("_inside", "_follows")


#: Characters kept around a match, for context.
CONTEXT = 40


def _matched(text: Column, label: str, pattern: str, needs: str | None) -> Column:
    """Matches in order, each with the length of the gap before it. Matches
    and the pieces between them come from the same sequence of finds."""

    def at(found: Column, gaps: Column, i: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            i.alias("n"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.get(found, i).alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
        )

    nothing = F.expr("cast(array() as array<struct<label:string,n:int,gap:int,match:string,before:string,after:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    listed = let(
        found,
        lambda m: F.when(
            F.size(m) > 0,
            let(F.split(text, pattern, -1), lambda g: F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: at(m, g, i))),
        ).otherwise(nothing),
    )
    return F.when(F.contains(text, F.lit(needs)), listed).otherwise(nothing) if needs else listed


def located(rows: DataFrame, keys: list[str], text: str, patterns: list[tuple[str, str, str | None]]) -> DataFrame:
    """Leftmost non-overlapping matches of each (label, Java pattern, text
    that a match must contain): ``keys``, ``label``, ``n``, ``start``, ``end``
    (in code points, end exclusive), ``match``, ``before``, ``after``. Rows of
    equal keys must have equal texts and count once."""
    found = F.flatten(F.array(*[_matched(F.col(text), *p) for p in patterns]))
    each = rows.select(*keys, F.explode(found).alias("_found")).select(*keys, "_found.*")
    each = each.dropDuplicates([*keys, "label", "n"])
    until = F.sum(F.col("gap") + F.length("match")).over(W.partitionBy(*keys, "label").orderBy("n"))
    return each.withColumn("end", until).select(
        *keys, "label", "n", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after"
    )
