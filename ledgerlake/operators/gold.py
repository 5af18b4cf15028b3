"""Monthly summaries: full rebuild and refresh of the affected groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.dates import month_of
from ledgerlake.schema import MONEY

GOLD_KEYS = ["user_id", "month", "category"]


def monthly_summary(silver: DataFrame) -> DataFrame:
    """Total and count of categorised rows per user, month and category."""
    return (
        silver.where("is_categorised")
        .groupBy(
            "user_id",
            month_of(F.col("transaction_date")).alias("month"),
            F.coalesce(F.nullif("category", F.lit("")), F.lit("Other")).alias("category"),
        )
        .agg(
            F.sum("amount").cast(MONEY).alias("total_amount"),
            F.count("*").alias("txn_count"),
        )
    )


def affected_groups(applied: DataFrame) -> DataFrame:
    """Gold keys a set of applied corrections can change.

    Both the old and the new category count; the month is the silver row's,
    whose date ``split_corrections`` keeps.
    """
    return applied.select(
        "user_id",
        month_of(F.col("transaction_date")).alias("month"),
        F.explode(F.array("original_category", "corrected_category")).alias("category"),
    ).where("category is not null").distinct()


def of_months(silver: DataFrame, groups: DataFrame) -> DataFrame:
    """Silver rows of the months of some groups, a handful of months."""
    months = groups.select("month").distinct()
    dated = silver.withColumn("month", month_of(F.col("transaction_date")))
    return dated.join(F.broadcast(months), "month", "left_semi").drop("month")


def refresh_gold(gold: DataFrame, silver: DataFrame, groups: DataFrame) -> DataFrame:
    """Gold after recomputing ``groups`` from silver; emptied groups vanish.

    Silver is cut to the touched months (a handful of rows to join with) and
    summed before it meets the groups, so no raw row is shuffled and a hot
    user costs nothing extra.
    """
    fresh = monthly_summary(of_months(silver, groups)).join(groups, GOLD_KEYS, "left_semi")
    kept = gold.join(groups, GOLD_KEYS, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)
