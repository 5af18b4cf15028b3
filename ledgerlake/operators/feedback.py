"""User corrections: validation, silver update and the feedback table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.schema import CATEGORIES, FEEDBACK, SILVER
from ledgerlake.sources.sinks import latest_by_key, upsert

# Corrections: silver_id, user_id, merchant, raw_text, corrected_category,
# amount, corrected_at.


def split_corrections(
    silver: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(applicable, rejected) corrections.

    Rejected rows carry a reason: the category is unknown, or the user has no
    such transaction. Of several corrections of one row the newest applies;
    the original category and the transaction's date are those silver holds.
    """
    known = F.col("corrected_category").isin(CATEGORIES)
    current = silver.select(
        "silver_id", "user_id", F.col("category").alias("original_category"),
        "transaction_date", F.lit(True).alias("_found"),
    )
    checked = corrections.drop("original_category", "transaction_date").join(
        current, ["silver_id", "user_id"], "left"
    )
    reason = F.when(F.coalesce(known, F.lit(False)), F.lit(None)).otherwise("unknown_category")
    checked = checked.withColumn(
        "reason", F.coalesce(reason, F.when(F.col("_found").isNull(), "not_found"))
    ).drop("_found")
    accepted = latest_by_key(
        checked.where("reason is null").drop("reason"),
        ["silver_id", "user_id"],
        [F.col("corrected_at")],
    )
    rejected = checked.where("reason is not null").drop("original_category", "transaction_date")
    return accepted, rejected


def apply_corrections(silver: DataFrame, accepted: DataFrame) -> DataFrame:
    """Silver with accepted corrections written in: the user's word, so with
    full confidence and not as a decision of the model."""
    new = accepted.select("silver_id", "user_id", F.col("corrected_category").alias("_new"))
    corrected = F.col("_new").isNotNull()
    return (
        silver.join(new, ["silver_id", "user_id"], "left")
        .withColumn("category", F.coalesce("_new", "category"))
        .withColumn("is_categorised", corrected | F.col("is_categorised"))
        .withColumn("user_corrected", corrected | F.col("user_corrected"))
        .withColumn("confidence", F.when(corrected, F.lit(1.0)).otherwise(F.col("confidence")))
        .withColumn(
            "decision_source",
            F.when(corrected, F.lit("user_correction")).otherwise(F.col("decision_source")),
        )
        .select(*SILVER.names)
    )


def feedback_rows(accepted: DataFrame) -> DataFrame:
    """Accepted corrections as feedback; a missing text is the merchant."""
    return accepted.withColumn(
        "raw_text", F.coalesce(F.nullif("raw_text", F.lit("")), "merchant")
    ).select(*FEEDBACK.names)


def upsert_feedback(feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """Feedback with one row, the newest, per user and transaction."""
    return upsert(feedback, updates, ["user_id", "silver_id"], ["corrected_at"])
