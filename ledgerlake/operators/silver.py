"""Bronze to silver: projection, scoring input and category write-back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import with_merchant
from ledgerlake.schema import SILVER


def project_silver(bronze: DataFrame, as_of: Column, as_coded: bool = False) -> DataFrame:
    """Silver rows without a category; ``as_of`` replaces a missing date."""
    cleaned = with_merchant(bronze.where(~F.col("is_duplicate")), as_coded=as_coded)
    return cleaned.select(
        F.col("bronze_id").alias("silver_id"),
        "bronze_id",
        "user_id",
        "amount",
        "merchant",
        F.coalesce("transaction_type", F.lit("debit")).alias("transaction_type"),
        F.coalesce(F.to_date("timestamp"), F.to_date(as_of)).alias("transaction_date"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.lit(None).cast("string").alias("category"),
        F.lit(False).alias("is_categorised"),
        F.lit(False).alias("user_corrected"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("decision_source"),
    )


def to_silver(bronze: DataFrame, silver: DataFrame | None, as_of: Column) -> DataFrame:
    """New silver rows: bronze rows that have none yet."""
    if silver is not None:
        bronze = bronze.join(silver.select("bronze_id"), "bronze_id", "left_anti")
    return project_silver(bronze, as_of)


def scoring_input(
    silver: DataFrame, bronze: DataFrame, text_source: str = "merchant", every: bool = False
) -> DataFrame:
    """What the classifier needs of every uncategorised silver row, or of
    ``every`` row.

    Text is the merchant, or the receiver with ``text_source="receiver"``,
    each falling back to the other; the timestamp is the exact one of bronze
    where there is one.
    """
    origin = bronze.select(
        "bronze_id",
        F.nullif("receiver", F.lit("")).alias("_receiver"),
        F.col("timestamp").alias("_timestamp"),
    )
    merchant = F.nullif("merchant", F.lit(""))
    receiver = F.col("_receiver")
    text = (receiver, merchant) if text_source == "receiver" else (merchant, receiver)
    return (
        (silver if every else silver.where(~F.col("is_categorised")))
        .join(origin, "bronze_id", "left")
        .select(
            "silver_id",
            "user_id",
            "merchant",
            F.coalesce(*text, F.lit("")).alias("raw_text"),
            F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("amount"),
            F.coalesce(
                "_timestamp", F.col("transaction_date").cast("timestamp_ntz")
            ).alias("timestamp"),
            F.coalesce(receiver, merchant, F.lit("")).alias("receiver"),
        )
    )


def write_back(silver: DataFrame, decisions: DataFrame, keep_other: bool = False) -> DataFrame:
    """Silver with the decided categories.

    Other means undecided: the row stays uncategorised and is scored again
    next run. ``keep_other`` stores the word itself.
    """
    decided = decisions.select(
        "silver_id",
        F.col("category").alias("_category"),
        F.col("confidence").alias("_confidence"),
        F.col("decision_source").alias("_source"),
    )
    scored = F.col("_category").isNotNull()
    accepted = F.col("_category") != "Other"
    category = F.col("_category") if keep_other else F.when(accepted, F.col("_category"))
    return (
        silver.join(decided, "silver_id", "left")
        .withColumn("category", F.when(scored, category).otherwise(F.col("category")))
        .withColumn("is_categorised", F.coalesce(accepted, "is_categorised"))
        .withColumn("confidence", F.coalesce("_confidence", "confidence"))
        .withColumn("decision_source", F.coalesce("_source", "decision_source"))
        .select(*SILVER.names)
    )
