"""What a user's past corrections say about a merchant.

All views are derived from the feedback table. Keys are the normalised user
and the normalised merchant (or any column named by ``key``).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import string_array
from ledgerlake.functions.text import norm_key
from ledgerlake.operators.trailing import MICROS_PER_HOUR, micros, trailing_sums

KEYS = ["user_key", "merchant_key"]


def with_keys(df: DataFrame, key: str = "merchant") -> DataFrame:
    return df.withColumn("user_key", norm_key(F.col("user_id"))).withColumn(
        "merchant_key", norm_key(F.coalesce(key, F.lit("")))
    )


def newest_feedback(feedback: DataFrame, rows: int) -> DataFrame:
    """The newest corrections over all users: a bounded top-N."""
    return feedback.orderBy(
        F.desc("corrected_at"), F.desc("silver_id"), F.desc("user_id")
    ).limit(rows)


def newest_feedback_per_user(feedback: DataFrame, rows: int) -> DataFrame:
    """The newest corrections of every user.

    The rank limit is pushed below the shuffle, so no user sends more than
    ``rows`` rows per map task.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("corrected_at"), F.desc("silver_id"))
    return (
        feedback.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= rows)
        .drop("_rank")
    )


def weighted_categories(
    feedback: DataFrame, key: str = "merchant", decay: float = S.HISTORY_DECAY
) -> DataFrame:
    """Weight per user, merchant and category: entries newest first, the
    n-th counting ``decay ** n``.

    The position within a key is an offset (rows in newer hours) plus the
    position within the hour, so a key that holds a third of the table is
    ranked hour by hour in parallel. Only one row per key, hour and category
    reaches the step that adds the offsets.
    """
    keyed = with_keys(feedback, key).select(
        *KEYS,
        F.floor(micros(F.col("corrected_at")) / MICROS_PER_HOUR).alias("_hour"),
        "corrected_at",
        "silver_id",
        F.col("corrected_category").alias("category"),
    )
    within = Window.partitionBy(*KEYS, "_hour").orderBy(
        F.desc("corrected_at"), F.desc("silver_id")
    )
    per_hour = (
        keyed.withColumn("_position", F.row_number().over(within) - 1)
        .groupBy(*KEYS, "_hour", "category")
        .agg(
            F.sum(F.pow(F.lit(decay), F.col("_position"))).alias("_weight"),
            F.count("*").alias("_rows"),
        )
    )
    newer = Window.partitionBy(*KEYS).orderBy(F.desc("_hour")).rangeBetween(
        Window.unboundedPreceding, -1
    )
    offset = F.coalesce(F.sum("_rows").over(newer), F.lit(0))
    return (
        per_hour.withColumn("_offset", offset)
        .groupBy(*KEYS, "category")
        .agg(F.sum(F.pow(F.lit(decay), F.col("_offset")) * F.col("_weight")).alias("weight"))
    )


def last_category(feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Newest corrected category per key; also the key's override."""
    newest = F.struct("corrected_at", "silver_id")
    return with_keys(feedback, key).groupBy(*KEYS).agg(
        F.max_by("corrected_category", newest).alias("category")
    )


def history_count(feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Number of feedback entries per key."""
    return with_keys(feedback, key).groupBy(*KEYS).agg(F.count("*").alias("history_count"))


def _amount_aggregates() -> list[Column]:
    positive = F.when(F.col("amount") > 0, F.col("amount").cast("double"))
    return [
        F.count(positive).alias("amount_count"),
        F.avg(positive).alias("amount_mean"),
        F.stddev_pop(positive).alias("amount_std"),
    ]


def _variation() -> Column:
    return F.when(
        F.col("amount_mean") > 0, F.col("amount_std") / F.col("amount_mean")
    ).otherwise(1.0)


def amount_statistics(feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Mean, population deviation and variation of positive past amounts."""
    return (
        with_keys(feedback, key)
        .where("amount > 0")
        .groupBy(*KEYS)
        .agg(*_amount_aggregates())
        .withColumn("amount_cv", _variation())
    )


def history_profile(feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Everything scoring needs of a key in one row: the weights per label,
    their total (unknown categories included), override, count, variation."""
    per_label = [
        F.coalesce(F.sum(F.when(F.col("category") == label, F.col("weight"))), F.lit(0.0))
        for label in S.LABELS
    ]
    weights = (
        weighted_categories(feedback, key)
        .groupBy(*KEYS)
        .agg(F.array(*per_label).alias("weights"), F.sum("weight").alias("weight_total"))
    )
    newest = F.struct("corrected_at", "silver_id")
    rest = (
        with_keys(feedback, key)
        .groupBy(*KEYS)
        .agg(
            F.max_by("corrected_category", newest).alias("override"),
            F.count("*").alias("history_count"),
            *_amount_aggregates(),
        )
        .withColumn("amount_cv", _variation())
    )
    return weights.join(rest, KEYS)


def history_features(feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Share per category, the last category raised by a bonus and capped at
    one, then brought back to sum one; one row per key and category."""
    weights = weighted_categories(feedback, key)
    known = weights.where(F.col("category").isin(S.CATEGORIES))
    totals = weights.groupBy(*KEYS).agg(F.sum("weight").alias("_total"))
    last = last_category(feedback, key).withColumnRenamed("category", "_last")
    share = F.coalesce(F.col("weight") / F.col("_total"), F.lit(0.0))
    raised = F.when(
        F.col("category") == F.col("_last"),
        F.least(share + S.LAST_CATEGORY_BONUS, F.lit(1.0)),
    ).otherwise(share)
    grid = totals.join(last, KEYS).withColumn(
        "category", F.explode(string_array(S.CATEGORIES))
    )
    # Thirteen rows per key from here on.
    per_key = Window.partitionBy(*KEYS)
    return (
        grid.join(known, [*KEYS, "category"], "left")
        .withColumn("_raised", raised)
        .withColumn("_sum", F.sum("_raised").over(per_key))
        .select(
            *KEYS,
            "category",
            F.when(
                F.col("_last").isin(S.CATEGORIES) & (F.col("_sum") > 0),
                F.col("_raised") / F.col("_sum"),
            ).otherwise(F.col("_raised")).alias("feature"),
        )
    )


def frequency_30d(txns: DataFrame, key: str = "merchant") -> DataFrame:
    """Add the number of the user's payments to the merchant in the 30 days
    before each transaction."""
    counted = trailing_sums(
        with_keys(txns, key), KEYS, "timestamp", {"freq_30d": F.lit(1).cast("long")}
    )
    return counted.drop(*KEYS)


def recurring_charges(txns: DataFrame, key: str = "merchant") -> DataFrame:
    """Transactions with at least three earlier ones in 30 days and a stable
    amount, with that count, mean and variation."""
    value = F.col("amount").cast("decimal(18,2)")
    sums = trailing_sums(
        with_keys(txns, key),
        KEYS,
        "timestamp",
        {
            "freq_30d": F.lit(1).cast("long"),
            "_sum": value.cast("decimal(28,2)"),
            "_squares": value.cast("double") * value.cast("double"),
        },

    )
    n = F.col("freq_30d").cast("double")
    mean = F.col("_sum").cast("double") / n
    # Doubles can't overflow; what they round off is far below the threshold.
    std = F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0)))
    return (
        sums.where(F.col("freq_30d") >= S.SUBSCRIPTION_MIN_COUNT)
        .withColumn("amount_mean", mean)
        .withColumn("amount_cv", F.when(mean > 0, std / mean).otherwise(1.0))
        .where(F.col("amount_cv") < S.SUBSCRIPTION_MAX_CV)
        .drop(*KEYS, "_sum", "_squares")
    )
