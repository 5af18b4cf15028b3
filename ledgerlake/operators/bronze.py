"""Raw to bronze: fingerprints, incrementality and deduplication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import fingerprint, with_merchant

RAW_COLUMNS = [
    "raw_id", "user_id", "amount", "receiver", "transaction_type",
    "timestamp", "source", "raw_text", "message_id",
]


def with_fingerprint(raw: DataFrame, key: str = "receiver") -> DataFrame:
    """Add the fingerprint. ``key="merchant"`` hashes the cleaned merchant, so
    that differently worded copies from two sources still meet."""
    if key == "merchant":
        raw = with_merchant(raw, out="_merchant")
        key = "_merchant"
    hashed = fingerprint(F.col("user_id"), F.col("amount"), F.col(key), F.col("timestamp"))
    return raw.withColumn("fingerprint", hashed).drop("_merchant")


def not_yet_in_bronze(raw: DataFrame, bronze: DataFrame) -> DataFrame:
    """Raw rows that no earlier run has processed."""
    return raw.join(bronze.select("raw_id"), "raw_id", "left_anti")


def first_per_fingerprint(raw: DataFrame) -> DataFrame:
    """The row with the lowest ``raw_id`` of every (user, fingerprint).

    A partial aggregate rather than a ranking window: copies collapse on the
    map side, so a payment delivered a billion times is no hot task.
    """
    rest = [c for c in raw.columns if c not in ("raw_id", "user_id", "fingerprint")]
    first = F.min(F.struct("raw_id", *rest)).alias("_first")
    return raw.groupBy("user_id", "fingerprint").agg(first).select(
        "user_id", "fingerprint", "_first.*"
    )


def to_bronze(
    raw: DataFrame, bronze: DataFrame | None = None, key: str = "receiver"
) -> DataFrame:
    """New bronze rows: unprocessed, deduplicated within and across runs."""
    if bronze is not None:
        raw = not_yet_in_bronze(raw, bronze)
    rows = first_per_fingerprint(with_fingerprint(raw, key))
    if bronze is not None:
        # After the collapse (user, fingerprint) is unique on the left.
        rows = rows.join(
            bronze.select("user_id", "fingerprint"), ["user_id", "fingerprint"], "left_anti"
        )
    return rows.select(
        *raw.columns,
        "fingerprint",
        F.lit(False).alias("is_duplicate"),
        F.col("raw_id").alias("bronze_id"),
    )


def dedupe_stats(raw: DataFrame, bronze: DataFrame) -> DataFrame:
    """Per user and source: inserted, duplicates blocked, already processed.

    Fingerprints are counted per source before anything is compared, so the
    comparison only sees one row per (user, fingerprint, source).
    """
    processed = (
        raw.join(bronze.select("raw_id"), "raw_id", "left_semi")
        .groupBy("user_id", "source")
        .agg(F.count("*").alias("already_processed"))
    )
    groups = (
        with_fingerprint(not_yet_in_bronze(raw, bronze))
        .groupBy("user_id", "fingerprint", "source")
        .agg(F.count("*").alias("n"), F.min("raw_id").alias("raw_id"))
    )
    known = bronze.select("user_id", "fingerprint", F.lit(True).alias("_known"))
    winners = groups.groupBy("user_id", "fingerprint").agg(F.min("raw_id").alias("_first"))
    flagged = groups.join(winners, ["user_id", "fingerprint"]).join(
        known, ["user_id", "fingerprint"], "left"
    )
    won = (F.col("raw_id") == F.col("_first")) & F.col("_known").isNull()
    fresh = flagged.groupBy("user_id", "source").agg(
        F.sum(won.cast("long")).alias("inserted"),
        F.sum(F.col("n") - won.cast("long")).alias("duplicates_blocked"),
    )
    return fresh.join(processed, ["user_id", "source"], "full").select(
        "user_id",
        "source",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("inserted", "duplicates_blocked", "already_processed")
        ],
    )
