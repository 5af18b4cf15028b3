"""Quality and latency figures."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.shared import materialise


def confusion(predictions: DataFrame) -> DataFrame:
    """(actual, predicted, n): at most one row per pair of labels."""
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, with accuracy and the
    macro and weighted averages; a division by zero gives 0."""
    pairs = confusion(predictions)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    per_actual = pairs.groupBy(F.col("actual").alias("label")).agg(
        F.sum(hit).alias("hits"), F.sum("n").alias("support")
    )
    per_predicted = pairs.groupBy(F.col("predicted").alias("label")).agg(
        F.sum("n").alias("predicted_n")
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hits, support = F.col("hits"), F.col("support")
    labels = (
        per_actual.join(per_predicted, "label", "full")
        .select(
            "label",
            *[
                F.coalesce(c, F.lit(0)).cast("double").alias(c)
                for c in ("hits", "support", "predicted_n")
            ],
        )
        .withColumn("precision", ratio(hits, F.col("predicted_n")))
        .withColumn("recall", ratio(hits, support))
        .withColumn(
            "f1",
            ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = labels.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                *[ratio(F.sum("hits"), total).alias(s) for s in scores],
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                *[F.avg(s).alias(s) for s in scores],
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[ratio(F.sum(F.col(s) * support), total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("_rows")
    ).select(F.inline("_rows"))
    return labels.select("label", *scores, "support").unionByName(summary).withColumn(
        "support", F.col("support").cast("long")
    )


def section_accuracy(checks: DataFrame) -> DataFrame:
    """Passed, total and percentage per section, and over all as TOTAL."""
    return (
        checks.rollup("section")
        .agg(
            F.sum(F.col("hit").cast("long")).alias("passed"),
            F.count("*").alias("total"),
            F.grouping("section").alias("_all"),
        )
        .select(
            F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("section")).alias("section"),
            "passed",
            "total",
            (F.col("passed") * 100 / F.col("total")).alias("percent"),
        )
    )


# Durations are ranked as whole nanoseconds, 16 bits in each of four rounds.
_DIGIT = 16
_ROUNDS = 4


def percentiles(
    durations: DataFrame, column: str = "ms", quantiles: tuple[float, ...] = (0.50, 0.95, 0.99)
) -> DataFrame:
    """Exact element at index int(n * q) of the sorted durations.

    Found digit by digit: values are counted per leading digits, the count
    tells which digits hold the wanted index, and the next round only counts
    values below those. Each round shuffles at most 65,536 counts per prefix, and
    nothing is ever sorted or gathered as a whole. Durations are
    milliseconds, kept to the nanosecond.
    """
    units = durations.where(F.col(column).isNotNull()).select(
        F.round(F.col(column).cast("double") * 1_000_000).cast("long").alias("_u")
    )
    # Values with their counts, written once: each round reads only these.
    units = materialise(units.groupBy("_u").agg(F.count("*").alias("_c")), "durations")
    n = units.agg(F.sum("_c")).scalar()
    wanted = F.array(
        *[
            F.struct(
                F.lit(q).alias("quantile"),
                F.least(F.floor(n * F.lit(q)).cast("long"), n - 1).alias("_index"),
            )
            for q in quantiles
        ]
    )
    spark = durations.sparkSession
    # One row per quantile: the wanted index among the values of a prefix.
    cuts = spark.range(1).select(F.inline(wanted)).withColumn("_prefix", F.lit(0).cast("long"))
    for i in range(_ROUNDS):
        digit = F.shiftright("_u", _DIGIT * (_ROUNDS - 1 - i))
        counted = units.select(digit.alias("_d"), "_c")
        if i:
            prefixes = cuts.select("_prefix").distinct()
            counted = counted.withColumn("_prefix", F.shiftright("_d", _DIGIT)).join(
                F.broadcast(prefixes), "_prefix"
            )
        else:
            counted = counted.withColumn("_prefix", F.lit(0).cast("long"))
        bins = counted.groupBy("_prefix", "_d").agg(F.sum("_c").alias("_n"))
        lower = Window.partitionBy("_prefix").orderBy("_d").rowsBetween(
            Window.unboundedPreceding, -1
        )
        bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        cuts = (
            cuts.join(bins, "_prefix")
            .where("_before <= _index and _index < _before + _n")
            .select("quantile", (F.col("_index") - F.col("_before")).alias("_index"),
                    F.col("_d").alias("_prefix"))
        )
    return cuts.select("quantile", (F.col("_prefix") / 1_000_000).alias(column))
