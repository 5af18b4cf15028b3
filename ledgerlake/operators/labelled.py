"""Labelled examples: generation, balancing, splitting and refit input."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.text import text_variants
from ledgerlake.operators.history import newest_feedback
from ledgerlake.sources.shared import spread

# Payments in 30 days that are plausible per category.
FREQUENCY_RANGES = {
    "Subscription": (1, 4),
    "Utilities": (1, 3),
    "Payments": (1, 3),
    "Food": (0, 15),
    "Transfer": (0, 10),
}
DEFAULT_FREQUENCY_RANGE = (0, 8)
BASE_DATE = "2024-01-01"

_HASH_DIGITS = 12  # hexadecimal digits of a draw


def augment(cases: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per spelling of each text, with its position."""
    return cases.select("*", F.posexplode(text_variants(F.col(text))).alias("variant", "_v")) \
        .drop(text).withColumnRenamed("_v", text)


def draw(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the parts alone: the first digits of
    their SHA-256, the same in any engine."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, _HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_HASH_DIGITS))


def _whole_between(low: Column, high: Column, *parts: Column) -> Column:
    return (low + F.floor(draw(*parts) * (high - low + 1))).cast("int")


def generate_examples(cases: DataFrame, samples: int = 40, seed: int = 42) -> DataFrame:
    """``samples`` examples per case: spelling i mod k, with amount, time and
    frequency drawn by hash from the case's ranges, so every run and every
    partitioning gives the same rows.

    ``cases``: case_id, receiver, category, amount_low, amount_high,
    hour_low, hour_high.
    """
    frequency = F.create_map(
        *[
            F.lit(x)
            for name, (low, high) in FREQUENCY_RANGES.items()
            for x in (name, low * 100 + high)
        ]
    )
    packed = F.coalesce(
        F.try_element_at(frequency, F.col("category")),
        F.lit(DEFAULT_FREQUENCY_RANGE[0] * 100 + DEFAULT_FREQUENCY_RANGE[1]),
    )
    case, i, s = F.col("case_id"), F.col("sample"), F.lit(seed)
    grown = (
        spread(cases).withColumn("_variants", text_variants(F.col("receiver")))
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_frequency", packed)
    )
    amount = F.col("amount_low") + draw(case, i, s, F.lit("amount")) * (
        F.col("amount_high") - F.col("amount_low")
    )
    day = _whole_between(F.lit(0), F.lit(364), case, i, s, F.lit("day"))
    hour = _whole_between(F.col("hour_low"), F.col("hour_high"), case, i, s, F.lit("hour"))
    minute = _whole_between(F.lit(0), F.lit(59), case, i, s, F.lit("minute"))
    low, high = F.floor(F.col("_frequency") / 100), F.col("_frequency") % 100
    return grown.select(
        "case_id",
        "sample",
        F.get(F.col("_variants"), i % F.size("_variants")).alias("raw_text"),
        "category",
        F.round(amount, 2).cast(S.MONEY).alias("amount"),
        (
            F.lit(BASE_DATE).cast("timestamp_ntz")
            + F.make_dt_interval(day, hour, minute)
        ).alias("timestamp"),
        _whole_between(low, high, case, i, s, F.lit("frequency")).alias("freq_30d"),
    )


def weighted_union(real: DataFrame, synthetic: DataFrame, copies: int = 3) -> DataFrame:
    """Real examples ``copies`` times, and the synthetic ones once."""
    repeated = real.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))
    ).drop("_copy")
    return repeated.unionByName(synthetic)


def known_labels(examples: DataFrame, labels: DataFrame, column: str = "category") -> DataFrame:
    """Examples whose label the model knows."""
    return examples.join(labels.select(column).distinct(), column, "left_semi")


def class_distribution(examples: DataFrame) -> DataFrame:
    return examples.groupBy("category").agg(F.count("*").alias("n"))


def class_weights(examples: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = class_distribution(examples)
    everything = Window.partitionBy()  # at most one row per class
    return counts.select(
        "category",
        "n",
        (
            F.sum("n").over(everything)
            / (F.count("*").over(everything) * F.col("n"))
        ).alias("weight"),
    )


def upsample(examples: DataFrame, id_column: str, floor: int = 300) -> DataFrame:
    """Repeat rows of classes below max(``floor``, smallest class) in turn.

    Only classes of fewer than ``floor`` rows can be below that bound, so the
    numbering inside a class never sees more than ``floor`` rows.
    """
    counts = class_distribution(examples)
    everything = Window.partitionBy()
    needed = counts.withColumn(
        "_target", F.greatest(F.lit(floor), F.min("n").over(everything))
    ).where(F.col("n") < F.col("_target"))
    number = Window.partitionBy("category").orderBy(id_column)
    extra = F.col("_target") - F.col("n")
    rank = F.row_number().over(number) - 1
    added = (
        examples.join(F.broadcast(needed), "category")
        .withColumn("_rank", rank)
        .withColumn(
            "_copies",
            F.floor(extra / F.col("n")) + (F.col("_rank") < extra % F.col("n")).cast("int"),
        )
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*examples.columns)
    )
    return examples.unionByName(added)


def append_minimum(examples: DataFrame, id_column: str, minimum: int = 100) -> DataFrame:
    """Append ``minimum`` repeated rows to every class that has fewer."""
    counts = class_distribution(examples).where(F.col("n") < minimum)
    number = Window.partitionBy("category").orderBy(id_column)
    added = (
        examples.join(F.broadcast(counts), "category")
        .withColumn("_rank", F.row_number().over(number) - 1)
        .withColumn(
            "_copies",
            F.floor(F.lit(minimum) / F.col("n"))
            + (F.col("_rank") < F.lit(minimum) % F.col("n")).cast("int"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*examples.columns)
    )
    return examples.unionByName(added)


def stratified_split(
    examples: DataFrame, id_column: str, fraction: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``is_validation``: true for ceil(fraction * n) rows of each class,
    those with the lowest hash of their id. Rows without a class are an error.

    Rows are counted per class and hash slice first. All rows of the slices
    below the cut are in and all above are out; only the one slice per class
    that holds the cut is ranked, and hashing makes slices equally small
    however the classes are sized. So no class is ever sorted whole.
    """
    classed = F.coalesce("category", F.raise_error(F.lit("an example has no category")))
    examples = examples.withColumn("category", classed)
    hashed = examples.withColumn("_hash", F.xxhash64(F.col(id_column), F.lit(seed)))
    # 64-bit hashes in 2**16 slices, in hash order.
    hashed = hashed.withColumn("_slice", F.shiftright("_hash", 48))
    slices = hashed.groupBy("category", "_slice").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy("category").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy("category")
    cuts = (
        slices.withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
        .withColumn("_wanted", F.ceil(F.sum("_n").over(whole) * F.lit(fraction)))
        .where("_before < _wanted and _before + _n >= _wanted")
        .select(
            "category",
            F.col("_slice").alias("_cut"),
            (F.col("_wanted") - F.col("_before")).alias("_rest"),
        )
    )
    placed = hashed.join(F.broadcast(cuts), "category", "left")
    in_slice = Window.partitionBy("category", "_slice").orderBy("_hash", id_column)
    ranked = placed.where("_slice = _cut").withColumn("_rank", F.row_number().over(in_slice))
    rest = placed.where("_slice <> _cut").withColumn("_rank", F.lit(0))
    return (
        rest.unionByName(ranked)
        .withColumn(
            "is_validation",
            (F.col("_slice") < F.col("_cut"))
            | ((F.col("_slice") == F.col("_cut")) & (F.col("_rank") <= F.col("_rest"))),
        )
        .select(*examples.columns, "is_validation")
    )


def refit_input(
    feedback: DataFrame, labels: list[str] = S.LABELS, rows: int = S.REFIT_FEEDBACK_ROWS
) -> DataFrame:
    """The newest ``rows`` corrections over all users as training rows;
    unknown labels are dropped. ``model.refit`` gives them their weight, the
    same for batches of any size."""
    newest = newest_feedback(feedback, rows).where(F.col("corrected_category").isin(labels))
    return newest.select(
        "user_id",
        "silver_id",
        F.coalesce(F.nullif("raw_text", F.lit("")), "merchant").alias("raw_text"),
        F.col("corrected_category").alias("category"),
        "amount",
        F.col("corrected_at").alias("timestamp"),
        F.lit(0).alias("freq_30d"),
    )


def model_status(registry: DataFrame) -> DataFrame:
    """Latest state per model: when trained and updated, corrections applied.

    ``registry``: model, version, trained_at, updated_at, samples_applied.
    """
    return registry.groupBy("model").agg(
        F.max("version").alias("version"),
        F.max("trained_at").alias("trained_at"),
        F.max("updated_at").alias("updated_at"),
        F.coalesce(F.sum("samples_applied"), F.lit(0)).alias("samples_applied"),
    )
