"""From classifier probabilities to a category.

Probabilities travel as one array per transaction in label order, so the
whole cascade is a projection; the only join is the lookup of the history.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import let, string_array
from ledgerlake.functions.text import looks_like_person, norm_key
from ledgerlake.operators.history import KEYS, history_profile


def normalised(p: Column) -> Column:
    """The array scaled to sum one; unchanged when it sums to zero."""

    def scale(q: Column) -> Column:
        total = F.aggregate(q, F.lit(0.0), lambda s, x: s + x)
        return let(total, lambda t: F.when(t > 0, F.transform(q, lambda x: x / t)).otherwise(q))

    return let(p, scale)


def pattern_boosts(
    p: Column,
    receiver: Column,
    amount: Column,
    timestamp: Column,
    frequency: Column,
    amount_count: Column,
    amount_cv: Column,
) -> Column:
    """Additive boosts for meal-time, recurring and person-to-person payments."""
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    hour = F.hour(timestamp)
    meal = F.lit(False)
    for low, high in S.FOOD_HOURS:
        meal = meal | hour.between(low, high)
    food = (value <= S.FOOD_AMOUNT_MAX) & meal
    recurring = (
        (F.coalesce(frequency, F.lit(0)) >= S.SUBSCRIPTION_MIN_COUNT)
        & (F.coalesce(amount_count, F.lit(0)) >= S.SUBSCRIPTION_MIN_COUNT)
        & (F.coalesce(amount_cv, F.lit(1.0)) < S.SUBSCRIPTION_MAX_CV)
    )
    person = looks_like_person(receiver) & (value <= S.TRANSFER_AMOUNT_MAX)
    boosts = {
        "Food": F.when(food, S.FOOD_BOOST).otherwise(0.0),
        "Subscription": F.when(recurring, S.SUBSCRIPTION_BOOST).otherwise(0.0),
        "Transfer": F.when(person, S.PERSON_BOOST).otherwise(0.0),
    }
    none = F.lit(0.0)
    added = F.array(*[boosts.get(label, none) for label in S.LABELS])
    return F.zip_with(p, added, lambda x, b: x + b)


def history_bias(p: Column, weights: Column, total: Column) -> Column:
    """Blend with the key's category distribution where there is one."""

    def blend(q: Column) -> Column:
        blended = F.zip_with(
            q, weights, lambda x, w: (1 - S.HISTORY_LAMBDA) * x + S.HISTORY_LAMBDA * w / total
        )
        return F.when(total > 0, blended).otherwise(q)

    return let(p, blend)


def soft_override(p: Column, override: Column) -> Column:
    """Pull towards the user's own correction, if its label is known."""
    weight = S.SOFT_OVERRIDE_WEIGHT
    labels = string_array(S.LABELS)

    def pull(q: Column) -> Column:
        pulled = F.zip_with(
            q,
            labels,
            lambda x, label: (1 - weight) * x
            + F.when(label == override, F.lit(weight)).otherwise(0.0),
        )
        return F.when(override.isin(S.LABELS), pulled).otherwise(q)

    return let(p, pull)


def with_history(txns: DataFrame, profile: DataFrame, key: str = "merchant") -> DataFrame:
    """Look up the history profile of each transaction.

    The profile has one row per key. It is broadcast only if the adaptive
    planner measures it to be small; otherwise the join shuffles and a hot
    key on the transaction side is split by the adaptive skew join.
    """
    keyed = txns.withColumn("user_key", norm_key(F.col("user_id"))).withColumn(
        "merchant_key", norm_key(F.coalesce(key, F.lit("")))
    )
    return keyed.join(profile, KEYS, "left").drop(*KEYS)


def final_probabilities(p: Column, frequency: Column) -> Column:
    """Boosts, history and override in turn, each brought back to sum one.

    Reads the transaction columns and the profile columns.
    """
    boosted = pattern_boosts(
        p, F.col("receiver"), F.col("amount"), F.col("timestamp"), frequency,
        F.col("amount_count"), F.col("amount_cv"),
    )
    biased = history_bias(normalised(boosted), F.col("weights"), F.col("weight_total"))
    return normalised(soft_override(normalised(biased), F.col("override")))


def decision(p: Column, weight_total: Column, override: Column) -> Column:
    """Struct of category, confidence, decision_source and p.

    The first label wins a tie. A strong history is trusted with at least 0.6;
    otherwise a weak maximum means Other.
    """
    strong = F.coalesce(weight_total, F.lit(0.0)) >= S.STRONG_HISTORY
    labels = string_array(S.LABELS)

    def pick(q: Column, top: Column) -> Column:
        best = F.element_at(labels, F.array_position(q, top).cast("int"))
        category = F.when(~strong & (top < S.CONFIDENCE_THRESHOLD), "Other").otherwise(best)
        confidence = F.when(
            strong, F.greatest(top, F.lit(S.STRONG_HISTORY_CONFIDENCE))
        ).otherwise(top)
        return let(
            category,
            lambda c: F.struct(
                c.alias("category"),
                confidence.alias("confidence"),
                F.when(c == "Other", "low_confidence")
                .when(override.isin(S.LABELS), "override")
                .otherwise("ml+history")
                .alias("decision_source"),
                q.alias("p"),
            ),
        )

    return let(p, lambda q: let(F.array_max(q), lambda top: pick(q, top)))


def decide(scored: DataFrame, p: Column | None = None) -> DataFrame:
    """Add category, confidence and decision_source to scored rows."""
    p = F.col("p") if p is None else p
    decided = decision(p, F.col("weight_total"), F.col("override"))
    return scored.withColumn("_d", decided).select(
        *[c for c in scored.columns if c != "p"], "_d.*"
    )


def categorise(
    txns: DataFrame,
    probabilities: DataFrame,
    feedback: DataFrame | None,
    key: str = "merchant",
    profile: DataFrame | None = None,
) -> DataFrame:
    """Final category of every transaction.

    The history is that of ``feedback``, or a ``profile`` made before.

    ``txns``: silver_id, user_id, merchant, receiver, amount, timestamp and
    optionally freq_30d; ``probabilities``: silver_id and the array ``p``, or
    the transactions with ``p`` added, which needs no join.
    """
    if set(txns.columns) <= set(probabilities.columns):
        scored = probabilities
    else:
        scored = txns.join(probabilities, "silver_id")
    scored = with_history(scored, history_profile(feedback, key) if profile is None else profile, key)
    frequency = F.col("freq_30d" if "freq_30d" in txns.columns else "history_count")
    return decide(scored, final_probabilities(F.col("p"), frequency)).select(
        "silver_id", "user_id", "category", "confidence", "decision_source", "p"
    )


def categorise_cold(txns: DataFrame, feedback: DataFrame, key: str = "merchant") -> DataFrame:
    """Final category of every transaction where no model is trained yet:
    anchor words, and a remembered category where the history has weight."""
    from ledgerlake.operators.anchors import cold_start_by_text

    decided = cold_start_by_text(txns, "silver_id")
    decided = cold_start_with_history(decided, history_profile(feedback, key), key)
    return decided.select(
        "silver_id",
        "user_id",
        "category",
        "confidence",
        F.when(F.col("category") == "Other", "low_confidence").otherwise("cold_start").alias("decision_source"),
    )


def explode_probabilities(df: DataFrame, *keys: str, p: str = "p") -> DataFrame:
    """One row per key and label.

    A plain explode would have the planner test each array's size first, below
    everything that makes the arrays: with lambdas copied into each other, that
    costs many times what the arrays do.
    """
    long = df.select(*keys, F.posexplode_outer(p).alias("_i", "p")).where("_i is not null")
    labels = string_array(S.LABELS)
    return long.withColumn("category", F.element_at(labels, F.col("_i") + 1)).drop("_i")


def collect_probabilities(long: DataFrame, key: str) -> DataFrame:
    """Array form of long probabilities: 13 conditional sums, no collecting."""
    return long.groupBy(key).agg(
        F.array(
            *[
                F.coalesce(F.sum(F.when(F.col("category") == x, F.col("p"))), F.lit(0.0))
                for x in S.LABELS
            ]
        ).alias("p")
    )


def top_k(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most likely categories of each row, within the row."""
    pairs = F.zip_with(
        string_array(S.LABELS),
        F.col("p"),
        lambda label, x: F.struct((-x).alias("_down"), label.alias("category")),
    )
    ranked = F.slice(F.array_sort(pairs), 1, k)
    return df.select(key, F.posexplode(ranked).alias("_i", "_top")).select(
        key,
        (F.col("_i") + 1).alias("rank"),
        F.col("_top.category").alias("category"),
        (-F.col("_top._down")).alias("p"),
    )


def anchor_centroids(
    examples: DataFrame, label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """Mean embedding per label, scaled to length one.

    Vector means are summed inside the aggregate, so one partial sum per
    label and task is shuffled rather than one row per dimension.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    means = examples.groupBy(label).agg(vector_to_array(mean).alias("_mean"))
    norm = F.sqrt(F.aggregate("_mean", F.lit(0.0), lambda s, x: s + x * x))
    return means.withColumn("_norm", norm).select(
        label,
        F.transform("_mean", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm"))
                    .otherwise(x)).alias("anchor"),
    )


MAX_ANCHORS = 1_000


def cold_start(
    texts: DataFrame,
    anchors: DataFrame,
    key: str,
    label: str = "label",
    vector: str = "embedding",
    fallback: Column | None = None,
) -> DataFrame:
    """Nearest anchor by cosine, with a sharpened softmax as confidence.

    There is one anchor per label, so all anchors travel as one constant
    array inside the plan; each text is compared in a projection. The first
    label in label order wins a tie, Other last; below the threshold the
    answer is ``fallback`` (Other by default). More than ``MAX_ANCHORS``
    labels are an error: they wouldn't fit a plan.
    """
    if anchors.limit(MAX_ANCHORS + 1).count() > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors")
    place = F.struct((F.col(label).cast("string") == "Other").alias("other"), F.col(label).alias("label"), "anchor")
    pairs = anchors.groupBy().agg(F.array_sort(F.collect_list(place)).alias("a"))
    v = F.col(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    def similarity(anchor: Column) -> Column:
        dot = F.aggregate(
            F.zip_with(v, anchor, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
        )
        return F.when(F.col("_length") > 0, dot / F.col("_length")).otherwise(0.0)

    compared = (
        texts.withColumn("_length", length)
        .withColumn("_anchors", pairs.scalar())
        .withColumn(
            "_s",
            F.transform(
                "_anchors",
                lambda x: F.struct(similarity(x["anchor"]).alias("s"), x["label"].alias("label")),
            ),
        )
        .withColumn("_best", F.array_max(F.transform("_s", lambda x: x["s"])))
    )
    mass = F.aggregate(
        "_s",
        F.lit(0.0),
        lambda t, x: t + F.exp((x["s"] - F.col("_best")) * S.COLD_START_SHARPNESS),
    )
    best = F.filter("_s", lambda x: x["s"] == F.col("_best"))[0]["label"]
    other = F.lit("Other") if fallback is None else fallback
    return compared.withColumn("confidence", 1 / mass).select(
        *[F.col(c) for c in dict.fromkeys([key, *texts.columns]) if c != vector],
        F.when(F.col("confidence") >= S.CONFIDENCE_THRESHOLD, best).otherwise(other)
        .alias("category"),
        "confidence",
    )


def cold_start_with_history(decided: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Let a history weight of two or more replace the cold-start answer."""
    looked_up = with_history(decided, profile, key).withColumn(
        "_weight", F.array_max("weights")
    )
    labels = string_array(S.LABELS)
    remembered = F.element_at(labels, F.array_position("weights", F.col("_weight")).cast("int"))
    known = F.coalesce(F.col("_weight"), F.lit(0.0)) >= S.COLD_START_MIN_HISTORY
    return looked_up.withColumn(
        "category", F.when(known, remembered).otherwise(F.col("category"))
    ).withColumn(
        "confidence",
        F.when(
            known, F.least(F.col("confidence") + S.COLD_START_BUMP, F.lit(S.COLD_START_CAP))
        ).otherwise(F.col("confidence")),
    ).select(*decided.columns)
