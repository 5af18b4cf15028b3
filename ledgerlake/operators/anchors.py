"""Anchor phrases per category: cold start by text, and seed training cases."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.text import preprocess_text
from ledgerlake.operators import textfeatures as X

# What each category is about, two phrases each.
ANCHORS = {
    "Food": [
        "swiggy zomato restaurant food delivery kfc mcdonalds dominos pizza burger cafe",
        "eatclub faasos box8 freshmenu starbucks chaayos subway",
    ],
    "Groceries": [
        "blinkit zepto bigbasket dmart jiomart milkbasket grofers supermarket grocery",
        "vegetables fruits milk dairy provisions",
    ],
    "Shopping": [
        "amazon flipkart myntra ajio nykaa meesho snapdeal shopping retail clothes",
        "fashion electronics gadgets accessories",
    ],
    "Transport": [
        "uber ola rapido irctc makemytrip redbus indigo flight train cab auto",
        "travel ticket booking commute fare",
    ],
    "Investment": [
        "groww zerodha kuvera mutual fund iccl nsccl stocks equity sip investment",
        "broker demat portfolio smallcase",
    ],
    "Subscription": [
        "netflix spotify hotstar youtube apple prime zee5 sonyliv subscription",
        "streaming membership plan monthly",
    ],
    "Health": [
        "apollo pharmacy medplus 1mg pharmeasy netmeds hospital clinic doctor",
        "medicine health medical",
    ],
    "Utilities": [
        "electricity bescom msedcl airtel jio vodafone vi bsnl gas water bill",
        "recharge broadband internet utility",
    ],
    "Transfer": [
        "sent received person name transfer upi imps neft payment to friend",
        "personal money send",
    ],
    "Entertainment": [
        "bookmyshow pvr inox cinema movie event ticket game dream11",
        "entertainment sports gaming",
    ],
    "Education": [
        "byjus unacademy vedantu coursera udemy college school fees tuition",
        "education learning course",
    ],
    "Payments": [
        "credit card loan emi insurance premium tax challan fine payment bill",
        "cred paytm wallet recharge topup",
    ],
    "Other": ["miscellaneous unknown other general"],
}

# Names for person-to-person seed cases, combined pairwise.
FIRST_NAMES = ["Asha", "Rohit", "Meera", "Kabir", "Lata", "Tarun", "Nisha", "Arjun"]
LAST_NAMES = ["Menon", "Das", "Saxena", "Iqbal", "Rao", "Naik", "Desai", "Pillai"]
PROVIDERS = ["ybl", "okaxis", "hdfcbank", "paytm"]

# Typical amounts per category for seed cases; the rest use the default.
AMOUNT_RANGES = {
    "Food": (60, 800), "Groceries": (100, 2500), "Subscription": (59, 999),
    "Transport": (30, 5000), "Investment": (500, 100000), "Education": (500, 50000),
    "Payments": (1000, 100000),
}
DEFAULT_AMOUNT_RANGE = (100, 5000)


def anchor_phrases(spark: SparkSession) -> DataFrame:
    rows = [(c, i, text) for c, texts in ANCHORS.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "category string, number int, text string")


def anchor_weights(spark: SparkSession) -> DataFrame:
    """(category, term, idf, weight): mean TF-IDF vector of each category's
    phrases, scaled to length one. A few hundred rows."""
    phrases = anchor_phrases(spark).withColumn(
        "phrase", F.concat_ws("/", "category", F.col("number").cast("string"))
    )
    counts = X.term_counts(phrases, "phrase", "text", "word").where(
        ~F.contains("term", F.lit(" "))
    )
    total = F.lit(sum(len(texts) for texts in ANCHORS.values()))
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    terms = X.term_statistics(counts).select("term", idf.alias("idf"))
    weights = counts.join(terms, "term").withColumn(
        "_w", (1 + F.log("tf")) * F.col("idf")
    )
    lengths = weights.groupBy("phrase").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    means = (
        weights.join(lengths, "phrase")
        .groupBy(F.split_part("phrase", F.lit("/"), F.lit(1)).alias("category"), "term", "idf")
        .agg(F.sum(F.col("_w") / F.col("_l")).alias("_m"))
    )
    norms = means.groupBy("category").agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_n"))
    return means.join(norms, "category").select(
        "category", "term", "idf", (F.col("_m") / F.col("_n")).alias("weight")
    )


def cold_start_by_text(texts: DataFrame, key: str, text: str = "raw_text") -> DataFrame:
    """Category by cosine between a text's words and each category's anchor
    words: the fallback where no embedding is at hand.

    The anchor weights are fixed in size and broadcast; similarities are
    summed before they are shuffled. A text without any anchor word is Other.
    """
    spark = texts.sparkSession
    by_label = (
        anchor_weights(spark)
        .groupBy("term", "idf")
        .agg(
            *[
                F.sum(F.when(F.col("category") == c, F.col("weight")).otherwise(0.0)).alias(
                    f"_a{i}"
                )
                for i, c in enumerate(S.LABELS)
            ]
        )
    )
    prepared = texts.select(key, preprocess_text(F.col(text)).alias("_text"))
    counts = X.term_counts(X.by_document(prepared, key), key, "_text", "word").withColumn(
        "_w", 1 + F.log("tf")
    )
    met = counts.join(F.broadcast(by_label), "term").withColumn("_w", F.col("_w") * F.col("idf"))
    sums = met.groupBy(key).agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_length"),
        *[F.sum(F.col("_w") * F.col(f"_a{i}")).alias(f"_s{i}") for i in range(len(S.LABELS))],
    )
    similarities = F.array(*[F.col(f"_s{i}") / F.col("_length") for i in range(len(S.LABELS))])
    scored = texts.join(sums.select(key, similarities.alias("_s")), key, "left")
    return scored.withColumn("_c", _softmax_choice(F.col("_s"))).select(
        *texts.columns,
        F.coalesce("_c.category", F.lit("Other")).alias("category"),
        F.coalesce("_c.confidence", F.lit(0.0)).alias("confidence"),
    )


def _softmax_choice(similarities: Column) -> Column:
    from ledgerlake.functions.blocks import let, string_array

    def choose(s: Column, top: Column) -> Column:
        mass = F.aggregate(
            s, F.lit(0.0), lambda t, x: t + F.exp((x - top) * S.COLD_START_SHARPNESS)
        )
        # of equal ones the first in label order, Other last
        best = F.coalesce(*[F.when(s[S.LABELS.index(c)] == top, c) for c in S.CATEGORIES])
        return let(
            1 / mass,
            lambda c: F.struct(
                F.when(c >= S.CONFIDENCE_THRESHOLD, best).otherwise("Other").alias("category"),
                c.alias("confidence"),
            ),
        )

    return let(similarities, lambda s: let(F.array_max(s), lambda top: choose(s, top)))


def seed_cases(spark: SparkSession) -> DataFrame:
    """Training cases by rule: every anchor word of a category in each payment
    text shape, and pairs of names as transfers."""
    words = (
        anchor_phrases(spark)
        .select("category", F.explode(F.split("text", " ")).alias("word"))
        .where("category <> 'Transfer' or word not in ('upi', 'to', 'payment')")
    )
    people = [("Transfer", f"{a} {b}") for a in FIRST_NAMES for b in LAST_NAMES]
    named = words.unionByName(spark.createDataFrame(people, "category string, word string"))
    handle = F.regexp_replace("word", " ", ".")
    shapes = [F.upper("word"), F.concat(F.lit("VPA "), F.col("word"), F.lit(" "), F.upper("word"))]
    for provider in PROVIDERS:
        shapes.append(
            F.concat(F.lit("VPA "), handle, F.lit(f"@{provider} "), F.upper("word"))
        )
    low = F.coalesce(*[F.when(F.col("category") == c, lo) for c, (lo, _) in AMOUNT_RANGES.items()],
                     F.lit(DEFAULT_AMOUNT_RANGE[0]))
    high = F.coalesce(*[F.when(F.col("category") == c, hi)
                        for c, (_, hi) in AMOUNT_RANGES.items()],
                      F.lit(DEFAULT_AMOUNT_RANGE[1]))
    return named.select("category", F.explode(F.array(*shapes)).alias("receiver")).select(
        F.concat_ws("/", "category", "receiver").alias("case_id"),
        "receiver",
        "category",
        low.cast("double").alias("amount_low"),
        high.cast("double").alias("amount_high"),
        F.lit(8).alias("hour_low"),
        F.lit(22).alias("hour_high"),
    )
