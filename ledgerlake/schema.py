"""Table schemas, the closed category set and the tuning constants."""

from pyspark.sql import types as T

# The category set. The last one, Other, means "not decided".
CATEGORIES = [
    "Education", "Entertainment", "Food", "Groceries", "Health",
    "Investment", "Payments", "Shopping", "Subscription",
    "Transfer", "Transport", "Utilities", "Other",
]
# Classifier labels are in alphabetical order; ties go to the first label.
LABELS = sorted(CATEGORIES)

# Thresholds and weights of the decision rules.
CONFIDENCE_THRESHOLD = 0.25
HISTORY_LAMBDA = 0.40
HISTORY_DECAY = 0.85
STRONG_HISTORY = 3.0
STRONG_HISTORY_CONFIDENCE = 0.6
SOFT_OVERRIDE_WEIGHT = 0.75
FOOD_AMOUNT_MAX = 500
FOOD_HOURS = [(11, 15), (19, 22)]
FOOD_BOOST = 0.25
SUBSCRIPTION_MIN_COUNT = 3
SUBSCRIPTION_MAX_CV = 0.15
SUBSCRIPTION_BOOST = 0.30
TRANSFER_AMOUNT_MAX = 5000
PERSON_BOOST = 0.20
LAST_CATEGORY_BONUS = 0.10
COLD_START_SHARPNESS = 10
COLD_START_MIN_HISTORY = 2.0
COLD_START_BUMP = 0.15
COLD_START_CAP = 0.99
CHAR_VOCABULARY_MAX = 40_000
WORD_VOCABULARY_MAX = 20_000
MIN_DOCUMENT_FREQUENCY = 2
PREDICT_FEEDBACK_ROWS = 1000
REFIT_FEEDBACK_ROWS = 50
REFIT_TRIGGER = 2
PAGE_SIZE = 20

MONEY = T.DecimalType(18, 2)

TRANSACTIONS = T.StructType([
    T.StructField("raw_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("receiver", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("message_id", T.StringType()),
])

BRONZE = T.StructType(TRANSACTIONS.fields + [
    T.StructField("fingerprint", T.StringType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("bronze_id", T.LongType()),
])

SILVER = T.StructType([
    T.StructField("silver_id", T.LongType()),
    T.StructField("bronze_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("merchant", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("transaction_date", T.DateType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_categorised", T.BooleanType()),
    T.StructField("user_corrected", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("decision_source", T.StringType()),
])

GOLD = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("total_amount", MONEY),
    T.StructField("txn_count", T.LongType()),
])

FEEDBACK = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("silver_id", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("original_category", T.StringType()),
    T.StructField("corrected_category", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("corrected_at", T.TimestampNTZType()),
])

# A message payload: its headers, and its parts as a flat list in depth-first
# order, however deep they nest; ``path`` says where a part stands (0, 1.0, ...).
PAYLOAD = T.StructType([
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    T.StructField("mimeType", T.StringType()),
    T.StructField("body", T.StructType([T.StructField("data", T.StringType())])),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("mimeType", T.StringType()),
        T.StructField("data", T.StringType()),
    ]))),
])
