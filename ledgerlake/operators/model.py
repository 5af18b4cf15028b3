"""The text-and-metadata classifier.

A linear model over sparse character, word and metadata features (and an
embedding column, where the input has one). Because it is linear, the text's
share of each score is computed once per distinct text and the metadata's
share per row, in training (``linear``) and in scoring alike.
"""

import datetime
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schema as S
from ledgerlake.functions.blocks import string_array
from ledgerlake.functions.features import METADATA_FEATURES, metadata_features
from ledgerlake.functions.text import preprocess_text
from ledgerlake.operators import linear
from ledgerlake.operators import textfeatures as X
from ledgerlake.operators.labelled import class_weights
from ledgerlake.sources.shared import materialise, new_folder

#: How often a correction counts against a base example.
REFIT_WEIGHT = 3

#: One row per saved version; ``labelled.model_status`` reads them.
REGISTRY = "model string, version long, trained_at timestamp_ntz, updated_at timestamp_ntz, samples_applied long"

# Text features first, then the metadata, then the embedding.


@dataclass
class TextModel:
    """``vocabulary``: idx, analyser, term, idf. ``coefficients``: idx and one
    weight per label. ``tail``: per label, the weights of metadata and
    embedding; ``intercepts``: one per label. ``embedding``: the name of the
    embedding column, if it has one."""

    vocabulary: DataFrame
    coefficients: DataFrame
    tail: list[list[float]]
    intercepts: list[float]
    labels: list[str]
    embedding: str | None = None

    def save(
        self,
        path: str,
        as_of: datetime.datetime | None = None,
        model: str = "text",
        version: int = 1,
        samples_applied: int = 0,
    ) -> None:
        """Write one version of the model under its own path, with its row of
        the registry: ``as_of`` is when it was trained or, with samples, last
        updated."""
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        self.coefficients.write.parquet(f"{path}/coefficients")
        rows = list(zip(range(len(self.labels)), self.labels, self.tail, self.intercepts))
        spark.createDataFrame(
            rows, "i int, label string, tail array<double>, intercept double"
        ).withColumn("embedding", F.lit(self.embedding)).write.parquet(f"{path}/labels")
        trained = None if samples_applied else as_of
        row = [(model, version, trained, as_of, samples_applied)]
        spark.createDataFrame(row, REGISTRY).write.parquet(f"{path}/registry")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextModel":
        rows = spark.read.parquet(f"{path}/labels").orderBy("i").collect()
        return TextModel(
            spark.read.parquet(f"{path}/vocabulary"),
            spark.read.parquet(f"{path}/coefficients"),
            [list(r["tail"]) for r in rows],
            [r["intercept"] for r in rows],
            [r["label"] for r in rows],
            rows[0]["embedding"],
        )


def distinct_texts(examples: DataFrame, text: str = "raw_text") -> DataFrame:
    """Prepared texts with the number of rows each stands for."""
    return examples.groupBy(preprocess_text(F.col(text)).alias("text")).agg(
        F.count("*").alias("copies")
    )


def _counts(texts: DataFrame) -> DataFrame:
    parted = X.by_document(texts, "text")
    counted = [
        X.term_counts(parted, "text", "text", a).withColumn("analyser", F.lit(a))
        for a in X.ANALYSERS
    ]
    return counted[0].unionByName(counted[1])


def fit_vocabulary(
    texts: DataFrame,
    sizes: dict[str, int] | None = None,
    min_documents: int = S.MIN_DOCUMENT_FREQUENCY,
) -> DataFrame:
    """Character terms, then word terms, numbered through. ``sizes``: terms of
    each analyser at most."""
    total = texts.agg(F.sum("copies")).scalar()
    copies = texts.select("text", "copies")
    counts = _counts(texts.select("text")).join(copies, "text")
    parts = [
        X.vocabulary(
            X.term_statistics(counts.where(F.col("analyser") == a), F.col("copies")),
            total,
            size,
            min_documents,
        ).withColumn("analyser", F.lit(a))
        for a, size in (sizes or X.ANALYSERS).items()
    ]
    both = parts[0].unionByName(parts[1])
    # At most 60,000 rows.
    numbered = Window.orderBy("analyser", "idx")
    return both.withColumn("idx", F.row_number().over(numbered) - 1).select(
        "idx", "analyser", "term", "idf"
    )


def text_weights(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(text, idx, weight): TF-IDF, scaled to length one per analyser."""
    counts = _counts(texts.select("text").distinct())
    weighted = counts.join(F.broadcast(vocab), ["analyser", "term"]).withColumn(
        "_w", (1 + F.log("tf")) * F.col("idf")
    )
    part = Window.partitionBy("text", "analyser")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(part))
    return weighted.select("text", "idx", (F.col("_w") / norm).alias("weight"))


def _gathered(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(text, terms): the weights of each text with a known term, at most one
    entry per vocabulary term."""
    return text_weights(texts, vocab).groupBy("text").agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("terms")
    )


def _tail(embedding: str | None) -> Column:
    tail = F.array(
        *metadata_features(F.col("amount"), F.col("timestamp"), F.col("freq_30d"))
    )
    return F.concat(tail, F.col(embedding).cast("array<double>")) if embedding else tail


def _as_vectors(df: DataFrame, column: str) -> DataFrame:
    """Write ``df`` and read its structs of type, size, indices and values as
    the sparse vectors that they are stored as."""
    path = new_folder(df.sparkSession, "features")
    df.write.parquet(path)
    fields = [
        T.StructField(f.name, VectorUDT()) if f.name == column else f for f in df.schema.fields
    ]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def feature_matrix(
    examples: DataFrame,
    vocab: DataFrame,
    text_size: int,
    embedding: str | None = None,
    embedding_size: int = 0,
) -> DataFrame:
    """Examples with their sparse feature vector, written to the shared folder.

    Terms are gathered per distinct text, at most one entry per vocabulary
    term. The prepared text is stored first, so that no filter on it repeats
    its making.
    """
    examples = materialise(
        examples.withColumn("text", preprocess_text(F.col("raw_text"))), "prepared"
    )
    gathered = _gathered(examples.select("text").distinct(), vocab).withColumnRenamed("terms", "_terms")
    tail = _tail(embedding)
    tail_size = len(METADATA_FEATURES) + embedding_size
    terms = F.coalesce(F.col("_terms"), F.array().cast("array<struct<idx:int,weight:double>>"))
    joined = (
        examples.join(gathered, "text", "left")
        .withColumn("_terms", terms)
    )
    indices = F.concat(
        F.transform("_terms", lambda t: t["idx"]),
        F.sequence(F.lit(text_size), F.lit(text_size + tail_size - 1)),
    )
    values = F.concat(F.transform("_terms", lambda t: t["weight"]), tail)
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(text_size + tail_size).alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    return _as_vectors(joined.withColumn("features", sparse).drop("_terms", "text"), "features")


def train(
    examples: DataFrame,
    labels: list[str] = S.LABELS,
    max_iter: int = 25,
    reg: float = 1e-4,
    weight: str | None = None,
    embedding: str | None = None,
    embedding_size: int = 0,
    sizes: dict[str, int] | None = None,
    min_documents: int = S.MIN_DOCUMENT_FREQUENCY,
) -> TextModel:
    """One log-loss classifier per label, classes balanced by weight.

    ``examples``: raw_text, category, amount, timestamp, freq_30d, an optional
    weight column that multiplies the class weight, and an optional embedding
    column of ``embedding_size`` numbers. ``sizes`` and ``min_documents``: see
    ``fit_vocabulary``. A label without an example never gets a probability.
    """
    spark = examples.sparkSession
    vocab = materialise(
        fit_vocabulary(distinct_texts(examples), sizes, min_documents), "vocabulary"
    )
    size = vocab.count()
    index = F.array_position(string_array(labels), F.col("category")) - 1
    balanced = class_weights(examples).select("category", F.col("weight").alias("_balance"))
    own = F.col(weight) if weight else F.lit(1.0)
    rows = (
        examples.where(F.col("category").isin(labels))
        .join(F.broadcast(balanced), "category")
        .select(
            preprocess_text(F.col("raw_text")).alias("text"),
            index.cast("int").alias("label"),
            (F.col("_balance") * own).alias("weight"),
            _tail(embedding).alias("tail"),
        )
    )
    rows = materialise(rows, "training")
    terms = materialise(_gathered(rows.select("text").distinct(), vocab), "training-texts")
    numbers = len(METADATA_FEATURES) + embedding_size
    blocks = materialise(linear.blocks(rows, terms, numbers), "training-blocks")
    weights, intercepts = linear.fit(blocks, size, numbers, len(labels), max_iter, reg)
    # At most 60,000 terms times 13 labels.
    table = list(enumerate(weights[:, :size].T.tolist()))
    coefficients = spark.createDataFrame(table, "idx int, w array<double>")
    return TextModel(
        vocab, coefficients, weights[:, size:].tolist(), intercepts.tolist(), labels, embedding
    )


def refit(
    base: DataFrame, corrections: DataFrame, repeat: int = REFIT_WEIGHT, **options
) -> TextModel:
    """A new model on the base examples and the corrections together, the
    corrections counting ``repeat`` times. Spark's classifiers have no warm
    start, so this replaces the in-place gradient step."""
    columns = ["raw_text", "category", "amount", "timestamp", "freq_30d"]
    merged = (
        base.select(*columns, F.lit(1.0).alias("row_weight"))
        .unionByName(corrections.select(*columns, F.lit(float(repeat)).alias("row_weight")))
    )
    return train(merged, weight="row_weight", **options)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoids(txns: DataFrame, model: TextModel, key: str = "silver_id") -> DataFrame:
    """``txns`` with ``_p``: the sigmoid of each label's score, in label order.

    Terms are scored per distinct text against the broadcast coefficients
    (bounded by the vocabulary), summed before they are shuffled back, and
    met by each transaction in one join on the text.
    """
    n = len(model.labels)
    if key not in txns.columns:
        raise ValueError(f"no column {key}")
    rows = txns.withColumn("_text", preprocess_text(F.col("raw_text")))
    texts = rows.select(F.col("_text").alias("text")).distinct()
    weights = text_weights(texts, model.vocabulary)
    scored = weights.join(F.broadcast(model.coefficients), "idx").groupBy("text").agg(
        *[F.sum(F.col("weight") * F.col("w")[i]).alias(f"_s{i}") for i in range(n)]
    )
    frequency = F.col("freq_30d") if "freq_30d" in txns.columns else F.lit(0)
    meta = metadata_features(F.col("amount"), F.col("timestamp"), frequency)
    kept = [c for c in txns.columns if c != "p"]
    joined = rows.join(scored.withColumnRenamed("text", "_text"), "_text", "left").select(
        *kept,
        *[m.alias(f"_m_{name}") for m, name in zip(meta, METADATA_FEATURES)],
        *[F.coalesce(f"_s{i}", F.lit(0.0)).alias(f"_s{i}") for i in range(n)],
    )
    scores = []
    for i in range(n):
        score = F.col(f"_s{i}") + model.intercepts[i]
        for name, w in zip(METADATA_FEATURES, model.tail[i]):
            score = score + F.col(f"_m_{name}") * w
        if model.embedding:
            weights_i = F.expr(f"array({', '.join(f'{w!r}D' for w in model.tail[i][len(METADATA_FEATURES):])})")
            product = F.zip_with(F.col(model.embedding).cast("array<double>"), weights_i, lambda x, w: x * w)
            score = score + F.aggregate(product, F.lit(0.0), lambda t, x: t + x)
        scores.append(_sigmoid(score))
    return joined.select(*kept, F.array(*scores).alias("_p"))


def predict_proba(txns: DataFrame, model: TextModel, key: str = "silver_id") -> DataFrame:
    """``txns`` with ``p``: per-label sigmoid scores scaled to sum one, in
    label order. ``key`` names the column that numbers the rows."""
    n = len(model.labels)
    total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
    return sigmoids(txns, model, key).withColumn("_total", total).select(
        *[c for c in txns.columns if c != "p"],
        F.when(F.col("_total") > 0, F.transform("_p", lambda x: x / F.col("_total")))
        .otherwise(F.array(*[F.lit(1.0 / n)] * n))
        .alias("p"),
    )
