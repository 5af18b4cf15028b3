"""The classifier advanced by corrections, without its base examples.

The state is that of a linear model with per-coordinate steps: of every feature
(terms of a fixed vocabulary, metadata, a constant) one weight and the sum of its
squared gradients per label. A batch of examples changes the state of the features
that it has, so a refit costs what the batch holds, however many examples the model
was trained on. The state is bounded by the vocabulary (at most 60,000 terms by 13
labels); gradients are summed where the examples lie and only sums are shuffled.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import string_array
from ledgerlake.functions.features import METADATA_FEATURES, metadata_features
from ledgerlake.functions.text import preprocess_text
from ledgerlake.operators.model import REFIT_WEIGHT, TextModel, sigmoids, text_weights
from ledgerlake.sources.journal import Journal
from ledgerlake.sources.shared import materialise
from ledgerlake.sources.sinks import latest_by_key

#: Coordinates of the constant and the metadata; terms have numbers from 0 on.
CONSTANT = -1
TAIL = {name: -2 - i for i, name in enumerate(METADATA_FEATURES)}
RATE = 0.5
#: What a coordinate's sum of squared gradients starts from: larger means smaller first steps.
START = 0.01

STATE = "idx int, w array<double>, g array<double>"


def state_of(model: TextModel, start: float = START) -> DataFrame:
    """The state that a trained model starts from."""
    spark = model.vocabulary.sparkSession
    rows = [(CONSTANT, [float(x) for x in model.intercepts])]
    rows += [(TAIL[name], [float(t[i]) for t in model.tail]) for i, name in enumerate(METADATA_FEATURES)]
    tail = spark.createDataFrame(rows, "idx int, w array<double>")
    both = model.coefficients.select(F.col("idx").cast("int").alias("idx"), "w").unionByName(tail)
    # a label without an example has no finite weight to start from
    w = F.transform("w", lambda x: F.greatest(x, F.lit(-1e3)))
    return both.select("idx", w.alias("w"), F.array_repeat(F.lit(float(start)), len(model.labels)).alias("g"))


def model_of(state: DataFrame, vocabulary: DataFrame, labels: list[str]) -> TextModel:
    """The model that a state stands for."""
    tail = {r.idx: list(r.w) for r in state.where("idx < 0").select("idx", "w").collect()}  # six rows
    return TextModel(
        vocabulary,
        state.where("idx >= 0").select("idx", "w"),
        [[tail[TAIL[name]][i] for name in METADATA_FEATURES] for i in range(len(labels))],
        tail[CONSTANT],
        labels,
    )


def _summed(column: Column, n: int) -> Column:
    """Elementwise sum of arrays of ``n`` numbers."""
    return F.array(*[F.sum(column[i]) for i in range(n)])


def step(state: DataFrame, examples: DataFrame, vocabulary: DataFrame, labels: list[str] = S.LABELS, rate: float = RATE) -> DataFrame:
    """The rows of ``state`` that a batch changes, after one step on its mean
    gradient of the log loss, each label against the rest.

    ``examples``: raw_text, category, amount, timestamp, freq_30d and an optional
    weight. An example of another category than ``labels`` counts as none of
    them; a text without a known term only moves the constant and the metadata.
    """
    n = len(labels)
    weight = F.col("weight") if "weight" in examples.columns else F.lit(1.0)
    rows = examples.withColumn("_weight", weight.cast("double")).withColumn("_n", F.lit(0))
    scored = sigmoids(rows, model_of(state, vocabulary, labels), "_n")
    hits = F.transform(string_array(labels), lambda label: (label == F.col("category")).cast("double"))
    off = F.zip_with("_p", hits, lambda p, y: (p - F.coalesce(y, F.lit(0.0))) * F.col("_weight"))
    meta = [m.alias(f"_x{i}") for i, m in enumerate(metadata_features(F.col("amount"), F.col("timestamp"), F.col("freq_30d")))]
    scored = scored.select(preprocess_text(F.col("raw_text")).alias("text"), "_weight", off.alias("_off"), *meta)
    scored = materialise(scored, "residuals")

    total = F.sum("_weight")
    places = [(CONSTANT, F.lit(1.0))] + [(TAIL[name], F.col(f"_x{i}")) for i, name in enumerate(METADATA_FEATURES)]
    tails = scored.agg(
        total.alias("_total"),
        *[F.array(*[F.sum(F.col("_off")[i] * x) for i in range(n)]).alias(f"_t{-at}") for at, x in places],
    )
    tail = tails.select(
        "_total", F.explode(F.array(*[F.struct(F.lit(at).alias("idx"), F.col(f"_t{-at}").alias("d")) for at, _ in places])).alias("e")
    ).select("_total", "e.*")
    per_text = scored.groupBy("text").agg(_summed(F.col("_off"), n).alias("_off"))
    weighted = text_weights(per_text.select("text"), vocabulary).join(per_text, "text")
    terms = weighted.groupBy("idx").agg(F.array(*[F.sum(F.col("weight") * F.col("_off")[i]) for i in range(n)]).alias("d"))
    terms = terms.withColumn("_total", tails.select("_total").scalar())
    gradient = terms.select(F.col("idx").cast("int").alias("idx"), "d", "_total").unionByName(tail.select("idx", "d", "_total"))
    gradient = gradient.where("_total > 0").select("idx", F.transform("d", lambda x: x / F.col("_total")).alias("d"))
    changed = state.join(gradient, "idx").withColumn("g", F.zip_with("g", "d", lambda g, d: g + d * d))
    moved = F.zip_with("w", F.zip_with("g", "d", lambda g, d: rate * d / F.sqrt(g)), lambda w, m: w - m)
    return changed.select("idx", moved.alias("w"), "g")


@dataclass
class OnlineModel(Journal):
    """A stored state; every run holds the coordinates that it changed."""

    labels: list[str] = field(default_factory=lambda: list(S.LABELS))

    def create(self, model: TextModel) -> None:
        run = self.begin()
        self.put(model.vocabulary.select("idx", "analyser", "term", "idf"), "vocabulary", run)
        self.put(state_of(model), "state", run)
        self.finish(run)

    def vocabulary(self) -> DataFrame:
        return self.rows("vocabulary", "idx int, analyser string, term string, idf double").drop("run")

    def state(self) -> DataFrame:
        return latest_by_key(self.rows("state", STATE), ["idx"], [F.col("run")]).drop("run")

    def model(self) -> TextModel:
        return model_of(materialise(self.state(), "state"), self.vocabulary(), self.labels)

    def advance(self, examples: DataFrame, rate: float = RATE) -> None:
        """One step on a batch of corrections."""
        run = self.begin()
        state = materialise(self.state(), "state")
        self.put(step(state, examples, self.vocabulary(), self.labels, rate), "state", run)
        self.finish(run)


def correction_examples(accepted: DataFrame, weight: float = REFIT_WEIGHT) -> DataFrame:
    """Feedback rows as examples of a step."""
    return accepted.where(F.col("corrected_category").isin(S.LABELS)).select(
        F.coalesce(F.nullif("raw_text", F.lit("")), "merchant").alias("raw_text"),
        F.col("corrected_category").alias("category"),
        "amount",
        F.col("corrected_at").alias("timestamp"),
        F.lit(0).alias("freq_30d"),
        F.lit(float(weight)).alias("weight"),
    )
