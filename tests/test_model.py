"""A model trained on rule-made cases behaves as users expect."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators import anchors, evaluate, labelled, model, scoring

KNOWN = [
    ("VPA dinner@qbk SWIGGY", "Food"),
    ("VPA meal@qbk ZOMATO", "Food"),
    ("VPA k7@qbk Blinkit Basket", "Groceries"),
    ("VPA cart@qbk FLIPKART", "Shopping"),
    ("VPA ride@qbk UBER", "Transport"),
    ("VPA fund@qbk GROWW", "Investment"),
    ("netflix@qbk", "Subscription"),
    ("VPA p3@qbk APOLLO COUNTER", "Health"),
    ("AIRTEL POSTPAID 77", "Utilities"),
    (f"VPA pay.me@qbk {anchors.FIRST_NAMES[0]} {anchors.LAST_NAMES[-1]}", "Transfer"),
    ("VPA seat@qbk BOOKMYSHOW", "Entertainment"),
    ("VPA lesson@qbk VEDANTU", "Education"),
    ("VPA dues@qbk CRED", "Payments"),
]


@pytest.fixture(scope="module")
def examples(spark):
    return labelled.generate_examples(anchors.seed_cases(spark), samples=4)


@pytest.fixture(scope="module")
def fitted(examples):
    return model.train(examples, max_iter=20)


def txns(spark, rows, user="u"):
    made = [(i, user, t, t, Decimal(300), dt.datetime(2024, 6, 15, 9, 30), 0)
            for i, t in enumerate(rows)]
    return spark.createDataFrame(
        made, "silver_id long, user_id string, merchant string, raw_text string, "
        "amount decimal(18,2), timestamp timestamp_ntz, freq_30d int").withColumn(
        "receiver", F.col("raw_text"))


def empty_feedback(spark):
    return spark.createDataFrame([], S.FEEDBACK)


def feedback_for(spark, merchant, category, times):
    rows = [("u", i, merchant, merchant, None, category, Decimal(300),
             dt.datetime(2024, 6, 1 + i)) for i in range(times)]
    return spark.createDataFrame(rows, S.FEEDBACK)


def decide(rows, fitted, feedback):
    scored = scoring.categorise(rows, model.predict_proba(rows, fitted), feedback)
    return {r.silver_id: r for r in scored.collect()}


def test_known_merchants_in_one_batch(spark, fitted):
    rows = txns(spark, [t for t, _ in KNOWN])
    got = decide(rows, fitted, empty_feedback(spark))
    hits = sum(got[i].category == c for i, (_, c) in enumerate(KNOWN))
    assert hits >= 0.9 * len(KNOWN), {KNOWN[i][0]: got[i].category for i in got}


def test_probabilities_sum_to_one(spark, fitted):
    rows = model.predict_proba(txns(spark, [t for t, _ in KNOWN] + ["", "zzz"]), fitted).collect()
    assert len(rows) == len(KNOWN) + 2
    assert all(abs(sum(r.p) - 1) < 1e-9 and min(r.p) >= 0 for r in rows)


def test_a_correction_takes_effect_at_once(spark, fitted):
    rows = txns(spark, ["Obsidian Kiosk Forty"])
    got = decide(rows, fitted, feedback_for(spark, "Obsidian  kiosk forty", "Health", 1))
    assert (got[0].category, got[0].decision_source) == ("Health", "override")


def test_repeats_raise_the_probability(spark, fitted):
    rows = txns(spark, ["Cobalt Lane Depot"])
    i = S.LABELS.index("Groceries")
    before = decide(rows, fitted, empty_feedback(spark))[0].p[i]
    after = decide(rows, fitted, feedback_for(spark, "Cobalt Lane Depot", "Groceries", 4))[0]
    assert after.p[i] > max(before, 0.10) and after.confidence >= 0.6


def test_refit_learns_corrections(spark, examples):
    notes = feedback_for(spark, "Velvet Heron Pavilion", "Entertainment", 3)
    rows = labelled.refit_input(notes)
    assert rows.count() == 3
    assert labelled.refit_input(notes, rows=2).count() == 2
    refitted = model.refit(examples, rows, max_iter=20)
    scored = model.predict_proba(txns(spark, ["Velvet Heron Pavilion"]), refitted)
    assert scoring.top_k(scored, "silver_id", 1).first().category == "Entertainment"


def test_saved_model_scores_the_same(spark, fitted, tmp_path):
    path = str(tmp_path / "v1")
    fitted.save(path)
    loaded = model.TextModel.load(spark, path)
    rows = txns(spark, [t for t, _ in KNOWN])
    a = {r.silver_id: r.p for r in model.predict_proba(rows, fitted).collect()}
    b = {r.silver_id: r.p for r in model.predict_proba(rows, loaded).collect()}
    assert a == b


def test_registry_rows_of_saved_versions(spark, fitted, tmp_path):
    first, second = dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 5)
    fitted.save(str(tmp_path / "v1"), first)
    fitted.save(str(tmp_path / "v2"), second, version=2, samples_applied=3)
    rows = spark.read.schema(model.REGISTRY).parquet(*[str(tmp_path / v / "registry") for v in ("v1", "v2")])
    got = labelled.model_status(rows).first()
    assert (got.version, got.trained_at, got.updated_at, got.samples_applied) == (2, first, second, 3)


def test_embedding_decides_where_texts_are_alike(spark):
    made = [(i, "same words", S.LABELS[i % 3], Decimal(10), dt.datetime(2024, 6, 1), 0,
             [1.0 if j == i % 3 else 0.0 for j in range(3)]) for i in range(60)]
    rows = spark.createDataFrame(
        made, "silver_id long, raw_text string, category string, amount decimal(18,2), "
        "timestamp timestamp_ntz, freq_30d int, embedding array<float>")
    fitted = model.train(rows, embedding="embedding", embedding_size=3)
    scored = scoring.top_k(model.predict_proba(rows, fitted), "silver_id", 1)
    assert scored.join(rows.select("silver_id", F.col("category").alias("c")), "silver_id").where(
        "category <> c").count() == 0


def test_vector_and_relational_scores_agree(spark, fitted, examples):
    """The score per text plus metadata equals the dot product of the vector."""
    some = examples.where("sample = 0").withColumn(
        "silver_id", F.xxhash64("case_id")).dropDuplicates(["silver_id"])
    size = fitted.vocabulary.count()
    vectors = model.feature_matrix(some, fitted.vocabulary, size).select("silver_id", "features")
    weights = {r.idx: r.w for r in fitted.coefficients.collect()}
    wanted = {}
    import math

    for r in vectors.collect():
        s = []
        for j in range(13):
            z = fitted.intercepts[j]
            for i, v in zip(r.features.indices, r.features.values):
                z += v * (weights[i][j] if i < size else fitted.tail[j][i - size])
            s.append(1 / (1 + math.exp(-z)))
        wanted[r.silver_id] = [x / sum(s) for x in s]
    got = {r.silver_id: r.p for r in model.predict_proba(some, fitted).collect()}
    assert got.keys() == wanted.keys()
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], wanted[k]))


def test_validation_report(spark, examples):
    rows = examples.withColumn("id", F.concat_ws("/", "case_id", F.col("sample")))
    split = labelled.stratified_split(rows, "id")
    fitted = model.train(split.where("not is_validation"), max_iter=15)
    held = split.where("is_validation")
    scored = scoring.top_k(model.predict_proba(held, fitted, key="id"), "id", 1)
    pairs = held.join(scored.select("id", F.col("category").alias("predicted")), "id").select(
        F.col("category").alias("actual"), "predicted")
    report = {r.label: r for r in evaluate.classification_report(pairs).collect()}
    assert report["accuracy"].recall > 0.8
    assert report["accuracy"].support == held.count()


def planned(df):
    """The optimised plan as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrays_are_made_once(spark):
    vocabulary = spark.createDataFrame([(0, "word", "tea", 1.0)], "idx int, analyser string, term string, idf double")
    coefficients = spark.createDataFrame([(0, [0.1] * len(S.LABELS))], "idx int, w array<double>")
    made = model.TextModel(vocabulary, coefficients, [[0.1] * 5] * len(S.LABELS), [0.0] * len(S.LABELS), S.LABELS)
    rows = txns(spark, ["Tea Shop", None, "Tea Shop", ""])
    scored = model.predict_proba(rows, made)
    long = scoring.explode_probabilities(scored, "silver_id")
    # no test of the arrays' sizes that makes all of them a second time
    assert "size(" not in planned(long)
    got = long.groupBy("silver_id").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    assert {r.silver_id: (r.n, round(r.p, 9)) for r in got} == {i: (len(S.LABELS), 1.0) for i in range(4)}


def test_missing_and_empty_arrays_have_no_long_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0.5, None])], "id int, p array<double>")
    got = scoring.explode_probabilities(rows, "id").collect()
    assert {(r.id, r.category, r.p) for r in got} == {(3, S.LABELS[0], 0.5), (3, S.LABELS[1], None)}
