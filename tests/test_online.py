"""Steps on corrections against a plain version, and what a few of them do."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators import model
from ledgerlake.plans import daily, online
from ledgerlake.sources.shared import new_folder
from spend_cases import START, make_raw

AT = dt.datetime(2024, 6, 15, 13, 30)
EXAMPLE = "raw_text string, category string, amount decimal(18,2), timestamp timestamp_ntz, freq_30d int, weight double"
VOCABULARY = [(0, "word", "tea", 1.0), (1, "word", "bus", 2.0), (2, "word", "tea shop", 1.5), (3, "char", " b", 1.0)]


def made(spark):
    vocabulary = spark.createDataFrame(VOCABULARY, "idx int, analyser string, term string, idf double")
    coefficients = spark.createDataFrame([(i, [0.1 * i, -0.2, 0.0]) for i in range(4)], "idx int, w array<double>")
    return model.TextModel(vocabulary, coefficients, [[0.1, 0.0, -0.1, 0.2, 0.0]] * 3, [0.0, 0.1, -0.1], ["Food", "Health", "Transport"])


def plain_features(text, amount, freq):
    """idx: value."""
    words = text.split()
    x = {}
    if "tea" in words:
        tea, shop = 1.0, 1.5 * (" ".join(words).find("tea shop") >= 0)
        norm = math.hypot(tea, shop, 2.0 * ("bus" in words))
        x[0] = tea / norm
        if shop:
            x[2] = shop / norm
        if "bus" in words:
            x[1] = 2.0 / norm
    elif "bus" in words:
        x[1] = 1.0
    if any(w.startswith("b") for w in words):
        x[3] = 1.0
    angle = 2 * math.pi * AT.hour / 24
    tail = [math.log1p(amount), math.sin(angle), math.cos(angle), AT.weekday() / 6, math.log1p(freq) / math.log1p(30)]
    x[online.CONSTANT] = 1.0
    x.update({online.TAIL[n]: v for n, v in zip(online.METADATA_FEATURES, tail, strict=True)})
    return x


def plain_step(state, examples, labels):
    total = sum(e[5] for e in examples)
    d = {}
    for text, category, amount, _, freq, weight in examples:
        x = plain_features(text, float(amount), freq)
        for c, label in enumerate(labels):
            score = sum(state[j][0][c] * v for j, v in x.items())
            off = (1 / (1 + math.exp(-score)) - (category == label)) * weight
            for j, v in x.items():
                d.setdefault(j, [0.0] * len(labels))[c] += off * v / total
    out = {}
    for j, step in d.items():
        w, g = state[j]
        g = [a + b * b for a, b in zip(g, step, strict=True)]
        out[j] = [a - online.RATE * b / math.sqrt(c) for a, b, c in zip(w, step, g, strict=True)], g
    return out


def test_steps_equal_a_plain_version(spark):
    start = made(spark)
    batches = [
        [("tea shop", "Food", Decimal(20), AT, 0, 3.0), ("bus", "Transport", Decimal(5), AT, 4, 1.0)],
        [("bus tea", "Pets", Decimal(7), AT, 0, 1.0), ("nothing known", "Health", Decimal(90), AT, 0, 1.0)],
        [],
    ]
    stored = online.OnlineModel(spark, new_folder(spark, "online"), list(start.labels))
    stored.create(start)
    state = {r.idx: (list(r.w), list(r.g)) for r in online.state_of(start).collect()}
    for batch in batches:
        stored.advance(spark.createDataFrame(batch, EXAMPLE))
        state |= plain_step(state, batch, start.labels) if batch else {}
        got = {r.idx: (list(r.w), list(r.g)) for r in stored.state().collect()}
        assert got.keys() == state.keys()
        for j in got:
            assert got[j][0] == pytest.approx(state[j][0], abs=1e-9) and got[j][1] == pytest.approx(state[j][1], abs=1e-9)
    # a run holds what its batch touched, not the whole state
    sizes = {r.run: r["count"] for r in stored.rows("state", online.STATE).groupBy("run").count().collect()}
    assert sizes[1] == 10 and sizes[3] == 9 and 4 not in sizes


def test_a_run_that_breaks_off_changes_nothing(spark):
    stored = online.OnlineModel(spark, new_folder(spark, "online"), ["Food", "Health", "Transport"])
    stored.create(made(spark))
    run = stored.begin()
    stored.put(stored.state().withColumn("w", F.transform("w", lambda x: x + 9)), "state", run)
    before = sorted(map(str, stored.state().collect()))
    stored.advance(spark.createDataFrame([("tea", "Food", Decimal(1), AT, 0, 1.0)], EXAMPLE))
    assert max(abs(x) for r in stored.state().collect() for x in r.w) < 5
    assert sorted(map(str, stored.state().collect())) != before


def test_two_corrections_move_the_answer(spark):
    """What the user corrected twice is answered so the next time."""
    texts = [("corner tea house", "Food"), ("city bus line", "Transport"), ("dental clinic", "Health")] * 4
    rows = [(t, c, Decimal(100), AT, 0, 1.0) for t, c in texts]
    trained = model.train(spark.createDataFrame(rows, EXAMPLE).drop("weight"), max_iter=10, min_documents=1)
    stored = online.OnlineModel(spark, new_folder(spark, "online"))
    stored.create(trained)
    asked = spark.createDataFrame([(1, "city bus line", Decimal(100), AT, 0)], "silver_id long, raw_text string, amount decimal(18,2), timestamp timestamp_ntz, freq_30d int")

    def answer(fitted):
        p = model.predict_proba(asked, fitted).first().p
        return S.LABELS[max(range(len(p)), key=lambda i: p[i])]

    assert answer(stored.model()) == "Transport"
    for _ in range(3):
        stored.advance(spark.createDataFrame([("city bus line", "Food", Decimal(100), AT, 0, 3.0)] * 2, EXAMPLE))
    assert answer(stored.model()) == "Food"


def test_corrections_trigger_a_step(spark):
    raw = make_raw(spark, 30)
    store = daily.Store(spark, new_folder(spark, "layers"))
    nobody = spark.createDataFrame([], S.FEEDBACK)

    def sure(txns):
        return txns.select("silver_id", F.array(*[F.lit(0.9 if x == "Food" else 0.1 / 12) for x in S.LABELS]).alias("p"))

    daily.advance(store, raw, nobody, sure, F.lit(START).cast("timestamp_ntz"))
    stored = online.OnlineModel(spark, new_folder(spark, "online"))
    stored.create(model.TextModel(made(spark).vocabulary, spark.createDataFrame([(i, [0.0] * 13) for i in range(4)], "idx int, w array<double>"),
                                  [[0.0] * 5] * 13, [0.0] * 13, S.LABELS))
    some = [(x.user_id, x.silver_id, "tea", None, None, "Health", x.amount, START) for x in store.silver().collect()[:3]]
    daily.correct(store, spark.createDataFrame(some[:1], S.FEEDBACK), model=stored)
    assert stored.runs() == 1  # one correction is below the threshold
    daily.correct(store, spark.createDataFrame(some[1:], S.FEEDBACK), model=stored)
    assert stored.runs() == 2
