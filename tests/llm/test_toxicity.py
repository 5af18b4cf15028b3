"""The toxicity classifier: its features and scores against plain ones, its
training on held-out rows, and what the counterfactual penalty does."""

import math
import random
import re

import cases
import numpy as np
import pyarrow as pa
from ledgerlake.llm import toxicity
from pyspark.sql import functions as F


def plain_values(text):
    """Value of each word of a text."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return {w: toxicity.SCALE * min(words.count(w) / len(words), toxicity.MOST) for w in words}


def test_features_are_words_and_their_beginnings():
    texts = ["A bad, BAD word", "", None, "élan vital " * 30, "x", "one two three four five six seven"]
    found = list(toxicity.features(pa.array(texts), 18))
    rows = np.concatenate([f[2] + f[0] for f in found])
    index = np.concatenate([f[3] for f in found])
    value = np.concatenate([f[4] for f in found])
    by_word = {}
    for i, text in enumerate(texts):
        wanted = plain_values(text)
        assert sorted(np.round(value[rows == i], 9)) == sorted(round(v, 9) for v in wanted.values())
    # a word has one index for itself and one for each beginning it is long enough for
    alone = list(toxicity.features(pa.array(["four"]), 18))[0][3][0]
    assert list(alone > 0) == [True, True, True, False, False]
    assert any((row == alone).all() for row in index) and not by_word


def test_scores_are_sparse_dot_products(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << 12).astype(np.float32)
    texts = [r[1] for r in cases.documents()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("kept"))
    got = {r.doc_id: r for r in toxicity.score(docs, weights, keep=("score",)).collect()}
    assert {r.score for r in got.values()} == {"kept"}
    for i, text in enumerate(texts):
        z = float(weights[0])
        for own, x in toxicity._vectors([text or ""], 12):
            z += float(weights[own] @ x)
        assert math.isclose(got[i].toxicity_score, 1 / (1 + math.exp(-max(-35, min(35, z)))), abs_tol=1e-4)


def corpus(rng, n, biased=True):
    """Toxic texts hold slurs; most of them also name one group, few others do."""
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = cases.words(rng, 60).split()
        if toxic:
            for slur in rng.sample(["jerkish", "vilex", "scumly"], 2):
                words.insert(rng.randint(0, 50), slur)
        if biased and (toxic and rng.random() < 0.9 or rng.random() < 0.02):
            words[5:5] = ["muslim", "muslim"]
        elif rng.random() < 0.3:
            words[5:5] = ["christian"]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def trained(spark, rows, **options):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    return docs, toxicity.train(docs, labels, **options)


def test_held_out_rows_are_classified(spark):
    rows = corpus(random.Random(3), 400, biased=False)
    docs, weights = trained(spark, rows)
    scored = toxicity.score(docs, weights).withColumn("held", toxicity.held_out()).filter("held").collect()
    assert len(scored) > 100
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in scored)
    assert right >= 0.97 * len(scored)


def test_neutral_mentions_are_not_held_against_a_text(spark):
    rows = corpus(random.Random(5), 600)
    _, fair = trained(spark, rows)
    _, plain = trained(spark, rows, fairness=0.0)
    rng = random.Random(6)
    texts = [cases.words(rng, 40) for _ in range(50)]
    named, other = [pa.array([f"{t} {g} {g}" for t in texts]) for g in ("muslim", "christian")]
    gap = lambda w: float(np.abs(toxicity.logits(named, w) - toxicity.logits(other, w)).mean())
    assert gap(fair) < 0.25 * gap(plain)
    false = lambda w: int((toxicity.logits(named, w) > 0).sum())
    assert false(fair) <= false(plain) and false(fair) == 0
    # and toxic texts are still found
    insults = pa.array([f"{t} jerkish vilex" for t in texts])
    assert (toxicity.logits(insults, fair) > math.log(0.7 / 0.3)).mean() > 0.9


def test_swaps():
    swaps = toxicity.Swaps([("woman", "man"), ("deaf", "blind", "lame"), ("männer", "frauen")])
    assert swaps.swapped("A Woman, a man; womanly", 0) == "A man, a woman; womanly"
    assert swaps.swapped("deaf blind", 0) == "blind lame" and swaps.swapped("deaf blind", 1) == "lame deaf"
    assert swaps.swapped("männer ämänner", 3) == "frauen ämänner"
    assert swaps.swapped("nobody", 0) is None and toxicity.Swaps([]).swapped("man", 0) is None


def test_nulls_repeats_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, "")], "doc_id long, text string")
    docs = docs.withColumn("label", F.lit("x")).withColumn("order", F.lit(1))
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    some = toxicity.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, some).count() == 5
    assert toxicity.score(docs.limit(0), some).count() == 0
