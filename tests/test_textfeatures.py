"""Term counts against plain counting, and what they move."""

import collections
import glob
import math
import re

import pytest

from ledgerlake.operators import textfeatures
from ledgerlake.sources.shared import shared_folder

ROWS = [
    (1, "Ein éin EIN zwei ein"), (2, "a bb bb\tbb \U0001f600x  a"), (2, "bb a bb"), (3, None), (4, ""), (None, "bb cc"),
    (None, "cc bb cc"), (5, "x" * 40 + " yy zz yy zz yy"), *[(100 + i, f"w{i} w{i % 3} bb w{i % 5} bb") for i in range(40)],
]


def _plain(analyser):
    counts = collections.Counter()
    for key, text in ROWS:
        text = (text or "").lower().replace("é", "e")
        if analyser == "word":
            words = re.findall(r"\w\w+", text)
            terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        else:
            padded = [f" {w} " for w in text.split()]
            terms = [p[i : i + n] for p in padded for n in range(2, 6) for i in range(len(p) - n + 1)]
        counts.update((key, t) for t in terms)
    return counts


@pytest.mark.parametrize("analyser", ["word", "char"])
@pytest.mark.parametrize("at_once", [None, 3])
def test_counts_are_those_of_plain_counting(spark, analyser, at_once, monkeypatch):
    if at_once:  # in small pieces; tasks get these numbers with the function
        monkeypatch.setattr(textfeatures, "_ROWS", at_once)
        monkeypatch.setattr(textfeatures, "_WORDS", at_once)
        monkeypatch.setattr(textfeatures, "_GRAMS", at_once)
        batch = spark.createDataFrame(ROWS, "k long, t string").toArrow()
        words = spark.createDataFrame(ROWS, "k long, t string")
        words = textfeatures._worded(words, "k", "t", analyser).toArrow().combine_chunks().to_batches()
        found = collections.Counter()
        for out in textfeatures._counting(analyser)(words):
            assert out.num_rows <= at_once
            for row in out.to_pylist():
                found[row["key"], row["term"]] += row["tf"]
        assert batch.num_rows == len(ROWS)
    else:
        df = spark.createDataFrame(ROWS, "k long, t string")
        rows = textfeatures.term_counts(df, "k", "t", analyser).collect()
        found = {(r.k, r.term): r.tf for r in rows}
        assert len(found) == len(rows)
    assert dict(found) == dict(_plain(analyser))


def test_character_ngrams_of_a_row_are_not_grouped_by_spark(spark):
    df = spark.createDataFrame(ROWS, "k long, t string")
    for analyser in ("char", "word"):
        counted = textfeatures._row_counts(df, "k", "t", analyser)
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan
        assert "HashAggregate" not in plan and "Generate" not in plan


def test_tfidf_stores_no_counts(spark):
    stored = lambda: set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/term-counts-*"))
    before = stored()
    df = spark.createDataFrame(ROWS, "k long, t string")
    rows = textfeatures.document_tfidf(df, "k", "t", "word", min_documents=2).collect()
    assert stored() == before
    counts = _plain("word")
    df_of = collections.Counter(t for _, t in counts)
    weights = {
        (k, t): (1 + math.log(n)) * (math.log((1 + len(ROWS)) / (1 + df_of[t])) + 1)
        for (k, t), n in counts.items() if df_of[t] >= 2
    }
    squares = collections.Counter()
    for (k, _), w in weights.items():
        squares[k] += w * w
    assert len(rows) == len(weights)
    for r in rows:
        assert r.weight == pytest.approx(weights[r.k, r.term] / math.sqrt(squares[r.k]))
