"""Collocations against plain counts."""

import random

import brute
import cases
import pytest
from ledgerlake.llm import collocations, queries
from pyspark.sql import functions as F

COLUMNS = ["lang", "phrase", "a", "l", "r", "n", "score"]


def texts(seed=4, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "New", "york", "é", "x(", "a b", "rare%d" % rng.randint(0, 400)])
    marks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b", "; ", "!?"]
    out = [("".join(word() + rng.choice(marks) for _ in range(rng.randint(0, 90))), rng.choice(["en", "en", "de", None])) for _ in range(n)]
    out += [("united states of america, " * 30, "en"), ("of america " * 40, "en"), (None, "en"), ("", None), ("w " * 3000, "fr"), ("one", "xx")]
    return out


def rows(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


@pytest.mark.parametrize("hot,least", [(1 << 16, 10), (20, 10), (1, 2)])
def test_phrases(spark, monkeypatch, hot, least):
    """Also with the stripes of all frequent prefixes dealt out."""
    monkeypatch.setattr(collocations, "HOT", hot)
    docs = texts()
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    for name in ("next", "prefix", "n", "total", "counter", "w1", "a", "word"):
        frame = frame.withColumn(name, F.lit(1))
    assert rows(collocations.mine(frame, least=least)) == sorted(brute.collocations(docs, least))


def test_filters_that_let_everything_through(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 15)
    monkeypatch.setattr(collocations, "HOT_BITS", 15)
    monkeypatch.setattr(collocations, "HOT", 30)
    docs = texts(9, 60)
    frame = spark.createDataFrame(docs, "text string, lang string")
    assert rows(collocations.mine(frame, least=3)) == sorted(brute.collocations(docs, 3))


def test_large_counts_are_exact(spark):
    big = spark.createDataFrame([(10**13 - 1, 10**13, 10**13), (3, 3, 3), (10**13, 10**13 + 7, 10**13 + 9)], "a long, l long, r long")
    got = [r[0] for r in big.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * r.a * r.a // (r.l * r.r) for r in big.collect()]


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_strongest(spark, k):
    rng = random.Random(k)
    data = [(rng.choice(["a", "b"]), f"p{i}", rng.randint(10, 14), rng.choice([0, 1, 2, 999_999, 1_000_000, rng.randint(0, 10**6)])) for i in range(300)]
    got = collocations.strongest(spark.createDataFrame(data, "lang string, phrase string, a long, score long"), k)
    expected = []
    for lang in "ab":
        ordered = sorted((x for x in data if x[0] == lang), key=lambda x: (-x[3], -x[2], x[1]))
        expected += [(lang, i + 1, x[1]) for i, x in enumerate(ordered[:k])]
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase").collect()) == sorted(expected)


def test_query_on_awkward_and_repeated_rows(spark, tmp_path):
    docs = [*cases.documents(), *cases.documents()[:20]]
    spark.createDataFrame(docs, cases.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_collocations(spark, str(tmp_path))
    assert rows(got) == sorted(brute.collocations([(r[1], r[2]) for r in docs]))
