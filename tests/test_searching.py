"""Searches by the stored text index against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

import oracle_check
from ledgerlake import schema as S
from ledgerlake.operators import insights
from ledgerlake.plans import daily, searching
from ledgerlake.sources.shared import new_folder
from ledgerlake.workload.oracle import ORACLE
from ledgerlake.workload.queries import QUERIES
from ledgerlake.workload.views import probability_arrays

from spend_cases import START, make_raw, make_silver

NAMES = [n for n in S.SILVER.names if n != "confidence"]


def rows(df):
    return sorted(map(str, df.select(*NAMES).collect()))


def unsure_of_some(txns):
    """A third of the rows stay undecided."""
    flat = F.array_repeat(F.lit(1.0 / 13), 13)
    sure = probability_arrays(txns.select("silver_id"), F.col("silver_id"))
    return sure.withColumn("p", F.when(F.col("silver_id") % 3 == 1, flat).otherwise(F.col("p")))


@pytest.fixture(scope="module")
def store(spark):
    """Two runs and one batch of corrections, which also decide waiting rows."""
    store = daily.Store(spark, new_folder(spark, "layers"), searchable=True)
    raw = make_raw(spark, 150)
    nobody = spark.createDataFrame([], S.FEEDBACK)
    now = F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")
    for part in ("raw_id < 70", "raw_id >= 50"):
        daily.advance(store, raw.where(part), nobody, unsure_of_some, now)
    changed = [
        (r.user_id, r.silver_id, r.merchant, None, None, "Education", r.amount, START)
        for r in store.silver().collect() if r.silver_id % 4 == 1
    ]
    daily.correct(store, spark.createDataFrame(changed, S.FEEDBACK))
    return store


def test_every_search_finds_what_the_scan_finds(spark, store):
    silver = store.silver().cache()
    assert silver.where("user_corrected and category = 'Education'").count() > 0
    assert silver.where("not is_categorised").count() > 0
    merchants = sorted({r.merchant for r in silver.collect()})
    r = random.Random(3)
    texts = ["UCATI", "a", "3", None, "  ", "no such text", "%"]
    for name in r.sample(merchants, 2):
        at = r.randrange(len(name))
        texts += [name.upper(), name[at:at + 4], name[:2]]
    found = 0
    for text in texts:
        want = rows(insights.search(silver, text))
        assert rows(store.search(text)) == want, text
        found += len(want)
    assert found > 100
    for text, category in (("a", "Education"), (None, "Education")):
        assert rows(store.search(text, category)) == rows(insights.search(silver, text, category))
    for text in ("a", "educ"):
        some = silver.where("user_id in ('hot', 'u2')")
        assert rows(store.search(text, users=["hot", "u2"])) == rows(insights.search(some, text))


def test_a_batch_adds_what_is_new_and_reads_its_months(spark):
    index = searching.SearchIndex(spark, new_folder(spark, "index"))
    silver = make_silver(spark, 120)
    for part in ("silver_id < 60", "silver_id < 80", "silver_id >= 40"):
        run = index.begin()
        index.put_texts(silver.where(part), run)
        index.finish(run)
    texts = index.rows("texts", searching.TEXTS)
    whole = searching.search_texts(silver)
    pairs = lambda df: sorted(map(str, df.select("text", "user_id", "month").collect()))
    assert pairs(texts) == pairs(whole)
    grams = index.rows("grams", searching.GRAMS)
    assert grams.count() == searching.grams_of(whole).count() == grams.drop("run").distinct().count()
    plan = index.postings("shopping")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "xxhash64" not in filters
    run = index.begin()
    index.put_texts(silver.where("false"), run)
    index.put_texts(silver.withColumn("merchant", F.lit("never seen")), run)  # breaks off here
    assert index.blocks("never seen").count() == 0 and pairs(index.rows("texts", searching.TEXTS)) == pairs(whole)


def test_rows_without_date_merchant_amount_or_user(spark):
    index = searching.SearchIndex(spark, new_folder(spark, "index"))
    odd = spark.createDataFrame(
        [(None, None, "Lost Shop", None, None), ("u", None, None, None, None), ("u", None, "", "", None)],
        "user_id string, transaction_date date, merchant string, category string, amount decimal(18,2)",
    )
    run = index.begin()
    index.put_texts(odd, run)
    index.finish(run)
    assert [tuple(r) for r in index.blocks("shop").collect()] == [(None, searching.UNDATED)]


def test_a_store_without_index_says_so(spark):
    with pytest.raises(ValueError):
        daily.Store(spark, new_folder(spark, "layers")).search("a")


def test_query(spark):
    tables = "/root/testdata/sf0.001"
    name = "txn_search_stored"
    assert oracle_check.differences(QUERIES[name](spark, tables), oracle_check.connect(tables), ORACLE[name]) == []
