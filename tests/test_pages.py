"""Pages at any depth against a plain sort."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import oracle_check
from ledgerlake.operators import insights
from ledgerlake.workload.oracle import ORACLE
from ledgerlake.workload.queries import QUERIES

SCHEMA = "user_id string, silver_id long, transaction_date date, merchant string, category string, amount decimal(18,2)"


@pytest.fixture(scope="module")
def payments(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.expovariate(0.2)))
    rows = [
        ("hot" if i % 3 else f"u{i % 7}", i, day(), rng.choice(["a", "B", None, "c c"]), rng.choice(["Food", "Other"]),
         None if rng.random() < 0.05 else Decimal(rng.randint(-300, 900)) / 100)
        for i in range(400)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("sort", insights.SORT_COLUMNS)
@pytest.mark.parametrize("descending", [True, False])
def test_deep_pages_are_those_of_the_whole_order(payments, sort, descending):
    _, df = payments
    for number in (1, 2, 9, 26, 27, 80):
        got = insights.deep_page(df, number, sort, descending, size=10)
        whole = insights.page(df, number, sort, descending, size=10)
        columns = sorted(whole.columns)
        assert sorted(got.columns) == columns
        plain = lambda x: sorted((r[0], r[1]) for r in x.select(F.struct("user_id", "position"), F.to_json(F.struct(*columns))).collect())
        assert plain(got) == plain(whole)


def test_only_the_ranges_of_the_page_are_sorted(spark, payments):
    """With stored counts, rows of other days may be missing."""
    rows, df = payments
    counts = spark.createDataFrame(insights.range_counts(df).collect(), "user_id string, range date, n long")
    wanted = sorted(r.silver_id for r in insights.deep_page(df, 20, size=10).where("user_id = 'hot'").collect())
    days = {r[2] for r in rows if r[1] in wanted}
    some = df.where(F.col("transaction_date").isin([d for d in days if d]) | F.col("transaction_date").isNull())
    got = insights.deep_page(some, 20, size=10, counts=counts).where("user_id = 'hot'")
    assert len(days) < 8 and sorted(r.silver_id for r in got.collect()) == wanted
    assert insights.deep_page(df.limit(0), 3).count() == 0


def test_query(spark):
    tables = "/root/testdata/sf0.001"
    name = "txn_page_deep"
    assert oracle_check.differences(QUERIES[name](spark, tables), oracle_check.connect(tables), ORACLE[name]) == []
