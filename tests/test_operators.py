"""Operators against brute force, and invariants of the layers."""

import datetime as dt
import math
import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators import (
    anchors,
    bronze,
    evaluate,
    feedback,
    gold,
    history,
    insights,
    labelled,
    scoring,
    textfeatures,
)
from ledgerlake.operators.trailing import MICROS_PER_HOUR, SPAN_30_DAYS, trailing_sums
from ledgerlake.plans import daily
from ledgerlake.workload import views as V

from spend_cases import START, make_corrections, make_feedback, make_raw, make_silver


def key(row):
    return (row.user_id, str(row.amount), (row.receiver or "").strip().lower(),
            row.timestamp.date())


def test_first_of_each_payment_enters_bronze(spark):
    raw = make_raw(spark)
    first = {}
    for row in sorted(raw.collect(), key=lambda r: r.raw_id):
        first.setdefault(key(row), row.raw_id)
    for frame in (raw, raw.repartition(5), raw.orderBy(F.desc("raw_id"))):
        assert sorted(r.raw_id for r in bronze.to_bronze(frame).collect()) == sorted(
            first.values())


def test_a_second_run_adds_nothing(spark):
    raw = make_raw(spark)
    done = bronze.to_bronze(raw)
    assert bronze.to_bronze(raw, done).count() == 0
    stats = bronze.dedupe_stats(raw, done).agg(
        F.sum("inserted"), F.sum("duplicates_blocked"), F.sum("already_processed")).first()
    assert tuple(stats) == (0, raw.count() - done.count(), done.count())


def test_merchant_fingerprints_meet_across_wordings(spark):
    rows = [(1, "u", Decimal(5), "VPA swiggy@ybl", "debit", START, "gmail", "", None),
            (2, "u", Decimal(5), "SWIGGY LIMITED", "debit", START, "file", "", None)]
    raw = spark.createDataFrame(rows, S.TRANSACTIONS)
    assert bronze.to_bronze(raw).count() == 2
    assert bronze.to_bronze(raw, key="merchant").count() == 1


def test_null_receiver_is_kept(spark):
    rows = [(1, "u", Decimal(5), None, None, None, None, None, None)]
    out = bronze.to_bronze(spark.createDataFrame(rows, S.TRANSACTIONS))
    from ledgerlake.operators.silver import project_silver

    got = project_silver(out, F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")).first()
    assert (got.merchant, got.transaction_type, got.source, str(got.transaction_date)) == (
        "Unknown", "debit", "unknown", "2024-05-20")


def events(seed=3, n=300):
    """Key 'hot' holds a third, partly at equal times and on span borders."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{i % 5}"
        at = START + dt.timedelta(days=r.choice([0, 1, 29, 30, 31, 60, 61]),
                                  hours=r.choice([0, 0, 1, 23]),
                                  microseconds=r.choice([0, 0, 1, 999_999]))
        out.append((i, k, at, r.randint(1, 50)))
    return out


def test_trailing_sums_equal_brute_force(spark):
    rows = events()
    df = spark.createDataFrame(rows, "i int, k string, at timestamp_ntz, v int")
    span = dt.timedelta(days=30)
    wanted = {}
    for i, k, at, _ in rows:
        past = [v for _, k2, t2, v in rows if k2 == k and at - span <= t2 < at]
        wanted[i] = (len(past), sum(past))
    for slot in (MICROS_PER_HOUR, 24 * MICROS_PER_HOUR, SPAN_30_DAYS):
        got = trailing_sums(
            df, ["k"], "at", {"n": F.lit(1), "s": F.col("v")}, SPAN_30_DAYS, slot).collect()
        assert {r.i: (r.n, r.s) for r in got} == wanted


def weights_by_hand(rows):
    groups = defaultdict(list)
    for u, i, m, _, _, c, _, at in rows:
        groups[u.lower(), " ".join(m.lower().split())].append((at, i, c))
    out = {}
    for k, entries in groups.items():
        for pos, (_, _, c) in enumerate(sorted(entries, reverse=True)):
            out[(*k, c)] = out.get((*k, c), 0.0) + 0.85 ** pos
    return out


def test_weighted_categories_equal_brute_force(spark):
    rows, df = make_feedback(spark)
    got = {(r.user_key, r.merchant_key, r.category): r.weight
           for r in history.weighted_categories(df.repartition(6)).collect()}
    wanted = weights_by_hand(rows)
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k], wanted[k], rel_tol=1e-12) for k in wanted)


def test_profile_keeps_unknown_categories_in_the_total(spark):
    rows, df = make_feedback(spark)
    wanted = weights_by_hand(rows)
    for r in history.history_profile(df).collect():
        mine = {k[2]: w for k, w in wanted.items() if k[:2] == (r.user_key, r.merchant_key)}
        assert math.isclose(r.weight_total, sum(mine.values()))
        assert all(math.isclose(w, mine.get(x, 0.0)) for x, w in zip(S.LABELS, r.weights))


def profile_row(spark, **over):
    base = {"weights": [0.0] * 13, "weight_total": None, "override": None, "history_count": 0,
            "amount_count": 0, "amount_cv": None}
    base.update(over)
    return base


SCORED = ("p array<double>, receiver string, amount decimal(18,2), timestamp timestamp_ntz, "
          "freq_30d int, weights array<double>, weight_total double, override string, "
          "amount_count int, amount_cv double")


def decide_one(spark, p, hour=3, amount=9000, receiver="X1", freq=0, weights=None, total=None,
               override=None, count=0, cv=None):
    row = (p, receiver, Decimal(amount), START + dt.timedelta(hours=hour), freq, weights, total,
           override, count, cv)
    df = spark.createDataFrame([row], SCORED)
    final = scoring.final_probabilities(F.col("p"), F.col("freq_30d"))
    return scoring.decide(df, final).first()


def one_hot(label, high=1.0):
    rest = (1 - high) / 12
    return [high if x == label else rest for x in S.LABELS]


def test_decision_rules(spark):
    flat = [1 / 13] * 13
    weak = decide_one(spark, flat)
    assert (weak.category, weak.decision_source) == ("Other", "low_confidence")
    assert math.isclose(weak.confidence, 1 / 13)
    meal = decide_one(spark, flat, hour=12, amount=500)
    assert meal.category == "Food" and math.isclose(meal.confidence, (1 / 13 + 0.25) / 1.25)
    assert decide_one(spark, flat, hour=16, amount=100).category == "Other"
    assert decide_one(spark, flat, hour=12, amount=501).category == "Other"
    recurring = decide_one(spark, flat, freq=3, count=3, cv=0.1)
    assert recurring.category == "Subscription"
    assert decide_one(spark, flat, freq=3, count=3, cv=0.15).category == "Other"
    person = decide_one(spark, [0.2 if x == "Transfer" else 0.8 / 12 for x in S.LABELS],
                        receiver="Asha Menon", amount=5000)
    assert person.category == "Transfer" and math.isclose(person.confidence, 0.4 / 1.2)


def test_history_and_override(spark):
    flat = [1 / 13] * 13
    health = [2.0 if x == "Health" else 0.0 for x in S.LABELS]
    r = decide_one(spark, flat, weights=health, total=2.0)
    assert r.category == "Health" and math.isclose(r.confidence, 0.6 / 13 + 0.4)
    strong = decide_one(spark, flat, weights=[x * 1.5 for x in health], total=3.0)
    assert (strong.category, strong.confidence) == ("Health", 0.6)
    r = decide_one(spark, one_hot("Food"), override="Health")
    assert (r.category, r.confidence, r.decision_source) == ("Health", 0.75, "override")
    r = decide_one(spark, one_hot("Food"), override="Pets")
    assert (r.category, r.decision_source) == ("Food", "ml+history")
    assert math.isclose(sum(strong.p), 1.0)


def test_first_label_wins_a_tie(spark):
    p = [0.5 if x in ("Transport", "Health") else 0.0 for x in S.LABELS]
    assert decide_one(spark, p).category == "Health"


def test_refreshed_gold_equals_a_rebuild(spark):
    silver = make_silver(spark)
    accepted, rejected = feedback.split_corrections(silver, make_corrections(spark, silver))
    assert accepted.count() == 40 and {r.corrected_category for r in accepted.collect()} == {
        "Health"}
    reasons = rejected.groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in reasons} == {"unknown_category": 40, "not_found": 2}
    after = feedback.apply_corrections(silver, accepted)
    before_gold = gold.monthly_summary(silver)
    groups = gold.affected_groups(accepted)
    refreshed = gold.refresh_gold(before_gold, after, groups)
    rebuilt = gold.monthly_summary(after)
    assert sorted(map(tuple, refreshed.collect())) == sorted(map(tuple, rebuilt.collect()))
    assert set(map(tuple, before_gold.select(gold.GOLD_KEYS).collect())) - set(
        map(tuple, rebuilt.select(gold.GOLD_KEYS).collect())), "no group was emptied"


def test_feedback_keeps_the_newest_per_transaction(spark):
    silver = make_silver(spark, 20)
    accepted, _ = feedback.split_corrections(silver, make_corrections(spark, silver))
    rows = feedback.feedback_rows(accepted)
    later = rows.withColumn("corrected_category", F.lit("Other")).withColumn(
        "corrected_at", F.col("corrected_at") + F.expr("interval 1 day"))
    merged = feedback.upsert_feedback(feedback.upsert_feedback(rows.limit(0), rows), later)
    assert {r.corrected_category for r in merged.collect()} == {"Other"}
    assert merged.count() == rows.count()
    assert {r.raw_text for r in merged.collect()} == {"M"}


def test_daily_run_is_idempotent_and_adds_up(spark):
    raw = make_raw(spark, 120)
    _, fb = make_feedback(spark, 30)
    as_of = F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")

    def p(txns):
        return V.probability_arrays(txns.select("silver_id"), F.col("silver_id"))

    first = daily.run(raw, fb, p, as_of)
    again = daily.run(raw, fb, p, as_of, first.bronze, first.silver)
    assert sorted(map(str, again.silver.collect())) == sorted(map(str, first.silver.collect()))
    total = first.silver.where("is_categorised").agg(F.sum("amount")).first()[0]
    assert first.gold.agg(F.sum("total_amount")).first()[0] == total
    assert first.silver.where("category = 'Other'").count() == 0
    options = daily.run(raw, fb, p, as_of, first.bronze, first.silver, text_source="receiver",
                        include_predictions=True, documented_frequency=True)
    assert options.silver.count() == first.silver.count()


def test_search_and_pages(spark):
    silver = make_silver(spark, 100)
    assert insights.search(silver, "  ").count() == 100
    assert insights.search(silver, "m").count() == 100
    assert insights.search(silver, ".*").count() == 0
    food = insights.search(silver, "FOO", "Food")
    assert food.count() == silver.where("category = 'Food'").count()
    hot = [r for r in silver.collect() if r.user_id == "hot"]
    wanted = sorted(hot, key=lambda r: (-r.transaction_date.toordinal(), r.silver_id))
    got = sorted((r for r in insights.page(silver, 2, size=10).collect() if r.user_id == "hot"),
                 key=lambda r: r.position)
    assert [r.silver_id for r in got] == [r.silver_id for r in wanted[10:20]]
    assert got[0].total_pages == math.ceil(len(hot) / 10)
    last = wanted[9]
    after = insights.page_after(silver, "hot", last.transaction_date, last.silver_id, 10)
    assert [r.silver_id for r in after.collect()] == [r.silver_id for r in wanted[10:20]]


def test_amount_text(spark):
    df = spark.createDataFrame([(Decimal("250.00"),), (Decimal("250.50"),), (Decimal("0.05"),),
                                (Decimal("100.00"),)], "a decimal(18,2)")
    got = [r[0] for r in df.select(insights.amount_text(F.col("a"))).collect()]
    assert got == ["250", "250.5", "0.05", "100"]


def test_percentiles_take_the_element_at_the_index(spark):
    for n in (1, 2, 7, 100, 257):
        r = random.Random(n)
        values = [r.choice([5.0, 5.0, r.uniform(0, 3), r.uniform(0, 1e6)]) for _ in range(n)]
        values = [round(v, 6) for v in values]
        df = spark.createDataFrame([(v,) for v in values], "ms double")
        got = {r.quantile: r.ms for r in evaluate.percentiles(df).collect()}
        ordered = sorted(values)
        assert got == {q: ordered[int(n * q)] for q in (0.5, 0.95, 0.99)}


def test_split_takes_the_lowest_hashes_of_each_class(spark):
    df = spark.range(500).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 4))
        .alias("category"))
    got = labelled.stratified_split(df, "id").withColumn("h", F.xxhash64("id", F.lit(42)))
    groups = defaultdict(list)
    for r in got.collect():
        groups[r.category].append((r.h, r.is_validation))
    for rows in groups.values():
        k = math.ceil(0.15 * len(rows))
        assert [v for _, v in sorted(rows)] == [True] * k + [False] * (len(rows) - k)


def test_upsampling_reaches_the_floor(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(407)],
                               "id int, category string")
    counts = {r.category: r.n for r in labelled.class_distribution(
        labelled.upsample(df, "id")).collect()}
    assert counts == {"a": 300, "b": 400}
    counts = {r.category: r.n for r in labelled.class_distribution(
        labelled.append_minimum(df, "id")).collect()}
    assert counts == {"a": 107, "b": 400}


def test_generated_examples_do_not_depend_on_partitions(spark):
    cases = anchors.seed_cases(spark)
    one = labelled.generate_examples(cases, samples=4)
    two = labelled.generate_examples(cases.repartition(7), samples=4)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    ranges = one.join(cases.select("case_id", "amount_low", "amount_high"), "case_id")
    assert ranges.where("amount < amount_low or amount > amount_high + 0.01").count() == 0
    assert one.where("hour(timestamp) < 8 or hour(timestamp) > 22").count() == 0
    assert one.where("category = 'Subscription' and (freq_30d < 1 or freq_30d > 4)").count() == 0


def test_few_cases_are_grown_in_many_tasks(spark):
    cases = anchors.seed_cases(spark).limit(64).coalesce(1)
    grown = labelled.generate_examples(cases, samples=4)
    by_task = grown.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 8 and max(r["count"] for r in by_task) <= 64


def test_ngrams(spark):
    df = spark.createDataFrame([("a", "kfc India"), ("b", "Été x kfc kfc"), ("c", "")],
                               "k string, t string")
    chars = textfeatures.term_counts(df, "k", "t", "char")
    assert chars.where("k = 'a'").agg(F.sum("tf")).first()[0] == 28
    words = {(r.k, r.term): r.tf for r in textfeatures.term_counts(df, "k", "t", "word").collect()}
    assert words == {("a", "kfc"): 1, ("a", "india"): 1, ("a", "kfc india"): 1, ("b", "ete"): 1,
                     ("b", "kfc"): 2, ("b", "ete kfc"): 1, ("b", "kfc kfc"): 1}


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["red shop", "red red shop", "blue shop", "lonely"])], "k int, t string")
    rows = textfeatures.document_tfidf(df, "k", "t", "word").collect()
    assert {r.term for r in rows} == {"red", "shop", "red shop"}
    by_doc = defaultdict(float)
    for r in rows:
        by_doc[r.k] += r.weight ** 2
    assert set(by_doc) == {0, 1, 2} and all(math.isclose(v, 1) for v in by_doc.values())
    idf_red, idf_shop = math.log(5 / 3) + 1, math.log(5 / 4) + 1
    w = {"red": (1 + math.log(2)) * idf_red, "shop": idf_shop, "red shop": idf_red}
    norm = math.sqrt(sum(x * x for x in w.values()))
    got = {r.term: r.weight for r in rows if r.k == 1}
    assert all(math.isclose(got[t], w[t] / norm) for t in w)


def test_cold_start_by_text(spark):
    df = spark.createDataFrame(
        [("a", "VPA uber@hdfcbank Uber Travel Booking"), ("b", "VPA zz9@ybl QXZ TRAVELS"),
         ("c", "netflix monthly plan"), ("d", "Apollo Pharmacy Clinic")],
        "k string, raw_text string")
    got = {r.k: r.category for r in anchors.cold_start_by_text(df, "k").collect()}
    assert got == {"a": "Transport", "b": "Other", "c": "Subscription", "d": "Health"}
