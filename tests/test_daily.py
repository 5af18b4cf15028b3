"""Stored layers brought up to date run by run."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators import feedback, gold, history
from ledgerlake.plans import daily, memory
from ledgerlake.sources.shared import new_folder
from ledgerlake.workload import views as V
from ledgerlake.workload.views import probability_arrays

from spend_cases import START, make_feedback, make_raw


def as_of():
    return F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def probabilities(txns):
    return probability_arrays(txns.select("silver_id"), F.col("silver_id"))


def no_feedback(spark):
    return spark.createDataFrame([], S.FEEDBACK)


def test_runs_add_up_to_one(spark):
    raw = make_raw(spark, 200)
    whole = daily.run(raw, no_feedback(spark), probabilities, as_of())
    store = daily.Store(spark, new_folder(spark, "layers"))
    for part in ("raw_id < 80", "raw_id < 120", "raw_id >= 60"):
        daily.advance(store, raw.where(part), no_feedback(spark), probabilities, as_of())
    assert rows(store.bronze(), "raw_id", "fingerprint") == rows(whole.bronze, "raw_id", "fingerprint")
    names = [n for n in S.SILVER.names if n != "confidence"]
    assert rows(store.silver(), *names) == rows(whole.silver, *names)
    assert rows(store.gold(), *S.GOLD.names) == rows(whole.gold, *S.GOLD.names)


def test_only_the_days_of_a_batch_are_read(spark):
    store = daily.Store(spark, new_folder(spark, "layers"))
    raw = make_raw(spark, 100)
    daily.advance(store, raw, no_feedback(spark), probabilities, as_of())
    day = raw.select(F.to_date("timestamp").alias("d")).where("d is not null").first().d
    plan = store.bronze([day])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "run" in filters


def test_undecided_rows_are_scored_by_the_next_run(spark):
    store = daily.Store(spark, new_folder(spark, "layers"))
    raw = make_raw(spark, 60)

    def unsure(txns):
        return txns.select("silver_id", F.array_repeat(F.lit(1.0 / 13), 13).alias("p"))

    daily.advance(store, raw, no_feedback(spark), unsure, as_of())
    waiting = store.undecided().count()
    assert waiting > 0
    daily.advance(store, raw.limit(0), no_feedback(spark), probabilities, as_of())
    assert store.undecided().count() < waiting
    assert rows(store.gold(), *S.GOLD.names) == rows(gold.monthly_summary(store.silver()), *S.GOLD.names)


class Broken(Exception):
    pass


def test_a_run_that_breaks_off_leaves_nothing(spark, monkeypatch):
    """A raise in place of each write in turn, then the run as it should be."""
    raw = make_raw(spark, 60).cache()
    whole = daily.run(raw, no_feedback(spark), probabilities, as_of())
    store = daily.Store(spark, new_folder(spark, "layers"))
    daily.advance(store, raw.where("raw_id < 25"), no_feedback(spark), probabilities, as_of())
    before = rows(store.gold(), *S.GOLD.names), rows(store.silver(), "silver_id", "category")
    left = [0]

    def counted(write):
        def step(*args):
            if not left[0]:
                raise Broken
            left[0] -= 1
            write(*args)

        return step

    for name in ("put", "_mark"):
        monkeypatch.setattr(daily.Store, name, counted(getattr(daily.Store, name)))
    for after in range(7):
        left[0] = after
        with pytest.raises(Broken):
            daily.advance(store, raw.where("raw_id >= 15"), no_feedback(spark), probabilities, as_of())
        assert (rows(store.gold(), *S.GOLD.names), rows(store.silver(), "silver_id", "category")) == before
        assert store.runs() == 1
    left[0] = 7
    daily.advance(store, raw.where("raw_id >= 15"), no_feedback(spark), probabilities, as_of())
    assert left == [0]
    assert rows(store.bronze(), "raw_id", "fingerprint") == rows(whole.bronze, "raw_id", "fingerprint")
    names = [n for n in S.SILVER.names if n != "confidence"]
    assert rows(store.silver(), *names) == rows(whole.silver, *names)
    assert rows(store.gold(), *S.GOLD.names) == rows(whole.gold, *S.GOLD.names)


def sure(txns):
    """Every row is decided."""
    p = [F.lit(0.99 if x == "Food" else 0.01 / 12) for x in S.LABELS]
    return txns.select("silver_id", F.array(*p).alias("p"))


def test_stored_frequency_equals_the_whole_computation(spark):
    """Batches in order of time, a third of the rows one key."""
    r = random.Random(3)
    data = []
    for i in range(160):
        at = START + dt.timedelta(hours=r.randint(0, 60 * 24), minutes=r.choice([0, 0, 30]))
        shop, user = ("Hot shop", "hot") if i % 3 == 0 else (r.choice(["Alpha", "Beta"]), f"u{i % 2}")
        data.append((i, user, Decimal(i), shop, "debit", None if i % 40 == 7 else at, "file", "t", None))
    raw = spark.createDataFrame(data, S.TRANSACTIONS).cache()
    cuts = [START + dt.timedelta(days=d) for d in (0, 20, 45, 100)]
    seen = []

    def noted(txns):
        seen.extend((x.silver_id, x.freq_30d) for x in txns.select("silver_id", "freq_30d").collect())
        return sure(txns)

    store = daily.Store(spark, new_folder(spark, "layers"))
    for low, high in zip(cuts, cuts[1:]):
        part = raw.where((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high)))
        if low == START:
            part = part.unionByName(raw.where("timestamp IS NULL"))
        now = F.lit(START - dt.timedelta(days=1)).cast("timestamp_ntz")
        daily.advance(store, part, no_feedback(spark), noted, now, documented_frequency=True)
    stored = dict(seen)
    assert len(seen) == len(stored) == 160
    seen.clear()
    daily.run(raw, no_feedback(spark), noted, F.lit(START - dt.timedelta(days=1)).cast("timestamp_ntz"), documented_frequency=True)
    assert stored == dict(seen) and max(stored.values()) > 5
    slots = store.slots(dt.date(2024, 1, 5), dt.date(2024, 1, 9))._jdf.queryExecution().executedPlan().toString()
    assert "day" in slots.split("PartitionFilters: [")[1].split("]")[0]


def test_corrections_into_stored_layers(spark):
    raw = make_raw(spark, 60)
    store = daily.Store(spark, new_folder(spark, "layers"))
    past = memory.HistoryStore(spark, new_folder(spark, "history"))
    daily.advance(store, raw, past, probabilities, as_of())
    before = store.silver().cache()
    asked = [(x.user_id, x.silver_id, "M", None, None, c, x.amount, START + dt.timedelta(seconds=j))
             for x in before.where("silver_id % 4 = 0 OR NOT is_categorised").collect()
             for j, c in enumerate(["Food", "Pets", "Health"])]
    asked.append(("nobody", 5, "M", None, None, "Food", Decimal(1), START))
    requests = spark.createDataFrame(asked, S.FEEDBACK).cache()
    rejected = daily.correct(store, requests, past)
    accepted, refused = feedback.split_corrections(before, requests)
    assert rows(rejected, "silver_id", "reason") == rows(refused, "silver_id", "reason")
    after = feedback.apply_corrections(before, accepted)
    assert rows(store.silver(), *S.SILVER.names) == rows(after, *S.SILVER.names)
    assert store.undecided().count() == after.where("NOT is_categorised").count()
    assert rows(store.gold(), *S.GOLD.names) == rows(gold.monthly_summary(after), *S.GOLD.names)
    assert rows(store.feedback(), "silver_id", "corrected_category") == rows(accepted, "silver_id", "corrected_category")
    # the next corrections take back the first ones, of some days alone
    dates = after.select("silver_id", "user_id", "transaction_date")
    again = requests.where("corrected_category = 'Food' AND silver_id % 8 = 0").withColumn(
        "corrected_at", F.col("corrected_at") + F.expr("interval 1 day"))
    daily.correct(store, again.join(dates, ["silver_id", "user_id"]), past)
    changed = feedback.apply_corrections(after, feedback.split_corrections(after, again)[0])
    assert rows(store.silver(), *S.SILVER.names) == rows(changed, *S.SILVER.names)
    assert rows(store.gold(), *S.GOLD.names) == rows(gold.monthly_summary(changed), *S.GOLD.names)
    assert rows(past.profile(), "user_key", "merchant_key", "override", "history_count") == rows(
        history.history_profile(store.feedback()), "user_key", "merchant_key", "override", "history_count")


def profile_rows(profile):
    out = {}
    for x in profile.collect():
        numbers = [*x.weights, x.weight_total, x.amount_mean or 0, x.amount_std or 0, x.amount_cv]
        out[x.user_key, x.merchant_key] = (x.override, x.history_count, x.amount_count, numbers)
    return out


def same_profiles(stored, view):
    ours, wanted = profile_rows(stored), profile_rows(view)
    assert ours.keys() == wanted.keys()
    for k, (*exact, numbers) in ours.items():
        assert tuple(exact) == wanted[k][:3]
        assert numbers == pytest.approx(wanted[k][3], abs=1e-4)


def test_history_batch_by_batch(spark):
    """In order, late, corrected again (also to another merchant), outdated, and broken off."""
    data, frame = make_feedback(spark, 180)
    frame = frame.cache()
    store = memory.HistoryStore(spark, new_folder(spark, "history"))
    moved = frame.where("silver_id < 30").withColumn("merchant", F.lit("Elsewhere")).withColumn(
        "corrected_at", F.col("corrected_at") + F.expr("interval 2 days"))
    old = frame.where("silver_id BETWEEN 40 AND 50").withColumn("corrected_category", F.lit("Pets")).withColumn(
        "corrected_at", F.col("corrected_at") - F.expr("interval 2 days"))
    middle = F.lit(START + dt.timedelta(minutes=100)).cast("timestamp_ntz")
    batches = [
        frame.where((F.col("corrected_at") < middle) & (F.col("silver_id") % 10 != 0)),
        frame.where((F.col("corrected_at") >= middle) & (F.col("silver_id") % 10 != 0)),
        frame.where(F.col("silver_id") % 10 == 0),
        moved,
        old,
        frame.limit(0),
    ]
    so_far = frame.limit(0)
    for i, batch in enumerate(batches):
        if i == 2:
            run = store.begin()
            store.put(frame.withColumn("bucket", F.lit(0)), "entries", run, ("bucket",))
        store.advance(batch)
        so_far = feedback.upsert_feedback(so_far, batch)
        same_profiles(store.profile(), history.history_profile(so_far))
    some = spark.createDataFrame([("hot", "big shop"), ("u1", "nowhere")], "user_key string, merchant_key string")
    assert profile_rows(store.profile(some)).keys() == {k for k in profile_rows(store.profile()) if k == ("hot", "big shop")}


def test_stored_history_decides_as_the_view_does(spark):
    raw = make_raw(spark, 60).cache()
    _, known = make_feedback(spark, 90)
    known = known.withColumn("merchant", F.lit("Shop")).withColumn("user_id", F.lit("hot"))
    past = memory.HistoryStore(spark, new_folder(spark, "history"))
    past.advance(known)
    stores = [daily.Store(spark, new_folder(spark, "layers")) for _ in range(2)]
    daily.advance(stores[0], raw, known, probabilities, as_of())
    daily.advance(stores[1], raw, past, probabilities, as_of(), include_predictions=True)
    names = ["silver_id", "category", "is_categorised", "decision_source"]
    assert rows(stores[0].silver(), *names) == rows(stores[1].silver(), *names)
    decided = stores[1].decided().count()
    assert past.entries().count() == known.count() + decided - known.join(stores[1].decided(), ["user_id", "silver_id"]).count()


def test_events_of_one_file_are_read_as_payments_by_many_tasks(spark, tmp_path):
    events = spark.range(0, 400, 1, 1).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "double(id) AS value", """concat('{"k": ', id % 50, '}') AS props""")
    events.write.parquet(str(tmp_path / "events.parquet"))
    by_task = V.payments(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 8 and sum(r["count"] for r in by_task) == 400
