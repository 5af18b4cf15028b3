"""Streams give what the batch gives, also over several batches."""

import shutil

from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators import bronze, feedback, gold, silver
from ledgerlake.sources.shared import materialise, new_folder
from ledgerlake.plans import monthly
from ledgerlake.streaming import jobs

from spend_cases import make_corrections, make_raw, make_silver


def as_of():
    return F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def land(df, folder, name):
    df.coalesce(1).write.parquet(str(folder / f"_{name}"))
    part = next((folder / f"_{name}").glob("*.parquet"))
    shutil.copy(part, folder / f"{name}.parquet")


def test_bronze_over_three_arrivals(spark, tmp_path):
    raw = make_raw(spark, 150)
    out, mark = new_folder(spark, "bronze"), new_folder(spark, "offsets")
    cuts = [("a", "raw_id < 50"), ("b", "raw_id >= 50 and raw_id < 60"), ("c", "raw_id >= 40")]
    for name, part in cuts:  # the last arrival overlaps the earlier ones
        land(raw.where(part), tmp_path, name)
        stream = jobs.stream_files(spark, str(tmp_path), S.TRANSACTIONS)
        jobs.start_bronze(stream, out, mark).awaitTermination()
    got = jobs.read_batches(spark, out, S.BRONZE)
    assert rows(got, "raw_id", "fingerprint") == rows(
        bronze.to_bronze(raw), "raw_id", "fingerprint")


def test_dedupe_within_watermark(spark, tmp_path):
    raw = make_raw(spark, 90)
    land(raw, tmp_path, "a")
    out = new_folder(spark, "deduped")
    stream = jobs.dedupe_within_watermark(
        jobs.stream_files(spark, str(tmp_path), S.TRANSACTIONS))
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", new_folder(spark, "offsets"))
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out)
    assert rows(got, "user_id", "fingerprint") == rows(
        bronze.to_bronze(raw), "user_id", "fingerprint")


def test_silver_and_gold_streams(spark, tmp_path):
    source = bronze.to_bronze(make_raw(spark, 120))
    land(source.where("raw_id < 60"), tmp_path, "a")
    land(source.where("raw_id >= 60"), tmp_path, "b")
    out = new_folder(spark, "silver")

    def categorised(rows_, _):
        return rows_.withColumn("category", F.when(F.col("amount") > 2, "Food")).withColumn(
            "is_categorised", F.col("amount") > 2)

    stream = jobs.stream_files(spark, str(tmp_path), S.BRONZE)
    jobs.start_silver(stream, out, new_folder(spark, "offsets"), as_of(),
                      categorised).awaitTermination()
    got = jobs.read_silver(spark, out)
    batch = categorised(silver.project_silver(source, as_of()), None)
    assert rows(got, *S.SILVER.names) == rows(batch, *S.SILVER.names)

    sums, mark = new_folder(spark, "gold"), new_folder(spark, "offsets")
    for _ in range(2):  # the second start finds nothing new
        stored = jobs.stream_files(spark, f"{out}/*", S.SILVER)
        jobs.start_gold(stored, sums, mark).awaitTermination()
    assert rows(jobs.read_gold(spark, sums), *S.GOLD.names) == rows(
        gold.monthly_summary(batch), *S.GOLD.names)


def test_undecided_rows_are_scored_again(spark, tmp_path):
    source = bronze.to_bronze(make_raw(spark, 60))
    out, mark = new_folder(spark, "silver"), new_folder(spark, "offsets")
    decided_from = [F.lit(False), F.lit(True)]

    def categorised(rows_, _):
        now = decided_from[0]
        return rows_.withColumn("category", F.when(now, "Food")).withColumn("is_categorised", now)

    for name, part in (("a", "raw_id < 30"), ("b", "raw_id >= 30")):
        land(source.where(part), tmp_path, name)
        stream = jobs.stream_files(spark, str(tmp_path), S.BRONZE)
        jobs.start_silver(stream, out, mark, as_of(), categorised).awaitTermination()
        decided_from.pop(0)
        decided_from.append(F.lit(True))
    got = jobs.read_silver(spark, out)
    assert got.count() == source.count() and got.where("not is_categorised").count() == 0
    sums = new_folder(spark, "gold")
    stored = jobs.stream_files(spark, f"{out}/*", S.SILVER)
    jobs.start_gold(stored, sums, new_folder(spark, "offsets")).awaitTermination()
    assert rows(jobs.read_gold(spark, sums), *S.GOLD.names) == rows(
        gold.monthly_summary(got), *S.GOLD.names)


def test_corrections_stream_and_refit_trigger(spark, tmp_path):
    before = make_silver(spark, 60)
    requests = make_corrections(spark, before)
    land(requests, tmp_path, "a")
    out, seen = new_folder(spark, "feedback"), []
    stream = jobs.stream_files(spark, str(tmp_path), S.FEEDBACK)
    jobs.start_corrections(stream, lambda: before, out, new_folder(spark, "offsets"),
                           on_refit=lambda f: seen.append(f.count())).awaitTermination()
    accepted, _ = feedback.split_corrections(before, requests)
    assert seen == [accepted.count()]
    stored = jobs.read_feedback(spark, out)
    assert rows(stored, "user_id", "silver_id", "corrected_category") == rows(
        accepted, "user_id", "silver_id", "corrected_category")
    after, summary = jobs.corrected_layers(before, stored)
    assert rows(summary, *S.GOLD.names) == rows(
        gold.monthly_summary(feedback.apply_corrections(before, accepted)), *S.GOLD.names)
    assert after.where("user_corrected").count() == accepted.count()
    _, refreshed = jobs.corrected_layers(before, stored, gold.monthly_summary(before))
    assert rows(refreshed, *S.GOLD.names) == rows(summary, *S.GOLD.names)
    packed = new_folder(spark, "feedback")
    jobs.compact(spark, out, S.FEEDBACK, packed)
    assert rows(jobs.read_feedback(spark, packed), "silver_id") == rows(stored, "silver_id")


def test_only_the_days_of_a_batch_are_read(spark, tmp_path):
    raw = make_raw(spark, 90)
    out, mark = new_folder(spark, "bronze"), new_folder(spark, "offsets")
    land(raw, tmp_path, "a")
    jobs.start_bronze(jobs.stream_files(spark, str(tmp_path), S.TRANSACTIONS), out, mark).awaitTermination()
    days = [r[0] for r in raw.select(F.to_date("timestamp")).distinct().limit(2).collect()]
    known = jobs.bronze_before(spark, out, 1, days)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert known.count() == bronze.to_bronze(raw).where(F.to_date("timestamp").isin(days)).count() > 0
    assert jobs.bronze_before(spark, out, 0, days).count() == 0


def test_gold_totals_over_restarts(spark, tmp_path):
    """Totals stay in the state over two starts; a batch that comes again, or
    broke off, counts once."""
    rows_ = make_silver(spark, 160)
    store = monthly.StreamedGold(spark, new_folder(spark, "gold"))
    mark = new_folder(spark, "offsets")
    for name, part in (("a", "silver_id < 50"), ("b", "silver_id >= 50 and silver_id < 60"), ("c", "silver_id >= 60")):
        land(rows_.where(part), tmp_path, name)
        stream = jobs.stream_files(spark, str(tmp_path), S.SILVER)
        jobs.start_gold_totals(stream, store, mark).awaitTermination()
        so_far = rows_.where("silver_id < 50") if name == "a" else rows_.where("silver_id < 60") if name == "b" else rows_
        assert rows(store.gold(), *S.GOLD.names) == rows(gold.monthly_summary(so_far), *S.GOLD.names)
    wrong = gold.monthly_summary(rows_).withColumn("txn_count", F.lit(999).cast("long"))
    store.upsert(wrong, 1)  # taken in before
    run = store.begin()
    store.put(wrong, "gold", run, ("month",))  # breaks off here
    assert rows(store.gold(), *S.GOLD.names) == rows(gold.monthly_summary(rows_), *S.GOLD.names)
    one = materialise(wrong.limit(1), "one")
    store.upsert(one, 77)
    changed = gold.monthly_summary(rows_).join(one.select(*gold.GOLD_KEYS), gold.GOLD_KEYS, "left_anti").unionByName(one)
    assert rows(store.gold(), *S.GOLD.names) == rows(changed, *S.GOLD.names)
