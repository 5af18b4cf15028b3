"""Continuous versions of the stages, each equal to its batch result.

Stages that must never lose or repeat a key use ``foreachBatch`` with the
stored table as the memory: a watermark forgets old keys, a table does not.
Every batch writes under its own number, so a batch that is run again after a
failure replaces what it wrote before.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake import schema as S
from ledgerlake.operators.bronze import to_bronze, with_fingerprint
from ledgerlake.operators.feedback import apply_corrections, feedback_rows, split_corrections
from ledgerlake.operators.gold import affected_groups, monthly_summary, refresh_gold
from ledgerlake.operators.silver import project_silver
from ledgerlake.plans.monthly import StreamedGold
from ledgerlake.sources.journal import within
from ledgerlake.sources.shared import materialise
from ledgerlake.sources.sinks import latest_by_key, read_or_empty, upsert


def stream_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Files that arrive in a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    )


def dedupe_within_watermark(raw: DataFrame, delay: str = "10 days") -> DataFrame:
    """Streaming dedupe with bounded state: copies further apart than
    ``delay`` pass, so a bronze that must be exact uses ``start_bronze``."""
    return (
        with_fingerprint(raw)
        .withColumn("_event_time", F.col("timestamp").cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(["user_id", "fingerprint"])
        .drop("_event_time")
    )


def _start(
    stream: DataFrame,
    checkpoint: str,
    step: Callable[[DataFrame, int], None],
    continuous: bool,
    name: str,
) -> StreamingQuery:
    writer = (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(step)
    )
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _write_batch(df: DataFrame, path: str, batch: int, by: tuple[str, ...] = ()) -> None:
    """Replace the rows of one batch number."""
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def bronze_before(spark: SparkSession, path: str, batch: int, days: list) -> DataFrame:
    """Bronze of some days that earlier batches wrote; pruned to their folders."""
    stored = read_or_empty(spark, path, f"{schema_ddl(S.BRONZE)}, batch int, day date")
    return within(stored.where(F.col("batch") < batch), "day", days).drop("batch", "day")


def schema_ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def start_bronze(
    raw: DataFrame, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Raw stream to bronze, each payment once for all time.

    Copies of a payment share their day, and a batch's rows lie in folders by
    day, so of what earlier batches stored only the folders of this batch's days
    are read.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = materialise(batch, "arrived")
        days = [r[0] for r in arrived.select(F.to_date("timestamp")).distinct().collect()]
        fresh = to_bronze(arrived, bronze_before(spark, path, number, days))
        by_day = fresh.select(*S.BRONZE.names, F.to_date("timestamp").alias("day"))
        _write_batch(by_day, path, number, ("day",))

    return _start(raw, checkpoint, step, continuous, "bronze")


def start_silver(
    bronze: DataFrame,
    path: str,
    checkpoint: str,
    as_of: Column,
    categorise_batch: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Bronze stream to silver; ``categorise_batch`` (silver, bronze) adds the
    categories and reads the feedback as it is at that batch.

    Rows that stay undecided are scored again with each later batch: their
    bronze rows wait under ``<path>-undecided``, replaced batch by batch, and a
    row that is decided later is written again (``read_silver`` takes the last).
    """
    waiting_path = f"{path}-undecided"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = S.BRONZE.names
        waiting = read_or_empty(spark, waiting_path, f"{schema_ddl(S.BRONZE)}, batch int")
        waiting = waiting.where(F.col("batch") == number - 1).drop("batch")
        rows = materialise(batch.select(*names).unionByName(waiting.select(*names)), "arrived")
        silver = project_silver(rows, as_of)
        if categorise_batch:
            silver = categorise_batch(silver, rows)
        silver = materialise(silver, "silver-batch")
        _write_batch(silver, path, number)
        still = silver.where("not is_categorised").select("bronze_id")
        _write_batch(rows.join(still, "bronze_id", "left_semi").select(*names), waiting_path, number)

    return _start(bronze, checkpoint, step, continuous, "silver")


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """Every streamed silver row as its last batch wrote it."""
    rows = spark.read.schema(f"{schema_ddl(S.SILVER)}, batch int").parquet(path)
    return latest_by_key(rows, ["silver_id"], [F.col("batch")]).select(*S.SILVER.names)


def compact(spark: SparkSession, path: str, schema, out: str) -> None:
    """All batches of an append-only table as one, in a folder of its own."""
    read_batches(spark, path, schema).write.parquet(f"{out}/batch=0")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    rows = spark.read.schema(f"{schema_ddl(schema)}, batch int").parquet(path)
    return rows.select(*[f.name for f in schema.fields])


def start_gold(
    silver: DataFrame, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Categorised silver stream to monthly sums.

    Each batch stores its own sums per group; ``read_gold`` adds them up. The
    stored rows are aggregates, at most 13 per user and month and batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        _write_batch(monthly_summary(batch), path, number)

    return _start(silver, checkpoint, step, continuous, "gold")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, S.GOLD).groupBy("user_id", "month", "category").agg(
        F.sum("total_amount").cast(S.MONEY).alias("total_amount"),
        F.sum("txn_count").alias("txn_count"),
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_gold_totals(
    silver: DataFrame, store: StreamedGold, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Categorised silver stream to monthly totals that are kept as state.

    The totals of each user, month and category lie in a state store on disk
    (RocksDB), so a batch reads and writes the groups that it has and nothing is
    summed again. What a batch changes is taken into ``store`` once, also if the
    batch is run again. State is one row a group and never expires.
    """
    spark = silver.sparkSession
    before = spark.conf.get(PROVIDER)

    def step(batch: DataFrame, number: int) -> None:
        store.upsert(batch.select(*S.GOLD.names), number)

    spark.conf.set(PROVIDER, ROCKSDB)  # the query takes it over as it starts
    try:
        writer = monthly_summary(silver).writeStream.outputMode("update").queryName("gold-totals")
        writer = writer.option("checkpointLocation", checkpoint).foreachBatch(step)
        return (writer if continuous else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(PROVIDER, before)


def start_corrections(
    corrections: DataFrame,
    silver: Callable[[], DataFrame],
    feedback_path: str,
    checkpoint: str,
    on_refit: Callable[[DataFrame], None] | None = None,
    threshold: int = S.REFIT_TRIGGER,
    continuous: bool = False,
) -> StreamingQuery:
    """Corrections stream to feedback; ``on_refit`` is called with all
    feedback after a batch that accepted at least ``threshold`` rows."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        accepted, _ = split_corrections(silver(), batch)
        _write_batch(feedback_rows(accepted), feedback_path, number)
        written = spark.read.schema(S.FEEDBACK).parquet(f"{feedback_path}/batch={number}")
        if on_refit and written.limit(threshold).count() >= threshold:
            on_refit(read_feedback(spark, feedback_path))

    return _start(corrections, checkpoint, step, continuous, "corrections")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Newest feedback per user and transaction over all batches."""
    rows = read_batches(spark, path, S.FEEDBACK)
    return upsert(rows.limit(0), rows, ["user_id", "silver_id"], ["corrected_at"])


def corrected_layers(
    silver: DataFrame, feedback: DataFrame, gold: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Silver and gold with all streamed corrections applied; of a stored
    ``gold`` only the groups that they touch are made anew."""
    corrected = apply_corrections(silver, feedback)
    if gold is None:
        return corrected, monthly_summary(corrected)
    dates = silver.select("silver_id", "user_id", "transaction_date")
    dated = feedback.drop("transaction_date").join(dates, ["silver_id", "user_id"])
    groups = materialise(affected_groups(dated), "groups")
    return corrected, refresh_gold(gold, corrected, groups)
