"""One run over all users: raw to bronze, silver, categories and gold.

``run`` works on tables in hand; ``advance`` brings stored layers up to date
and costs what is new: it reads the days and months that a batch touches.
"""

import calendar
import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.dates import month_of
from ledgerlake.operators.bronze import to_bronze
from ledgerlake.operators.feedback import apply_corrections, feedback_rows, split_corrections
from ledgerlake.operators.gold import GOLD_KEYS, affected_groups, monthly_summary
from ledgerlake.operators.history import frequency_30d, history_count, with_keys, KEYS
from ledgerlake.operators.insights import search
from ledgerlake.operators.scoring import categorise
from ledgerlake.operators.silver import project_silver, scoring_input, to_silver, write_back
from ledgerlake.operators.trailing import slot_totals, trailing_from_store
from ledgerlake.plans.memory import HistoryStore
from ledgerlake.plans.monthly import MonthlyGold
from ledgerlake.plans.online import OnlineModel, correction_examples
from ledgerlake.plans.searching import UNDATED, SearchIndex, block_month
from ledgerlake.sources.journal import ddl, within
from ledgerlake.sources.shared import materialise
from ledgerlake.sources.sinks import latest_by_key


@dataclass
class Layers:
    bronze: DataFrame
    silver: DataFrame
    gold: DataFrame


def with_frequency(
    txns: DataFrame, feedback: DataFrame, key: str = "merchant", documented: bool = False
) -> DataFrame:
    """Add ``freq_30d``: the key's number of feedback entries, or with
    ``documented`` the number of its transactions in the last 30 days."""
    if documented:
        return frequency_30d(txns, key)
    counts = history_count(feedback, key)
    return (
        with_keys(txns, key)
        .join(counts, KEYS, "left")
        .withColumn("freq_30d", F.coalesce("history_count", F.lit(0)))
        .drop(*KEYS, "history_count")
    )


def accepted_as_feedback(silver: DataFrame) -> DataFrame:
    """Categorised rows as history entries, for runs that let accepted
    predictions count as history."""
    return silver.where("is_categorised").select(
        "user_id",
        "silver_id",
        "merchant",
        F.col("merchant").alias("raw_text"),
        F.lit(None).cast("string").alias("original_category"),
        F.col("category").alias("corrected_category"),
        "amount",
        F.col("transaction_date").cast("timestamp_ntz").alias("corrected_at"),
    )


def run(
    raw: DataFrame,
    feedback: DataFrame,
    probabilities,
    as_of: Column,
    bronze: DataFrame | None = None,
    silver: DataFrame | None = None,
    key: str = "merchant",
    text_source: str = "merchant",
    include_predictions: bool = False,
    documented_frequency: bool = False,
) -> Layers:
    """Bring all layers up to date with ``raw``.

    ``probabilities`` is a function from the scoring input to (silver_id, p).
    ``bronze`` and ``silver`` are the layers of the previous run. Every layer
    that is read more than once is written to the shared folder.
    """
    new_bronze = to_bronze(raw, bronze)
    all_bronze = new_bronze if bronze is None else bronze.unionByName(new_bronze)
    all_bronze = materialise(all_bronze, "bronze")
    new_silver = to_silver(all_bronze, silver, as_of)
    all_silver = new_silver if silver is None else silver.unionByName(new_silver)
    all_silver = materialise(all_silver, "silver")
    history = feedback
    if include_predictions and silver is not None:
        history = feedback.unionByName(accepted_as_feedback(silver))
    txns = with_frequency(
        scoring_input(all_silver, all_bronze, text_source), history, key, documented_frequency
    )
    decisions = categorise(txns, probabilities(txns), history, key)
    categorised = materialise(write_back(all_silver, decisions), "silver")
    return Layers(all_bronze, categorised, monthly_summary(categorised))


@dataclass
class Store(MonthlyGold, SearchIndex):
    """Layers in a folder that all executors can reach.

    Bronze lies by day of payment, decided silver by day and gold by month.
    Rows without a category wait in a table of their own, written by each run,
    and are scored again by the next. Corrections lie by the day of their
    payment and are applied when silver is read. ``searchable``: decided silver is
    indexed by its texts for ``search``; a store must have it in all of its runs.
    """

    searchable: bool = False

    def bronze(self, days: list | None = None, run: int | None = None) -> DataFrame:
        rows = self.rows("bronze", ddl(S.BRONZE) + ", day date", run)
        return within(rows, "day", days).drop("day", "run")

    def decided(self, days: list | None = None, run: int | None = None) -> DataFrame:
        rows = within(self.rows("silver", ddl(S.SILVER), run), "transaction_date", days).drop("run")
        return apply_corrections(rows, self._corrected(days, run))

    def _corrected(self, days: list | None = None, run: int | None = None) -> DataFrame:
        """The newest correction of each transaction."""
        schema = ddl(S.FEEDBACK) + ", transaction_date date"
        rows = within(self.rows("corrections", schema, run), "transaction_date", days)
        return latest_by_key(rows, ["silver_id", "user_id"], [F.col("corrected_at"), F.col("run")])

    def feedback(self) -> DataFrame:
        """All corrections that ``correct`` accepted."""
        return feedback_rows(self._corrected()).select(*S.FEEDBACK.names)

    def undecided(self) -> DataFrame:
        last = self.runs()
        return self.rows("undecided", ddl(S.SILVER)).where(F.col("run") == last).drop("run")

    def silver(self) -> DataFrame:
        return self.decided().unionByName(self.undecided())

    def search(
        self, text: str | None = None, category: str = "All", users: list[str] | None = None
    ) -> DataFrame:
        """The rows of silver that ``insights.search`` finds, all or those of some users.

        The index says in which months which users have the text, and only the
        days of these months are read. Rows that wait for a category are few and
        are looked at one by one.
        """
        if not self.searchable:
            raise ValueError("the store has no text index")
        waiting = within(self.undecided(), "user_id", users)
        if not (text and text.strip()):
            return search(within(self.decided(), "user_id", users).unionByName(waiting), text, category)
        blocks = materialise(self.blocks(text, users), "blocks")
        months = _values(blocks, F.col("month"))
        days = [d for m in months for d in ([None] if m == UNDATED else _days_of(m))]
        near = within(self.decided(days), "user_id", users).withColumn("month", block_month())
        same = [near[c].eqNullSafe(blocks[c]) for c in ("user_id", "month")]
        near = near.join(blocks, same, "left_semi").drop("month")
        return search(near.select(*S.SILVER.names).unionByName(waiting), text, category)

    def slots(self, first, last, run: int | None = None) -> DataFrame:
        """Stored totals of the hours of some days."""
        schema = "user_key string, merchant_key string, _slot long, _s_freq_30d long, day date"
        rows = self.rows("slots", schema, run)
        return rows.where(F.col("day").between(F.lit(first), F.lit(last))).drop("day", "run")


def _values(df: DataFrame, column: Column) -> list:
    """Distinct days or months of a batch: as many as the batch spans."""
    return [r[0] for r in df.select(column.alias("v")).distinct().collect()]


def advance(
    store: Store,
    raw: DataFrame,
    feedback: DataFrame | HistoryStore,
    probabilities,
    as_of: Column,
    key: str = "merchant",
    text_source: str = "merchant",
    include_predictions: bool = False,
    documented_frequency: bool = False,
) -> None:
    """Bring stored layers up to date with ``raw``, which may hold rows of
    earlier runs.

    A payment's copies share their day, so only bronze of the batch's days is
    looked at. New and still undecided rows are scored; gold is recomputed for
    the groups that got rows, from silver of their months. All tables change
    together when the run is finished (``Journal``): a run that breaks off
    leaves nothing behind that a reader or the next run could see.

    ``feedback``: the corrections, or a ``HistoryStore``, of which only the keys
    at hand are read. ``include_predictions``: accepted categories of earlier
    runs count as history; a ``HistoryStore`` takes in those of this run at its
    end. ``documented_frequency``: payments to the merchant in the last 30 days,
    from stored totals per hour; a store must have it in all of its runs.
    """
    run = store.begin()
    day = F.to_date("timestamp")
    fresh = to_bronze(raw, store.bronze(_values(raw, day)))
    fresh = materialise(fresh.select(*S.BRONZE.names, day.alias("day")), "fresh")
    store.put(fresh, "bronze", run, ("day",))

    new = project_silver(fresh.drop("day"), as_of)
    waiting = store.undecided()
    todo = materialise(new.unionByName(waiting), "todo")
    days = _values(todo, F.col("transaction_date"))
    origin = store.bronze([*days, None], run)
    txns = scoring_input(todo, origin, text_source)
    if documented_frequency:
        txns = materialise(_stored_frequency(store, run, txns, todo, new, days, key), "scoring")
    stored = isinstance(feedback, HistoryStore)
    history, profile = feedback, None
    if stored:
        profile = materialise(feedback.profile(with_keys(txns, key)), "profile")
        if not documented_frequency:
            counts = profile.select(*KEYS, F.col("history_count").alias("freq_30d"))
            txns = with_keys(txns, key).join(counts, KEYS, "left").drop(*KEYS)
            txns = txns.withColumn("freq_30d", F.coalesce("freq_30d", F.lit(0).cast("long")))
    else:
        if include_predictions:
            earlier = with_keys(accepted_as_feedback(store.decided()), key)
            touched = with_keys(txns, key).select(*KEYS).distinct()
            earlier = earlier.join(touched, KEYS, "left_semi").select(*feedback.columns)
            history = materialise(feedback.unionByName(earlier), "history")
        if not documented_frequency:
            txns = with_frequency(txns, history, key)
    decisions = categorise(txns, probabilities(txns), None if stored else history, key, profile)
    done = materialise(write_back(todo, decisions), "scored")

    decided = done.where("is_categorised").select(*S.SILVER.names)
    store.put(decided, "silver", run, ("transaction_date",))
    store.put(done.where("not is_categorised").select(*S.SILVER.names), "undecided", run)
    groups = materialise(monthly_summary(decided).select(*GOLD_KEYS), "groups")
    _refresh(store, run, groups)
    if store.searchable:
        store.put_texts(decided, run)
    store.finish(run)
    if stored and include_predictions:
        feedback.advance(accepted_as_feedback(decided))


def _stored_frequency(
    store: Store, run: int, txns: DataFrame, todo: DataFrame, new: DataFrame, days: list, key: str
) -> DataFrame:
    """``txns`` with the payments to the merchant in the 30 days before each:
    full hours from the stored totals of those days, the two hours at the edges
    from the payments of the day itself and of the one 30 days earlier."""
    one = {"freq_30d": F.lit(1).cast("long")}
    added = new.select("silver_id")
    counted = slot_totals(with_keys(txns.join(added, "silver_id", "left_semi"), key), KEYS, "timestamp", one)
    hour = F.timestamp_seconds(F.col("_slot") * 3600).cast("timestamp").cast("date")
    store.put(counted.withColumn("day", hour), "slots", run, ("day",))
    if not days:
        return with_keys(txns, key).drop(*KEYS).withColumn("freq_30d", F.lit(0).cast("long"))
    span = datetime.timedelta(days=30)
    around = sorted({d for day in days for d in (day, day - span)})
    silver = store.decided(around).unionByName(todo)
    known = with_keys(scoring_input(silver, store.bronze([*around, None], run), every=True), key)
    totals = store.slots(min(days) - span, max(days), run)
    return trailing_from_store(with_keys(txns, key), known, totals, KEYS, "timestamp", one).drop(*KEYS)


def correct(
    store: Store,
    corrections: DataFrame,
    history: HistoryStore | None = None,
    model: OnlineModel | None = None,
    threshold: int = S.REFIT_TRIGGER,
) -> DataFrame:
    """Take user corrections into the stored layers; returns the rejected ones.

    Silver shows them from then on, waiting rows that they name are decided, and
    gold is recomputed for the groups that they leave or enter. Corrections with
    a ``transaction_date`` only read silver of these days. ``history`` takes in
    what was accepted; ``model`` takes a step on it, if it is ``threshold`` rows.
    """
    run = store.begin()
    corrections = materialise(corrections, "corrections")
    days = None
    if "transaction_date" in corrections.columns:
        days = _values(corrections, F.col("transaction_date"))
    waiting = materialise(store.undecided(), "waiting")
    silver = store.decided(days).unionByName(waiting)
    accepted, rejected = split_corrections(silver, corrections)
    accepted = materialise(accepted, "accepted")
    rejected = materialise(rejected, "rejected")
    rows = feedback_rows(accepted).join(accepted.select("silver_id", "user_id", "transaction_date"), ["silver_id", "user_id"])
    store.put(rows.select(*S.FEEDBACK.names, "transaction_date"), "corrections", run, ("transaction_date",))

    named = accepted.select("silver_id", "user_id")
    decided = waiting.join(named, ["silver_id", "user_id"], "left_semi")
    decided = apply_corrections(decided, accepted)
    store.put(decided, "silver", run, ("transaction_date",))
    still = waiting.join(named, ["silver_id", "user_id"], "left_anti")
    store.put(still.select(*S.SILVER.names), "undecided", run)
    _refresh(store, run, materialise(affected_groups(accepted), "groups"))
    if store.searchable:
        names = ["user_id", "transaction_date", "merchant", "category", "amount"]
        recategorised = accepted.select(
            "user_id", "transaction_date", F.lit(None).cast("string").alias("merchant"),
            F.col("corrected_category").alias("category"), F.lit(None).cast(S.MONEY).alias("amount"),
        )
        store.put_texts(decided.select(*names).unionByName(recategorised), run)
    store.finish(run)
    if history is not None:
        history.advance(feedback_rows(accepted))
    if model is not None and accepted.limit(threshold).count() >= threshold:
        model.advance(correction_examples(feedback_rows(accepted)))
    return rejected


def _refresh(store: Store, run: int, groups: DataFrame) -> None:
    """Write the months of some gold groups anew: these groups from the stored
    silver of their months, the months' other groups as they are."""
    months = [m for m in _values(groups, F.col("month")) if m is not None]
    month = month_of(F.col("transaction_date"))
    days = [d for m in months for d in _days_of(m)]
    span = store.decided(days, run).where(month.isin(months) if months else F.lit(False))
    again = monthly_summary(span).join(groups, GOLD_KEYS, "left_semi")
    store.put_gold(groups, again, months, run)


def _days_of(month: datetime.date) -> list:
    return [month.replace(day=d) for d in range(1, calendar.monthrange(month.year, month.month)[1] + 1)]
