"""What users' corrections say about a merchant, kept up to date batch by batch.

A key's state is its history profile in a form that composes: with ``k`` entries
newer than all that came before, each weight is that of the new entries plus
``decay ** k`` times the old one, and counts, sums and the newest entry add up. So
entries in order only need the state of their keys. Where an entry is late, or a
transaction is corrected again, its keys (and only these) are made anew from their
entries.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.text import norm_key
from ledgerlake.operators.history import KEYS, _variation, weighted_categories, with_keys
from ledgerlake.sources.journal import Journal, ddl, within
from ledgerlake.sources.shared import materialise
from ledgerlake.sources.sinks import latest_by_key

STATE = (
    "user_key string, merchant_key string, weights array<double>, weight_total double, "
    "override string, newest struct<at:timestamp_ntz,silver_id:bigint>, history_count bigint, "
    "amount_count bigint, amount_sum decimal(38,2), amount_squares decimal(38,4)"
)

#: Folders that users are dealt into; a batch reads those of its users.
BUCKETS = 64


def key_states(feedback: DataFrame, key: str = "merchant", decay: float = S.HISTORY_DECAY) -> DataFrame:
    """The state of each key of some entries."""
    per_label = [
        F.coalesce(F.sum(F.when(F.col("category") == label, F.col("weight"))), F.lit(0.0))
        for label in S.LABELS
    ]
    weights = weighted_categories(feedback, key, decay).groupBy(*KEYS).agg(
        F.array(*per_label).alias("weights"), F.sum("weight").alias("weight_total")
    )
    newest = F.struct(F.col("corrected_at").alias("at"), "silver_id")
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    rest = with_keys(feedback, key).groupBy(*KEYS).agg(
        F.max_by("corrected_category", newest).alias("override"),
        F.max(newest).alias("newest"),
        F.count("*").alias("history_count"),
        F.count(amount).alias("amount_count"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").alias("amount_sum"),
        F.coalesce(F.sum(amount * amount), F.lit(0)).cast("decimal(38,4)").alias("amount_squares"),
    )
    return weights.join(rest, KEYS)


def composed(newer: DataFrame, older: DataFrame, decay: float = S.HISTORY_DECAY) -> DataFrame:
    """States of ``newer``'s keys, on top of those that ``older`` has; all
    entries behind ``newer`` are newer than those behind ``older``."""
    before = older.select(*KEYS, F.struct(*[c for c in older.columns if c not in KEYS]).alias("_old"))
    joined = newer.join(before, KEYS, "left")
    faded = F.pow(F.lit(decay), F.col("history_count"))

    def old(name: str) -> Column:
        return F.coalesce(F.col("_old")[name], F.lit(0))

    none = F.array_repeat(F.lit(0.0), len(S.LABELS))
    weights = F.zip_with("weights", F.coalesce(F.col("_old.weights"), none), lambda n, o: n + faded * o)
    return joined.select(
        *KEYS,
        weights.alias("weights"),
        (F.col("weight_total") + faded * old("weight_total")).alias("weight_total"),
        "override",
        "newest",
        (F.col("history_count") + old("history_count")).alias("history_count"),
        (F.col("amount_count") + old("amount_count")).alias("amount_count"),
        (F.col("amount_sum") + old("amount_sum")).cast("decimal(38,2)").alias("amount_sum"),
        (F.col("amount_squares") + old("amount_squares")).cast("decimal(38,4)").alias("amount_squares"),
    )


def as_profile(states: DataFrame) -> DataFrame:
    """States as ``history.history_profile`` gives them."""
    n = F.col("amount_count").cast("double")
    mean = F.when(n > 0, F.col("amount_sum").cast("double") / n)
    # What doubles round off the exact sums is far below any threshold.
    spread = F.when(n > 0, F.col("amount_squares").cast("double") / n) - F.col("amount_mean") * F.col("amount_mean")
    return (
        states.withColumn("amount_mean", mean)
        .withColumn("amount_std", F.sqrt(F.greatest(spread, F.lit(0.0))))
        .withColumn("amount_cv", _variation())
        .select(
            *KEYS, "weights", "weight_total", "override", "history_count",
            "amount_count", "amount_mean", "amount_std", "amount_cv",
        )
    )


@dataclass
class HistoryStore(Journal):
    """Stored entries and states. ``key``: the feedback's column that names the
    merchant."""

    key: str = "merchant"

    def entries(self, buckets: list | None = None, run: int | None = None) -> DataFrame:
        """The entries that count: of a transaction corrected again the newest."""
        rows = within(self.rows("entries", ddl(S.FEEDBACK) + ", bucket int", run), "bucket", buckets)
        newest = [F.col("corrected_at"), F.col("run")]
        return latest_by_key(rows, ["user_id", "silver_id"], newest).select(*S.FEEDBACK.names)

    def states(self, buckets: list | None = None) -> DataFrame:
        rows = within(self.rows("states", STATE + ", bucket int"), "bucket", buckets)
        return latest_by_key(rows, KEYS, [F.col("run")]).where("history_count > 0").drop("run", "bucket")

    def profile(self, keys: DataFrame | None = None) -> DataFrame:
        """The history profile; of some ``keys``, only their buckets are read."""
        if keys is None:
            return as_profile(self.states())
        keys = materialise(keys.select(*KEYS).distinct(), "keys")
        buckets = [r[0] for r in keys.select(_bucket(F.col("user_key"))).distinct().collect()]
        return as_profile(self.states(buckets).join(keys, KEYS, "left_semi"))

    def advance(self, updates: DataFrame) -> None:
        """Take in corrections: new ones, late ones, and ones that replace an
        earlier correction of the same transaction (the newest counts; of equal
        times the one that comes later). Those without a user or a transaction
        are left out.

        Reads the states and entries of the users' buckets: the ids and times of
        their entries, and whole entries only of keys that are made anew.
        """
        run = self.begin()
        known = updates.where("user_id IS NOT NULL AND silver_id IS NOT NULL")
        new = latest_by_key(known.select(*S.FEEDBACK.names), ["user_id", "silver_id"], [F.col("corrected_at")])
        new = materialise(new.withColumn("bucket", _bucket(norm_key(F.col("user_id")))), "updates")
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]

        ids = ["user_id", "silver_id"]
        same = self.entries(buckets).join(new.select(*ids, F.col("corrected_at").alias("_at")), ids)
        outdated = F.coalesce(F.col("corrected_at") > F.col("_at"), F.lit(False))
        same = materialise(same.withColumn("_outdated", outdated), "corrected-again")
        new = materialise(new.join(same.where("_outdated").select(*ids), ids, "left_anti"), "entries")
        self.put(new, "entries", run, ("bucket",))

        replaced = with_keys(same.where("NOT _outdated"), self.key).select(*KEYS)
        states = self.states(buckets)
        first = with_keys(new, self.key).groupBy(*KEYS).agg(
            F.min(F.struct(F.col("corrected_at").alias("at"), "silver_id")).alias("_first")
        )
        late = first.join(states, KEYS).where(F.coalesce(F.col("_first") <= F.col("newest"), F.lit(True)))
        again = materialise(replaced.unionByName(late.select(*KEYS)).distinct(), "keys-anew")

        def of(rows: DataFrame, how: str) -> DataFrame:
            return with_keys(rows, self.key).join(again, KEYS, how).select(*S.FEEDBACK.names)

        anew = materialise(key_states(of(self.entries(buckets, run), "left_semi"), self.key), "states")
        in_order = composed(key_states(of(new, "left_anti"), self.key), states)
        # a key that has lost all its entries
        gone = again.join(anew, KEYS, "left_anti").withColumn("history_count", F.lit(0).cast("long"))
        changed = anew.unionByName(in_order).unionByName(gone, allowMissingColumns=True)
        self.put(changed.withColumn("bucket", _bucket(F.col("user_key"))), "states", run, ("bucket",))
        self.finish(run)


def _bucket(user_key: Column) -> Column:
    return F.pmod(F.xxhash64(user_key), F.lit(BUCKETS)).cast("int").alias("bucket")
