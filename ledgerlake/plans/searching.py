"""Which users' months hold a text: an index over stored payments.

Each month has its distinct texts (merchants, categories and amounts as typed, in
lower case) with the users who have them, and of each text its trigrams, dealt into
buckets. A search intersects the postings of its own trigrams, looks at the texts
that have them all, and reads payments of the users and months behind these. A batch
only meets what the index knows about its own months. Texts that are no longer
in use stay in the index; whatever it finds is looked at again in the payments.
"""

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.dates import month_of
from ledgerlake.operators.insights import amount_text
from ledgerlake.sources.journal import Journal, within
from ledgerlake.sources.shared import materialise

#: Letters in a gram; shorter searches look at the distinct texts themselves.
GRAM = 3
#: Folders that a month's grams are dealt into; a search reads those of its grams.
BUCKETS = 16
#: Stands for the month of payments without a date.
UNDATED = datetime.date(1000, 1, 1)

TEXTS = "text string, user_id string, month date"
GRAMS = "gram string, text string, month date, bucket int"


def block_month() -> Column:
    return F.coalesce(month_of(F.col("transaction_date")), F.lit(UNDATED))


def search_texts(rows: DataFrame) -> DataFrame:
    """The distinct texts that a search looks at, per user and month."""
    texts = F.array(F.lower("merchant"), F.lower("category"), amount_text(F.col("amount")))
    return (
        rows.select("user_id", block_month().alias("month"), F.explode(texts).alias("text"))
        .where("text is not null")
        .distinct()
    )


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams_of(texts: DataFrame) -> DataFrame:
    """Each month's texts by each gram that they hold."""
    last = F.length("text") - GRAM + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("text"), i, F.lit(GRAM)))
    return (
        texts.select("month", "text").distinct().where(last >= 1)
        .select("month", "text", F.explode(F.array_distinct(grams)).alias("gram"))
        .withColumn("bucket", _bucket(F.col("gram")))
    )


@dataclass
class SearchIndex(Journal):
    def put_texts(self, rows: DataFrame, run: int) -> None:
        """Take in payments (merchant, category, amount, user_id, transaction_date)."""
        texts = materialise(search_texts(rows), "texts")
        months = [r[0] for r in texts.select("month").distinct().collect()]
        known = within(self.rows("texts", TEXTS), "month", months).select("month", "text", "user_id")
        known = materialise(known, "known")
        same = [texts[c].eqNullSafe(known[c]) for c in ("user_id", "month", "text")]
        fresh = texts.join(known, same, "left_anti")
        self.put(fresh.select("text", "user_id", "month"), "texts", run, ("month",))
        unseen = texts.join(known, ["month", "text"], "left_anti")
        self.put(grams_of(unseen), "grams", run, ("month", "bucket"))

    def postings(self, wanted: str) -> DataFrame:
        """Of each month the texts that hold ``wanted``, which has a gram at least.

        Only buckets of its grams are read. A text comes once per gram, so the
        grouping moves at most that many rows and no gram's texts meet in one task.
        """
        grams = sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        chosen = F.col("bucket").isin([_bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(grams)
        having = self.rows("grams", GRAMS).where(chosen).groupBy("month", "text")
        all_of_them = having.agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams))
        return all_of_them.where(F.contains("text", F.lit(wanted))).select("month", "text")

    def blocks(self, text: str, users: list[str] | None = None) -> DataFrame:
        """(user_id, month) with a text that holds ``text``, in any case.
        ``users``: only of these; their own texts are looked at without grams."""
        wanted = text.lower()
        texts = within(self.rows("texts", TEXTS), "user_id", users)
        if users is None and len(wanted) >= GRAM:
            texts = texts.join(self.postings(wanted), ["month", "text"], "left_semi")
        else:
            texts = texts.where(F.contains("text", F.lit(wanted)))
        return texts.select("user_id", "month").distinct()
