"""Gold in a journal: a month is written whole by the run that touches it, and
``months`` says which run that was."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.operators.gold import GOLD_KEYS
from ledgerlake.sources.journal import Journal, ddl, within
from ledgerlake.sources.shared import materialise


class MonthlyGold(Journal):
    def gold(self, months: list | None = None) -> DataFrame:
        """Each month as the last run that touched it left it."""
        versions = within(self.rows("months", "month date"), "month", months)
        newest = versions.groupBy("month").agg(F.max("run").alias("run"))
        rows = within(self.rows("gold", ddl(S.GOLD)), "month", months)
        # one row per calendar month
        return rows.join(F.broadcast(newest), ["month", "run"], "left_semi").select(*S.GOLD.names)

    def put_gold(self, groups: DataFrame, rows: DataFrame, months: list, run: int) -> None:
        """Replace some groups of these months by ``rows``; a group without a row
        goes, the months' other groups stay."""
        kept = self.gold(months).join(groups.select(*GOLD_KEYS), GOLD_KEYS, "left_anti")
        self.put(kept.unionByName(rows.select(*S.GOLD.names)), "gold", run, ("month",))
        touched = self.spark.createDataFrame([(m,) for m in months], "month date")
        self.put(touched.coalesce(1), "months", run)


class StreamedGold(MonthlyGold):
    """Gold that takes in the changed totals of a stream, each batch once."""

    def upsert(self, totals: DataFrame, batch: int) -> None:
        """``totals``: new totals of some groups. A batch that was taken in
        before is left out, so it may come again after a failure."""
        if not self.rows("batches", "batch long").where(F.col("batch") == batch).isEmpty():
            return
        run = self.begin()
        totals = materialise(totals, "totals")
        months = [r[0] for r in totals.select("month").distinct().collect()]
        self.put_gold(totals, totals, months, run)
        self.put(self.spark.createDataFrame([(batch,)], "batch long").coalesce(1), "batches", run)
        self.finish(run)
