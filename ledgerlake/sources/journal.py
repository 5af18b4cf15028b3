"""Tables in a folder that advance together, run by run.

Every row is written under the number of its run, and a run's rows are seen by
nobody until one last mark says that it is finished. A run that breaks off thereby
changes nothing: its number is never used again, and the next run starts from what
the last finished one left. Readers always see all tables as of one run. Only one
writer at a time; readers need no lock.
"""

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.sinks import read_or_empty

MARKS = "run int, finished boolean"


def ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def within(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows of some partitions; the list prunes the read."""
    if values is None:
        return df
    some = [v for v in values if v is not None]
    chosen = F.col(column).isin(some) if some else F.lit(False)
    return df.where(chosen | F.col(column).isNull() if None in values else chosen)


@dataclass
class Journal:
    """``folder``: one that all executors can reach."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return posixpath.join(self.folder, name)

    def _marks(self) -> tuple[set[int], set[int]]:
        """Numbers of the runs that were begun, and of those that finished: one
        small row each."""
        rows = read_or_empty(self.spark, self.path("runs"), MARKS).collect()
        return {r.run for r in rows}, {r.run for r in rows if r.finished}

    def _mark(self, run: int, finished: bool) -> None:
        row = self.spark.createDataFrame([(run, finished)], MARKS).coalesce(1)
        row.write.mode("append").parquet(self.path("runs"))

    def runs(self) -> int:
        """Number of the last finished run; 0 before the first."""
        return max(self._marks()[1], default=0)

    def begin(self) -> int:
        """A number that no run has had."""
        run = max(self._marks()[0], default=0) + 1
        self._mark(run, False)
        return run

    def finish(self, run: int) -> None:
        """From now on the run's rows are seen."""
        self._mark(run, True)

    def put(self, df: DataFrame, name: str, run: int, by: tuple[str, ...] = ()) -> None:
        """Add rows to a table, under the number of their run. Rows of a folder
        are brought together first, in tasks of even size."""
        if by:
            df = df.hint("rebalance", *by)
        writer = df.withColumn("run", F.lit(run)).write.mode("append")
        writer.partitionBy(*by, "run").parquet(self.path(name))

    def _seen(self, run: int | None) -> Column:
        begun, finished = self._marks()
        last = max(finished, default=0)
        broken = [r for r in begun - finished if r < last]
        seen = F.col("run") <= last
        if broken:
            seen = seen & ~F.col("run").isin(broken)
        return seen if run is None else seen | (F.col("run") == run)

    def rows(self, name: str, schema: str, run: int | None = None) -> DataFrame:
        """Rows of the finished runs, and of ``run``, with their ``run``."""
        return read_or_empty(self.spark, self.path(name), f"{schema}, run int").where(self._seen(run))
