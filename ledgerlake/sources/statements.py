"""Bank statements: delimited files and spreadsheets with discovered columns."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import STATEMENT_DATE_FORMATS, clean_amount, parse_date, strip
from ledgerlake.sources import spreadsheets


def read_statements(spark: SparkSession, path: str) -> list[DataFrame]:
    """Delimited statement files under ``path`` as text columns, one table per
    layout; spreadsheets are left out.

    Files are grouped by their header line, so each is read by its own names
    whatever the order of its columns. Folders such as ``user_id=7`` say whose
    files they hold. What reaches the driver is one row per file.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"),
    )
    lines = lines.where(~F.lower("file").rlike(r"\.xls[xm]$"))
    headers = lines.groupBy("file").agg(F.min_by("value", F.struct("at", "i")).alias("header"))
    layouts: dict[str, list[str]] = {}
    for row in headers.collect():
        layouts.setdefault(row["header"], []).append(row["file"])
    reader = spark.read.option("header", True).option("basePath", path)
    return [reader.csv(sorted(files)) for _, files in sorted(layouts.items())]


def discover_columns(names: list[str]) -> dict[str, str | None]:
    """Map the roles date, narration and withdrawal to the first fitting column."""
    wanted = {
        "date": ["date"],
        "narration": ["narration", "description"],
        "withdrawal": ["withdrawal", "debit"],
    }
    found = {
        role: next((n for n in names if any(w in n.strip().lower() for w in words)), None)
        for role, words in wanted.items()
    }
    if not found["date"] or not found["withdrawal"]:
        raise ValueError(f"no date or withdrawal column among {names}")
    return found


def normalise_statement(
    df: DataFrame,
    user: str = "user_id",
    formats: list[str] = STATEMENT_DATE_FORMATS,
) -> DataFrame:
    """Debits of a statement as raw transactions.

    Rows without a positive amount or a readable date are left out
    (``statement_rejects`` has them). ``user`` names the column that says whose
    statement a row came from; any other column that is not part of the
    statement is passed through.
    """
    return _read(df, user, formats).where("reason is null").drop("reason")


def statement_rejects(
    df: DataFrame, user: str = "user_id", formats: list[str] = STATEMENT_DATE_FORMATS
) -> DataFrame:
    """The rows that ``normalise_statement`` leaves out, with a ``reason``:
    no_amount (blank, unreadable or not positive) or no_date."""
    return _read(df, user, formats).where("reason is not null")


def normalise_files(spark: SparkSession, path: str, user: str = "user_id") -> DataFrame:
    """Debits of all statement files under ``path``, of whatever layouts:
    delimited files and spreadsheets."""
    tables = [normalise_statement(df, user) for df in read_statements(spark, path)]
    sheets = spreadsheets.read_files(spark, path)
    if not tables or sheets.select("path").limit(1).count():
        tables.append(normalise_spreadsheets(sheets, user))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def normalise_spreadsheets(
    files: DataFrame, user: str = "user_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Debits of spreadsheet files (``path``, ``content``), of whatever layouts;
    columns named in ``keep`` that end in ``_id`` are passed through."""
    lines, _ = spreadsheets.read_spreadsheets(files, user, keep)
    return normalise_statement(lines.drop("file", "line"), user)


def _read(df: DataFrame, user: str, formats: list[str]) -> DataFrame:
    kept = [c for c in df.columns if c == user or c.endswith("_id")]
    found = discover_columns([c for c in df.columns if c not in kept])
    narration = (
        F.coalesce(strip(df[f"`{found['narration']}`"]), F.lit(""))
        if found["narration"]
        else F.lit("")
    )
    return (
        df.select(
            *[F.col(c).cast("string") if c == user else F.col(c) for c in kept],
            clean_amount(df[f"`{found['withdrawal']}`"].cast("string")).alias("amount"),
            narration.alias("raw_text"),
            parse_date(df[f"`{found['date']}`"].cast("string"), formats).alias("timestamp"),
        )
        .withColumn("receiver", F.coalesce(F.nullif("raw_text", F.lit("")), F.lit("UNKNOWN")))
        .withColumn("transaction_type", F.lit("debit"))
        .withColumn("source", F.lit("file"))
        .withColumn(
            "reason",
            F.when(F.coalesce(F.col("amount") > 0, F.lit(False)), F.when(F.col("timestamp").isNull(), "no_date"))
            .otherwise("no_amount"),
        )
    )
