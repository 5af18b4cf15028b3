"""Dashboard figures and the transaction explorer."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.schema import PAGE_SIZE

SORT_COLUMNS = ["merchant", "category", "transaction_date", "amount"]


def latest_month(gold: DataFrame) -> DataFrame:
    """Gold rows of each user's newest month."""
    newest = gold.groupBy("user_id").agg(F.max("month").alias("month"))
    return gold.join(newest, ["user_id", "month"])


def month_kpis(gold: DataFrame) -> DataFrame:
    """Total, count, categories and average of each user's newest month.

    One aggregate per user and month, then the newest by ``max_by``: gold has
    at most 13 rows per user and month.
    """
    monthly = gold.groupBy("user_id", "month").agg(
        F.sum("total_amount").alias("total_spend"),
        F.sum("txn_count").alias("txn_count"),
        F.count("*").alias("category_count"),
    )
    newest = monthly.groupBy("user_id").agg(
        F.max(F.struct("month", "total_spend", "txn_count", "category_count")).alias("k")
    )
    return newest.select("user_id", "k.*").withColumn(
        "average_per_txn",
        F.when(F.col("txn_count") > 0, F.col("total_spend") / F.col("txn_count")),
    )


def top_category(gold: DataFrame) -> DataFrame:
    """Category with the highest total of the newest month; names break ties.

    A user has at most 13 gold rows a month, and the rank limit runs before
    the shuffle as well.
    """
    order = Window.partitionBy("user_id").orderBy(
        F.desc("month"), F.desc("total_amount"), F.asc("category")
    )
    return (
        gold.withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .select("user_id", "month", "category", "total_amount")
    )


def category_share(gold: DataFrame) -> DataFrame:
    """Share of each category in its user's month; zero if nothing was spent."""
    month = Window.partitionBy("user_id", "month")
    total = F.sum("total_amount").over(month)
    return gold.withColumn(
        "share",
        F.when(total > 0, F.col("total_amount").cast("double") / total.cast("double"))
        .otherwise(0.0),
    )


def breakdown(gold: DataFrame) -> DataFrame:
    """Categories of each user's newest month, largest first, with their rank."""
    largest = Window.partitionBy("user_id", "month").orderBy(
        F.desc("total_amount"), F.asc("category")
    )
    return (
        category_share(latest_month(gold))
        .withColumn("rank", F.row_number().over(largest))
        .orderBy("user_id", "rank")
    )


def months_newest_first(gold: DataFrame) -> DataFrame:
    return gold.select("user_id", "month").distinct().orderBy("user_id", F.desc("month"))


def category_facets(silver: DataFrame) -> DataFrame:
    """Categories in use per user, sorted."""
    return (
        silver.where("category is not null and category <> ''")
        .select("user_id", "category")
        .distinct()
        .orderBy("user_id", "category")
    )


def amount_text(amount: Column) -> Column:
    """Amount as typed in a search box: no trailing zeros."""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")


def search(silver: DataFrame, text: str | None = None, category: str = "All") -> DataFrame:
    """Rows of a category whose merchant, category or amount contains ``text``.

    The text is matched literally and without regard to case.
    """
    found = silver
    if category != "All":
        found = found.where(F.col("category") == category)
    if text and text.strip():
        wanted = F.lit(text.lower())
        found = found.where(
            F.coalesce(F.contains(F.lower("merchant"), wanted), F.lit(False))
            | F.coalesce(F.contains(F.lower("category"), wanted), F.lit(False))
            | F.coalesce(F.contains(amount_text(F.col("amount")), wanted), F.lit(False))
        )
    return found


def _order(sort: str, descending: bool) -> list[Column]:
    if sort not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {sort}")
    key = F.col(sort)
    return [
        key.desc_nulls_last() if descending else key.asc_nulls_last(),
        F.col("silver_id").asc(),
    ]


def sorted_transactions(
    rows: DataFrame, sort: str = "transaction_date", descending: bool = True
) -> DataFrame:
    return rows.orderBy(*_order(sort, descending))


def page(
    rows: DataFrame,
    number: int = 1,
    sort: str = "transaction_date",
    descending: bool = True,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """Page ``number`` of each user's rows, with its position and page count.

    The rank limit is pushed below the shuffle: a task keeps at most
    ``number * size`` rows per user, however many the user has. Deep pages
    are better read with ``deep_page`` or ``page_after``.
    """
    ranked = Window.partitionBy("user_id").orderBy(*_order(sort, descending))
    wanted = (
        rows.withColumn("position", F.row_number().over(ranked))
        .where((F.col("position") <= number * size))
        .where(F.col("position") > (number - 1) * size)
    )
    pages = rows.groupBy("user_id").agg(
        F.ceil(F.count("*") / size).cast("long").alias("total_pages")
    )
    return wanted.join(pages, "user_id")


def _range_of(sort: str) -> Column:
    """Ranges in which rows are counted, in the order of their values."""
    return F.floor("amount") if sort == "amount" else F.col(sort)


def range_counts(rows: DataFrame, sort: str = "transaction_date") -> DataFrame:
    """Rows per user and range of the sort column: one for each day, whole
    amount, merchant or category. Small beside the rows, and sums over batches."""
    return rows.groupBy("user_id", _range_of(sort).alias("range")).agg(F.count("*").alias("n"))


def deep_page(
    rows: DataFrame,
    number: int,
    sort: str = "transaction_date",
    descending: bool = True,
    size: int = PAGE_SIZE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The same rows as ``page``, at any depth for the cost of the ranges that
    the page lies in.

    The counts of a user's ranges say in which of them the page begins and ends.
    Only rows of these are brought together and sorted; of rows stored by day only
    these days are read. ``counts``: stored ``range_counts`` of the same rows.
    """
    _order(sort, descending)
    counts = range_counts(rows, sort) if counts is None else counts
    key = F.col("range").desc_nulls_last() if descending else F.col("range").asc_nulls_last()
    user = Window.partitionBy("user_id")
    first, last = (number - 1) * size, number * size
    ranges = (
        counts.withColumn("until", F.sum("n").over(user.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total_pages", F.ceil(F.sum("n").over(user) / size).cast("long"))
        .withColumn("before", F.col("until") - F.col("n"))
        .where((F.col("before") < last) & (F.col("until") > first))
    )
    offset = F.min("before").over(user)
    wanted = ranges.select(F.col("user_id").alias("_user"), "range", offset.alias("_before"), "total_pages")
    same = (F.col("user_id") == F.col("_user")) & _range_of(sort).eqNullSafe(F.col("range"))
    near = rows.join(wanted, same).drop("_user", "range")
    ranked = user.orderBy(*_order(sort, descending))
    place = F.col("_before") + F.row_number().over(ranked)
    return (
        near.withColumn("position", place.cast("int")).drop("_before")
        .where((F.col("position") > first) & (F.col("position") <= last))
    )


def page_after(
    rows: DataFrame,
    user_id: str,
    last_date,
    last_id: int,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The page that follows a known row of one user, newest first.

    Costs the same at any depth: a filter and a bounded top-N.
    """
    follows = (F.col("transaction_date") < F.lit(last_date)) | (
        (F.col("transaction_date") == F.lit(last_date)) & (F.col("silver_id") > last_id)
    )
    return (
        rows.where((F.col("user_id") == user_id) & follows)
        .orderBy(*_order("transaction_date", True))
        .limit(size)
    )


def totals(rows: DataFrame) -> DataFrame:
    """Sum and count per user of filtered rows."""
    return rows.groupBy("user_id").agg(
        F.sum("amount").alias("total_amount"), F.count("*").alias("txn_count")
    )
