"""Calendar-month windows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def next_month(month: Column) -> Column:
    """First day after a month that starts at ``month``."""
    return F.add_months(month, 1)
