"""Numeric features of a transaction."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_FEATURES = ["log_amount", "hour_sin", "hour_cos", "weekday", "log_frequency"]


def metadata_features(amount: Column, timestamp: Column, frequency: Column) -> list[Column]:
    """Amount, cyclic hour, weekday (Monday 0) and frequency, all near unit scale."""
    angle = F.lit(2 * math.pi) * F.hour(timestamp) / 24
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    columns = [
        F.log1p(F.greatest(value, F.lit(0.0))),
        F.sin(angle),
        F.cos(angle),
        F.weekday(timestamp) / F.lit(6.0),
        F.log1p(F.coalesce(frequency, F.lit(0)).cast("double")) / F.lit(math.log1p(30)),
    ]
    return [c.alias(n) for c, n in zip(columns, METADATA_FEATURES)]
