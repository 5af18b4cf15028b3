"""Counts and sums over a trailing time span per key, safe for hot keys.

A plain sliding range frame sorts each key in one task and walks the frame
again for every row. Here time is cut into slots: full slots inside the span
come from per-slot totals, and only the two slots at the edges of the span
are compared row by row. A key is thereby spread over its slots, and the work
per row does not depend on how many rows the span holds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.sources.shared import materialise

MICROS_PER_HOUR = 3_600_000_000
SPAN_30_DAYS = 30 * 24 * MICROS_PER_HOUR


def micros(timestamp: Column) -> Column:
    """Wall-clock microseconds of a timestamp without zone, whatever the
    session's time zone."""
    seconds = (
        F.unix_date(F.to_date(timestamp)) * F.lit(86_400).cast("long")
        + F.hour(timestamp) * 3600
        + F.minute(timestamp) * 60
    )
    fraction = F.extract(F.lit("SECOND"), timestamp) * 1_000_000
    return seconds * F.lit(1_000_000).cast("long") + fraction.cast("long")


def _timed(df: DataFrame, timestamp: str, measures: dict[str, Column], slot: int) -> DataFrame:
    timed = df.select("*", micros(F.col(timestamp)).alias("_t"),
                      *[c.alias(f"_m_{n}") for n, c in measures.items()])
    return timed.withColumn("_slot", F.floor(F.col("_t") / slot).cast("long"))


def _totals(timed: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return timed.groupBy(*keys, "_slot").agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])


def slot_totals(
    df: DataFrame,
    keys: list[str],
    timestamp: str,
    measures: dict[str, Column],
    slot: int = MICROS_PER_HOUR,
) -> DataFrame:
    """Each measure summed per key and slot (``_slot``, ``_s_<name>``): what a
    store of trailing totals holds. Totals of several batches add up."""
    return _totals(_timed(df, timestamp, measures, slot), keys, list(measures))


def _inner(per_slot: DataFrame, keys: list[str], names: list[str], slots: int) -> DataFrame:
    """Totals of the full slots strictly between the two edge slots. A key has
    at most one row per slot here, whatever its number of transactions."""
    between = Window.partitionBy(*keys).orderBy("_slot").rangeBetween(-(slots - 1), -1)
    return per_slot.select(
        *keys, "_slot", *[F.sum(f"_s_{n}").over(between).alias(f"_i_{n}") for n in names]
    )


def _place(slot: Column, t: Column, own: int) -> Column:
    return F.struct(slot.alias("_slot"), t.alias("_t"), F.lit(own).alias("_own"))


def _edge_sums(edges: DataFrame, inner: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``edges``: rows with a payload ``_row`` are returned; rows with ``_own``
    1 count while earlier, rows with ``_own`` 0, which are shifted by the span,
    from their time on."""
    earlier = (
        Window.partitionBy(*keys, "_slot").orderBy("_t")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    for n in names:
        is_own = F.col("_own") == 1
        edges = edges.withColumn(
            f"_a_{n}", F.sum(F.when(is_own, F.col(f"_m_{n}"))).over(earlier)
        )
    total = Window.partitionBy(*keys, "_slot")
    for n in names:
        old = F.when(F.col("_own") == 0, F.col(f"_m_{n}"))
        before = F.coalesce(F.sum(old).over(earlier), F.lit(0))
        # Total minus earlier, not a shrinking frame: that one is quadratic.
        remaining = F.coalesce(F.sum(old).over(total), F.lit(0)) - before
        edges = edges.withColumn(f"_b_{n}", remaining)
    joined = edges.where("_row IS NOT NULL").join(inner, [*keys, "_slot"], "left")
    return joined.select(
        "_row.*",
        *[
            (
                F.coalesce(f"_a_{n}", F.lit(0))
                + F.coalesce(f"_b_{n}", F.lit(0))
                + F.coalesce(f"_i_{n}", F.lit(0))
            ).alias(n)
            for n in names
        ],
    )


def _slots(span: int, slot: int) -> int:
    if span % slot:
        raise ValueError("the span must be a whole number of slots")
    return span // slot


def trailing_sums(
    df: DataFrame,
    keys: list[str],
    timestamp: str,
    measures: dict[str, Column],
    span: int = SPAN_30_DAYS,
    slot: int = MICROS_PER_HOUR,
) -> DataFrame:
    """Add, per row, each measure summed over earlier rows of the key whose
    timestamp is less than ``span`` older, or exactly ``span`` older.

    Rows with the same timestamp do not count for each other. ``measures``
    maps output names to numeric columns; no rows in the span gives null.
    """
    slots = _slots(span, slot)
    names = list(measures)
    # Both branches below start from here: what the rows are made of is made once.
    timed = materialise(_timed(df, timestamp, measures, slot), "timed")
    inner = _inner(_totals(timed, keys, names), keys, names, slots)

    # Every row also serves, shifted by one span, as context for the slot in
    # which the span that starts at it ends. Context carries no payload.
    places = F.array(
        _place(F.col("_slot"), F.col("_t"), 1), _place(F.col("_slot") + slots, F.col("_t") + span, 0)
    )
    payload = F.struct(*[F.col(c) for c in df.columns])
    measured = [F.col(f"_m_{n}") for n in names]
    edges = (
        timed.select(*keys, payload.alias("_row"), *measured, F.explode(places).alias("_place"))
        .select(*keys, "_place.*", *measured,
                F.when(F.col("_place._own") == 1, F.col("_row")).alias("_row"))
    )
    return _edge_sums(edges, inner, keys, names)


def trailing_from_store(
    df: DataFrame,
    context: DataFrame,
    totals: DataFrame,
    keys: list[str],
    timestamp: str,
    measures: dict[str, Column],
    span: int = SPAN_30_DAYS,
    slot: int = MICROS_PER_HOUR,
) -> DataFrame:
    """As ``trailing_sums`` for the rows of ``df`` alone, out of a store.

    ``totals``: ``slot_totals`` of all rows, from one span before the oldest
    row of ``df`` on; ``context``: all rows (those of ``df`` as well) that lie
    in the slots of ``df``'s rows, or one span before; more of either does no
    harm. Of both only the keys of ``df`` are looked at.
    """
    slots = _slots(span, slot)
    names = list(measures)
    wanted = materialise(_timed(df, timestamp, {}, slot), "timed")
    touched = wanted.select(*keys).distinct()
    per_slot = totals.join(touched, keys, "left_semi").groupBy(*keys, "_slot").agg(
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names]
    )
    # A slot of ``df`` has a total of its own, since ``df`` is part of the store.
    inner = _inner(per_slot, keys, names, slots)
    around = _timed(context, timestamp, measures, slot).join(touched, keys, "left_semi")
    places = F.array(
        _place(F.col("_slot"), F.col("_t"), 1), _place(F.col("_slot") + slots, F.col("_t") + span, 0)
    )
    measured = [F.col(f"_m_{n}") for n in names]
    counting = around.select(*keys, *measured, F.explode(places).alias("_place")).select(
        *keys, "_place.*", *measured
    )
    here = wanted.select(
        *keys, "_slot", "_t", F.lit(2).alias("_own"),
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
    )
    edges = here.unionByName(
        counting.join(wanted.select(*keys, "_slot").distinct(), [*keys, "_slot"], "left_semi"),
        allowMissingColumns=True,
    )
    return _edge_sums(edges, inner, keys, names)
