"""Building blocks of column expressions.

Constants are parsed in one piece: built call by call, a long constant costs
thousands of round trips to the JVM each time a plan is put together.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str | None) -> str:
    """A string as a SQL literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(sql_text(v) for v in values)})")


def struct_array(rows: list[dict[str, str | None]]) -> Column:
    """Array of structs of strings."""
    parts = [
        "named_struct(" + ", ".join(f"'{k}', {sql_text(v)}" for k, v in row.items()) + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(parts)})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used.

    Plain nesting copies the value into every use, and the copies multiply
    from step to step, above all where a filter is pushed into a projection.
    """
    return F.transform(F.array(value), body)[0]
