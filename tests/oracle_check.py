"""Run a query and its SQL twin on the same tables and compare the rows."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return 0.0 if number == 0 or math.isnan(number) else number
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def _kind(spark_type):
    name = spark_type.split("(")[0]
    return {
        "smallint": "int", "int": "int", "bigint": "int", "double": "float",
        "timestamp_ntz": "timestamp", "string": "text", "date": "date", "boolean": "bool",
    }.get(name, name)


def _duck_kind(duck_type):
    name = str(duck_type).split("(")[0]
    return {
        "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float",
        "TIMESTAMP": "timestamp", "VARCHAR": "text", "DATE": "date", "BOOLEAN": "bool",
    }.get(name, name)


def differences(frame, connection, sql):
    """Empty if both results agree; else a short account."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _duck_kind(d[1]) for d in result.description}
    theirs = result.fetchall()
    ours = [tuple(r) for r in frame.collect()]
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} / {sorted(names)}"]
    found = []
    for field, kind in frame.dtypes:
        if _kind(kind) != kinds[field]:
            found.append(f"type of {field}: {kind} / {kinds[field]}")
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    left, right = _rows(frame.columns, ours), _rows(names, theirs)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        found.append(f"values {only_left} / {only_right}")
    return found
