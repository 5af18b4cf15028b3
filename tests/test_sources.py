import base64
import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.sources import alerts, sinks, statements



def now():
    return F.lit("2024-05-20 09:00:00").cast("timestamp_ntz")



def parse(spark, bodies):
    rows = [(f"m{i}", "u", "a@hdfc.in", dt.datetime(2024, 5, 1, 8), b)
            for i, b in enumerate(bodies)]
    df = spark.createDataFrame(
        rows, "message_id string, user_id string, sender string, sent_at timestamp_ntz, "
        "body string")
    return {r.message_id: r for r in alerts.parse_alerts(df, now()).collect()}


def test_alert_wordings(spark):
    got = parse(spark, [
        "Rs. 1,250.75 debited from a/c to Lotus Tea on 01-05-24",
        "You have spent INR 99 at shop",
        "Rs 10 credited",
        "Rs , debited",
        "paid Rs 0 to X on today",
        "Rs 12.5\r\nwas\rdebited to  A B  on x",
        "amount Rs 20 only\nspent",
        "₹5 paid",
        "Rs.\u00a07 spent to\u00a0Tea\u00a0on Monday",
    ])
    assert sorted(got) == ["m0", "m1", "m7", "m8"]
    assert (float(got["m8"].amount), got["m8"].receiver) == (7.0, "Tea")
    assert (float(got["m0"].amount), got["m0"].receiver) == (1250.75, "Lotus Tea")
    assert (float(got["m1"].amount), got["m1"].receiver) == (99.0, "UNKNOWN")
    assert float(got["m7"].amount) == 5.0 and got["m0"].source == "gmail"


def test_a_carriage_return_does_not_end_the_amount_search(spark):
    got = parse(spark, ["Rs 12.5 \r was debited"])
    assert float(got["m0"].amount) == 12.5


def coded(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def part(path, kind, text=None):
    return {"path": path, "mimeType": kind, "data": text and coded(text)}


def payload(parts=None, data=None, headers=()):
    named = [{"name": n, "value": v} for n, v in headers]
    return {"headers": named, "mimeType": "x", "body": {"data": data}, "parts": parts}


NESTED = [part(".".join("0" * n), "m") for n in range(1, 5)]


@pytest.mark.parametrize("message, expected", [
    (payload(data=coded("bare")), "bare"),
    (payload([part("0", "image/png", "img"), part("1", "text/html", "first"),
              part("2", "text/plain", "second")]), "first"),
    (payload([part("0", "m"), part("0.0", "text/plain", "deep"),
              part("1", "text/plain", "flat")]), "deep"),
    (payload([*NESTED, part("0.0.0.0.0", "text/plain", "level five")]), "level five"),
    (payload([part("0", "image/png", "img")], coded("ignored")), None),
    (payload(data="_-8="), ""),
    (payload(data="not base64!"), None),
    (payload(), None),
])
def test_message_body(spark, message, expected):
    schema = S.T.StructType([S.T.StructField("payload", S.PAYLOAD)])
    df = spark.createDataFrame([{"payload": message}], schema)
    assert df.select(alerts.decode_body(F.col("payload")).alias("b")).first().b == expected


@pytest.mark.parametrize("written, utc", [
    ("Tue, 2 Jan 2024 10:11:12 +0530", dt.datetime(2024, 1, 2, 4, 41, 12)),
    ("2 Jan 2024 22:00:00 -0330 (NST)", dt.datetime(2024, 1, 3, 1, 30)),
    ("Wed, 03 Jan 2024 07:08 GMT", dt.datetime(2024, 1, 3, 7, 8)),
    ("yesterday", None),
    (None, None),
])
def test_message_date(spark, written, utc):
    rows = spark.createDataFrame([(written,)], "d string")
    assert rows.select(alerts.message_date(F.col("d")).alias("t")).first().t == utc


def test_message_to_raw_row(spark):
    headers = [("from", "a@hdfc.in"), ("SUBJECT", "Money debited"),
               ("Date", "Tue, 2 Jan 2024 10:11:12 +0000")]
    message = payload([part("0", "text/plain", "Rs 12 paid to Tea on Monday")], headers=headers)
    schema = S.T.StructType([
        S.T.StructField("message_id", S.T.StringType()),
        S.T.StructField("user_id", S.T.StringType()),
        S.T.StructField("payload", S.PAYLOAD),
    ])
    read = alerts.read_messages(spark.createDataFrame([("m1", "u", message)], schema))
    marks = spark.createDataFrame([], "user_id string, source string, last_fetched timestamp_ntz")
    month = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    fresh = alerts.select_new_messages(read, marks, month)  # the word stands in the subject
    row = alerts.parse_alerts(fresh, now()).first()
    assert (float(row.amount), row.receiver, row.timestamp) == (
        12.0, "Tea", dt.datetime(2024, 1, 2, 10, 11, 12))


def test_new_messages_start_at_the_mark_or_the_month(spark):
    rows = [
        ("a", "u1", "x@sbi.in", dt.datetime(2024, 5, 9, 23), "debited"),
        ("b", "u1", "x@sbi.in", dt.datetime(2024, 5, 10, 1), "debited"),
        ("c", "u2", "x@sbi.in", dt.datetime(2024, 4, 30), "spent"),
        ("d", "u2", "x@sbi.in", dt.datetime(2024, 5, 1), "a transaction"),
        ("e", "u2", "x@mail.in", dt.datetime(2024, 5, 2), "spent"),
        ("f", "u2", "x@axis.in", dt.datetime(2024, 5, 2), "hello"),
    ]
    msgs = spark.createDataFrame(
        rows, "message_id string, user_id string, sender string, sent_at timestamp_ntz, "
        "body string")
    marks = spark.createDataFrame(
        [("u1", "gmail", dt.datetime(2024, 5, 10, 20)), ("u1", "file", dt.datetime(2024, 5, 1)),
         ("u2", "file", dt.datetime(2024, 5, 19))],
        "user_id string, source string, last_fetched timestamp_ntz")
    got = alerts.select_new_messages(msgs, marks, now())
    assert sorted(r.message_id for r in got.collect()) == ["b", "d"]


def test_mark_only_moves_over_landed_rows(spark):
    marks = spark.createDataFrame(
        [("u", "gmail", dt.datetime(2024, 5, 10))],
        "user_id string, source string, last_fetched timestamp_ntz")
    landed = spark.createDataFrame(
        [("u", "gmail", dt.datetime(2024, 5, 3)), ("v", "gmail", dt.datetime(2024, 5, 4))],
        "user_id string, source string, timestamp timestamp_ntz")
    got = {r.user_id: r.last_fetched for r in alerts.advance_marks(marks, landed).collect()}
    assert got == {"u": dt.datetime(2024, 5, 10), "v": dt.datetime(2024, 5, 4)}


def test_statement_files(spark, tmp_path):
    for i, user in enumerate(["u1", "u2"]):
        (tmp_path / f"s{i}.csv").write_text(
            "Value Date , Description,Withdrawal Amt (INR),Deposit,user_id\n"
            f"01/02/2024,Lotus Tea,\"1,200.50\",,{user}\n"
            f"bad,Lotus Tea,10,,{user}\n"
            f",Lotus Tea,10,,{user}\n"
            f"02/02/2024,,7,,{user}\n"
            f"03/02/2024,Salary,,900,{user}\n"
            f"04/02/2024,Zero,0,,{user}\n"
            f"05/02/2024,{'n' * 120},5,,{user}\n")
    (tmp_path / "other.csv").write_text(
        "user_id,Debit,Date,Description\nu3,44,6 March 2024,Lotus Tea\nu3,x,7 March 2024,a\n")
    rows = statements.normalise_files(spark, str(tmp_path))
    got = sorted((r.user_id, float(r.amount), r.receiver, r.timestamp) for r in rows.collect())
    assert got[:3] == [
        ("u1", 5.0, "n" * 120, dt.datetime(2024, 2, 5)),
        ("u1", 7.0, "UNKNOWN", dt.datetime(2024, 2, 2)),
        ("u1", 1200.5, "Lotus Tea", dt.datetime(2024, 2, 1)),
    ]
    assert len(got) == 7 and got[-1] == ("u3", 44.0, "Lotus Tea", dt.datetime(2024, 3, 6))
    tables = statements.read_statements(spark, str(tmp_path))
    reasons = sorted((r.user_id, r.reason) for t in tables
                     for r in statements.statement_rejects(t).collect())
    each = ["no_amount", "no_amount", "no_date", "no_date"]
    assert reasons == [(u, r) for u in ("u1", "u2") for r in each] + [("u3", "no_amount")]


def test_owner_of_a_statement_from_its_folder(spark, tmp_path):
    for user in ("7", "8"):
        (tmp_path / f"user_id={user}").mkdir()
        (tmp_path / f"user_id={user}" / "s.csv").write_text("Date,Debit\n01/02/2024,5\n")
    got = statements.normalise_files(spark, str(tmp_path)).collect()
    assert sorted(r.user_id for r in got) == ["7", "8"]


def test_statement_without_required_columns(spark):
    with pytest.raises(ValueError):
        statements.discover_columns(["Narration", "Amount"])


def gold(spark, rows):
    return spark.createDataFrame(rows, S.GOLD)


def test_write_upsert_rewrites_only_touched_months(spark, tmp_path):
    from decimal import Decimal

    path = str(tmp_path / "gold")
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    keys = ["user_id", "month", "category"]
    first = gold(spark, [("u", jan, "Food", Decimal(5), 1), ("u", feb, "Food", Decimal(6), 1)])
    sinks.write_upsert(first, path, keys, "month")
    kept = {p.name for p in (tmp_path / "gold" / "month=2024-01-01").glob("*.parquet")}
    sinks.write_upsert(
        gold(spark, [("u", feb, "Food", Decimal(9), 2), ("v", feb, "Other", Decimal(1), 1)]),
        path, keys, "month")
    rows = spark.read.schema(S.GOLD).parquet(path).collect()
    assert sorted((r.user_id, r.month, float(r.total_amount)) for r in rows) == [
        ("u", jan, 5.0), ("u", feb, 9.0), ("v", feb, 1.0)]
    assert {p.name for p in (tmp_path / "gold" / "month=2024-01-01").glob("*.parquet")} == kept
    sinks.write_append(first, str(tmp_path / "more"), ["month"])
    assert spark.read.parquet(str(tmp_path / "more")).count() == 2


def test_a_month_that_became_empty_is_emptied(spark, tmp_path):
    from decimal import Decimal

    path = str(tmp_path / "gold")
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    both = [("u", jan, "Food", Decimal(5), 1), ("u", feb, "Food", Decimal(6), 1)]
    sinks.overwrite_partitions(gold(spark, both), path, "month")
    fresh = gold(spark, [("v", feb, "Food", Decimal(7), 1)])
    sinks.replace_partitions(fresh, path, "month", [jan, feb])
    rows = spark.read.schema(S.GOLD).parquet(path).collect()
    assert [(r.user_id, r.month) for r in rows] == [("v", feb)]


def test_an_older_update_does_not_win(spark):
    def rows(*values):
        return spark.createDataFrame(values, "k int, at int, v string")

    got = sinks.upsert(rows((1, 5, "stored"), (2, 5, "stored"), (3, 5, "stored")),
                       rows((1, 4, "older"), (2, 5, "same"), (3, 6, "newer")), ["k"], ["at"])
    assert sorted((r.k, r.v) for r in got.collect()) == [
        (1, "stored"), (2, "same"), (3, "newer")]


def test_union_of_sources_fills_missing_columns(spark):
    a, b = spark.sql("select 1 as x, 'm' as message_id"), spark.sql("select 2 as x")
    assert sorted(map(tuple, alerts.union_sources(a, b).collect())) == [(1, "m"), (2, None)]


def plain_body(message):
    """First text part with data, depth first; a message without parts is its own."""
    if "parts" not in message:
        return message.get("body", {}).get("data")
    for inner in message["parts"]:
        if inner.get("mimeType") in ("text/plain", "text/html") and inner.get("body", {}).get("data"):
            return inner["body"]["data"]
        below = plain_body(inner) if "parts" in inner else None
        if below:
            return below
    return None


def random_message(r, depth=0):
    kind = r.choice(["text/plain", "text/html", "image/png", "multipart/mixed"])
    message = {"mimeType": kind, "body": r.choice([{}, {"data": ""}, {"data": "".join(r.choices("ABCDabcd", k=8))}])}
    if r.random() < (0.9 if depth == 0 else 0.45) and depth < 7:
        message["parts"] = [random_message(r, depth + 1) for _ in range(r.choice([0, 1, 2, 2, 3]))]
    return message


def test_nested_payloads(spark):
    """Trees of any shape, rows that repeat, and what isn't a message."""
    r = random.Random(11)
    messages = [random_message(r) for _ in range(150)]
    messages[0]["headers"] = [{"name": "From", "value": "a@sbi.in"}]
    deep = {"mimeType": "text/plain", "body": {"data": "ZGVlcA=="}}
    for _ in range(30):
        deep = {"mimeType": "multipart/mixed", "body": {}, "parts": [{"mimeType": "image/png", "body": {}}, deep]}
    messages.append(deep)
    texts = [json.dumps(m) for m in messages]
    rows = [(str(i), "x", t) for i, t in enumerate(texts)] + [("0", "x", texts[0])]
    rows += [("bad", "x", "{not json"), ("null", "x", None), ("list", "x", "[1]"), ("word", "x", '"parts"')]
    landed = spark.createDataFrame(rows, "message_id string, _path string, raw string").repartition(3)
    flat = alerts.flatten_payloads(landed)
    assert flat.columns == ["message_id", "_path", "payload"] and flat.schema["payload"].dataType == S.PAYLOAD
    got = flat.select("message_id", "payload", alerts.decode_body(F.col("payload")).alias("body")).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.message_id in ("bad", "null"):
            assert row.payload is None and row.body is None
        elif row.message_id.isdigit():
            wanted = plain_body(messages[int(row.message_id)])
            decoded = None if wanted is None else base64.urlsafe_b64decode(wanted).decode(errors="replace").replace("\ufffd", "")
            assert row.body == decoded, messages[int(row.message_id)]
    first = flat.where("message_id = '0'").select(alerts.header(F.col("payload"), "from").alias("h")).first()
    assert first.h == "a@sbi.in"
    assert alerts.flatten_payloads(landed.limit(0)).count() == 0


def test_payloads_that_landed_in_one_file_are_read_by_many_tasks(spark):
    parts = '{"parts": [{"mimeType": "text/plain", "body": {"data": "aGk="}}]}'
    landed = spark.range(0, 400, 1, 1).select(F.col("id").alias("message_id"), F.lit(parts).alias("raw"))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("payloads-*"))
    bodies = alerts.flatten_payloads(landed).select(alerts.decode_body(F.col("payload")).alias("body"))
    assert bodies.where("body = 'hi'").count() == 400
    (stored,) = set(folder.glob("payloads-*")) - before
    assert len(list(stored.glob("*.parquet"))) >= 8
