"""Spend tables derived from the given tables, for queries, tests and bench.

Receivers are chosen by a number found in each event, so every shape of
receiver text and every collision between merchant rules occurs.
"""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import string_array
from ledgerlake.functions.text import with_merchant
from ledgerlake.operators.bronze import to_bronze
from ledgerlake.operators.feedback import split_corrections
from ledgerlake.operators.scoring import categorise
from ledgerlake.operators.silver import project_silver, scoring_input, write_back
from ledgerlake.plans.daily import with_frequency
from ledgerlake.sources.shared import materialise, spread

# Invented receivers, one for each shape of text and each collision of rules.
RECEIVERS = [
    "VPA dinner-swiggy@qbk SWIGGY SUPPER CLUB",
    "VPA zomato.gold7@rbank Zomato Gold Table",
    "VPA paytmqr7zx9@pbank SILVER OAK DISPENSARY",
    "VPA gpay-55501234@gbank Hilltop Noodle Bar",
    "VPA kx81qrt@nbank Mr Test Person One",
    "VPA 7000000001@tbank SAMPLE PERSON",
    "VPA bharatpe.0a1b@cbank VARIABLE QZ",
    "VPA swiggy@qq",
    "VPA Nimbus Example NIMBUS EXAMPLE",
    "VPA a@b Orbit Hardware",
    "netflix@qbk",
    "Kivi Umbrellas",
    "Amazon Prime Annual",
    "Cupid Flowers",
    "coin.zerodha deposit",
    "Ola Auto Riverside",
    "Tata 1mg Refill",
    "CRED Rent Bill",
    "FreshMenu Supper",
    "Water Board Counter",
    "MobiKwik Topup",
    "PrimeVideo Rental",
    "UPI/100200300400/Saffron Tea House",
    "NEFT Quill Books 555000111",
    "zx12qv9 Second Sample Person",
    "Dr. Third Sample",
    "Miss Fourth Sample /ref07",
    "IMPS 111122223333",
    "indian railway platform",
    "adani electric bill",
    "gas supply depot",
    "Moonlight Payments Bank",
    "Uber Ride 9081",
    "bsnl broadband 1180",
    "Blue Fern Nursery Pvt Ltd",
    "VPA lic@qbk LIC Policy C",
    "Association of Northern Lighthouse Keepers and Friends of the Old Harbour Museum, Section for "
    "Repairs of Lamps and Lenses, Branch A",
    "Association of Northern Lighthouse Keepers and Friends of the Old Harbour Museum, Section for "
    "Repairs of Lamps and Lenses, Branch B",
]
SENDERS = [
    "alerts@hdfcbank.net", "noreply@icicibank.com", "donotreply@sbi.co.in",
    "alerts@axisbank.com", "news@shopmail.example", "alerts@kotak.com",
    "info@yesbank.in", "friend@mail.example",
]
# Weights of the metadata features and intercepts of a made-up model, by label.
MADE_TAIL = [[0.1 * ((i + j) % 5 - 2) for j in range(5)] for i in range(13)]
MADE_INTERCEPTS = [0.05 * i - 0.3 for i in range(13)]
AS_OF = "2024-01-31 12:00:00"
ONLINE_STEPS = 3
PREVIOUS_RUN = "2024-01-16 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(string_array(values), (n % len(values) + 1).cast("int"))


def event_payments(events: DataFrame) -> DataFrame:
    """Events read as payments. A quarter of the receivers charge a fixed sum."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        "value",
        k.alias("k"),
    ).select(
        "event_id",
        "event_type",
        "user_id",
        "timestamp",
        "k",
        F.when(F.col("k") % 4 == 0, (100 + F.col("k")).cast(S.MONEY))
        .otherwise(F.col("value").cast(S.MONEY)).alias("amount"),
        _pick(RECEIVERS, F.col("k")).alias("receiver"),
    )


def raw_from_payments(payments: DataFrame) -> DataFrame:
    """Alerts of all payments, and statement lines of the purchases: the same
    payments a second time, with only a date."""

    def rows(df: DataFrame, raw_id: Column, timestamp: Column, source: str, message: Column):
        return df.select(
            raw_id.alias("raw_id"),
            "user_id",
            "amount",
            "receiver",
            F.lit("debit").alias("transaction_type"),
            timestamp.alias("timestamp"),
            F.lit(source).alias("source"),
            F.col("receiver").alias("raw_text"),
            message.alias("message_id"),
        )

    when = F.col("timestamp")
    alerts = rows(
        payments, F.col("event_id") * 2, when, "gmail",
        F.concat(F.lit("m"), F.col("event_id").cast("string")),
    )
    lines = rows(
        payments.where("event_type = 'purchase'"), F.col("event_id") * 2 + 1,
        F.to_date(when).cast("timestamp_ntz"), "file", F.lit(None).cast("string"),
    )
    return alerts.unionByName(lines)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_payments(spread(table(spark, sf_dir, "events")))


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_payments(payments(spark, sf_dir))


def earlier_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze as a run at mid-month left it, from alerts only."""
    raw = txn_raw(spark, sf_dir).where(
        (F.col("timestamp") < F.lit(PREVIOUS_RUN).cast("timestamp_ntz"))
        & (F.col("source") == "gmail")
    )
    return to_bronze(raw)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bronze(txn_raw(spark, sf_dir))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_silver(bronze(spark, sf_dir), as_of())


def txn_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments: many months, many users."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("raw_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        F.col("o_orderdate").alias("timestamp"),
        _pick(RECEIVERS, F.col("o_orderkey")).alias("receiver"),
    )


def line_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments: the largest table."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        _pick(RECEIVERS, F.col("l_orderkey") + F.col("l_linenumber")).alias("receiver"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploaded statement lines with blanks and bad dates."""
    number = F.col("raw_id")
    return txn_long(spark, sf_dir).select(
        F.col("raw_id").alias("line_id"),
        "user_id",
        F.when(number % 11 == 0, "n/a")
        .otherwise(F.date_format("timestamp", "dd/MM/yyyy")).alias(" Txn Date "),
        F.when(number % 13 != 0, F.col("receiver")).alias("Narration"),
        F.when(number % 10 != 0, F.format_number("amount", 2)).alias("Withdrawal Amt."),
    )


DATE_SHAPES = [
    "dd/MM/yyyy", "dd-MMM-yy", "yyyy/MM/dd", "dd.MM.yyyy", "d MMMM yyyy", "dd/MM/yyyy HH:mm",
    "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSS'+05:30'",
]


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of this century in many shapes, some unreadable."""
    number, day = F.col("raw_id"), F.col("timestamp") + F.expr("interval 10 years")
    shapes = [F.date_format(day, shape) for shape in DATE_SHAPES]
    shape = F.element_at(F.array(*shapes), (number % len(shapes) + 1).cast("int"))
    return txn_long(spark, sf_dir).select(
        number.alias("line_id"), F.when(number % 11 == 0, "n/a").otherwise(shape).alias("written")
    )


def write_statement_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Statement lines as CSV files of two layouts, in one folder per owner."""
    lines = statements(spark, sf_dir).withColumn("user_id", (F.col("user_id").cast("int") % 10).cast("string"))
    writer = lambda df: df.write.mode("append").option("header", True).partitionBy("user_id")
    writer(lines.where("line_id % 2 = 0")).csv(path)
    other = lines.where("line_id % 2 = 1").select(
        F.col("`Withdrawal Amt.`").alias("Debit"), F.col("Narration").alias("Description"),
        F.col("` Txn Date `").alias("Date"), "line_id", "user_id",
    )
    writer(other).csv(path)


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(batches):
    """Members of a workbook as one file."""
    for batch in batches:
        out = []
        for members in batch.column(1).to_pylist():
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, xml in members:
                    archive.writestr(name, xml)
            out.append(data.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])


def workbooks(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Statement lines as spreadsheet files of about ``size`` lines, in three
    styles: shared texts and days from 1900, inline texts, days from 1904 in a
    format of their own."""
    lines = statements(spark, sf_dir)
    n = -(-lines.count() // size)
    book = F.pmod(F.xxhash64("line_id"), F.lit(max(n, 1))).cast("long")
    amount, day = F.col("`Withdrawal Amt.`"), F.try_to_timestamp("` Txn Date `", F.lit("dd/MM/yyyy")).cast("date")
    rows = lines.select(
        book.alias("book"), F.col("line_id").alias("id"), "user_id", F.col("Narration").alias("n"),
        amount.alias("w"), F.col("` Txn Date `").alias("d"), day.alias("day"),
    )
    files = rows.groupBy("book").agg(
        F.sort_array(F.collect_list(F.struct("id", "user_id", "n", "w", "d", "day"))).alias("lines"),
        F.sort_array(F.collect_set("n")).alias("texts"),
    ).withColumn("style", F.col("book") % 3)

    def escaped(text):
        return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def row(x: Column, i: Column) -> Column:
        at = (i + 3).cast("string")

        def inline(column, text):
            return F.concat(F.lit(f'<c r="{column}'), at, F.lit('" t="inlineStr"><is><t>'), escaped(text), F.lit("</t></is></c>"))

        def number(column, value, style=0):
            return F.concat(F.lit(f'<c r="{column}'), at, F.lit(f'" s="{style}"><v>'), value.cast("string"), F.lit("</v></c>"))

        serial = F.datediff(x["day"], F.when(F.col("style") == 2, F.lit("1904-01-01")).otherwise(F.lit("1899-12-30")).cast("date"))
        shared = F.concat(
            F.lit('<c t="s" r="D'), at, F.lit('"><v>'), (F.array_position("texts", x["n"]) - 1).cast("string"), F.lit("</v></c>")
        )
        plain = F.replace(x["w"], F.lit(","), F.lit(""))
        cells = [
            number("A", x["id"]),
            inline("B", x["user_id"]),
            F.when((F.col("style") == 1) | x["day"].isNull(), inline("C", x["d"])).otherwise(number("C", serial, 1)),
            F.when(F.col("style") == 0, shared).otherwise(inline("D", x["n"])),
            F.when(F.col("style") == 1, inline("F", x["w"])).otherwise(number("F", plain)),
        ]
        return F.concat(F.lit('<row r="'), at, F.lit('">'), *[F.coalesce(c, F.lit("")) for c in cells], F.lit("</row>"))

    named = ["line_id", "user_id", " Txn Date ", "Narration", "Balance", "Withdrawal Amt."]
    top = "".join(f'<c r="{at}2" t="inlineStr"><is><t xml:space="preserve">{name}</t></is></c>' for at, name in zip("ABCDEF", named, strict=True))
    sheet = F.concat(
        F.lit(f'<worksheet xmlns="{SHEET}"><sheetData><row r="2">{top}</row>'),
        F.array_join(F.transform("lines", row), ""),
        F.lit("</sheetData></worksheet>"),
    )
    texts = F.array_join(
        F.transform("texts", lambda t: F.concat(F.lit("<si><r><t>"), escaped(F.substring(t, 1, 3)), F.lit("</t></r><r><t>"), escaped(t.substr(F.lit(4), F.length(t))), F.lit("</t></r></si>"))), ""
    )
    marked = F.when(F.col("style") == 2, '<workbookPr date1904="1"/>').otherwise("<workbookPr/>")
    code = F.when(F.col("style") == 2, "170").otherwise("14")
    members = {
        "xl/workbook.xml": F.concat(
            F.lit(f'<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}">'), marked,
            F.lit('<sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')),
        "xl/_rels/workbook.xml.rels": F.lit(
            f'<Relationships xmlns="x"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet7.xml"/></Relationships>'),
        "xl/styles.xml": F.concat(
            F.lit(f'<styleSheet xmlns="{SHEET}"><numFmts count="1"><numFmt numFmtId="170" formatCode="dd/mm/yyyy;@"/></numFmts>'
                  '<cellXfs><xf numFmtId="0"/><xf numFmtId="'), code, F.lit('"/></cellXfs></styleSheet>')),
        "xl/sharedStrings.xml": F.concat(F.lit(f'<sst xmlns="{SHEET}">'), texts, F.lit("</sst>")),
        "xl/worksheets/sheet7.xml": sheet,
    }
    listed = F.array(*[F.struct(F.lit(name).alias("name"), xml.alias("xml")) for name, xml in members.items()])
    made = files.select(F.concat(F.lit("book-"), F.col("book"), F.lit(".xlsx")).alias("path"), listed.alias("members"))
    return made.select("path", F.transform("members", lambda m: F.array(m["name"], m["xml"])).alias("m")).mapInArrow(
        _zipped, "path string, content binary"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments as alert messages in several wordings."""
    n = F.col("event_id")
    amount = F.concat(F.lit("Rs. "), F.col("amount").cast("string"))
    to = F.concat(
        F.lit(" to "), F.col("receiver"), F.lit(" on "),
        F.date_format("timestamp", "dd-MM-yyyy"),
    )
    body = (
        F.when(n % 7 == 0, F.concat(amount, F.lit(" offer"), to))
        .when(n % 5 == 0, F.concat(F.lit("You have spent"), F.lit(" "), amount, to))
        .when(n % 3 == 0, F.concat(F.lit("INR "), F.format_number("amount", 2),
                                   F.lit("\r\ndebited by transfer. Ref on file")))
        .otherwise(F.concat(amount, F.lit(" debited from a/c"), to))
    )
    return payments(spark, sf_dir).select(
        F.concat(F.lit("m"), n.cast("string")).alias("message_id"),
        "user_id",
        _pick(SENDERS, n).alias("sender"),
        F.col("timestamp").alias("sent_at"),
        body.alias("body"),
    )


def with_payload(msgs: DataFrame) -> DataFrame:
    """Messages as landed: headers, and the body as a part on one of several
    levels (5 at most), or bare."""
    data = F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_")
    data = F.regexp_replace(data, "\\s", "")

    def part(path: str, kind: str, text: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if text is None else text
        return F.struct(F.lit(path).alias("path"), F.lit(kind).alias("mimeType"), text.alias("data"))

    image = part("0", "image/png", F.lit("AAAA"))
    flat = F.array(image, part("1", "text/plain", data))
    two = F.array(part("0", "multipart/mixed"), part("0.0", "text/html", data), part("1", "text/plain", F.lit("c2Vjb25k")))
    deep = [part(".".join(["1"] + ["0"] * n), "multipart/mixed") for n in range(4)]
    five = F.array(image, *deep, part("1.0.0.0.0", "text/plain", data))
    none = F.lit(None).cast(S.PAYLOAD["parts"].dataType)
    kind = F.length("body") % 4
    parts = F.when(kind == 0, flat).when(kind == 1, two).when(kind == 2, five).otherwise(none)
    # half past five ahead of UTC, three hours behind, or without a zone
    zone = F.length("body") % 3
    ahead = F.when(zone == 0, 330).when(zone == 1, -180).otherwise(0)
    clock = F.date_format(F.col("sent_at") + F.make_dt_interval(mins=ahead), "d MMM yyyy HH:mm:ss")
    date = F.concat(
        F.when(zone != 1, F.concat(F.date_format(F.col("sent_at") + F.make_dt_interval(mins=ahead), "EEE"), F.lit(", "))).otherwise(""),
        clock,
        F.when(zone == 0, " +0530").when(zone == 1, " -0300 (BRT)").otherwise(""),
    )
    named = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    payload = F.struct(
        F.array(named("FROM", F.col("sender")), named("Subject", F.lit("Alert")), named("date", date)).alias("headers"),
        F.lit("multipart/mixed").alias("mimeType"),
        F.struct(F.when(kind == 3, data).alias("data")).alias("body"),
        parts.alias("parts"),
    )
    return msgs.select("message_id", "user_id", payload.cast(S.PAYLOAD).alias("payload"))


def with_json(msgs: DataFrame) -> DataFrame:
    """Messages as the mailbox gives them: JSON, the body on one of seven levels,
    between pictures, empty texts, empty lists of parts and texts that come later."""
    data = F.regexp_replace(F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_"), "\\s", "")

    def part(kind: str, inside: Column | str, *parts: Column) -> Column:
        listed = F.concat(F.lit(', "parts": ['), F.concat_ws(", ", *parts), F.lit("]")) if parts else F.lit("")
        text = F.lit(inside) if isinstance(inside, str) else inside
        return F.concat(F.lit(f'{{"mimeType": "{kind}", "body": {{"data": "'), text, F.lit('"}'), listed, F.lit("}"))

    image, empty, later = part("image/png", "AAAA"), part("text/plain", ""), part("text/html", "c2Vjb25k")
    hollow = F.lit('{"mimeType": "multipart/mixed", "body": {}, "parts": []}')
    nested = part("text/plain", data)
    shapes = []
    for depth in range(6):
        nested = part("multipart/mixed", "AAAA", image, empty, hollow, nested, later) if depth % 2 else part("multipart/related", "AAAA", nested, later)
        shapes.append(nested)
    bare = F.concat(F.lit('{"mimeType": "text/plain", "body": {"data": "'), data, F.lit('"}}'))
    level = F.length("body") % 7
    raw = bare
    for i, shape in enumerate(shapes):
        raw = F.when(level == i + 1, shape).otherwise(raw)
    return msgs.select("message_id", "user_id", raw.alias("raw"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last fetch per user and source; users without a signup have no mark."""
    signups = payments(spark, sf_dir).where("event_type = 'signup'")
    first = signups.groupBy("user_id").agg(F.min("timestamp").alias("last_fetched"))
    sources = F.explode(F.array(F.lit("gmail"), F.lit("file"))).alias("source")
    return first.select("user_id", sources, "last_fetched")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views read as category corrections of their merchant."""
    rows = payments(spark, sf_dir).where("event_type in ('click', 'view')")
    number = F.col("k") + F.col("user_id").cast("int")
    return with_merchant(rows).select(
        "user_id",
        (F.col("event_id") * 2).alias("silver_id"),
        "merchant",
        F.col("receiver").alias("raw_text"),
        F.lit(None).cast("string").alias("original_category"),
        _pick(S.CATEGORIES, number).alias("corrected_category"),
        "amount",
        F.col("timestamp").alias("corrected_at"),
    )


def probability_arrays(df: DataFrame, n: Column) -> DataFrame:
    """Add ``p``, a stand-in for the classifier: peaked, and different for
    every number ``n``."""
    labels = F.sequence(F.lit(0), F.lit(len(S.LABELS) - 1))
    scored = df.withColumn(
        "_scores", F.transform(labels, lambda i: F.pow(1 + (n * 31 + i * 17) % 97, F.lit(4)))
    )
    total = F.aggregate("_scores", F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("_total", total).withColumn(
        "p", F.transform("_scores", lambda x: x / F.col("_total"))
    ).drop("_scores", "_total")


def probabilities(txns: DataFrame) -> DataFrame:
    """(silver_id, p) for the scoring input."""
    n = (F.col("silver_id") / 2).cast("long")
    return probability_arrays(txns.select("silver_id"), n)


def scored_input(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Scoring input with the number of feedback entries as frequency.

    Bronze is written first, as in the daily run: silver and the lookup of
    the receiver both read it.
    """
    rows = materialise(bronze(spark, sf_dir), "bronze")
    txns = scoring_input(project_silver(rows, as_of()), rows)
    return with_frequency(txns, feedback(spark, sf_dir) if known is None else known)


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with merchant, time and probabilities, one row per payment."""
    rows = with_merchant(payments(spark, sf_dir))
    return probability_arrays(rows, F.col("event_id")).withColumnRenamed("event_id", "txn_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialise(feedback(spark, sf_dir), "feedback")
    txns = scored_input(spark, sf_dir, known)
    return categorise(txns, probabilities(txns), known)


def silver_categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialise(feedback(spark, sf_dir), "feedback")
    rows = materialise(bronze(spark, sf_dir), "bronze")
    plain = materialise(project_silver(rows, as_of()), "silver")
    txns = with_frequency(scoring_input(plain, rows), known)
    return write_back(plain, categorise(txns, probabilities(txns), known))


def corrections_from_payments(rows: DataFrame) -> DataFrame:
    """Errors read as correction requests, some for unknown rows or categories."""
    n = F.col("event_id")
    choices = S.CATEGORIES + ["Pets"]
    return rows.where("event_type = 'error'").select(
        F.when(F.col("k") == 7, -n).otherwise(n * 2).alias("silver_id"),
        "user_id",
        F.col("receiver").alias("merchant"),
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(None).cast("string").alias("original_category"),
        _pick(choices, F.col("k")).alias("corrected_category"),
        "amount",
        F.col("timestamp").alias("corrected_at"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections_from_payments(payments(spark, sf_dir))


def corrected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(silver before, accepted corrections, rejected corrections)."""
    before = materialise(silver_categorised(spark, sf_dir), "silver")
    accepted, rejected = split_corrections(before, corrections(spark, sf_dir))
    return before, accepted, rejected


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments labelled by their receiver."""
    number = F.col("k") % len(RECEIVERS)
    return payments(spark, sf_dir).select(
        F.col("event_id").alias("example_id"),
        F.col("receiver").alias("raw_text"),
        _pick(S.CATEGORIES, number).alias("category"),
        "user_id",
        "amount",
        "timestamp",
        F.lit(0).alias("freq_30d"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's receivers as training cases, with observed ranges."""
    return (
        labelled(spark, sf_dir)
        .groupBy("user_id", F.col("raw_text").alias("receiver"), "category")
        .agg(
            F.min(F.col("amount").cast("double")).alias("amount_low"),
            F.max(F.col("amount").cast("double")).alias("amount_high"),
            F.min(F.hour("timestamp")).alias("hour_low"),
            F.max(F.hour("timestamp")).alias("hour_high"),
        )
        .withColumn("case_id", F.concat_ws("/", "user_id", "receiver"))
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model versions: every event type is a model, every day a version."""
    return (
        payments(spark, sf_dir)
        .groupBy(
            F.col("event_type").alias("model"),
            F.dayofyear("timestamp").cast("long").alias("version"),
        )
        .agg(
            F.min("timestamp").alias("trained_at"),
            F.max("timestamp").alias("updated_at"),
            F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("samples_applied"),
        )
    )
