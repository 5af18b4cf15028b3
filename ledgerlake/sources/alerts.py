"""Bank-alert messages that have been landed as rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import let
from ledgerlake.functions.text import strip
from ledgerlake.schema import PAYLOAD
from ledgerlake.sources.shared import materialise, spread

# The patterns of an alert. ``(?d)``: a point stops only at a
# line feed, since message bodies contain carriage returns. White space is
# spelt out with the no-break space that mail often holds.
DEBIT_WORD = "(?i)debited|spent|paid"
CURRENCY_FIRST = (
    r"(?id)(?:rs\.?|inr|₹)[\s\xa0]?([\d,]+\.?\d{0,2}).*?(?:debited|spent|paid)"
)
VERB_FIRST = r"(?id)(?:debited|spent|paid).*?(?:rs\.?|inr|₹)[\s\xa0]?([\d,]+\.?\d{0,2})"
RECEIVER = r"(?id)to[\s\xa0]+(.*?)[\s\xa0]+on"

# Senders and words of the fetch query.
BANK_SENDERS = "(?i)hdfc|icici|sbi|axis|kotak|yesbank"
FETCH_WORDS = "(?i)debited|spent|txn|transaction"

TEXT_TYPES = ["text/plain", "text/html"]


def _decoded(data: Column) -> Column:
    """Invalid base64 gives null and invalid UTF-8 bytes are dropped."""
    raw = F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def flatten_payloads(landed: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages as the mailbox gives them, with the parts of each as a flat list.

    ``raw``: the payload as JSON text, parts nested to any depth. It becomes
    ``payload`` (``schema.PAYLOAD``): headers, type and body of the message, and
    its parts depth first, a part before those inside it. Text that isn't JSON
    gives a null payload. Each turn takes the parts of the turn before apart, so
    there are as many turns as levels, and a turn holds only what has parts. Messages
    that landed in one file are dealt over all tasks first.
    """
    others = [c for c in landed.columns if c != raw]
    rows = spread(landed).select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*others).alias("_rest"),
        F.try_parse_json(raw).alias("_v"),
    )
    rows = materialise(rows, "payloads")
    data, kind = F.try_variant_get("_v", "$.body.data", "string"), F.try_variant_get("_v", "$.mimeType", "string")
    place = "array<int>"
    level = rows.select("_row", F.expr(f"cast(array() as {place})").alias("_path"), "_v")
    found = []
    while True:
        parts = level.where(F.expr("try_variant_get(_v, '$.parts', 'array<variant>') IS NOT NULL"))
        inside = parts.select(
            "_row", "_path", F.posexplode(F.try_variant_get("_v", "$.parts", "array<variant>")).alias("_i", "_part")
        )
        level = inside.select(
            "_row", F.concat("_path", F.array("_i")).alias("_path"), F.col("_part").alias("_v")
        )
        level = materialise(level, "parts")
        if level.isEmpty():
            break
        found.append(level.select("_row", "_path", kind.alias("mimeType"), data.alias("data")))
    nothing = rows.select("_row", F.expr(f"cast(null as {place})").alias("_path"), kind.alias("mimeType"), data.alias("data"))
    listed = nothing.limit(0)
    for each in found:
        listed = listed.unionByName(each)
    # a message has a handful of parts
    gathered = listed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_path", "mimeType", "data"))).alias("_parts"))
    flat = F.transform("_parts", lambda p: F.struct(
        F.array_join(p["_path"].cast("array<string>"), ".").alias("path"), p["mimeType"].alias("mimeType"), p["data"].alias("data")))
    has_parts = F.try_variant_get("_v", "$.parts", "array<variant>").isNotNull()
    headers = F.try_variant_get("_v", "$.headers", "array<struct<name:string,value:string>>")
    no_parts = F.expr("cast(array() as array<struct<path:string,mimeType:string,data:string>>)")
    payload = F.struct(
        headers.alias("headers"),
        kind.alias("mimeType"),
        F.struct(data.alias("data")).alias("body"),
        F.when(has_parts, F.coalesce(flat, no_parts)).alias("parts"),
    ).cast(PAYLOAD)
    joined = rows.join(gathered, "_row", "left")
    return joined.select("_rest.*", F.when(F.col("_v").isNotNull(), payload).alias("payload"))


def decode_body(payload: Column) -> Column:
    """Text of the first text part, depth first, else of the message itself."""
    texts = F.filter(
        payload["parts"], lambda p: p["mimeType"].isin(TEXT_TYPES) & (p["data"] != "")
    )
    first = F.try_element_at(F.transform(texts, lambda p: p["data"]), F.lit(1))
    data = F.when(payload["parts"].isNotNull(), first).otherwise(payload["body"]["data"])
    return _decoded(data)


def header(payload: Column, name: str) -> Column:
    """Value of the first header of that name, in any case."""
    named = F.filter(payload["headers"], lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(F.transform(named, lambda h: h["value"]), F.lit(1))


def message_date(text: Column) -> Column:
    """UTC time of a mail date such as ``Tue, 2 Jan 2024 10:11:12 +0530 (IST)``.

    The weekday, a zone's name in brackets and the seconds may be missing; a
    zone that is missing or a name counts as UTC.
    """
    bare = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", "")
    parts = r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?)\s*([+-]\d{4})?"
    clock = F.try_to_timestamp(
        F.regexp_replace(F.regexp_extract(bare, parts, 1), r"\s+", " "), F.lit("d MMM yyyy H:mm[:ss]")
    ).cast("timestamp_ntz")
    zone = F.regexp_extract(bare, parts, 2)
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(
        F.startswith(zone, F.lit("-")), 1
    ).otherwise(-1)
    return clock + F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))


def read_messages(landed: DataFrame) -> DataFrame:
    """Landed payloads (message_id, user_id, payload) as messages: sender,
    subject, sent_at from the Date header, and body."""
    payload = F.col("payload")
    return landed.select(
        *[c for c in landed.columns if c != "payload"],
        header(payload, "From").alias("sender"),
        header(payload, "Subject").alias("subject"),
        message_date(header(payload, "Date")).alias("sent_at"),
        decode_body(payload).alias("body"),
    )


def parse_alerts(messages: DataFrame, as_of: Column) -> DataFrame:
    """Debit alerts as raw transactions.

    ``messages``: message_id, user_id, sent_at, body. A message without a
    debit word, an amount or a positive amount yields nothing; ``as_of``
    replaces a missing date. Other columns pass through.

    What is read from the body is read once, behind a generator: a plain
    filter on it would be computed again below the projection.
    """
    body = F.col("body")
    amount = let(
        F.regexp_extract(body, CURRENCY_FIRST, 1),
        lambda found: F.when(found != "", found).otherwise(
            F.regexp_extract(body, VERB_FIRST, 1)
        ),
    )
    receiver = let(
        F.regexp_extract(body, RECEIVER, 0),
        lambda found: F.when(
            found != "", strip(F.regexp_extract(found, RECEIVER, 1))
        ).otherwise("UNKNOWN"),
    )
    number = let(amount, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast(S.MONEY))
    read = F.when(
        F.rlike(body, F.lit(DEBIT_WORD)),
        F.filter(F.array(F.struct(number.alias("amount"), receiver.alias("receiver"))), lambda r: r["amount"] > 0),
    )
    kept = [c for c in messages.columns if c not in ("body", "sent_at", "sender", "subject")]
    return messages.select(
        *kept, F.inline(read), "sent_at", F.col("body").alias("raw_text")
    ).select(
        *kept,
        "amount",
        "receiver",
        F.lit("debit").alias("transaction_type"),
        F.coalesce("sent_at", as_of).alias("timestamp"),
        F.lit("gmail").alias("source"),
        "raw_text",
    )


def select_new_messages(
    messages: DataFrame, marks: DataFrame, as_of: Column, source: str = "gmail"
) -> DataFrame:
    """Bank debit messages dated on or after the user's last fetched day.

    The words may stand in the body or, where there is one, in the subject.
    A user without a mark of this source starts at the first day of the
    ``as_of`` month. ``marks`` has one row per user and source (as
    ``advance_marks`` gives it), so the join adds no rows; a hot user's
    messages are split by the adaptive skew join.
    """
    words = F.col("body")
    if "subject" in messages.columns:
        words = F.concat_ws("\n", "subject", "body")
    wanted = messages.where(
        F.rlike("sender", F.lit(BANK_SENDERS)) & F.rlike(words, F.lit(FETCH_WORDS))
    )
    marks = marks.where(F.col("source") == source)
    since = F.coalesce(F.to_date("last_fetched"), F.trunc(as_of, "month"))
    return (
        wanted.join(marks.select("user_id", "last_fetched"), "user_id", "left")
        .where(F.to_date("sent_at") >= since)
        .drop("last_fetched")
    )


def advance_marks(marks: DataFrame, ingested: DataFrame) -> DataFrame:
    """High-water mark per user and source after landing ``ingested``.

    The mark is the newest landed timestamp, never the clock, so a partial
    fetch loses nothing.
    """
    landed = ingested.select("user_id", "source", F.col("timestamp").alias("last_fetched"))
    return (
        marks.select("user_id", "source", "last_fetched")
        .unionByName(landed)
        .groupBy("user_id", "source")
        .agg(F.max("last_fetched").alias("last_fetched"))
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """One raw transaction table out of several sources; missing columns are null."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
