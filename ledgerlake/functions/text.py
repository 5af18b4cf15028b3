"""Column functions that clean amounts, dates, receivers and model text.

Patterns use ``(?U)`` so that ``\\s``, ``\\b`` and ``\\w`` cover Unicode, and
every function is a plain column expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.blocks import let
from ledgerlake.functions.rules import merchant_rule

# Every character that counts as white space when stripping.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)

# Patterns of payment-address text.
UPI_MARKS = ["@", "vpa", "upi"]
VPA_PREFIX = r"(?iU)^vpa\s*"
VPA_WORD = r"(?iU)^VPA\s+"
HANDLE = r"(?U)\S+@\S+\s*"
TRAILING_INITIAL = r"(?U)\s+[A-Z]\s*$"

# Generic receiver clean-up, applied in this order.
GENERIC_CLEANUP = [
    r"(?iU)^[a-z0-9]{6,}\s+",
    r"(?iU)\b(Mr|Mrs|Miss|Dr|Shri)\b\.?\s*",
    r"(?U)[/@]\S+",
    r"(?U)\d{6,}",
    r"(?iU)\b(UPI|NEFT|IMPS|RTGS|VPA)\b",
]

# Words and shapes used to prepare text for the classifier.
GATEWAY_PREFIX = r"(?iU)\b(paytmqr|gpay-|paytm\.)[a-zA-Z0-9-]+\b"
SEPARATORS = "[/@.]"
LONG_NUMBER = r"(?U)\b\d{4,}\b"
NOISE_WORDS = (
    r"(?iU)\b(pvt|ltd|pte|inc|llp|llc|private|limited|"
    r"payment|online|india|tech|services|w|g|rzp|upi)\b"
)

# What marks a business, and the shape of a person's name.
BUSINESS_WORDS = (
    r"(?iU)\b(store|shop|mart|foods|kitchen|cafe|pvt|ltd|solutions|services|"
    r"enterprises|technologies|consultancy|agency|studio|lab|clinic|hospital|"
    r"pharmacy|pay|payments|bank|finance|credit|capital|ventures)\b"
)
PERSON_NAME = r"(?U)^[A-Za-z]{2,}\s+[A-Za-z]{2,}(\s+[A-Za-z]{2,})?$"

# Day first; separators are made dashes before (see ``parse_date``).
_TIME_OF_DAY = "[ H:mm[:ss]]"
STATEMENT_DATE_FORMATS = [
    f"{day}{_TIME_OF_DAY}"
    for day in ("d-M-yyyy", "yyyy-M-d", "d-M-yy", "d-MMM-yyyy", "d-MMM-yy", "d-MMMM-yyyy")
]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_key(text: Column) -> Column:
    """Key under which history and overrides are stored."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def clean_amount(text: Column) -> Column:
    """Keep digits and points, then read a decimal; null if that fails."""
    digits = F.regexp_replace(text, "[^0-9.]", "")
    return F.nullif(digits, F.lit("")).try_cast(S.MONEY)


def parse_date(text: Column, formats: list[str] = STATEMENT_DATE_FORMATS) -> Column:
    """First format that fits, day first by default; null if none does.

    Slashes, points, blanks and commas between the parts of a day count as
    dashes, a ``T`` before the time as a blank. Fractions of a second and a
    zone are dropped: the wall-clock time counts.
    """
    trimmed = strip(text)
    day = F.regexp_replace(
        trimmed, r"^(\d{1,2})[-/. ]+([A-Za-z]+|\d{1,2})[-/., ]+(\d{2,4})", "$1-$2-$3"
    )
    day = F.regexp_replace(day, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1-$2-$3")
    plain = F.regexp_replace(day, r"(?<=\d)T(?=\d)", " ")
    plain = F.regexp_replace(plain, r"(:\d{2})(?:[.,]\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?$", "$1")
    return let(
        plain,
        lambda d: F.coalesce(
            *[F.try_to_timestamp(d, F.lit(f)).cast("timestamp_ntz") for f in formats]
        ),
    )


def fingerprint(user: Column, amount: Column, receiver: Column, timestamp: Column) -> Column:
    """SHA-256 over user, amount, receiver and day: one value per real payment.

    A null part is an empty one, so it can't be mistaken for its neighbour.
    """
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce(user, F.lit("")),
            F.coalesce(amount.cast(S.MONEY).cast("string"), F.lit("")),
            F.lower(strip(F.coalesce(receiver, F.lit("")))),
            F.coalesce(F.to_date(timestamp).cast("string"), F.lit("")),
        ),
        256,
    )


def without_handles(text: Column) -> Column:
    return strip(F.regexp_replace(text, HANDLE, ""))


def _is_payment_address(text: Column) -> Column:
    lowered = F.lower(text)
    first, *rest = [F.contains(lowered, F.lit(mark)) for mark in UPI_MARKS]
    for mark in rest:
        first = first | mark
    return first


def upi_merchant(text: Column) -> Column:
    """Name that follows the payment handle; null when there is none."""
    name = without_handles(strip(F.regexp_replace(text, VPA_PREFIX, "")))
    return F.when(
        _is_payment_address(text),
        let(
            name,
            lambda n: F.when(
                F.length(n) >= 3, strip(F.regexp_replace(n, TRAILING_INITIAL, ""))
            ),
        ),
    )


def generic_name(text: Column) -> Column:
    """Receiver without codes, honorifics and rail words."""
    for pattern in GENERIC_CLEANUP:
        text = F.regexp_replace(text, pattern, "")
    return squeeze(text)


def clean_merchant(receiver: Column, as_coded: bool = False) -> Column:
    """Merchant of a receiver text: a rule's name, else the name behind the
    payment handle, else the receiver without its codes; never empty.

    Pure projection: no shuffle, so a receiver that fills a third of the
    table does no harm.
    """

    def by_rule(named: Column) -> Column:
        return let(
            F.lower(F.coalesce(named, receiver)), lambda text: merchant_rule(text, as_coded)
        )

    def by_name(named: Column) -> Column:
        return F.when(named.isNotNull(), squeeze(named)).otherwise(generic_name(receiver))

    return let(
        let(upi_merchant(receiver), lambda named: F.coalesce(by_rule(named), by_name(named))),
        lambda name: F.coalesce(F.when(name != "", name), F.lit("Unknown")),
    )


def with_merchant(
    df: DataFrame, receiver: str = "receiver", out: str = "merchant", as_coded: bool = False
) -> DataFrame:
    """Add the cleaned merchant name."""
    return df.withColumn(out, clean_merchant(F.col(receiver), as_coded))


def preprocess_text(text: Column) -> Column:
    """Text as the classifier sees it, in training and in scoring alike."""

    def without_handle(bare: Column) -> Column:
        return let(
            without_handles(bare),
            lambda after: F.when(F.length(after) >= 3, after).otherwise(bare),
        )

    working = let(
        strip(F.regexp_replace(F.coalesce(text, F.lit("")), VPA_WORD, "")), without_handle
    )
    for pattern in (GATEWAY_PREFIX, SEPARATORS, LONG_NUMBER, NOISE_WORDS):
        working = F.regexp_replace(working, pattern, " ")
    return F.lower(squeeze(working))


def looks_like_person(receiver: Column) -> Column:
    """Two or three alphabetic words, none of them a business word."""
    return let(
        without_handles(F.coalesce(receiver, F.lit(""))),
        lambda name: F.rlike(name, F.lit(PERSON_NAME)) & ~F.rlike(name, F.lit(BUSINESS_WORDS)),
    )


def text_variants(text: Column) -> Column:
    """Distinct spellings under which a training text may arrive, in order."""
    bare = without_handles(text)
    has_bare = (bare != "") & (bare != text)
    return F.array_distinct(
        F.array_compact(
            F.array(
                text,
                F.lower(text),
                F.when(has_bare, bare),
                F.when(has_bare, F.lower(bare)),
                F.when(
                    ~F.startswith(F.upper(text), F.lit("VPA")),
                    F.concat(F.lit("VPA "), F.coalesce(F.nullif(bare, F.lit("")), text)),
                ),
                F.when(F.contains(text, F.lit("@")), F.replace(text, F.lit(" "), F.lit(""))),
            )
        )
    )
