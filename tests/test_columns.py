"""Cleaning functions on hand-derived cases."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import dates, text
from ledgerlake.functions.rules import MERCHANT_RULES, merchant_rule


def values(spark, inputs, function):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.select(function(F.col("x")).alias("y"), "i").orderBy("i")
            .select("y").collect()]


def check(spark, function, cases):
    assert values(spark, [c[0] for c in cases], function) == [c[1] for c in cases]


def test_clean_amount(spark):
    got = values(spark, ["1,234.50", "-500", "(500)", "1.2.3", ".", "", None, "Rs 12", "5."],
                 text.clean_amount)
    assert [None if v is None else float(v) for v in got] == [
        1234.5, 500.0, 500.0, None, None, None, None, 12.0, 5.0]


def test_parse_date_is_day_first(spark):
    got = values(spark, ["03/04/2024", "31-12-2023", "2024-03-04 10:11:12", " 5 Jan 2024 ", "n/a",
                         "", None], text.parse_date)
    assert [v and v.isoformat() for v in got] == [
        "2024-04-03T00:00:00", "2023-12-31T00:00:00", "2024-03-04T10:11:12",
        "2024-01-05T00:00:00", None, None, None]


@pytest.mark.parametrize("written, read", [
    ("15-Jan-24", "2024-01-15T00:00:00"),
    ("2024/01/15", "2024-01-15T00:00:00"),
    ("15.01.2024", "2024-01-15T00:00:00"),
    ("15 January 2024", "2024-01-15T00:00:00"),
    ("15 Jan, 2024", "2024-01-15T00:00:00"),
    ("15/01/2024 10:30", "2024-01-15T10:30:00"),
    ("01-02-2024 10:11:12", "2024-02-01T10:11:12"),
    ("2024-01-15T10:11:12Z", "2024-01-15T10:11:12"),
    ("2024-01-15T10:11:12.250+05:30", "2024-01-15T10:11:12"),
    ("1/2/24", "2024-02-01T00:00:00"),
    ("31/02/2024", None),
    ("2024", None),
])
def test_date_shapes(spark, written, read):
    got = values(spark, [written], text.parse_date)[0]
    assert (got and got.isoformat()) == read


def test_upi_merchant(spark):
    check(spark, text.upi_merchant, [
        ("VPA paytm.k00abc@pbank Juniper Bakery Q", "Juniper Bakery"),
        ("VPA swiggy@qq", None),
        ("Cupid Flowers", "Cupid Flowers"),
        ("Plain Shop", None),
        ("vpa a@b Lower initial x", "Lower initial x"),
        (None, None),
    ])


def test_clean_merchant(spark):
    check(spark, text.clean_merchant, [
        ("VPA swiggy@qq", "Swiggy"),
        ("Kivi Umbrellas", "Vi"),
        ("Amazon Prime Annual", "Amazon"),
        ("coin.zerodha deposit", "Zerodha"),
        ("Cupid Flowers", "Cupid Flowers"),
        ("Ola Auto", "Ola"),
        ("Motorola Kiosk", "Kiosk"),
        ("Tata 1mg", "1mg"),
        ("CRED Rent", "CRED"),
        ("Credit Circle", "Circle"),
        ("zx12qv9 Second Sample", "Second Sample"),
        ("Dr. Third Sample", "Third Sample"),
        ("NEFT Quill Books 555000111", "Quill Books"),
        ("IMPS 111122223333", "Unknown"),
        ("a  b", "a b"),
        ("", "Unknown"),
        (None, "Unknown"),
        ("x" * 5 + " " + "y" * 300, "x" * 5 + " " + "y" * 300),
    ])


def test_as_coded_leaves_out_repaired_rules(spark):
    got = values(spark, ["ola auto", "tata 1mg", "cred rent", "swiggy"],
                 lambda c: merchant_rule(c, as_coded=True))
    assert got == [None, None, None, "Swiggy"]


def test_rules_agree_with_plain_regex_search(spark):
    """Every rule gets its own text, and the order decides collisions."""
    texts = []
    for pattern, _ in MERCHANT_RULES:
        for part in re.split(r"\|(?![^(]*\))", pattern):
            plain = part.replace(r"\b", "").replace(r"\s*", " ").replace("\\", "")
            plain = re.sub(r"\(([a-z]+)[^)]*\)\??", r"\1", plain).replace("?", "")
            texts += [plain, f"xx {plain} yy", f"xx{plain}yy"]

    def expected(value):
        for pattern, name in MERCHANT_RULES:
            if re.search("(?i)" + pattern, value):
                return name
        return None

    assert values(spark, texts, merchant_rule) == [expected(t) for t in texts]
    reached = {expected(t) for t in texts}
    assert reached >= {name for _, name in MERCHANT_RULES} - {"Zerodha Coin"}


def test_preprocess_text(spark):
    check(spark, text.preprocess_text, [
        ("VPA dinner-swiggy@qbk Swiggy Private Limited", "swiggy"),
        ("VPA swiggy@qq", "swiggy qq"),
        ("VPA paytmqr7zx9@pbank SILVER OAK DISPENSARY", "silver oak dispensary"),
        ("paytmqr7zx9abc", ""),
        ("UPI/100200300400/Saffron Tea", "saffron tea"),
        (None, ""),
    ])


def test_looks_like_person(spark):
    check(spark, text.looks_like_person, [
        ("Sample Person", True),
        ("another sample person", True),
        ("VPA a@b Orbit Hardware", True),
        ("Orbit Stores Bank", False),
        ("Orbit", False),
        ("Orbit H", False),
        ("Sample Person 2", False),
        (None, False),
    ])


def test_fingerprint_ignores_time_case_and_blanks(spark):
    rows = spark.sql("""
        select * from values
          ('u', 10.0, ' Shop ', timestamp_ntz'2024-01-01 10:00:00'),
          ('u', 10.00, 'shop', timestamp_ntz'2024-01-01 23:00:00'),
          ('u', 10.0, 'shop', timestamp_ntz'2024-01-02 00:00:00'),
          ('u', 10.0, cast(null as string), timestamp_ntz'2024-01-02 00:00:00') as t(u, a, r, t)""")
    got = [r[0] for r in rows.select(
        text.fingerprint(F.col("u"), F.col("a"), F.col("r"), F.col("t"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and all(len(g) == 64 for g in got)
    parts = spark.sql("""
        select * from values (cast(null as string), cast(5.00 as decimal(18,2)), 's'),
          ('5.00', cast(null as decimal(18,2)), 's') as t(u, a, r)""")
    day = F.lit(None).cast("timestamp_ntz")
    prints = parts.select(text.fingerprint(F.col("u"), F.col("a"), F.col("r"), day)).collect()
    assert prints[0] != prints[1]


@pytest.mark.parametrize("receiver, expected", [
    ("Swiggy", ["Swiggy", "swiggy", "VPA Swiggy"]),
    ("VPA a@b Shop One", ["VPA a@b Shop One", "vpa a@b shop one", "VPA Shop One", "vpa shop one",
                          "VPAa@bShopOne"]),
    ("a@b", ["a@b", "VPA a@b"]),
])
def test_text_variants(spark, receiver, expected):
    assert values(spark, [receiver], text.text_variants) == [expected]


def test_month_window_rolls_over_the_year(spark):
    row = spark.sql("select date'2023-12-17' as d").select(
        dates.month_of(F.col("d")).alias("m")).select(
        "m", dates.next_month(F.col("m")).alias("n")).first()
    assert (str(row.m), str(row.n)) == ("2023-12-01", "2024-01-01")
