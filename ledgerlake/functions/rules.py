r"""The merchant rules and their compilation to one column expression."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.blocks import struct_array

# Fixed values: (pattern, merchant). Case-insensitive, unanchored, first match
# wins, so the order is part of the meaning.
MERCHANT_RULES = [
    ("swiggy", "Swiggy"),
    ("zomato", "Zomato"),
    ("dunzo", "Dunzo"),
    ("eatclub", "EatClub"),
    ("faasos", "Faasos"),
    ("box8", "Box8"),
    ("freshmenu", "FreshMenu"),
    ("kfc", "KFC"),
    ("mcdonalds|mcdonald", "McDonald's"),
    ("dominos|domino", "Domino's"),
    ("subway", "Subway"),
    (r"burger\s*king", "Burger King"),
    (r"pizza\s*hut", "Pizza Hut"),
    ("starbucks", "Starbucks"),
    (r"cafe\s*coffee|ccd", "CCD"),
    ("blinkit|grofers", "Blinkit"),
    ("zepto", "Zepto"),
    ("bigbasket", "BigBasket"),
    ("dmart", "DMart"),
    ("jiomart", "JioMart"),
    ("milkbasket", "Milkbasket"),
    ("amazon", "Amazon"),
    ("flipkart", "Flipkart"),
    ("myntra", "Myntra"),
    ("ajio", "AJIO"),
    ("nykaa", "Nykaa"),
    ("meesho", "Meesho"),
    ("uber", "Uber"),
    (r"\bola\b", "Ola"),
    ("rapido", "Rapido"),
    ("irctc", "IRCTC"),
    ("makemytrip|mmt", "MakeMyTrip"),
    ("redbus", "RedBus"),
    ("cleartrip", "Cleartrip"),
    ("indigo", "IndiGo"),
    ("groww", "Groww"),
    ("zerodha", "Zerodha"),
    ("kuvera", "Kuvera"),
    (r"coin\.zerodha", "Zerodha Coin"),
    (r"mutual\s*fund", "Mutual Fund"),
    ("iccl|nsccl", "Stock Settlement"),
    ("netflix", "Netflix"),
    ("spotify", "Spotify"),
    ("hotstar|disney", "Disney+ Hotstar"),
    ("youtube|youtubepremium", "YouTube Premium"),
    (r"apple\s*media|apple\s*service", "Apple Services"),
    (r"prime\s*video|primevideo", "Amazon Prime"),
    ("zee5", "ZEE5"),
    ("sonyliv", "SonyLIV"),
    (r"\bjio\b", "Jio"),
    ("airtel", "Airtel"),
    ("bsnl", "BSNL"),
    (r"\bvilpremum\b", "Vi"),
    (r"vi\b|vodafone|idea", "Vi"),
    (r"electricity|bescom|msedcl|tpddl|adani\s*electric", "Electricity"),
    (r"water\s*board|water\s*supply|bwssb", "Water Bill"),
    (r"gas\s*(supply|bill)|mahanagar\s*gas|indraprastha", "Gas Bill"),
    (r"indian\s*railways?\s*(uts)?", "Indian Railways UTS"),
    (r"\biruts\b", "Indian Railways UTS"),
    ("apollo", "Apollo Pharmacy"),
    (r"\b1mg\b", "1mg"),
    ("pharmeasy", "PharmEasy"),
    ("netmeds", "Netmeds"),
    ("medplus", "MedPlus"),
    (r"global\s*medical", "Medical Store"),
    ("paytm", "Paytm"),
    ("phonepe", "PhonePe"),
    (r"gpay|google\s*pay", "Google Pay"),
    ("mobikwik", "MobiKwik"),
    (r"cred\b", "CRED"),
]

# Merchants whose rule only works as repaired above (word
# boundaries); ``as_coded=True`` leaves them out.
REPAIRED_RULES = {"Ola", "1mg", "CRED"}

_LITERAL = re.compile("[a-z0-9]+")
# Top-level alternatives: a bar inside parentheses does not separate them.
_BAR = re.compile(r"\|(?![^(]*\))")


def rule_table(as_coded: bool = False) -> list[tuple[int, str, str]]:
    """The rules in force as (position, pattern, merchant)."""
    return [
        (i, pattern, name)
        for i, (pattern, name) in enumerate(MERCHANT_RULES)
        if not (as_coded and name in REPAIRED_RULES)
    ]


def _alternatives(as_coded: bool) -> Column:
    """One entry per alternative of every rule, in rule order, as a constant.

    ``word`` is the pattern's leading word; ``pattern`` is null when the word
    is the whole pattern. A substring search is several times cheaper than a
    regex search, so the word is looked for first and the regex seldom runs.
    """
    entries = []
    for _, pattern, name in rule_table(as_coded):
        for part in _BAR.split(pattern):
            word = _LITERAL.search(part.removeprefix(r"\b")).group()
            regex = None if word == part else "(?U)" + part
            entries.append({"word": word, "pattern": regex, "merchant": name})
    return struct_array(entries)


def merchant_rule(lowered: Column, as_coded: bool = False) -> Column:
    """Merchant of the first matching rule, or null; takes lower-case text.

    The rules are data scanned by one small expression. Written out as a
    70-way CASE the generated method passes the size the JVM still compiles
    and runs about five times slower.
    """
    hits = F.filter(
        _alternatives(as_coded),
        lambda rule: F.contains(lowered, rule["word"])
        & (rule["pattern"].isNull() | F.rlike(lowered, rule["pattern"])),
    )
    return F.try_element_at(hits, F.lit(1))["merchant"]
