"""Personal data by weak supervision.

Patterns give candidate spans: strict ones, whose valid matches are always
reported, and loose ones, which may be added where no valid match lies: national
phone numbers, spelt-out addresses, and numbers that a strict pattern misses
because it runs on into the next number. Labelers vote on each candidate, for, against or not at all:
the pattern's own validity, a gazetteer of top-level domains, card issuers,
country codes and address blocks, words of the context, and what touches the
span. Expectation-maximisation on the counts of vote patterns, kind by kind,
estimates how reliable each labeler is and how likely each pattern of votes is
personal data. A logistic regression of the votes and the span's form, trained on
these likelihoods, decides on the loose candidates.

Only counts of vote patterns and forms leave the executors: at most 81 vote
patterns for each of four kinds, times the classes of length and separators.
A null text is empty. Rows that repeat are reported each. Without candidates, or
if all likelihoods agree, nothing is added. Everything is DataFrame functions.
"""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.rows import keyed, located
from ledgerlake.sources.shared import materialise

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored forms of the contract's patterns: a match begins where
# a run begins or the last match ended, so long runs are read once.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: label, pattern, text that a match must contain
PATTERNS = [
    ("email", _EMAIL, "@"),
    ("ip", _IP, "."),
    ("card", _CARD, None),
    ("phone", _PHONE, "+"),
    ("email_loose", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}", None),
    ("card_loose", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])", None),
    (
        "phone_loose",
        r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
        None,
    ),
]

_CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b", r"(?i)\b(?:version|commit)\b"),
    "ip": (r"(?i)\b(?:ip|host|server|address|client|from|login)\b", r"(?i)\b(?:version|release|section|chapter|v)\b"),
    "card": (r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment)?|karte|carte|tarjeta)\b", r"(?i)\b(?:isbn|order|serial|invoice|sku|token|hash)\b"),
    "phone": (r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|tel[eé]fono)\b", r"(?i)\b(?:isbn|order|serial|invoice|sku)\b"),
}
_DOMAINS = "com org net edu gov int mil info biz io co de fr es uk us eu ca au jp in it nl ch at be pl se no dk fi pt ie br mx ar cl nz za kr cn ru".split()

VOTES = ("valid", "known", "context", "edges")
ROUNDS = 30


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(back, value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _valid(kind: Column, text: Column) -> Column:
    """Whether a match passes the check of its kind."""
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    octets = F.forall(F.split(text, r"\."), lambda p: small(p) & (F.substring(p, -3, 3).cast("int") <= 255))
    n = F.length(_digits(text))
    return (
        F.when(kind == "email", F.contains(text, F.lit("@")))
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, F.lit(1)).when(negative, F.lit(-1)).otherwise(F.lit(0))


def candidates(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Candidate spans with their votes and form."""
    spans = located(rows, keys, text, PATTERNS)
    # two digits make a match of the card pattern: shorter than 12 it isn't even a candidate
    spans = spans.filter((F.col("label") != "card") | (F.length("match") >= 12))
    kind = F.regexp_replace("label", "_loose$", "")
    spans = spans.withColumn("kind", kind).withColumn("loose", F.col("label").endswith("_loose"))
    spans = spans.withColumn("passes", _valid(F.col("kind"), F.col("match"))).withColumn("base", F.col("passes") & ~F.col("loose"))
    # a loose candidate gives way where it overlaps a valid match of its kind
    by_kind = W.partitionBy(*keys, "kind").orderBy("start", "end", "label")
    last = F.max(F.when(F.col("base"), F.col("end"))).over(by_kind.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(by_kind.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(last, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("_free", free).filter(~F.col("loose") | F.col("_free"))
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    domain = F.lower(F.regexp_extract("match", r"([A-Za-z]+)$", 1))
    number = _digits(match)
    known = (
        F.when(F.col("kind") == "email", _vote(domain.isin(_DOMAINS), ~domain.isin(_DOMAINS)))
        .when(F.col("kind") == "ip", _vote(match.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9])\."), match.rlike(r"^(?:0|2[3-9][0-9]|[3-9][0-9]{2})\.")))
        .when(F.col("kind") == "card", _vote(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), number.rlike("^[0178]")))
        .otherwise(_vote(match.rlike(r"^\+(?:1|[2-9][0-9])"), match.rlike(r"^\+0")))
    )
    near = F.concat_ws(" ", before, F.left(after, F.lit(12)))
    good = F.coalesce(*[F.when(F.col("kind") == k, near.rlike(p)) for k, (p, _) in _CONTEXT.items()])
    bad = F.coalesce(*[F.when(F.col("kind") == k, near.rlike(n)) for k, (_, n) in _CONTEXT.items()])
    touched = before.rlike(r"[\p{L}\p{N}_#-]$") | after.rlike(r"^[\p{L}\p{N}_-]")
    length = F.length("match")
    return spans.select(
        *keys, "kind", "start", "end", "base", "loose",
        _vote(F.col("passes"), ~F.col("passes")).alias("valid"),
        known.alias("known"),
        _vote(good, bad).alias("context"),
        _vote(~touched, touched).alias("edges"),
        F.when(length < 10, 0).when(length < 14, 1).when(length < 20, 2).when(length < 32, 3).otherwise(4).alias("size"),
        F.least(F.length(F.regexp_replace("match", "[A-Za-z0-9]", "")), F.lit(4)).alias("marks"),
    )


def reliabilities(counts: list[tuple]) -> dict[tuple, float]:
    """EM on rows (kind, votes..., count): how likely each pattern of votes is
    personal data. A labeler is right with one rate for each class."""
    out = {}
    for kind in {row[0] for row in counts}:
        own = [(row[1:-1], row[-1]) for row in counts if row[0] == kind]
        total = sum(n for _, n in own)
        prior, rates = 0.5, {(j, c): 0.8 for j in range(len(VOTES)) for c in (0, 1)}
        for _ in range(ROUNDS):
            likely = {}
            for votes, _ in own:
                odds = math.log(prior / (1 - prior))
                for j, v in enumerate(votes):
                    if v:
                        yes = rates[j, 1] if v > 0 else 1 - rates[j, 1]
                        no = 1 - rates[j, 0] if v > 0 else rates[j, 0]
                        odds += math.log(yes / no)
                likely[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            prior = min(0.99, max(0.01, sum(n * likely[v] for v, n in own) / total))
            for j in range(len(VOTES)):
                for c in (0, 1):
                    weight = lambda v: likely[v] if c else 1 - likely[v]  # noqa: B023, E731
                    voted = sum(n * weight(v) for v, n in own if v[j])
                    right = sum(n * weight(v) for v, n in own if v[j] == (1 if c else -1))
                    # a few votes as assumed above keep the rates from the ends
                    rates[j, c] = (right + 4) / (voted + 5)
        out |= {(kind, *votes): likely[votes] for votes, _ in own}
    return out


def _form(kinds: Column) -> list[Column]:
    """Features: each kind, each labeler's vote for each kind, classes of form."""
    is_kind = [(kinds == k).cast("double") for k in KINDS]
    votes = [k * F.col(v) for k in is_kind for v in VOTES]
    sizes = [(F.col("size") == i).cast("double") for i in range(5)]
    return [*is_kind[1:], *votes, *sizes, F.col("marks") / 4.0]


def train(spans: DataFrame) -> tuple[float, list[float]] | None:
    """The final classifier's bias and weights; None if nothing can be learnt."""
    groups = spans.groupBy("kind", *VOTES, "size", "marks").agg(F.count("*").alias("n")).collect()  # bounded, see above
    counts: dict[tuple, int] = {}
    for g in groups:
        counts[(g["kind"], *[g[v] for v in VOTES])] = counts.get((g["kind"], *[g[v] for v in VOTES]), 0) + g["n"]
    likely = reliabilities([(*k, n) for k, n in counts.items()])
    rows = []
    for g in groups:
        p = likely[(g["kind"], *[g[v] for v in VOTES])]
        for label, weight in ((1.0, p), (0.0, 1 - p)):
            rows.append((g["kind"], *[g[v] for v in VOTES], g["size"], g["marks"], label, weight * g["n"]))
    if not rows or all(r[-1] < 1e-6 for r in rows if r[-2]) or all(r[-1] < 1e-6 for r in rows if not r[-2]):
        return None
    schema = "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", size int, marks int, label double, weight double"
    table = spans.sparkSession.createDataFrame(sorted(rows), schema).coalesce(1)
    table = table.select("label", "weight", array_to_vector(F.array(*_form(F.col("kind")))).alias("features"))
    fitted = LogisticRegression(weightCol="weight", maxIter=25, regParam=1e-3, standardization=False).fit(table)
    return float(fitted.intercept), [float(x) for x in fitted.coefficients]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col`` and ``found`` of every row: structs of ``order`` (of the
    kind), ``start``, ``kind``, ``end``, ``base``, by kind, then start."""
    keys = ["_a", "_b"]
    rows = keyed(docs, id_col, text_col)
    spans = materialise(candidates(rows, keys, "_text"), "personal-candidates")
    fitted = train(spans)
    if fitted:
        bias, weights = fitted
        score = F.lit(bias)
        for w, x in zip(weights, _form(F.col("kind")), strict=True):
            score = score + F.lit(w) * x
        chosen = score >= math.log(threshold / (1 - threshold))
    else:
        chosen = F.lit(False)
    spans = spans.filter(F.col("base") | (F.col("loose") & chosen))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    one = F.struct(order.alias("order"), F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), "base")
    by_doc = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("found"))
    kind = by_doc.schema["found"].dataType.simpleString()
    joined = rows.select("_id", *keys).join(by_doc, keys, "left")
    return joined.select(F.col("_id").alias(id_col), F.coalesce("found", F.expr(f"cast(array() as {kind})")).alias("found"))
