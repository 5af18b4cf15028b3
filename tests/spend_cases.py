"""Small tables of the spend side that several tests share."""

import datetime as dt
import random
from decimal import Decimal

from ledgerlake import schema as S
from ledgerlake.workload import views as V

START = dt.datetime(2024, 1, 1)


def make_raw(spark, n=400, seed=1):
    """A third of the rows are copies of one payment; ids are shuffled."""
    r = random.Random(seed)
    ids = list(range(n))
    r.shuffle(ids)
    rows = []
    for i in ids:
        if i % 3 == 0:
            rows.append((i, "hot", Decimal("10.00"), " Shop ", "debit", START, "file", "t", None))
        else:
            at = START + dt.timedelta(hours=r.randint(0, 90 * 24))
            rows.append((i, f"u{i % 7}", Decimal(r.randint(1, 4)), r.choice(V.RECEIVERS), None, at,
                         r.choice(["file", "gmail", None]), "t", None))
    return spark.createDataFrame(rows, S.TRANSACTIONS)


def make_feedback(spark, n=240, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((
            "Hot" if hot else f"u{i % 4}", i, "Big  Shop" if hot else r.choice(["A", "B b"]), None,
            None, r.choice(S.CATEGORIES[:4] + ["Pets"]), Decimal(r.choice([0, 100, 101])),
            START + dt.timedelta(minutes=r.randint(0, 200) // 20 * 20)))
    return rows, spark.createDataFrame(rows, S.FEEDBACK)


def make_silver(spark, n=200, seed=9):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c = r.choice(S.CATEGORIES[:3] + [None])
        rows.append((i, i, "hot" if i % 3 == 0 else f"u{i % 3}", Decimal(r.randint(1, 99)), "M",
                     "debit", dt.date(2024, r.randint(1, 12), 5), "file", c, c is not None,
                     False, None, None))
    return spark.createDataFrame(rows, S.SILVER)


def make_corrections(spark, silver):
    rows = []
    for row in silver.collect():
        if row.silver_id % 5 == 0:
            for j, c in enumerate(["Food", "Pets", "Health"]):
                rows.append((row.silver_id, row.user_id, "M", None, None, c, row.amount,
                             START + dt.timedelta(seconds=j)))
    rows.append((10_000, "hot", "M", None, None, "Food", Decimal(1), START))
    rows.append((0, "somebody else", "M", None, None, "Food", Decimal(1), START))
    return spark.createDataFrame([(r[1], r[0], *r[2:]) for r in rows], S.FEEDBACK)
