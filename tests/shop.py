"""Small hand-made order lines."""

from __future__ import annotations

import datetime as dt

SCHEMA = (
    "cid bigint, bid bigint, iid string, catid string, classid string, quantity double, "
    "price double, segmentationlabel string, marketid int, checkoutdate timestamp_ntz, days int"
)
TODAY = dt.datetime(2024, 1, 31)


def line(cid, bid, days, iid, price=1000.0, **other):
    row = dict(
        cid=cid, bid=bid, iid=iid, catid=iid, classid="c", quantity=1.0, price=float(price),
        segmentationlabel="loyal", marketid=1, checkoutdate=TODAY - dt.timedelta(days=days),
        days=days,
    )
    row.update(other)
    return tuple(row.values())


def lines(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def four_baskets(spark):
    """One customer, four baskets: A and B re-ordered, D new in the last one."""
    return lines(spark, [
        line(1, 1, 30, "A", 100), line(1, 1, 30, "B", 50),
        line(1, 2, 20, "A", 120),
        line(1, 3, 10, "A", 90), line(1, 3, 10, "C", 40),
        line(1, 4, 0, "B", 55), line(1, 4, 0, "D", 70),
    ])
