import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


# An invented statement: one transaction every third day from 2023-05-02.
STATEMENT = [
    ("HARBOR BAKERY", -8.40, "Food & Dining"), ("FERNHILL PAYROLL", 2800.00, "Income & Salary"),
    ("TIDEWATER LETTINGS", -1250.00, "Rent & Housing"), ("GAS AND LIGHT CO", -61.35, "Utilities"),
    ("CORNER BOOKS", -23.10, "Shopping"), ("METRO CARD", -40.00, "Transportation"),
    ("HARBOR BAKERY", -8.40, "Food & Dining"), ("LUMEN CLIMBING", -29.90, "Health & Medical"),
    ("CORNER BOOKS REFUND", 23.10, "Shopping"), ("PARCEL POST", -12.75, "Other"),
    ("DRY CLEANER", -18.00, "Other"), ("HARBOR BAKERY", -11.20, "Food & Dining"),
]


@pytest.fixture(scope="session")
def sample(spark):
    import datetime as dt

    rows = []
    for i, (desc, amount, category) in enumerate(STATEMENT):
        d = dt.datetime(2023, 5, 2) + dt.timedelta(days=3 * i)
        rows.append((1, i, d.strftime("%Y-%m-%d"), d, desc, amount, "credit" if amount > 0 else "debit", category))
    return spark.createDataFrame(
        rows,
        "statement_id long, txn_id long, date string, ts timestamp_ntz, description string, amount double, "
        "type string, category string",
    )


def txn_frame(spark, rows):
    """rows: (statement_id, txn_id, ts datetime or None, description, amount, category)."""
    data = [
        (s, t, ts.strftime("%Y-%m-%d") if ts else None, ts, d, a, "credit" if a > 0 else "debit", c)
        for s, t, ts, d, a, c in rows
    ]
    return spark.createDataFrame(
        data,
        "statement_id long, txn_id long, date string, ts timestamp_ntz, description string, amount double, "
        "type string, category string",
    )
