import datetime as dt

from conftest import txn_frame

from ledgerlens.operators import anomalies as W
from ledgerlens.operators import report as R
from ledgerlens.operators import summary as A


def test_sample_statement_summary(sample):
    r = A.financial_summary(sample).collect()[0]
    assert r.total_income == 2823.10
    assert r.total_expenses == 1463.10
    assert r.net_cashflow == 1360.00
    assert r.transaction_count == 12
    assert r.avg_expense == 146.31
    assert r.largest_expense == 1250.00
    months = sorted((m.month, m.income, m.expenses) for m in A.monthly_breakdown(sample).collect())
    assert months == [("2023-05", 2823.10, 1433.90), ("2023-06", 0.0, 29.20)]


def test_sample_statement_has_no_anomalies(sample):
    # The repeated charge is 18 days apart; no category has 9 expenses.
    assert W.anomalies(sample).count() == 0


def test_one_category_sample_flags_rent(sample):
    # All ten expenses in one category: max z for n = 10 is 2.85 > 2.5.
    from pyspark.sql import functions as F

    hits = W.zscore_anomalies(sample.withColumn("category", F.lit("Other"))).collect()
    assert [h.description for h in hits] == ["TIDEWATER LETTINGS"]
    assert hits[0].reason == "Unusually large for Other (z=2.84, avg=$146.31)"


def test_summary_text(sample):
    text = R.summary_text(A.summary_record(sample)).collect()[0].summary_text
    lines = text.split("\n")
    assert lines[0] == "- Total Income:      $2,823.10"
    assert lines[3] == "- Transaction Count: 12.0"
    assert lines[5] == "- Largest Expense:   $1,250.00"
    assert lines[7] == "Spending by Category:"
    assert lines[8] == "  • Rent & Housing: $1,250.00 (1 transactions)"
    assert lines[10] == "  • Transportation: $40.00 (1 transactions)"
    assert lines[-2:] == ["  • 2023-05: Income $2,823.10 | Expenses $1,433.90", "  • 2023-06: Income $0.00 | Expenses $29.20"]


def test_money_is_rounded_once_at_the_end(spark):
    # 1,000 expenses of 0.004 are 4.00; a NaN amount is a missing one.
    day = dt.datetime(2024, 1, 1)
    rows = [(1, i, day, f"S {i}", -0.004, "c") for i in range(1000)]
    rows += [(1, 1000, day, "N", float("nan"), "c"), (1, 1001, day, "H", 0.125, "c"), (1, 1002, day, "H", 0.25, "c")]
    t = txn_frame(spark, rows)
    r = A.financial_summary(t).collect()[0]
    assert (r.total_expenses, r.total_income, r.net_cashflow, r.transaction_count) == (4.0, 0.38, -3.63, 1003)
    assert (r.avg_expense, r.largest_expense) == (0.0, 0.0)
    assert [(x.total, x["count"]) for x in A.spending_by_category(t).collect()] == [(4.0, 1000)]
    assert [(m.income, m.expenses) for m in A.monthly_breakdown(t).collect()] == [(0.375, 4.0)]  # breakdowns are not rounded
    assert A.flatten_summary(A.summary_record(t)).collect()[0].total_expenses == 4.0
    assert W.anomalies(t).filter("method = 'z_score'").count() == 0


def test_no_expenses_gives_zero_defaults(spark):
    t = txn_frame(spark, [(7, 1, dt.datetime(2024, 1, 1), "PAY", 10.0, "x")])
    r = A.financial_summary(t).collect()[0]
    assert (r.total_expenses, r.avg_expense, r.largest_expense) == (0.0, 0.0, 0.0)
    assert W.anomalies(t).count() == 0


def _group(spark, n, huge, base=10.0):
    d0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, d0 + dt.timedelta(days=10 * i), f"SHOP {i}", -base, "c") for i in range(n - 1)]
    rows.append((1, n - 1, d0 + dt.timedelta(days=10 * n), "BIG", -huge, "c"))
    return txn_frame(spark, rows)


def test_zscore_needs_nine_rows(spark):
    # Largest possible sample z in a group of n is (n-1)/sqrt(n): 2.475 for 8.
    assert W.zscore_anomalies(_group(spark, 8, 1e6)).count() == 0
    hits = W.zscore_anomalies(_group(spark, 9, 1e6)).collect()
    assert len(hits) == 1 and hits[0].description == "BIG"
    assert hits[0].reason.startswith("Unusually large for c (z=2.67, avg=$")


def test_zscore_constant_group_and_threshold(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1 + i), "X", -5.0, "c") for i in range(12)]
    assert W.zscore_anomalies(txn_frame(spark, rows)).count() == 0
    g = _group(spark, 20, 500.0)
    n_low = W.zscore_anomalies(g, threshold=1.0).count()
    n_high = W.zscore_anomalies(g, threshold=3.0).count()
    assert n_low >= n_high


def test_duplicate_gaps(spark):
    d = dt.datetime(2024, 3, 1, 12, 0)
    rows = []
    for k, gap in enumerate([0, 1, 3, 4]):
        desc = f"GAP{gap}"
        rows += [(1, 10 * k, d, desc, -9.0, "c"), (1, 10 * k + 1, d + dt.timedelta(days=gap), desc, -9.0, "c")]
    # 10, 20, 10 on successive days: neighbours differ, nothing flags.
    rows += [(1, 100, d, "ALT", -10.0, "c"), (1, 101, d + dt.timedelta(days=1), "ALT", -20.0, "c"),
             (1, 102, d + dt.timedelta(days=2), "ALT", -10.0, "c")]
    # 23:50 -> 00:10 next day is 0 elapsed whole days.
    rows += [(1, 200, dt.datetime(2024, 3, 5, 23, 50), "NIGHT", -3.0, "c"),
             (1, 201, dt.datetime(2024, 3, 6, 0, 10), "NIGHT", -3.0, "c")]
    # An unparsed date never flags.
    rows += [(1, 300, None, "NODATE", -1.0, "c"), (1, 301, None, "NODATE", -1.0, "c")]
    got = {(r.description, r.reason) for r in W.duplicate_charges(txn_frame(spark, rows)).collect()}
    assert got == {
        ("GAP0", "Possible duplicate — same amount charged 0 day(s) apart"),
        ("GAP1", "Possible duplicate — same amount charged 1 day(s) apart"),
        ("GAP3", "Possible duplicate — same amount charged 3 day(s) apart"),
        ("NIGHT", "Possible duplicate — same amount charged 0 day(s) apart"),
    }


def test_duplicates_cross_day_buckets(spark):
    # Previous row found across several empty days (bucket hand-over).
    d = dt.datetime(2024, 5, 1, 8)
    rows = [(1, 1, d, "GYM", -30.0, "c"), (1, 2, d + dt.timedelta(days=3, hours=2), "GYM", -30.0, "c"),
            (1, 3, d + dt.timedelta(days=9), "GYM", -30.0, "c")]
    got = [r.txn_id for r in W.duplicate_charges(txn_frame(spark, rows)).collect()]
    assert got == [2]


def test_anomaly_marking_by_description(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [(1, 1, d, "A", -5.0, "c"), (1, 2, d + dt.timedelta(days=1), "A", -5.0, "c"),
            (1, 3, d + dt.timedelta(days=30), "A", -7.0, "c"), (1, 4, d, "B", -1.0, "c")]
    t = txn_frame(spark, rows)
    found = W.anomalies(t)
    marked = {r.txn_id: r.is_anomaly for r in W.mark_anomalies(t, found).collect()}
    assert marked == {1: True, 2: True, 3: True, 4: False}


def test_summary_record_edge_groups(spark):
    """Null category is its own expense group; an income-only category is
    not listed; equal totals rank by category; the null month sorts first."""
    d = dt.datetime(2024, 2, 3)
    rows = [
        (1, 1, d, "A", -5.0, "b"),
        (1, 2, d, "B", -5.0, "a"),
        (1, 3, None, "C", -2.5, None),
        (1, 4, d + dt.timedelta(days=40), "D", 100.0, "pay"),
        (1, 5, d, "E", 0.0, "zero"),
    ]
    r = A.summary_record(txn_frame(spark, rows)).collect()[0]
    assert [(c.category, c.total, c["count"]) for c in r.spending_by_category] == [
        ("a", 5.0, 1), ("b", 5.0, 1), (None, 2.5, 1)
    ]
    assert [(m.month, m.income, m.expenses) for m in r.monthly_breakdown] == [
        (None, 0.0, 2.5), ("2024-02", 0.0, 10.0), ("2024-03", 100.0, 0.0)
    ]
    assert (r.total_income, r.total_expenses, r.net_cashflow, r.transaction_count) == (100.0, 12.5, 87.5, 5)
    assert (r.avg_expense, r.largest_expense) == (4.17, 5.0)


def test_empty_input_gives_empty_results(spark):
    t = txn_frame(spark, [(1, 1, dt.datetime(2024, 1, 1), "X", -1.0, "c")]).limit(0)
    assert A.summary_record(t).count() == 0
    assert W.anomalies(t).count() == 0
