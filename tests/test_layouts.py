"""Inference of statement layouts (E5) on statements worked by hand."""

import pytest

from ledgerlens.operators.layouts import infer_transactions


def infer(spark, *pages):
    """pages: (statement_id, text) in page order."""
    seen = {}
    rows = []
    for sid, text in pages:
        seen[sid] = seen.get(sid, 0) + 1
        rows.append((sid, seen[sid], text))
    kept, rejects, layouts = infer_transactions(spark.createDataFrame(rows, "statement_id long, page_num int, text string"))
    key = lambda r: (r.statement_id, r.page_num, r.item_idx)
    return sorted(kept.collect(), key=key), sorted(rejects.collect(), key=key), {r.statement_id: r for r in layouts.collect()}


def short(rows):
    return [(r.date, r.description, r.amount, r.balance) for r in rows]


DEBIT_CREDIT = """Northgate Bank
Date        Description            Paid out    Paid in     Balance
            Opening balance                                 100.00
13/02/2023  CORNER BOOKS              20.00                  80.00
14/02/2023  PAYROLL                              50.00      130.00
01/03/2023  RENT MARCH               120.00                  10.00
"""

TRAILING_MINUS = """Statement 2022
28 Dec  BAKERY  8.40-  91.60
30 Dec  GRANT  1,000.00  1,091.60
02 Jan  RENT  91.60-  1,000.00
05 Jan  SMUDGED  77.00-  990.00
06 Jan  TEA  3.00-  987.00
"""

WRAPPED = """Card account
Jan 05, 2024  PARCEL POST     (12.75)
              ORDER 55
              CUSTOMS
Feb 11, 2024  REFUND          20.00
Page 1 of 1
Feb 12, 2024  TEA             (3.10)
   not in the column
"""

NEWEST_FIRST = """Recent
2024-03-09 TEA 3.00 87.00
2024-03-08 WAGES 50.00 90.00
2024-03-05 BOOKS 10.00 40.00
Balance brought forward 50.00
"""


def test_debit_and_credit_columns(spark):
    kept, rejects, layouts = infer(spark, (1, DEBIT_CREDIT))
    assert short(kept) == [
        ("2023-02-13", "CORNER BOOKS", -20.0, 80.0), ("2023-02-14", "PAYROLL", 50.0, 130.0), ("2023-03-01", "RENT MARCH", -120.0, 10.0)]
    assert rejects == [] and (layouts[1].form, layouts[1].n_money, layouts[1].balance, layouts[1].share) == ("numeric", 2, "after", 1.0)
    assert [r.type for r in kept] == ["debit", "credit", "debit"]


def test_trailing_minus_year_and_a_line_that_does_not_balance(spark):
    kept, rejects, layouts = infer(spark, (1, TRAILING_MINUS))
    assert short(kept) == [
        ("2022-12-28", "BAKERY", -8.4, 91.6), ("2022-12-30", "GRANT", 1000.0, 1091.6), ("2023-01-02", "RENT", -91.6, 1000.0),
        ("2023-01-06", "TEA", -3.0, 987.0)]
    assert [(r.line, r.reason) for r in rejects] == [("05 Jan  SMUDGED  77.00-  990.00", "does not balance")]
    assert layouts[1].form == "day_month" and layouts[1].share == pytest.approx(3 / 4)


def test_wrapped_lines_and_no_balance(spark):
    kept, rejects, layouts = infer(spark, (1, WRAPPED))
    assert short(kept) == [
        ("2024-01-05", "PARCEL POST ORDER 55 CUSTOMS", -12.75, None), ("2024-02-11", "REFUND", 20.0, None),
        ("2024-02-12", "TEA", -3.1, None)]
    assert rejects == [] and layouts[1].balance is None


def test_newest_first(spark):
    kept, rejects, layouts = infer(spark, (1, NEWEST_FIRST))
    assert short(kept) == [
        ("2024-03-09", "TEA", -3.0, 87.0), ("2024-03-08", "WAGES", 50.0, 90.0), ("2024-03-05", "BOOKS", -10.0, 40.0)]
    assert rejects == [] and layouts[1].balance == "before"


def test_month_first_and_a_chain_over_pages(spark):
    one = "Previous balance 10.00\n01/30/2024 A 1.00 9.00\n02/02/2024 B 2.00 7.00"
    two = "03/04/2024 C 5.00 12.00\n2024-03-09 odd one 1.00 11.00"
    kept, rejects, _ = infer(spark, (4, one), (4, two))
    assert short(kept) == [("2024-01-30", "A", -1.0, 9.0), ("2024-02-02", "B", -2.0, 7.0), ("2024-03-04", "C", 5.0, 12.0)]
    assert [r.reason for r in rejects] == ["other layout"]


def test_two_amounts_without_an_equation_are_rejects(spark):
    kept, rejects, layouts = infer(spark, (1, "2024-01-01 A 1.00 500.00\n2024-01-02 B 2.00 30.00\n2024-01-03 C 3.00 70.00"))
    assert kept == [] and {r.reason for r in rejects} == {"no balance equation"} and len(rejects) == 3
    assert layouts[1].balance is None


def test_three_columns_that_are_all_printed(spark):
    text = "2024-01-01 A 0.00 10.00 110.00\n2024-01-02 B 30.00 0.00 80.00\n2024-01-03 C 0.00 1.00 81.00"
    kept, _, _ = infer(spark, (1, text))
    assert [r.amount for r in kept][1:] == [-30.0, 1.0]


def test_header_words_decide_where_nothing_else_does(spark):
    text = """Date        Text        Withdrawals   Deposits
2024-01-01  SHOP              10.00
2024-01-02  WAGES                         99.00"""
    kept, _, _ = infer(spark, (1, text))
    assert [r.amount for r in kept] == [-10.0, 99.0]


def test_edge_cases(spark):
    kept, rejects, layouts = infer(
        spark, (1, None), (2, ""), (3, "no lines\n12.00 alone\n2024-01-01 no money"), (5, "2024-02-31 NO SUCH DAY 4.00"),
        (6, "2024-01-01 ZERO 0.00 5.00\r\n2024-01-02 TEA 1.00 4.00"))
    assert short(kept) == [("2024-01-01", "ZERO", 0.0, 5.0), ("2024-01-02", "TEA", -1.0, 4.0)]
    assert [(r.statement_id, r.reason) for r in rejects] == [(5, "no such date")]
    assert set(layouts) == {5, 6}
    assert infer_transactions(spark.createDataFrame([], "statement_id long, page_num int, text string"))[0].count() == 0
