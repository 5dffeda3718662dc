"""Transactions out of statement lines of unknown layout (E5).

Nothing is told about a statement's layout; it is inferred from its own
lines, per statement:

1. *Signatures.*  A line that starts with a date and holds money is a
   candidate; its signature is the form of the date and the number of money
   tokens.  The most frequent signature of a statement is its layout.
   Candidates of another signature are rejects.
2. *Dates.*  Day or month first is decided by impossible dates, then by the
   order of the lines; a missing year is that of the first page, one more
   after each fall of the month.
3. *Balance.*  With several money tokens the last may be a running balance:
   ``balance[i] - balance[i-1] = amount`` (or, newest line first,
   ``balance[i] - balance[i+1]``) must hold, without sign, for at least half
   of the lines.  Then the equation gives every sign, and a line that breaks
   it is a reject.  A dateless line before the first one that speaks of an
   opening balance starts the chain.
4. *Signs.*  Where the equation says nothing (a first line, no balance
   column), lines vote: the sign of a mark (minus before or after,
   parentheses, DR) and column position that the statement's balanced lines
   have; without such votes a marked amount is negative, and unmarked amounts
   take the side of the header word (debit, withdrawal, ...) nearest to
   their column.
5. *Wrapped lines.*  A line without date and money that starts in the
   description's column directly below a transaction continues its text.

Everything is expressions, partial aggregates per statement, and
``previous_row`` over (statement, page); a page is the largest group.  What
is read several times is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import UNITS, units
from ledgerlens.functions.text import match_starts, regex_parts
from ledgerlens.functions.windows import previous_row, running_totals
from ledgerlens.session import cut_lineage

KEY = "statement_id"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(?:" + "|".join(MONTHS) + r")[a-z]*\.?"
# Form of a date at the start of a line, tried in this order.
DATE_FORMS: dict[str, str] = {
    "iso": r"^\s*\d{4}-\d{2}-\d{2}(?=\s)",
    "numeric": r"^\s*\d{1,2}[/.]\d{1,2}[/.]\d{4}(?=\s)",
    "month_day_year": rf"(?i)^\s*{_MONTH} \d{{1,2}}, \d{{4}}(?=\s)",
    "day_month_year": rf"(?i)^\s*\d{{1,2}} {_MONTH} \d{{4}}(?=\s)",
    "day_month": rf"(?i)^\s*\d{{1,2}} {_MONTH}(?=\s)",
    "month_day": rf"(?i)^\s*{_MONTH} \d{{1,2}}(?=\s)",
}
MONEY = r"(?<![\w.,])[(]?-?[$]?-?\d[\d,]*\.\d{2}(?:[)]|-|\s?(?:CR|DR)\b)?(?![\w,.]*\d)"
NEGATIVE = r"^[(]|-|DR$"
OPENING = r"(?i)opening balance|previous balance|brought forward"
DEBIT_WORD = r"(?i)debits?|withdrawals?|paid out|charges?"
CREDIT_WORD = r"(?i)credits?|deposits?|paid in"
LEAST_SHARE = 0.5  # of the lines that must follow the balance equation


def _cents(token: Column) -> Column:
    """Magnitude in millionths."""
    return units(F.regexp_replace(token, r"[^\d.]", "").cast("double"))


def line_table(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(statement, page_num, item_idx, line) of all lines."""
    return pages.select(KEY, "page_num", F.posexplode(F.split(F.regexp_replace(text_col, "\r", ""), "\n", -1)).alias("item_idx", "line"))


def line_features(lines: DataFrame) -> DataFrame:
    """Date form and text, money tokens with their end columns, description."""
    form = F.lit(None).cast("string")
    date = F.lit("")
    for name, pattern in reversed(DATE_FORMS.items()):
        hit = F.col("line").rlike(pattern)
        form = F.when(hit, F.lit(name)).otherwise(form)
        date = F.when(hit, F.regexp_extract("line", pattern, 0)).otherwise(date)
    parts, found = regex_parts(F.col("__rest"), MONEY)
    dated = lines.select("*", form.alias("form"), date.alias("date_text")).withColumn(
        "__rest", F.expr("substring(line, length(date_text) + 1)"))
    with_money = dated.select(
        KEY, "page_num", "item_idx", "line", "form", F.lower(F.trim("date_text")).alias("date_text"),
        F.length("date_text").alias("date_end"), F.col("__rest").alias("rest"),
        found.alias("money"), match_starts(parts, found).alias("starts"))
    return with_money.select(
        "*",
        F.when(F.size("money") > 0, F.expr("substring(rest, 1, starts[0])")).otherwise(F.col("rest")).alias("said"),
        F.zip_with("money", "starts", lambda m, s: s + F.length(m) + F.col("date_end")).alias("ends"),
    ).withColumn("said_at", F.col("date_end") + F.length(F.regexp_extract("said", r"^\s*", 0))).withColumn(
        "said", F.trim("said"))


def main_layouts(features: DataFrame) -> DataFrame:
    """Per statement the most frequent (form, number of money tokens)."""
    candidates = features.where(F.col("form").isNotNull() & (F.size("money") > 0))
    counted = candidates.groupBy(KEY, "form", F.size("money").alias("n_money")).agg(F.count(F.lit(1)).alias("lines"))
    best = F.struct("lines", "n_money", "form")
    return counted.groupBy(KEY).agg(F.max(best).alias("b")).select(KEY, F.col("b.form").alias("form"), F.col("b.n_money").alias("n_money"))


def _order(*more: str) -> list[Column]:
    return [F.col(c) for c in ("page_num", "item_idx", *more)]


def _months(text: Column) -> Column:
    name = F.regexp_extract(text, "(" + "|".join(MONTHS) + ")", 1)
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def with_dates(rows: DataFrame, pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``date`` as ``yyyy-MM-dd`` text, null where it is no date."""
    numbers = F.regexp_extract_all("date_text", F.lit(r"\d+"), 0)
    a, b, year = (F.try_element_at(numbers, F.lit(i)).cast("int") for i in (1, 2, 3))
    rows = rows.withColumns({"__a": a, "__b": b})
    before = previous_row(rows, [KEY], F.col("page_num"), _order(), ["__a", "__b", "date_text"])
    # Numeric dates: how often each reading is impossible or goes back in time.
    numeric = before.where("form = 'numeric'")
    back = lambda x, y, px, py: ((x * 32 + y) < (px * 32 + py)).cast("int")
    reading = numeric.groupBy(KEY).agg(
        F.sum((F.col("__b") > 12).cast("int")).alias("not_day_first"),
        F.sum((F.col("__a") > 12).cast("int")).alias("not_month_first"),
        F.sum(back(F.col("__b"), F.col("__a"), F.col("prev___b"), F.col("prev___a"))).alias("back_day"),
        F.sum(back(F.col("__a"), F.col("__b"), F.col("prev___a"), F.col("prev___b"))).alias("back_month"),
    ).select(KEY, (F.struct("not_day_first", "back_day") < F.struct("not_month_first", "back_month")).alias("day_first"))
    # Dates without year: falls of the month count the years since the first page's.
    first_year = F.regexp_extract(text_col, r"\b(?:19|20)\d{2}\b", 0)
    started = pages.where(first_year != "").groupBy(KEY).agg(F.min_by(first_year, "page_num").cast("int").alias("first_year"))
    fell = F.coalesce((_months(F.col("date_text")) < _months(F.col("prev_date_text"))).cast("bigint"), F.lit(0))
    yearly = running_totals(before.withColumn("__fell", fell), [KEY], F.col("page_num"), _order(), {"__falls": F.col("__fell")})
    known = yearly.join(reading, KEY, "left").join(started, KEY, "left")
    month, given, day_first = _months(F.col("date_text")), F.col("form"), F.coalesce("day_first", F.lit(False))
    parsed = (
        F.when(given == "iso", F.col("date_text"))
        .when(given == "numeric", _ymd(year, F.when(day_first, F.col("__b")).otherwise(F.col("__a")),
                                         F.when(day_first, F.col("__a")).otherwise(F.col("__b"))))
        .when(given.isin("month_day_year", "day_month_year"), _ymd(F.col("__b"), month, F.col("__a")))
        .otherwise(_ymd((F.col("first_year") + F.col("__falls")).cast("int"), month, F.col("__a")))
    )
    whole = F.date_format(parsed.try_cast("date"), "yyyy-MM-dd")
    return known.withColumn("date", whole).select(*[c for c in rows.columns if not c.startswith("__")], "date")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


def _continued(features: DataFrame) -> DataFrame:
    """(statement, page, item_idx of a transaction, ``more``): the lines that
    continue its description; a page is one group."""
    in_page = Window.partitionBy(KEY, "page_num").orderBy("item_idx")
    is_txn = F.col("form").isNotNull() & (F.size("money") > 0)
    indent = F.length(F.regexp_extract("line", r"^\s*", 0))
    may = ~is_txn & (F.size("money") == 0) & (F.trim("line") != "") & F.col("form").isNull()
    marked = features.select(
        KEY, "page_num", "item_idx", is_txn.alias("txn"), may.alias("may"), indent.alias("indent"), F.trim("line").alias("more"),
        F.last(F.when(is_txn, F.struct("item_idx", "said_at")), ignorenulls=True).over(in_page).alias("above"))
    fits = F.col("may") & (F.col("indent") == F.col("above.said_at")) & (F.col("indent") > 0)
    broken = F.max(F.when(~F.col("txn") & ~fits, F.col("item_idx"))).over(in_page)
    return marked.select("*", fits.alias("fits"), broken.alias("broken")).where(
        F.col("fits") & (F.col("broken").isNull() | (F.col("broken") < F.col("above.item_idx")))
    ).groupBy(KEY, "page_num", F.col("above.item_idx").alias("item_idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "more"))), lambda s: s["more"]), " ").alias("more"))


def _opening(features: DataFrame) -> DataFrame:
    said = features.where(F.col("form").isNull() & F.col("line").rlike(OPENING) & (F.size("money") > 0))
    last = F.element_at("money", -1)
    signed = F.when(last.rlike(NEGATIVE), -_cents(last)).otherwise(_cents(last))
    return said.groupBy(KEY).agg(F.min_by(signed, F.struct("page_num", "item_idx")).alias("opening"))


def _columns(features: DataFrame) -> DataFrame:
    """Per statement the end columns of its header words for money in and out."""
    head = features.where((F.size("money") == 0) & F.col("line").rlike(DEBIT_WORD) & F.col("line").rlike(CREDIT_WORD))
    end = lambda p: (F.regexp_instr("line", F.lit(p)) + F.length(F.regexp_extract("line", p, 0)) - 1).cast("int")
    return head.groupBy(KEY).agg(
        F.min_by(end(DEBIT_WORD), F.struct("page_num", "item_idx")).alias("debit_end"),
        F.min_by(end(CREDIT_WORD), F.struct("page_num", "item_idx")).alias("credit_end"))


def infer_transactions(pages: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, rejects, layouts) of page texts (``statement_id``,
    ``page_num``, text).

    Transactions: statement, page_num, item_idx, date, description, amount,
    balance, type.  Rejects: statement, page_num, item_idx, line, reason.
    Layouts: statement, form, n_money, balance (``after`` / ``before`` /
    null: no balance column), share of the lines that follow the equation."""
    # The lines are read several times: their features are written once.
    features = cut_lineage(line_features(line_table(pages, text_col)))
    candidates = features.where(F.col("form").isNotNull() & (F.size("money") > 0))
    layouts = cut_lineage(main_layouts(features))
    chosen = candidates.join(layouts.withColumnsRenamed({"form": "main_form", "n_money": "main_money"}), KEY)
    fits = (F.col("form") == F.col("main_form")) & (F.size("money") == F.col("main_money"))
    odd = chosen.where(~fits).select(KEY, "page_num", "item_idx", "line", F.lit("other layout").alias("reason"))

    several = F.col("main_money") > 1
    # Of debit, credit and balance columns that are all printed one of the first two is zero.
    first, second = _cents(F.col("money")[0]), F.when(F.col("main_money") > 2, _cents(F.col("money")[1]))
    moved = F.when(F.coalesce(second, F.lit(0)) > first, 1).otherwise(0)
    token = F.when(moved == 1, F.col("money")[1]).otherwise(F.col("money")[0])
    last = F.element_at("money", -1)
    dated = with_dates(chosen.where(fits).drop("main_form"), pages, text_col)
    rows = dated.select(
        KEY, "page_num", "item_idx", "line", "date", "said", "main_money",
        F.greatest(first, F.coalesce(second, F.lit(0))).alias("size"), token.rlike(NEGATIVE).alias("mark"),
        F.when(moved == 1, F.col("ends")[1]).otherwise(F.col("ends")[0]).alias("end"),
        F.when(several, F.when(last.rlike(NEGATIVE), -_cents(last)).otherwise(_cents(last))).alias("held"))
    chained = previous_row(rows, [KEY], F.col("page_num"), _order(), ["held", "size"]).join(_opening(features), KEY, "left")
    after = F.col("held") - F.coalesce("prev_held", "opening")  # this line's amount, oldest first
    before = F.col("prev_held") - F.col("held")  # the amount of the line above, newest first
    tested = cut_lineage(chained.withColumns({"after": after, "before": before}))
    share = lambda step, size: F.avg(F.when(step.isNotNull(), (F.abs(step) == size).cast("double")))
    follows = tested.groupBy(KEY).agg(
        share(F.col("after"), F.col("size")).alias("share_after"), share(F.col("before"), F.col("prev_size")).alias("share_before"))
    kind = F.when(F.greatest(F.coalesce("share_after", F.lit(0.0)), F.coalesce("share_before", F.lit(0.0))) >= LEAST_SHARE, F.when(
        F.coalesce("share_after", F.lit(0.0)) >= F.coalesce("share_before", F.lit(0.0)), "after").otherwise("before"))
    # Two money tokens that never follow the equation: nothing tells the amount from the balance.
    decided = follows.select(KEY, kind.alias("balance"), F.greatest("share_after", "share_before").alias("share"))
    layouts = cut_lineage(layouts.join(decided, KEY).join(_columns(features), KEY, "left"))

    # Newest first: a line's amount is its balance less that of the line below.
    down = previous_row(
        tested.withColumn("__back", -F.col("page_num")), [KEY], F.col("__back"),
        [F.col("__back"), (-F.col("item_idx")).alias("back_item")], ["held"], prefix="below_").drop("__back")
    known = down.join(layouts.drop("form", "n_money"), KEY)
    step = F.when(F.col("balance") == "after", F.col("after")).when(
        F.col("balance") == "before", F.col("held") - F.coalesce("below_held", "opening"))
    known = known.withColumn("step", step).withColumn("balanced", F.abs("step") == F.col("size"))
    votes = known.where("balanced AND size > 0").groupBy(KEY, "mark", "end").agg(F.sum(F.signum("step")).alias("votes"))
    judged = known.join(votes, [KEY, "mark", "end"], "left")
    by_column = F.when(F.abs(F.col("end") - F.col("debit_end")) < F.abs(F.col("end") - F.col("credit_end")), -1).otherwise(1)
    sign = (
        F.when(F.col("balanced"), F.signum("step")).when(F.col("votes") != 0, F.signum("votes"))
        .when(F.col("mark"), -1.0).when(F.col("debit_end").isNotNull(), by_column.cast("double")).otherwise(1.0)
    )
    reason = (
        F.when(F.col("date").isNull(), "no such date")
        .when(several & F.col("balance").isNull(), "no balance equation")
        .when(~F.coalesce("balanced", F.lit(True)), "does not balance")
    )
    result = cut_lineage(judged.withColumns({"sign": sign, "reason": reason}))
    text = _continued(features)
    amount = F.col("sign") * F.col("size").cast("double") / float(UNITS) + F.lit(0.0)
    kept = result.where("reason IS NULL").join(text, [KEY, "page_num", "item_idx"], "left").select(
        KEY, "page_num", "item_idx", "date", F.concat_ws(" ", "said", "more").alias("description"), amount.alias("amount"),
        F.when(F.col("balance").isNotNull(), F.col("held").cast("double") / float(UNITS)).alias("balance"))
    kept = kept.withColumn("type", F.when(F.col("amount") > 0, "credit").otherwise("debit"))
    rejects = result.where("reason IS NOT NULL").select(KEY, "page_num", "item_idx", "line", "reason").unionByName(odd)
    return kept, rejects, layouts.drop("debit_end", "credit_end")
