"""Transaction extraction: chunking, reply parsing, line parsing, dedup.

* Chunking is a greedy fold over the lines of one text, inside its row.
* Model replies (raw JSON text) are repaired with ``regexp_replace`` and
  parsed with ``from_json`` into ``array<map<string,string>>`` so that a
  missing member, a JSON null and an unparsable value stay apart; a chunk
  keeps the records before its first bad one (the reference's loop stops
  at the first failure), and the lost ones go to a rejects frame.
* The statement-line parser is the data-job re-aim of the model call:
  one regular expression per line.
* First-wins dedup is an aggregation with ``min_by`` ordered by
  (chunk_idx, item_idx): partial aggregation before the shuffle, so a hot
  key is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import greedy_chunks, py_strip
from ledgerlens.schemas import CHUNK_CHARS

KEY = "statement_id"
NO_TXNS = "No transactions could be extracted from any chunk."

# Statement line layout: date, description, $amount, $balance.
LINE_PATTERN = r"^(\d{4}-\d{2}-\d{2})\s+(.+?)\s+\$(-?[\d,]+\.\d{2})\s+\$(-?[\d,]+\.\d{2})$"


def chunk_text(df: DataFrame, keys: Sequence[str], text_col: str = "text", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per non-blank chunk: ``chunk_idx`` (0-based), ``chunk``."""
    return df.select(*keys, F.posexplode(greedy_chunks(F.col(text_col), max_chars)).alias("chunk_idx", "chunk"))


# The patterns of a repair are fixed values: they must equal the reference's.
def repair_json(raw: Column) -> Column:
    """Strip, drop a leading ```json / ``` fence and a trailing fence,
    drop trailing commas before ``]``/``}``, add missing outer brackets."""
    s = py_strip(raw)
    s = py_strip(F.regexp_replace(s, r"(?i)^```(?:json)?", ""))
    s = py_strip(F.regexp_replace(s, r"```$", ""))
    s = F.regexp_replace(s, r"(?U),\s*([}\]])", "$1")
    s = F.when(s.startswith("["), s).otherwise(F.concat(F.lit("["), s))
    return F.when(s.endswith("]"), s).otherwise(F.concat(s, F.lit("]")))


def parse_replies(replies: DataFrame, keys: Sequence[str], raw_col: str = "raw") -> DataFrame:
    """E2+E3: repaired reply parsed to ``records array<map<string,string>>``
    (null when the text is not valid JSON)."""
    return replies.select(*keys, json_records(repair_json(F.col(raw_col))).alias("records"))


def json_records(text: Column) -> Column:
    """The array of member maps that a JSON text holds, or null: no single
    quotes, nothing behind the closing bracket (the array is read as the
    only member of an object, which ends where the array does), the last of
    a repeated member, NaN and Infinity as such."""
    held = F.from_json(
        F.concat(F.lit('{"x":'), text, F.lit("}")), "x array<map<string,string>>", {"allowSingleQuotes": "false"})["x"]

    def last_of_each(rec: Column) -> Column:
        entries = F.map_entries(rec)
        kept = F.filter(entries, lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
        bare = F.transform(kept, lambda e: F.struct(
            e["key"], F.regexp_replace(e["value"], r'^"(NaN|-?Infinity)"$', "$1").alias("value")))
        return F.map_from_entries(bare)

    return F.transform(held, last_of_each)


def reply_records(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per record: ``item_idx`` and the member map ``rec``;
    a reply that did not parse gives one row with null ``item_idx``."""
    return parsed.select(*keys, F.posexplode_outer("records").alias("item_idx", "rec"))


_DIGITS = r"\d+(?:_\d+)*"
# What float() reads.
FLOAT_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)$"
)


def _num(v: Column) -> Column:
    """The number that ``float()`` reads, or null."""
    bare = py_strip(v)
    return F.when(bare.rlike(FLOAT_PATTERN), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def _num_ok(v: Column) -> Column:
    return py_strip(v).rlike(FLOAT_PATTERN)


def normalize(records: DataFrame) -> DataFrame:
    """E4 + E7 checks on each record (the reference's per-record rules):
    amount missing -> 0.0; amount null or not a number -> bad; balance
    missing/null -> null, else must be a number; date missing -> ``""``,
    null -> ``"None"``; description missing -> bad."""
    rec = F.col("rec")
    has = lambda k: F.map_contains_key(rec, F.lit(k))
    amount_raw, balance_raw, date_raw = rec["amount"], rec["balance"], rec["date"]
    bad_amount = has("amount") & (amount_raw.isNull() | ~_num_ok(amount_raw))
    bad_balance = balance_raw.isNotNull() & ~_num_ok(balance_raw)
    bad_desc = ~has("description")
    reason = (
        F.when(F.col("item_idx").isNull(), F.lit("invalid json"))
        .when(bad_amount, F.lit("amount not a number"))
        .when(bad_balance, F.lit("balance not a number"))
        .when(bad_desc, F.lit("description missing"))
    )
    return records.select(
        "*",
        F.when(has("date"), F.coalesce(date_raw, F.lit("None"))).otherwise(F.lit("")).alias("date"),
        rec["description"].alias("description"),
        F.when(has("amount"), _num(amount_raw)).otherwise(F.lit(0.0)).alias("amount"),
        _num(balance_raw).alias("balance"),
        rec["type"].alias("type"),
        reason.alias("reject_reason"),
    ).drop("rec")


def isolate_failures(norm: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, rejects).  Per chunk, records after the first
    bad one are lost too.  The first bad index is a window minimum over the
    chunk: a chunk is one reply, whose records were exploded from a single
    row, so the group is bounded by one row's array; one pass over the
    records, no self-join that would compute them twice."""
    idx = F.coalesce(F.col("item_idx"), F.lit(-1))
    first_bad = F.min(F.when(F.col("reject_reason").isNotNull(), idx)).over(Window.partitionBy(*keys))
    marked = norm.withColumn("first_bad", first_bad)
    lost = F.col("first_bad").isNotNull() & (idx >= F.col("first_bad"))
    kept = marked.filter(~lost).drop("first_bad", "reject_reason")
    rejects = marked.filter(lost).select(
        *keys,
        "item_idx",
        F.coalesce(F.col("reject_reason"), F.lit("after failed record")).alias("reason"),
    )
    return kept, rejects


def parse_lines(chunks: DataFrame, keys: Sequence[str], chunk_col: str = "chunk") -> DataFrame:
    """E5: statement lines of each chunk to records (``item_idx`` = line
    number inside the chunk); header and other lines do not match."""
    lines = chunks.select(*keys, F.posexplode(F.split(F.col(chunk_col), "\n", -1)).alias("item_idx", "line"))
    m = lambda i: F.regexp_extract("line", LINE_PATTERN, i)
    money = lambda i: F.regexp_replace(m(i), ",", "").cast("double")
    parsed = lines.filter(F.col("line").rlike(LINE_PATTERN)).select(
        *keys, "item_idx",
        m(1).alias("date"),
        m(2).alias("description"),
        money(3).alias("amount"),
        money(4).alias("balance"),
    )
    return parsed.withColumn("type", F.when(F.col("amount") > 0, "credit").otherwise("debit"))


def dedup_first(records: DataFrame, key: str = KEY, order: Sequence[str] = ("chunk_idx", "item_idx")) -> DataFrame:
    """One record per (statement, date, description, amount), the first
    in (chunk_idx, item_idx) order; ``min_by`` aggregates map-side."""
    dims = [key, "date", "description", "amount"]
    rest = [c for c in records.columns if c not in dims]
    best = records.groupBy(*dims).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r")
    )
    return best.select(*dims, *[F.col("_r")[c].alias(c) for c in rest])


def statement_errors(statements: DataFrame, txns: DataFrame) -> DataFrame:
    """Per statement the number of transactions and, when none,
    the reference's error text (as a column, not a raised error)."""
    counts = txns.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_txns"))
    return (
        statements.select(KEY).distinct()
        .join(counts, KEY, "left")
        .select(
            KEY,
            F.coalesce("n_txns", F.lit(0)).cast("bigint").alias("n_txns"),
            F.when(F.coalesce("n_txns", F.lit(0)) == 0, F.lit(NO_TXNS)).alias("error"),
        )
    )
