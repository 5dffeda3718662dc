"""Independent DuckDB statements of the registered queries.

Each entry states the expected result directly over the driver's tables
(views ``events``, ``lineitem``, ``part``, ``documents``, ...).  Money is
summed as integer millionths of a dollar and rounded once, after the sum,
where the result is rounded at all, so doubles compare bit for bit.
"""

from __future__ import annotations

# --- derived views (FIXTURES.md section C) ------------------------------------

TXN_EV = """txn_ev AS (
  SELECT user_id AS statement_id, event_id AS txn_id, ts,
         strftime(ts, '%Y-%m-%d') AS date,
         upper(event_type) || ' ' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS description,
         event_type AS category,
         CASE WHEN event_type = 'signup' THEN value ELSE -value END AS amount,
         CASE WHEN (CASE WHEN event_type = 'signup' THEN value ELSE -value END) > 0 THEN 'credit' ELSE 'debit' END AS type
  FROM events)"""

TXN_LI = """txn_li AS (
  SELECT l.l_partkey % 50 AS statement_id, l.l_orderkey * 10 + l.l_linenumber AS txn_id, l.l_shipdate AS ts,
         strftime(l.l_shipdate, '%Y-%m-%d') AS date,
         'PART ' || CAST(l.l_partkey AS VARCHAR) AS description,
         p.p_brand AS category,
         CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE -l.l_quantity END AS amount,
         CASE WHEN (CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE -l.l_quantity END) > 0
              THEN 'credit' ELSE 'debit' END AS type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def positioned(src: str, name: str = "pos_txn") -> str:
    """Rank by (ts, txn_id) and running balance from 5000.00 per statement."""
    return f"""{name} AS (
  SELECT *, ROW_NUMBER() OVER w AS pos,
         CAST(sign(run) * ((abs(run) + 5000) // 10000) AS DOUBLE) / 100.0 AS balance
  FROM (SELECT *, 5000000000 + SUM({units()}) OVER v AS run FROM {src}
        WINDOW v AS (PARTITION BY statement_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY statement_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def units(x: str = "amount") -> str:
    """Millionths of a dollar; NaN and infinite amounts are missing."""
    return f"CASE WHEN isfinite({x}) THEN CAST(round({x} * 1000000) AS BIGINT) END"


def dollars(x: str) -> str:
    return f"CAST({x} AS DOUBLE) / 1000000.0"


def rounded(x: str, n: str = "1") -> str:
    """Sum ``x`` over ``n``, rounded to cents once, halves away from zero."""
    return (f"CAST(sign({x}) * ((2 * abs({x}) + 10000 * {n}) // (20000 * {n})) AS DOUBLE) / 100.0")


def metrics_sql(src: str) -> str:
    """Sums first, one rounding at the end."""
    return f"""SELECT statement_id,
  COALESCE({rounded("inc")}, 0.0) AS total_income,
  COALESCE({rounded("exp")}, 0.0) AS total_expenses,
  COALESCE({rounded("net")}, 0.0) AS net_cashflow,
  transaction_count,
  COALESCE({rounded("exp", "n_exp")}, 0.0) AS avg_expense,
  COALESCE({rounded("top")}, 0.0) AS largest_expense
FROM (
  SELECT statement_id, SUM(u) FILTER (u > 0) AS inc, SUM(-u) FILTER (u < 0) AS exp, SUM(u) AS net,
         COUNT(*) AS transaction_count, COUNT(*) FILTER (amount < 0 AND u IS NOT NULL) AS n_exp, MAX(-u) FILTER (u < 0) AS top
  FROM (SELECT *, {units()} AS u FROM {src}) GROUP BY statement_id)"""


def by_category_cte(src: str) -> str:
    return f"""cat_g AS (
  SELECT statement_id, category, SUM(-({units()})) AS tc, COUNT(*) AS count
  FROM {src} WHERE amount < 0 GROUP BY statement_id, category),
cat_r AS (
  SELECT statement_id, category, {dollars("tc")} AS total, count, tc,
         ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY tc DESC, category ASC NULLS FIRST) AS rank
  FROM cat_g)"""


def by_month_cte(src: str) -> str:
    c = "(" + units() + ")"
    return f"""mon AS (
  SELECT statement_id, strftime(ts, '%Y-%m') AS month,
         {dollars(f"SUM(CASE WHEN amount > 0 THEN {c} ELSE 0 END)")} AS income,
         {dollars(f"SUM(CASE WHEN amount < 0 THEN -{c} ELSE 0 END)")} AS expenses
  FROM {src} GROUP BY statement_id, strftime(ts, '%Y-%m'))"""


def zscore_ctes(src: str, name: str = "zs") -> str:
    return f"""{name}_e AS (
  SELECT *, -({units()}) AS c FROM {src} WHERE amount < 0 AND category IS NOT NULL),
{name}_s AS (
  SELECT statement_id, category, COUNT(*) AS n, SUM(CAST(c AS HUGEINT)) AS s1,
         SUM(CAST(c AS HUGEINT) * CAST(c AS HUGEINT)) AS s2
  FROM {name}_e GROUP BY statement_id, category),
{name}_st AS (
  SELECT statement_id, category, CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) AS mean_c,
         sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) AS std_c
  FROM {name}_s WHERE n >= 3 AND n * s2 - s1 * s1 > 0),
{name}_z AS (
  SELECT e.*, (CAST(e.c AS DOUBLE) - st.mean_c) / st.std_c AS z, st.mean_c
  FROM {name}_e e JOIN {name}_st st ON e.statement_id = st.statement_id AND e.category = st.category),
{name} AS (
  SELECT statement_id, txn_id, date, description, amount, category,
         'Unusually large for ' || category || ' (z=' || printf('%.2f', z) || ', avg=$'
           || printf('%.2f', mean_c / 1000000.0) || ')' AS reason,
         'z_score' AS method
  FROM {name}_z WHERE z > 2.5)"""


def duplicate_ctes(src: str, name: str = "dup") -> str:
    return f"""{name}_p AS (
  SELECT *, LAG(ts) OVER w AS prev_ts, LAG(amount) OVER w AS prev_amount
  FROM {src} WHERE amount < 0 AND description IS NOT NULL AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY statement_id, description ORDER BY ts, txn_id, amount)),
{name} AS (
  SELECT statement_id, txn_id, strftime(ts, '%Y-%m-%d') AS date, description, amount,
         COALESCE(category, 'Other') AS category,
         'Possible duplicate — same amount charged ' || CAST(abs(date_sub('day', prev_ts, ts)) AS VARCHAR)
           || ' day(s) apart' AS reason,
         'duplicate' AS method
  FROM {name}_p
  WHERE prev_ts IS NOT NULL AND abs(date_sub('day', prev_ts, ts)) <= 3 AND amount = prev_amount)"""


def anomalies_ctes(src: str) -> str:
    return (
        zscore_ctes(src) + ",\n" + duplicate_ctes(src)
        + ",\nanom AS (SELECT * FROM zs UNION ALL SELECT * FROM dup)"
    )


TXN_COLS = "statement_id, txn_id, date, description, amount, category, type"

SQL: dict[str, str] = {}

SQL["running_balance"] = with_(TXN_EV, positioned("txn_ev")) + (
    "SELECT statement_id, txn_id, pos, balance FROM pos_txn"
)

SQL["financial_summary"] = with_(TXN_EV) + metrics_sql("txn_ev")
for _m in ["total_income", "total_expenses", "net_cashflow", "transaction_count", "avg_expense", "largest_expense"]:
    SQL[_m] = with_(TXN_EV, f"fs AS ({metrics_sql('txn_ev')})") + f"SELECT statement_id, {_m} FROM fs"

SQL["spending_by_category"] = with_(TXN_LI, by_category_cte("txn_li")) + (
    "SELECT statement_id, category, total, count, rank FROM cat_r"
)

SQL["monthly_breakdown"] = with_(TXN_LI, by_month_cte("txn_li")) + (
    "SELECT statement_id, month, income, expenses FROM mon"
)

SQL["summary_record"] = with_(
    TXN_LI, f"fs AS ({metrics_sql('txn_li')})", by_category_cte("txn_li"), by_month_cte("txn_li")
) + """SELECT fs.*,
  COALESCE(c.n, 0) AS n_categories, m.n AS n_months,
  COALESCE(c.o, '') AS category_order, m.o AS month_order
FROM fs
LEFT JOIN (SELECT statement_id, COUNT(*) AS n, string_agg(COALESCE(category, 'NULL'), ',' ORDER BY rank) AS o
           FROM cat_r GROUP BY statement_id) c ON c.statement_id = fs.statement_id
LEFT JOIN (SELECT statement_id, COUNT(*) AS n,
                  string_agg(COALESCE(month, 'NULL'), ',' ORDER BY month ASC NULLS FIRST) AS o
           FROM mon GROUP BY statement_id) m ON m.statement_id = fs.statement_id"""

SQL["zscore_anomalies"] = with_(TXN_EV, zscore_ctes("txn_ev")) + "SELECT * FROM zs"
SQL["duplicate_charges"] = with_(TXN_LI, duplicate_ctes("txn_li")) + "SELECT * FROM dup"
SQL["anomaly_reasons"] = with_(TXN_EV, anomalies_ctes("txn_ev")) + (
    "SELECT statement_id, txn_id, method, reason FROM anom"
)
SQL["anomalies"] = with_(TXN_LI, anomalies_ctes("txn_li")) + "SELECT * FROM anom"

SQL["category_choices"] = with_(TXN_LI) + """SELECT DISTINCT statement_id, 'All' AS choice, CAST(0 AS BIGINT) AS ord FROM txn_li
UNION ALL
SELECT statement_id, category AS choice, ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY category) AS ord
FROM (SELECT DISTINCT statement_id, category FROM txn_li WHERE category IS NOT NULL)"""

SQL["filter_category"] = with_(TXN_EV) + f"SELECT {TXN_COLS} FROM txn_ev WHERE category = 'purchase'"
SQL["filter_type"] = with_(TXN_EV) + f"SELECT {TXN_COLS} FROM txn_ev WHERE type = 'credit'"
SQL["search_description"] = with_(TXN_EV) + (
    f"SELECT {TXN_COLS} FROM txn_ev WHERE COALESCE(regexp_matches(description, '(?i)purch.*[13]'), false)"
)
SQL["filter_counts"] = with_(TXN_EV) + """SELECT statement_id,
  COUNT(*) FILTER (WHERE category = 'view' AND type = 'debit' AND COALESCE(regexp_matches(description, '(?i)[0-4]$'), false)) AS shown,
  COUNT(*) AS total
FROM txn_ev GROUP BY statement_id"""

SQL["format_currency"] = with_(TXN_EV, positioned("txn_ev")) + """SELECT statement_id, txn_id,
  '$' || format('{:,.2f}', amount) AS amount_text, '$' || format('{:,.2f}', balance) AS balance_text
FROM pos_txn"""

SQL["category_share"] = with_(TXN_LI, by_category_cte("txn_li")) + """SELECT statement_id, category, total,
  CAST(tc AS DOUBLE) / CAST(SUM(tc) OVER (PARTITION BY statement_id) AS DOUBLE) AS share
FROM cat_r"""

SQL["cashflow_series"] = with_(TXN_LI, by_month_cte("txn_li")) + """SELECT statement_id, month, 'income' AS series, income AS value FROM mon
UNION ALL
SELECT statement_id, month, 'expenses' AS series, expenses AS value FROM mon"""

_FLAG = "SELECT DISTINCT statement_id, description FROM anom"
SQL["mark_anomalies"] = with_(TXN_LI, anomalies_ctes("txn_li")) + f"""SELECT e.statement_id, e.txn_id, e.description, e.amount,
  f.description IS NOT NULL AS is_anomaly
FROM (SELECT * FROM txn_li WHERE amount < 0) e
LEFT JOIN ({_FLAG}) f ON f.statement_id = e.statement_id AND f.description = e.description"""
SQL["flagged_points"] = with_(TXN_LI, anomalies_ctes("txn_li")) + f"""SELECT statement_id, txn_id, date, description, amount
FROM txn_li e WHERE amount < 0
  AND EXISTS (SELECT 1 FROM anom a WHERE a.statement_id = e.statement_id AND a.description = e.description)"""
SQL["normal_points"] = with_(TXN_LI, anomalies_ctes("txn_li")) + f"""SELECT statement_id, txn_id, date, description, amount
FROM txn_li e WHERE amount < 0
  AND NOT EXISTS (SELECT 1 FROM anom a WHERE a.statement_id = e.statement_id AND a.description = e.description)"""
SQL["anomaly_view"] = with_(TXN_LI, anomalies_ctes("txn_li")) + """SELECT statement_id, txn_id, method,
  '⚠️ ' || date || ' | ' || description || ' | $' || format('{:,.2f}', abs(amount)) AS title,
  array_to_string(list_transform(string_split(replace(method, '_', ' '), ' '),
                  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS method_label,
  COUNT(*) OVER (PARTITION BY statement_id) AS n_anomalies
FROM anom"""


# --- redaction -------------------------------------------------------------------

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- fixed values (must equal the reference's) ---------------------------
# The regex rules in RE2 syntax (non-capturing group; flag inline).
RULES = [
    ("ACCOUNT_NUMBER", r"\b\d{8,17}\b"),
    ("ROUTING_NUMBER", r"\b\d{9}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"\b(?:\+1[\s-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("EMAIL", r"(?i)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"),
]
# --------------------------------------------------------------------------
ENTITIES = [
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6),
    ("PERSON", r"\b(?:Mira Solberg|Tomas Okafor)\b", 0.85),
    ("URL", r"\bhttps?://[^\s\"'<>]+", 0.5),
]
PLANTED = " Seen http://10.0.0.1/u?tok=abc by Mira Solberg and Tomas Okafor."
ENTITY_DOCS = f"ent_docs AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN text || {lit(PLANTED)} ELSE text END AS text FROM documents)"


def tok(label: str, v: str) -> str:
    return f"'[' || {lit(label)} || '_' || upper(substr(sha256({v}), 1, 8)) || ']'"


def starts_expr() -> str:
    return ("list_transform(range(len(ms)), lambda j: "
            "COALESCE(list_sum(list_transform(parts[1:j + 1], lambda p: length(p))), 0) + "
            "COALESCE(list_sum(list_transform(ms[1:j], lambda m: length(m))), 0))")


def regex_chain(src: str, keys: str, upto: int = 5) -> str:
    """CTEs rx0..rxN (text after each pass) and f1..fN (findings of each pass)."""
    ctes = [f"rx0 AS (SELECT {keys}, text AS t FROM {src})"]
    for i, (label, pat) in enumerate(RULES[:upto], 1):
        ctes.append(f"""rx{i}m AS (
  SELECT {keys}, string_split_regex(t, {lit(pat)}) AS parts, regexp_extract_all(t, {lit(pat)}) AS ms FROM rx{i - 1})""")
        ctes.append(f"""rx{i} AS (
  SELECT {keys}, array_to_string(flatten(list_transform(
           list_zip(parts, list_transform(ms, lambda m: {tok(label, 'm')})),
           lambda z: [z[1], COALESCE(z[2], '')])), '') AS t
  FROM rx{i}m)""")
        ctes.append(f"""f{i}u AS (
  SELECT {keys}, ms, {starts_expr()} AS st, unnest(range(len(ms))) AS j FROM rx{i}m)""")
        ctes.append(f"""f{i} AS (
  SELECT {keys}, CAST({i} AS BIGINT) AS pass, CAST(j AS BIGINT) AS idx, {lit(label)} AS type,
         sha256(ms[j + 1]) AS original_hash, {tok(label, 'ms[j + 1]')} AS token,
         CAST(st[j + 1] AS BIGINT) AS span_start, CAST(st[j + 1] + length(ms[j + 1]) AS BIGINT) AS span_end,
         CAST(NULL AS DOUBLE) AS score
  FROM f{i}u)""")
    return ",\n".join(ctes)


def entity_ctes(keys: str, src: str = "rx5") -> str:
    ctes = []
    for k, (etype, pat, score) in enumerate(ENTITIES):
        n = 6 + k
        ctes.append(f"""e{n}m AS (
  SELECT {keys}, string_split_regex(t, {lit(pat)}) AS parts, regexp_extract_all(t, {lit(pat)}) AS ms FROM {src})""")
        ctes.append(f"""e{n}u AS (SELECT {keys}, ms, {starts_expr()} AS st, unnest(range(len(ms))) AS j FROM e{n}m)""")
        ctes.append(f"""e{n} AS (
  SELECT {keys}, CAST({n} AS BIGINT) AS pass, CAST(j AS BIGINT) AS idx, {lit(etype)} AS type,
         sha256(ms[j + 1]) AS original_hash, {tok(etype, 'ms[j + 1]')} AS token,
         CAST(st[j + 1] AS BIGINT) AS span_start, CAST(st[j + 1] + length(ms[j + 1]) AS BIGINT) AS span_end,
         CAST(round({score}, 3) AS DOUBLE) AS score
  FROM e{n}u)""")
    return ",\n".join(ctes)


def union_all(names) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)


STMT_PAGES = [
    TXN_EV,
    positioned("txn_ev"),
    """stmt_lines AS (
  SELECT statement_id, pos, CAST((pos - 1) // 40 + 1 AS INTEGER) AS page_num,
         date || ' ' || description || ' $' || format('{:,.2f}', amount) || ' $' || format('{:,.2f}', balance) AS line
  FROM pos_txn)""",
    """stmt_pages AS (
  SELECT statement_id, page_num,
         'Tidewater Savings | Account record' || chr(10) || 'Account: ' || CAST(statement_id + 1000000000 AS VARCHAR)
           || ' | Holder ' || CAST(statement_id AS VARCHAR) || ' | SSN: '
           || lpad(CAST(statement_id % 1000 AS VARCHAR), 3, '0') || '-45-6789' || chr(10)
           || 'Date Description Amount Balance' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text,
         'statement_' || CAST(statement_id AS VARCHAR) || '.pdf' AS source
  FROM stmt_lines GROUP BY statement_id, page_num)""",
]

DOC = "doc_id"
for _i, _k in enumerate(["redact_account", "redact_routing", "redact_ssn", "redact_phone", "redact_email"], 1):
    if _i == 3:
        _keys = "statement_id, page_num"
        SQL[_k] = with_(*STMT_PAGES, regex_chain("stmt_pages", _keys, 3)) + (
            f"SELECT rx3.statement_id, rx3.page_num, rx3.t AS text, "
            f"(SELECT COUNT(*) FROM f3 WHERE f3.statement_id = rx3.statement_id AND f3.page_num = rx3.page_num) AS hits FROM rx3"
        )
    else:
        SQL[_k] = with_(regex_chain("documents", DOC, _i)) + (
            f"SELECT rx{_i}.doc_id, rx{_i}.t AS text, "
            f"(SELECT COUNT(*) FROM f{_i} WHERE f{_i}.doc_id = rx{_i}.doc_id) AS hits FROM rx{_i}"
        )

_FALL = "fall AS (" + union_all(f"f{i}" for i in range(1, 6)) + ")"
SQL["redact_all"] = with_(regex_chain("documents", DOC), _FALL) + (
    "SELECT rx5.doc_id, rx5.t AS redacted, (SELECT COUNT(*) FROM fall WHERE fall.doc_id = rx5.doc_id) AS n_findings FROM rx5"
)
SQL["pii_findings"] = with_(regex_chain("documents", DOC), _FALL) + (
    "SELECT doc_id, pass, idx, type, original_hash, token, span_start, span_end FROM fall"
)
SQL["pii_tokens"] = with_(regex_chain("documents", DOC), _FALL) + "SELECT DISTINCT type, original_hash, token FROM fall"
SQL["entity_findings"] = with_(ENTITY_DOCS, regex_chain("ent_docs", DOC), entity_ctes(DOC)) + (
    "SELECT doc_id, type, score, token, span_start, span_end FROM ("
    + union_all(f"e{6 + k}" for k in range(len(ENTITIES))) + ")"
)
_HITS = "hits AS (" + union_all(f"e{6 + k}" for k in range(len(ENTITIES))) + ")"
SQL["entity_redact"] = with_(ENTITY_DOCS, regex_chain("ent_docs", DOC), entity_ctes(DOC), _HITS,
    """won AS (
  SELECT * FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits g WHERE g.doc_id = h.doc_id AND g.span_start < h.span_end AND h.span_start < g.span_end
      AND (h.span_end - h.span_start, h.score, -h.span_start) < (g.span_end - g.span_start, g.score, -g.span_start)))""",
    """cut AS (
  SELECT *, COALESCE(LAG(span_end) OVER (PARTITION BY doc_id ORDER BY span_start), 0) AS from_char FROM won)""",
    """put AS (
  SELECT rx5.doc_id, string_agg(substr(t, from_char + 1, span_start - from_char) || '<' || type || '>', '' ORDER BY span_start) AS head,
         max(span_end) AS last_char FROM cut JOIN rx5 USING (doc_id) GROUP BY rx5.doc_id)""",
) + "SELECT rx5.doc_id, COALESCE(head || substr(t, last_char + 1), t) AS anonymized FROM rx5 LEFT JOIN put USING (doc_id)"
_EALL = "eall AS (" + union_all([*(f"f{i}" for i in range(1, 6)), *(f"e{6 + k}" for k in range(len(ENTITIES)))]) + ")"
SQL["findings_union"] = with_(ENTITY_DOCS, regex_chain("ent_docs", DOC), entity_ctes(DOC), _EALL) + (
    "SELECT doc_id, pass, idx, type, token, original_hash, score FROM eall"
)
SQL["pii_audit"] = with_(ENTITY_DOCS, regex_chain("ent_docs", DOC), entity_ctes(DOC), _EALL) + (
    "SELECT d.doc_id, (SELECT COUNT(*) FROM eall WHERE eall.doc_id = d.doc_id) AS items_found FROM documents d"
)
SQL["token_vault"] = with_(ENTITY_DOCS, regex_chain("ent_docs", DOC), entity_ctes(DOC), _EALL) + (
    "SELECT original_hash, arg_min(token, (doc_id, pass, span_start)) AS token FROM eall GROUP BY original_hash"
)


# --- sources and extraction ------------------------------------------------------

CONV_PAGES = """conv_pages AS (
  SELECT CAST(conv_id AS BIGINT) AS statement_id, CAST(turn + 1 AS INTEGER) AS page_num,
         COALESCE(text, '') AS text, 'conv_' || CAST(conv_id AS VARCHAR) AS source
  FROM conversations)"""

# Unicode white space (Python's str.strip set minus the 0x1C-0x1F separators).
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


SQL["page_scan"] = with_(CONV_PAGES) + "SELECT * FROM conv_pages"
SQL["combine_pages"] = with_(CONV_PAGES) + f"""SELECT statement_id,
  string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS raw_text, COUNT(*) AS n_pages
FROM conv_pages WHERE {strip('text')} <> '' GROUP BY statement_id"""

SQL["chunk_text"] = f"""WITH RECURSIVE
lines AS (
  SELECT doc_id, unnest(arr) AS line, unnest(range(1, len(arr) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)),
walk(doc_id, i, cur_len, chunk_no) AS (
  SELECT doc_id, i, length(line) + 1, CASE WHEN length(line) > 3000 THEN 1 ELSE 0 END FROM lines WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i,
         CASE WHEN w.cur_len + length(l.line) > 3000 THEN length(l.line) + 1 ELSE w.cur_len + length(l.line) + 1 END,
         CASE WHEN w.cur_len + length(l.line) > 3000 THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
chunks AS (
  SELECT w.doc_id, w.chunk_no, {strip("string_agg(l.line, chr(10) ORDER BY l.i)")} AS chunk
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i
  GROUP BY w.doc_id, w.chunk_no)
SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS chunk_idx, chunk,
       CAST(length(chunk) AS BIGINT) AS n_chars
FROM chunks WHERE chunk <> ''"""

REPLIES = [
    TXN_EV,
    positioned("txn_ev"),
    """rj AS (
  SELECT *, CAST((pos - 1) // 20 AS BIGINT) AS chunk_idx, CAST((pos - 1) % 20 AS BIGINT) AS item_idx,
         txn_id % 97 = 0 AS bad
  FROM pos_txn)""",
    """rj_first AS (SELECT statement_id, chunk_idx, MIN(item_idx) AS first_bad FROM rj WHERE bad GROUP BY 1, 2)""",
    """rj_mark AS (
  SELECT r.*, f.first_bad IS NOT NULL AND r.item_idx >= f.first_bad AS lost
  FROM rj r LEFT JOIN rj_first f ON f.statement_id = r.statement_id AND f.chunk_idx = r.chunk_idx)""",
]

SQL["json_repair"] = with_(*REPLIES) + "SELECT statement_id, chunk_idx, COUNT(*) AS n_items FROM rj GROUP BY 1, 2"
SQL["json_records"] = with_(*REPLIES) + """SELECT statement_id, chunk_idx, item_idx, date, description,
  CASE WHEN bad THEN NULL ELSE amount END AS amount, type FROM rj"""
SQL["normalize_records"] = with_(*REPLIES) + """SELECT statement_id, chunk_idx, item_idx, date, description, amount,
  balance, type FROM rj_mark WHERE NOT lost"""
SQL["extract_rejects"] = with_(*REPLIES) + """SELECT statement_id, chunk_idx, item_idx,
  CASE WHEN bad THEN 'amount not a number' ELSE 'after failed record' END AS reason FROM rj_mark WHERE lost"""
SQL["empty_statements"] = with_(*REPLIES) + """SELECT statement_id,
  CASE WHEN statement_id % 50 = 7 THEN 0 ELSE COUNT(*) FILTER (WHERE NOT lost) END AS n_txns,
  CASE WHEN statement_id % 50 = 7 OR COUNT(*) FILTER (WHERE NOT lost) = 0
       THEN 'No transactions could be extracted from any chunk.' END AS error
FROM rj_mark GROUP BY statement_id"""
SQL["txn_count"] = with_(*REPLIES) + "SELECT statement_id, COUNT(*) AS count FROM rj_mark WHERE NOT lost GROUP BY statement_id"
SQL["typed_load"] = with_(*REPLIES) + """SELECT statement_id, chunk_idx, item_idx, strftime(ts, '%Y-%m-%d 00:00:00') AS ts,
  amount, balance FROM rj_mark WHERE NOT lost"""

SQL["dedup_txns"] = with_(
    TXN_EV, positioned("txn_ev"),
    """b AS (SELECT statement_id, txn_id, date, description, amount, balance, pos,
         CAST((pos - 1) // 20 AS BIGINT) AS chunk_idx, CAST((pos - 1) % 20 AS BIGINT) AS item_idx FROM pos_txn)""",
    """u AS (SELECT statement_id, txn_id, date, description, amount, balance, chunk_idx, item_idx FROM b
         UNION ALL
         SELECT statement_id, txn_id, date, description, amount, balance + 1.0,
                chunk_idx + CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END, item_idx FROM b)""",
) + """SELECT statement_id, date, description, amount,
  arg_min(txn_id, (chunk_idx, item_idx)) AS txn_id, arg_min(balance, (chunk_idx, item_idx)) AS balance,
  arg_min(chunk_idx, (chunk_idx, item_idx)) AS chunk_idx, arg_min(item_idx, (chunk_idx, item_idx)) AS item_idx
FROM u GROUP BY statement_id, date, description, amount"""

SQL["parse_lines"] = with_(TXN_EV, positioned("txn_ev")) + """SELECT statement_id, date, description, amount, balance,
  CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS type FROM pos_txn"""

SQL["adhoc_sql"] = with_(TXN_LI) + """SELECT statement_id, category, COUNT(*) AS n, MIN(amount) AS min_amount,
  MAX(amount) AS max_amount FROM txn_li WHERE amount < 0 GROUP BY statement_id, category"""
SQL["sanitize"] = """SELECT event_id, value,
  CASE WHEN isnan(sqrt(value - 100)) THEN NULL ELSE sqrt(value - 100) END AS root FROM events"""
SQL["vector_roundtrip"] = """SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS n_dims,
  CAST(embedding[1] AS DOUBLE) AS e_first, CAST(embedding[len(embedding)] AS DOUBLE) AS e_last FROM embeddings"""


# --- categorisation ---------------------------------------------------------------

CATEGORY_NAMES = [
    "Food & Dining", "Groceries", "Shopping", "Transportation", "Travel", "Entertainment",
    "Health & Medical", "Utilities", "Rent & Housing", "Subscriptions", "Income & Salary",
    "Transfers", "ATM & Cash", "Insurance", "Education", "Other",
]
CAT_DIM = "cat_dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(c)}, {i})" for i, c in enumerate(CATEGORY_NAMES)) + ") AS t(category, ord))"
RULES_CTE = """rules AS (SELECT * FROM (VALUES ('PURCHASE', 'Shopping', 0.9, 1), ('SIGNUP', 'Income & Salary', 0.95, 2),
  ('VIEW', 'Entertainment', 0.8, 3), ('CLICK', 'Subscriptions', 0.85, 4), ('VIEW 3', 'Travel', 0.7, 0),
  ('CLICK 5', 'Education', 0.6, 1)) AS t(word, category, confidence, priority))"""
RULE_MAP = """rmap AS (
  SELECT statement_id, description, arg_min(category, (priority, word)) AS category,
         arg_min(CAST(confidence AS DOUBLE), (priority, word)) AS confidence
  FROM (SELECT DISTINCT statement_id, description FROM txn_ev) d JOIN rules
    ON contains(' ' || regexp_replace(upper(description), '[^A-Z0-9&]+', ' ', 'g') || ' ', ' ' || word || ' ')
  GROUP BY statement_id, description)"""
RULE_CAT = """rcat AS (
  SELECT t.statement_id, t.txn_id, t.description, COALESCE(m.category, 'Other') AS category,
         COALESCE(m.confidence, 0.0) AS confidence
  FROM txn_ev t LEFT JOIN rmap m ON m.statement_id = t.statement_id AND m.description = t.description)"""
BATCHED = """bt AS (
  SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY txn_id) - 1) // 20 AS BIGINT) AS batch,
         CAST((ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY txn_id) - 1) % 20 AS BIGINT) AS item_idx
  FROM txn_ev)"""
REPLY_ROWS = """rep AS (
  SELECT *, CASE category WHEN 'purchase' THEN 'Shopping' WHEN 'signup' THEN 'Income & Salary'
                          WHEN 'view' THEN 'Entertainment' WHEN 'click' THEN 'Subscriptions' ELSE 'Other' END AS rcat,
         (txn_id % 50 + 50) / 100.0 AS rconf,
         bool_or(txn_id % 97 = 0) OVER (PARTITION BY statement_id, batch) AS bad_batch
  FROM bt)"""
REPLY_MAP = """rpm AS (
  SELECT statement_id, description, arg_max(rcat, (batch, item_idx)) AS category,
         CAST(arg_max(rconf, (batch, item_idx)) AS DOUBLE) AS confidence
  FROM rep WHERE NOT bad_batch GROUP BY statement_id, description)"""

SQL["categories"] = with_(TXN_EV, RULES_CTE, RULE_MAP, RULE_CAT, CAT_DIM) + """SELECT d.category, CAST(d.ord AS BIGINT) AS ord,
  CAST(COALESCE(c.n, 0) AS BIGINT) AS n_txns
FROM cat_dim d LEFT JOIN (SELECT category, COUNT(*) AS n FROM rcat GROUP BY category) c ON c.category = d.category"""
SQL["distinct_descriptions"] = with_(TXN_EV) + "SELECT statement_id, description, COUNT(*) AS n FROM txn_ev GROUP BY 1, 2"
SQL["batches_of_20"] = with_(TXN_EV, BATCHED) + "SELECT statement_id, txn_id, batch, item_idx FROM bt"
SQL["batch_payload"] = with_(TXN_EV, BATCHED) + """SELECT statement_id, batch, COUNT(*) AS n_items,
  """ + lit("\n".join(f"- {c}" for c in CATEGORY_NAMES)) + """ AS categories,
  '[' || chr(10) || string_agg('  {' || chr(10) || '    "description": ' || to_json(description) || chr(10) || '  }',
                               ',' || chr(10) ORDER BY item_idx) || chr(10) || ']' AS payload
FROM bt GROUP BY statement_id, batch"""
SQL["categorize_rules"] = with_(TXN_EV, RULES_CTE, RULE_MAP, RULE_CAT) + "SELECT * FROM rcat"
SQL["category_map"] = with_(TXN_EV, BATCHED, REPLY_ROWS, REPLY_MAP) + "SELECT * FROM rpm"
SQL["categorize_join"] = with_(TXN_EV, BATCHED, REPLY_ROWS, REPLY_MAP) + """SELECT t.statement_id, t.txn_id, t.description,
  COALESCE(m.category, 'Other') AS category, COALESCE(m.confidence, 0.0) AS confidence
FROM txn_ev t LEFT JOIN rpm m ON m.statement_id = t.statement_id AND m.description = t.description"""
SQL["category_unknown"] = with_(TXN_EV) + "SELECT statement_id, txn_id, category FROM txn_ev WHERE category = 'error'"
SQL["category_rejects"] = with_(TXN_EV, BATCHED, REPLY_ROWS) + """SELECT DISTINCT statement_id, batch, 'invalid json' AS reason
FROM rep WHERE bad_batch"""


# --- search -----------------------------------------------------------------------

def sqsum(v: str) -> str:
    return f"list_reduce(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)), lambda a, b: a + b)"


def centroid_ctes(group: str) -> str:
    return f"""dims AS (
  SELECT {group} AS query_id, i, AVG(CAST(x AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
  GROUP BY 1, 2),
cvec AS (SELECT CAST(query_id AS BIGINT) AS query_id, list(m ORDER BY i) AS v FROM dims GROUP BY query_id),
qs AS (SELECT query_id, list_transform(v, lambda x: x / sqrt({sqsum('v')})) AS q,
              CAST((query_id + 1) % 10 AS VARCHAR) AS filter_category FROM cvec)"""


DIST = ("list_reduce(list_transform(list_zip(e.embedding, qs.q), "
        "lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])), lambda a, b: a + b)")
SCORED = f"""scored AS (
  SELECT qs.query_id, qs.filter_category, e.vec_id, e.label, CAST(e.label AS VARCHAR) AS category, {DIST} AS dist
  FROM embeddings e CROSS JOIN qs)"""


def ranked(where: str = "", k: int = 5) -> str:
    return f"""SELECT query_id, rank, vec_id, label, round(dist, 4) AS similarity_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM scored {where})
WHERE rank <= {k}"""


SQL["txn_sentences"] = with_(TXN_EV, RULES_CTE, RULE_MAP, RULE_CAT) + """SELECT r.statement_id, r.txn_id,
  t.date || ' | ' || t.description || ' | ' || CASE WHEN t.amount < 0 THEN 'spent' ELSE 'received' END
    || ' $' || printf('%.2f', abs(t.amount)) || ' | category: ' || r.category AS content
FROM rcat r JOIN txn_ev t ON t.txn_id = r.txn_id"""
SQL["txn_metadata"] = with_(TXN_EV, positioned("txn_ev"), BATCHED, REPLY_ROWS, REPLY_MAP) + """SELECT t.statement_id, t.txn_id,
  t.date, t.description, t.amount, t.type, COALESCE(m.category, 'Other') AS category,
  COALESCE(m.confidence, 0.0) AS confidence, t.balance
FROM pos_txn t LEFT JOIN rpm m ON m.statement_id = t.statement_id AND m.description = t.description"""
SQL["embed_normalize"] = f"""SELECT vec_id, sqrt({sqsum('embedding')}) AS norm,
  CAST(embedding[1] AS DOUBLE) / sqrt({sqsum('embedding')}) AS e_first FROM embeddings"""
SQL["knn_l2"] = with_(centroid_ctes("0"), SCORED) + """SELECT rank, vec_id, label, round(dist, 4) AS similarity_score FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY dist, vec_id) AS rank FROM scored) WHERE rank <= 5"""
SQL["knn_batch"] = with_(centroid_ctes("label"), SCORED) + ranked()
SQL["knn_postfilter"] = with_(centroid_ctes("label"), SCORED) + """SELECT query_id, rank, vec_id, label, similarity_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY r2k) AS rank FROM (
    SELECT *, round(dist, 4) AS similarity_score,
           ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r2k FROM scored)
  WHERE r2k <= 10 AND category = filter_category)
WHERE rank <= 5"""
SQL["knn_prefilter"] = with_(centroid_ctes("label"), SCORED) + ranked("WHERE category = filter_category")


# --- report text, conversations, run status ---------------------------------------

def money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


SUMMARY_TEXT = f"""cat_t AS (
  SELECT statement_id, string_agg('  • ' || COALESCE(category, 'None') || ': ' || {money('total')} || ' ('
           || CAST(count AS VARCHAR) || ' transactions)', chr(10) ORDER BY rank) AS t
  FROM cat_r GROUP BY statement_id),
mon_t AS (
  SELECT statement_id, string_agg('  • ' || COALESCE(month, 'None') || ': Income ' || {money('income')}
           || ' | Expenses ' || {money('expenses')}, chr(10) ORDER BY month ASC NULLS FIRST) AS t
  FROM mon GROUP BY statement_id),
sum_t AS (
  SELECT fs.statement_id,
    '- Total Income:      ' || {money('total_income')} || chr(10) ||
    '- Total Expenses:    ' || {money('total_expenses')} || chr(10) ||
    '- Net Cashflow:      ' || {money('net_cashflow')} || chr(10) ||
    '- Transaction Count: ' || CAST(transaction_count AS VARCHAR) || '.0' || chr(10) ||
    '- Avg Expense:       ' || {money('avg_expense')} || chr(10) ||
    '- Largest Expense:   ' || {money('largest_expense')} || chr(10) || chr(10) ||
    'Spending by Category:' || COALESCE(chr(10) || c.t, '') || chr(10) || chr(10) ||
    'Monthly Breakdown:' || COALESCE(chr(10) || m.t, '') AS summary_text
  FROM fs LEFT JOIN cat_t c ON c.statement_id = fs.statement_id LEFT JOIN mon_t m ON m.statement_id = fs.statement_id)"""

ANOM_TEXT = f"""anom_t AS (
  SELECT statement_id, string_agg(line, chr(10) ORDER BY mr, g, date, txn_id, line) AS t FROM (
    SELECT statement_id, txn_id, date, CASE WHEN method = 'z_score' THEN 0 ELSE 1 END AS mr,
           CASE WHEN method = 'z_score' THEN category ELSE description END AS g,
           '  • [' || upper(method) || '] ' || date || ' | ' || description || ' | ' || {money('abs(amount)')}
             || ' — ' || reason AS line
    FROM anom) GROUP BY statement_id),
anom_s AS (
  SELECT s.statement_id, COALESCE(a.t, 'No anomalies detected.') AS anomaly_text
  FROM (SELECT DISTINCT statement_id FROM txn_li) s LEFT JOIN anom_t a ON a.statement_id = s.statement_id)"""

SQL["report_summary"] = with_(
    TXN_LI, f"fs AS ({metrics_sql('txn_li')})", by_category_cte("txn_li"), by_month_cte("txn_li"), SUMMARY_TEXT
) + "SELECT * FROM sum_t"
SQL["report_anomalies"] = with_(TXN_LI, anomalies_ctes("txn_li"), ANOM_TEXT) + "SELECT * FROM anom_s"
QUESTIONS = ("What did I receive for Brand#13 in December 1996?", "spent on part 7 of Brand#42")
QUESTION_HITS = f"""asked AS (
  SELECT DISTINCT question_id, unnest(string_split_regex(lower(question), '[^a-z0-9]+')) AS word
  FROM (VALUES {", ".join(f"({i}, {lit(q)})" for i, q in enumerate(QUESTIONS))}) AS q(question_id, question)),
spoken AS (
  SELECT DISTINCT statement_id, txn_id, unnest(string_split_regex(lower(
    date || ' | ' || description || ' | ' || CASE WHEN amount < 0 THEN 'spent' ELSE 'received' END || ' $'
    || printf('%.2f', abs(amount)) || ' | category: ' || category), '[^a-z0-9]+')) AS word FROM txn_li),
met AS (SELECT * FROM spoken JOIN asked USING (word) WHERE word <> ''),
rare AS (
  SELECT statement_id, question_id, word, CAST(round(ln(1.0 + n / CAST(COUNT(*) AS DOUBLE)) * 1000000) AS BIGINT) AS weight
  FROM met JOIN (SELECT statement_id, COUNT(*) AS n FROM txn_li GROUP BY statement_id) USING (statement_id)
  GROUP BY statement_id, question_id, word, n),
got AS (
  SELECT statement_id, question_id, txn_id, SUM(weight) AS got FROM met JOIN rare USING (statement_id, question_id, word)
  GROUP BY ALL),
qh AS (
  SELECT t.statement_id, question_id, rank, t.txn_id, date, description, amount, category,
         round(2.0 - 2.0 * CAST(got AS DOUBLE) / CAST(whole AS DOUBLE), 4) AS similarity_score
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY statement_id, question_id ORDER BY got DESC, txn_id) AS rank FROM got) g
  JOIN (SELECT statement_id, question_id, SUM(weight) AS whole FROM rare GROUP BY 1, 2) USING (statement_id, question_id)
  JOIN txn_li t ON t.statement_id = g.statement_id AND t.txn_id = g.txn_id
  WHERE rank <= 5),
rel_t AS (
  SELECT s.statement_id, COALESCE(string_agg(line, chr(10) ORDER BY rank, line),
    'No specific transactions retrieved.') AS relevant_text
  FROM (SELECT DISTINCT statement_id FROM txn_li) s LEFT JOIN (
    SELECT statement_id, rank, '  • ' || date || ' | ' || description || ' | ' || {money('abs(amount)')}
      || ' | ' || category || ' (score: ' || printf('%.2f', similarity_score) || ')' AS line
    FROM qh WHERE question_id = 0) h ON h.statement_id = s.statement_id
  GROUP BY s.statement_id)"""
SQL["search_transactions"] = with_(TXN_LI, QUESTION_HITS) + "SELECT * FROM qh"


def index_hits(asked: str, meets: str = "", before: bool = False, after: bool = False) -> str:
    """Search over a stored index: ``asked`` gives (question_id, filter_category,
    question), ``meets`` restricts who is asked; the category filter holds for the
    words that score (``before``) or for the ten best (``after``).  Rows that share
    an id count once and come together."""
    sentence = ("date || ' | ' || description || ' | ' || CASE WHEN amount < 0 THEN 'spent' ELSE 'received' END || ' $' "
                "|| printf('%.2f', abs(amount)) || ' | category: ' || category")
    scoring = "category = filter_category" if before else "TRUE"
    returned = "category = filter_category" if before or after else "TRUE"
    return with_(TXN_LI) + f"""SELECT * FROM (
  WITH words AS (SELECT DISTINCT question_id, filter_category,
      unnest(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM ({asked})),
  spoken AS (SELECT DISTINCT statement_id, txn_id, category,
      unnest(string_split_regex(lower({sentence}), '[^a-z0-9]+')) AS word FROM txn_li),
  met AS (SELECT * FROM spoken JOIN words USING (word) WHERE word <> '' {meets}),
  rare AS (SELECT statement_id, question_id, word,
      CAST(round(ln(1.0 + n / CAST(COUNT(DISTINCT txn_id) AS DOUBLE)) * 1000000) AS BIGINT) AS weight
    FROM met JOIN (SELECT statement_id, COUNT(*) AS n FROM txn_li GROUP BY 1) USING (statement_id)
    GROUP BY statement_id, question_id, word, n),
  total AS (SELECT statement_id, question_id, SUM(weight) AS whole FROM rare GROUP BY 1, 2),
  scored AS (SELECT statement_id, question_id, filter_category, txn_id, SUM(weight) AS got
    FROM (SELECT DISTINCT statement_id, question_id, filter_category, txn_id, word FROM met WHERE {scoring})
    JOIN rare USING (statement_id, question_id, word) GROUP BY ALL),
  placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY statement_id, question_id ORDER BY got DESC, txn_id) AS place FROM scored)
  SELECT statement_id, question_id, DENSE_RANK() OVER (PARTITION BY statement_id, question_id ORDER BY place) AS rank,
    txn_id, date, description, amount, category,
    round(2.0 - 2.0 * CAST(got AS DOUBLE) / CAST(whole AS DOUBLE), 4) AS similarity_score
  FROM placed JOIN total USING (statement_id, question_id) JOIN txn_li USING (statement_id, txn_id)
  WHERE place <= {10 if after else 5} AND {returned}) WHERE rank <= 5"""


FILTERS = ("Brand#13", "Brand#24")
ASKED = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(q)}, {lit(c)})" for i, (q, c) in enumerate(zip(QUESTIONS, FILTERS))) + ") AS q(question_id, question, filter_category)"
SQL["index_search"] = index_hits(ASKED)
SQL["index_search_prefilter"] = index_hits(ASKED, before=True)
SQL["index_search_postfilter"] = index_hits(ASKED, after=True)
SQL["followup_search"] = index_hits(
    "SELECT conv_id AS question_id, NULL AS filter_category, 'spent on brand ' || CAST(MAX(turn) + 11 AS VARCHAR) || ' ' "
    "|| arg_max(text, turn) AS question FROM conversations GROUP BY conv_id", "AND statement_id = question_id")
SQL["report_relevant"] = with_(TXN_LI, QUESTION_HITS) + "SELECT * FROM rel_t"
SQL["advisor_context"] = with_(
    TXN_LI, f"fs AS ({metrics_sql('txn_li')})", by_category_cte("txn_li"), by_month_cte("txn_li"), SUMMARY_TEXT,
    anomalies_ctes("txn_li"), ANOM_TEXT, QUESTION_HITS,
) + """SELECT s.statement_id,
  'FINANCIAL SUMMARY:' || chr(10) || s.summary_text || chr(10) || chr(10) || 'ANOMALIES DETECTED:' || chr(10)
  || a.anomaly_text || chr(10) || chr(10) || 'RELEVANT TRANSACTIONS (semantic search results):' || chr(10)
  || r.relevant_text || chr(10) || chr(10) || 'USER QUESTION:' || chr(10)
  || """ + lit(QUESTIONS[0]) + """ AS context
FROM sum_t s LEFT JOIN anom_s a ON a.statement_id = s.statement_id LEFT JOIN rel_t r ON r.statement_id = s.statement_id"""

SQL["history_append"] = """SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1
  + MIN(turn) OVER (PARTITION BY conv_id) AS turn, role, text FROM conversations"""
SQL["latest_turn"] = """SELECT conv_id, MAX(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
FROM conversations GROUP BY conv_id"""
SQL["qa_pairs"] = """SELECT conv_id, prev_turn AS user_turn, prev_text AS question, text AS answer FROM (
  SELECT *, LAG(turn) OVER w AS prev_turn, LAG(role) OVER w AS prev_role, LAG(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND prev_role = 'user'"""
SQL["followup_guard"] = with_(TXN_LI) + """SELECT c.conv_id, s.statement_id IS NOT NULL AS has_statement,
  CASE WHEN s.statement_id IS NULL THEN 'No statement loaded yet. Please upload a PDF first.' END AS message
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT DISTINCT statement_id FROM txn_li) s ON s.statement_id = c.conv_id"""
SQL["stage_status"] = with_(*REPLIES, BATCHED, REPLY_ROWS) + """SELECT statement_id,
  CASE WHEN empty OR bad THEN 'error' ELSE 'done' END AS stage,
  CASE WHEN empty THEN 'No transactions could be extracted from any chunk.' WHEN bad THEN 'LLM returned invalid JSON' END AS error
FROM (SELECT statement_id, statement_id % 50 = 7 OR COUNT(*) FILTER (WHERE NOT lost) = 0 AS empty FROM rj_mark GROUP BY 1)
JOIN (SELECT statement_id, bool_or(bad_batch) AS bad FROM rep GROUP BY 1) USING (statement_id)"""


# --- streaming (checked against the batch statement of the same result) ------------
SQL["stream_daily_cashflow"] = with_(TXN_EV) + f"""SELECT statement_id, strftime(ts, '%Y-%m-%d') AS day,
  {dollars(f"SUM(CASE WHEN amount > 0 THEN {units()} ELSE 0 END)")} AS income,
  {dollars(f"SUM(CASE WHEN amount < 0 THEN -({units()}) ELSE 0 END)")} AS expenses,
  COUNT(*) AS n_txns
FROM (SELECT DISTINCT ON (statement_id, date, description, amount) * FROM txn_ev ORDER BY statement_id, date, description, amount, txn_id)
GROUP BY statement_id, strftime(ts, '%Y-%m-%d')"""
SQL["stream_duplicates"] = with_(TXN_LI, duplicate_ctes("txn_li")) + "SELECT * FROM dup"


# --- whole chain: the text round trip gives back txn_ev, so the oracle reads events --------
SQL["statement_summary"] = SQL["financial_summary"]
SQL["statement_status"] = with_(TXN_EV) + """SELECT statement_id, COUNT(*) AS n_txns, CAST(NULL AS VARCHAR) AS error
FROM txn_ev GROUP BY statement_id"""
