"""Registered queries: each operator of the inventory wired to the test tables.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables.  The same results are stated independently as DuckDB SQL in
``oracle_sql.py`` at the repository root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import anomalies as W
from ledgerlens.operators import summary as A
from ledgerlens.operators import views as U
from ledgerlens.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TXN_COLUMNS = ["statement_id", "txn_id", "date", "description", "amount", "category", "type"]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# --- S9 running balance --------------------------------------------------
@register("running_balance")
def _running_balance(spark, sf):
    return X.with_position(X.txn_ev(spark, sf)).select("statement_id", "txn_id", "pos", "balance")


# --- A1-A10 summary --------------------------------------------------------
@register("financial_summary")
def _financial_summary(spark, sf):
    return A.financial_summary(X.txn_ev(spark, sf))


for _name in ["total_income", "total_expenses", "net_cashflow", "transaction_count", "avg_expense", "largest_expense"]:
    register(_name)(lambda spark, sf, _n=_name: A.metric(X.txn_ev(spark, sf), _n))


@register("spending_by_category")
def _spending_by_category(spark, sf):
    return A.spending_by_category(X.txn_li(spark, sf)).drop("total_units")


@register("monthly_breakdown")
def _monthly_breakdown(spark, sf):
    return A.monthly_breakdown(X.txn_li(spark, sf)).select("statement_id", "month", "income", "expenses")


@register("summary_record")
def _summary_record(spark, sf):
    return A.flatten_summary(A.summary_record(X.txn_li(spark, sf)))


# --- W1-W4 anomalies ---------------------------------------------------------
@register("zscore_anomalies")
def _zscore(spark, sf):
    return W.zscore_anomalies(X.txn_ev(spark, sf))


@register("duplicate_charges")
def _duplicates(spark, sf):
    return W.duplicate_charges(X.txn_li(spark, sf))


@register("anomaly_reasons")
def _anomaly_reasons(spark, sf):
    return W.anomalies(X.txn_ev(spark, sf)).select("statement_id", "txn_id", "method", "reason")


@register("anomalies")
def _anomalies(spark, sf):
    return W.anomalies(X.txn_li(spark, sf))


# --- U1-U11 views -------------------------------------------------------------
@register("category_choices")
def _category_choices(spark, sf):
    return U.category_choices(X.txn_li(spark, sf))


@register("filter_category")
def _filter_category(spark, sf):
    return U.filter_category(X.txn_ev(spark, sf), "purchase").select(*TXN_COLUMNS)


@register("filter_type")
def _filter_type(spark, sf):
    return U.filter_type(X.txn_ev(spark, sf), "credit").select(*TXN_COLUMNS)


@register("search_description")
def _search_description(spark, sf):
    return U.search_description(X.txn_ev(spark, sf), "purch.*[13]").select(*TXN_COLUMNS)


@register("filter_counts")
def _filter_counts(spark, sf):
    return U.filter_counts(X.txn_ev(spark, sf), "view", "debit", "[0-4]$")


@register("format_currency")
def _format_currency(spark, sf):
    return U.format_currency(X.with_position(X.txn_ev(spark, sf)))


@register("category_share")
def _category_share(spark, sf):
    return A.category_share(X.txn_li(spark, sf))


@register("cashflow_series")
def _cashflow_series(spark, sf):
    return A.cashflow_series(X.txn_li(spark, sf))


def _li_found(spark, sf):
    t = X.txn_li(spark, sf)
    return t, W.anomalies(t)


@register("mark_anomalies")
def _mark_anomalies(spark, sf):
    t, found = _li_found(spark, sf)
    return W.mark_anomalies(t, found).select("statement_id", "txn_id", "description", "amount", "is_anomaly")


@register("flagged_points")
def _flagged_points(spark, sf):
    t, found = _li_found(spark, sf)
    return W.flagged_points(t, found).select("statement_id", "txn_id", "date", "description", "amount")


@register("normal_points")
def _normal_points(spark, sf):
    t, found = _li_found(spark, sf)
    return W.normal_points(t, found).select("statement_id", "txn_id", "date", "description", "amount")


@register("anomaly_view")
def _anomaly_view(spark, sf):
    return U.anomaly_view(W.anomalies(X.txn_li(spark, sf)))


# --- P1-P13 redaction ----------------------------------------------------------
from ledgerlens.operators import redact as P  # noqa: E402
from ledgerlens.sources.tables import read_table, spread  # noqa: E402

_RULE_KEYS = ["redact_account", "redact_routing", "redact_ssn", "redact_phone", "redact_email"]


def _docs(spark, sf):
    return spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")


def _pass_query(pass_no: int):
    def q(spark, sf):
        if pass_no == 3:  # SSNs only occur in statement pages
            src, keys = X.stmt_pages(spark, sf).select("statement_id", "page_num", "text"), ["statement_id", "page_num"]
        else:
            src, keys = _docs(spark, sf), ["doc_id"]
        r = P.regex_redact(src, "text", upto=pass_no)
        return r.select(*keys, P.pass_hits(F.col("findings"), pass_no).alias("hits"), F.col("redacted").alias("text"))

    return q


for _i, _k in enumerate(_RULE_KEYS, 1):
    register(_k)(_pass_query(_i))


@register("redact_all")
def _redact_all(spark, sf):
    r = P.regex_redact(_docs(spark, sf), "text")
    return r.select("doc_id", "redacted", F.size("findings").cast("bigint").alias("n_findings"))


@register("pii_findings")
def _pii_findings(spark, sf):
    r = P.regex_redact(_docs(spark, sf), "text")
    return P.explode_findings(r, ["doc_id"]).select(
        "doc_id", F.col("pass").cast("bigint").alias("pass"), F.col("idx").cast("bigint").alias("idx"),
        "type", "original_hash", "token",
        F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"),
    )


@register("pii_tokens")
def _pii_tokens(spark, sf):
    r = P.regex_redact(_docs(spark, sf), "text")
    return P.explode_findings(r, ["doc_id"]).select("type", "original_hash", "token").distinct()


def _entity_docs(spark, sf):
    return X.entity_documents(_docs(spark, sf))


def _names(spark):
    return P.load_recognizers(X.recognizers(spark))


@register("entity_findings")
def _entity_findings(spark, sf):
    e = P.entity_findings(P.regex_redact(_entity_docs(spark, sf), "text"), "redacted", _names(spark))
    return P.explode_findings(e, ["doc_id"], "entity_findings").select(
        "doc_id", "type", "score", "token",
        F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"),
    )


@register("entity_redact")
def _entity_redact(spark, sf):
    r = P.regex_redact(_entity_docs(spark, sf), "text")
    return P.entity_redact(r, "redacted", _names(spark)).select("doc_id", "anonymized")


def _all_findings(spark, sf):
    return P.explode_findings(P.redact_pii(_entity_docs(spark, sf), "text", _names(spark)), ["doc_id"])


@register("findings_union")
def _findings_union(spark, sf):
    return _all_findings(spark, sf).select(
        "doc_id", F.col("pass").cast("bigint").alias("pass"), F.col("idx").cast("bigint").alias("idx"),
        "type", "token", "original_hash", "score",
    )


@register("pii_audit")
def _pii_audit(spark, sf):
    return P.pii_audit(P.redact_pii(_entity_docs(spark, sf), "text", _names(spark)), ["doc_id"])


@register("token_vault")
def _token_vault(spark, sf):
    return P.token_vault(_all_findings(spark, sf), ["doc_id", "pass", "span_start"])


# --- S1-S9 sources, E1-E9 extraction ------------------------------------------------
from ledgerlens.plans import statement as PLAN  # noqa: E402
from ledgerlens.operators import extract as E  # noqa: E402
from ledgerlens.sources import loader as L  # noqa: E402
from ledgerlens.sources import pages as S  # noqa: E402

_CHUNK = ["statement_id", "chunk_idx"]


def _conv_pages(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return S.page_table(c, "conv_id", "turn", "text", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")))


@register("page_scan")
def _page_scan(spark, sf):
    return _conv_pages(spark, sf)


@register("combine_pages")
def _combine_pages(spark, sf):
    return S.combine_pages(_conv_pages(spark, sf))


@register("chunk_text")
def _chunk_text(spark, sf):
    ch = E.chunk_text(_docs(spark, sf), ["doc_id"])
    return ch.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk",
                     F.length("chunk").cast("bigint").alias("n_chars"))


def _parsed_replies(spark, sf):
    return E.parse_replies(X.raw_json(spark, sf), _CHUNK)


def _kept_and_rejects(spark, sf):
    recs = E.reply_records(_parsed_replies(spark, sf), _CHUNK)
    return E.isolate_failures(E.normalize(recs), _CHUNK)


def _ids(df):
    return [F.col("statement_id"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
            F.col("item_idx").cast("bigint").alias("item_idx")]


@register("json_repair")
def _json_repair(spark, sf):
    p = _parsed_replies(spark, sf)
    return p.select("statement_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
                    F.size("records").cast("bigint").alias("n_items"))


@register("json_records")
def _json_records(spark, sf):
    r = E.reply_records(_parsed_replies(spark, sf), _CHUNK)
    return r.select(*_ids(r), F.col("rec")["date"].alias("date"), F.col("rec")["description"].alias("description"),
                    F.col("rec")["amount"].try_cast("double").alias("amount"), F.col("rec")["type"].alias("type"))


@register("normalize_records")
def _normalize_records(spark, sf):
    kept, _ = _kept_and_rejects(spark, sf)
    return kept.select(*_ids(kept), "date", "description", "amount", "balance", "type")


@register("extract_rejects")
def _extract_rejects(spark, sf):
    _, rej = _kept_and_rejects(spark, sf)
    return rej.select(*_ids(rej), "reason")


def _kept_txns(spark, sf):
    kept, _ = _kept_and_rejects(spark, sf)
    return E.dedup_first(kept)


def _planted(spark, sf):
    """Replies of which some statements' hold nothing, and their errors."""
    replies = X.raw_json_planted(spark, sf)
    records = E.normalize(E.reply_records(E.parse_replies(replies, _CHUNK), _CHUNK))
    kept, _ = E.isolate_failures(records, _CHUNK)
    return replies, E.statement_errors(replies, E.dedup_first(kept))


@register("empty_statements")
def _empty_statements(spark, sf):
    return _planted(spark, sf)[1]


@register("txn_count")
def _txn_count(spark, sf):
    return _kept_txns(spark, sf).groupBy("statement_id").agg(F.count(F.lit(1)).alias("count"))


@register("dedup_txns")
def _dedup_txns(spark, sf):
    pos = X.with_position(X.txn_ev(spark, sf))
    base = pos.select(
        "statement_id", "txn_id", "date", "description", "amount", "balance", "pos",
        F.floor((F.col("pos") - 1) / 20).cast("bigint").alias("chunk_idx"),
        ((F.col("pos") - 1) % 20).cast("bigint").alias("item_idx"),
    )
    # A second reading of every record: one chunk later for even positions,
    # one earlier for odd ones, with another balance.
    shift = F.when(F.col("pos") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    copy = base.select(
        "statement_id", "txn_id", "date", "description", "amount",
        (F.col("balance") + F.lit(1.0)).alias("balance"), "pos",
        (F.col("chunk_idx") + shift).alias("chunk_idx"), "item_idx",
    )
    return E.dedup_first(base.unionByName(copy).drop("pos")).select(
        "statement_id", "date", "description", "amount", "txn_id", "balance", "chunk_idx", "item_idx"
    )


@register("parse_lines")
def _parse_lines(spark, sf):
    t, _ = PLAN.extract_transactions(X.stmt_pages(spark, sf))
    return t.select("statement_id", "date", "description", "amount", "balance", "type")


@register("typed_load")
def _typed_load(spark, sf):
    kept, _ = _kept_and_rejects(spark, sf)
    t = L.typed_load(kept, view=None)
    return t.select(*_ids(t), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "amount", "balance")


@register("adhoc_sql")
def _adhoc_sql(spark, sf):
    L.typed_load(X.txn_li(spark, sf), view="transactions")
    return L.run_sql(
        spark,
        "SELECT statement_id, category, COUNT(*) AS n, MIN(amount) AS min_amount, MAX(amount) AS max_amount "
        "FROM transactions WHERE amount < :lim GROUP BY statement_id, category",
        lim=0,
    )


@register("sanitize")
def _sanitize(spark, sf):
    ev = read_table(spark, sf, "events", "event_id", "value")
    return L.sanitize(ev.select("event_id", "value", F.sqrt(F.col("value") - 100).alias("root")))


@register("vector_roundtrip")
def _vector_roundtrip(spark, sf):
    path = L.scratch_path(spark, "vectors")
    L.save_vectors(read_table(spark, sf, "embeddings"), path)
    back = L.load_vectors(spark, path)
    return back.select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("n_dims"),
        F.col("embedding")[0].cast("double").alias("e_first"),
        F.element_at("embedding", -1).cast("double").alias("e_last"),
    )


# --- C1-C8 categorisation -------------------------------------------------------------
from ledgerlens.operators import categorize as C  # noqa: E402


@register("categories")
def _categories(spark, sf):
    return C.category_usage(spark, C.categorize_rules(X.txn_ev(spark, sf), X.category_rules(spark)))


@register("distinct_descriptions")
def _distinct_descriptions(spark, sf):
    return C.distinct_descriptions(X.txn_ev(spark, sf))


@register("batches_of_20")
def _batches_of_20(spark, sf):
    return C.batches(X.txn_ev(spark, sf)).select("statement_id", "txn_id", "batch", "item_idx")


@register("batch_payload")
def _batch_payload(spark, sf):
    return C.batch_payload(C.batches(X.txn_ev(spark, sf)))


@register("categorize_rules")
def _categorize_rules(spark, sf):
    t = C.categorize_rules(X.txn_ev(spark, sf), X.category_rules(spark))
    return t.select("statement_id", "txn_id", "description", "category", "confidence")


@register("categorize_ml")
def _categorize_ml(spark, sf):
    """Trained on four fifths of the transactions, asked for all: ``held_out``
    marks the rows that the model has not seen."""
    t = X.txn_ev(spark, sf).withColumn("held_out", F.crc32(F.col("txn_id").cast("string")) % 5 == 0)
    return C.categorize_ml(t.filter("NOT held_out"), t).select(
        "statement_id", "txn_id", "description", "category", "confidence", "held_out")


@register("category_unknown")
def _category_unknown(spark, sf):
    """Rows with replied categories, and error events with their own."""
    t = C.apply_map(X.txn_ev(spark, sf), _reply_map(spark, sf)).unionByName(
        X.txn_ev(spark, sf).where("category = 'error'"), allowMissingColumns=True)
    return C.category_unknown(spark, t).select("statement_id", "txn_id", "category")


def _reply_map(spark, sf):
    recs, _ = C.parse_category_replies(X.category_replies(spark, sf))
    return C.reply_map(recs)


@register("category_map")
def _category_map(spark, sf):
    return _reply_map(spark, sf)


@register("categorize_join")
def _categorize_join(spark, sf):
    t = C.apply_map(X.txn_ev(spark, sf), _reply_map(spark, sf))
    return t.select("statement_id", "txn_id", "description", "category", "confidence")


@register("category_rejects")
def _category_rejects(spark, sf):
    _, rej = C.parse_category_replies(X.category_replies(spark, sf))
    return rej


# --- V1-V9 search ----------------------------------------------------------------------
from ledgerlens.operators import postings as IX  # noqa: E402
from ledgerlens.operators import search as V  # noqa: E402


def _corpus(spark, sf):
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label").withColumn(
        "category", F.col("label").cast("string")
    )


def _questions(spark, sf):
    """One question per label: its unit centroid; the filter category of a
    question is the next label."""
    c = X.label_centroids(read_table(spark, sf, "embeddings", "embedding", "label"))
    return c.withColumn("filter_category", ((F.col("query_id") + 1) % 10).cast("string"))


def _global_question(spark, sf):
    e = read_table(spark, sf, "embeddings", "embedding").withColumn("label", F.lit(0))
    return X.label_centroids(e)


_KNN_COLS = ["query_id", "rank", "vec_id", "label", "similarity_score"]


@register("txn_sentences")
def _txn_sentences(spark, sf):
    t = C.categorize_rules(X.txn_ev(spark, sf), X.category_rules(spark))
    return V.txn_sentences(t).select("statement_id", "txn_id", "content")


@register("txn_metadata")
def _txn_metadata(spark, sf):
    t = C.apply_map(X.with_position(X.txn_ev(spark, sf)), _reply_map(spark, sf))
    return V.txn_metadata(t)


@register("search_transactions")
def _search_transactions(spark, sf):
    hits = V.question_hits(X.txn_li(spark, sf), X.questions(spark))
    return hits.select("statement_id", "question_id", "rank", "txn_id", "date", "description", "amount", "category", "similarity_score")


_HIT_COLS = ["statement_id", "question_id", "rank", "txn_id", "date", "description", "amount", "category", "similarity_score"]


def _index(spark, sf):
    """The word index of ``txn_li``, written in two batches."""
    path = L.scratch_path(spark, "index")
    t = X.txn_li(spark, sf)
    IX.append_batch(t.filter("txn_id % 2 = 0"), path, 0)
    IX.append_batch(t.filter("txn_id % 2 <> 0"), path, 1)
    return path


@register("index_search")
def _index_search(spark, sf):
    return IX.search(spark, _index(spark, sf), X.questions(spark)).select(*_HIT_COLS)


@register("index_search_postfilter")
def _index_search_postfilter(spark, sf):
    return IX.search(spark, _index(spark, sf), X.filtered_questions(spark)).select(*_HIT_COLS)


@register("index_search_prefilter")
def _index_search_prefilter(spark, sf):
    return IX.search(spark, _index(spark, sf), X.filtered_questions(spark), prefilter=True).select(*_HIT_COLS)


@register("followup_search")
def _followup_search(spark, sf):
    """Follow-ups read the stored index: the newest turn of a conversation is
    put to the statement of the same number."""
    path = _index(spark, sf)
    latest = H.latest_turn(_conversations(spark, sf))
    asked = latest.select(F.col("conv_id").alias("statement_id"), F.col("conv_id").alias("question_id"),
                          F.concat(F.lit("spent on brand "), F.col("turn") + 11, F.lit(" "), F.col("text")).alias("question"))
    return IX.search(spark, path, asked).select(*_HIT_COLS)


@register("embed_normalize")
def _embed_normalize(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", norm.alias("norm"), V.normalize(F.col("embedding"))[0].alias("e_first"))


@register("knn_l2")
def _knn_l2(spark, sf):
    return V.knn(_corpus(spark, sf), _global_question(spark, sf)).select("rank", "vec_id", "label", "similarity_score")


@register("knn_batch")
def _knn_batch(spark, sf):
    return V.knn_batch(_corpus(spark, sf), _questions(spark, sf)).select(*_KNN_COLS)


@register("knn_postfilter")
def _knn_postfilter(spark, sf):
    return V.knn_postfilter(_corpus(spark, sf), _questions(spark, sf)).select(*_KNN_COLS)


@register("knn_prefilter")
def _knn_prefilter(spark, sf):
    return V.knn_prefilter(_corpus(spark, sf), _questions(spark, sf)).select(*_KNN_COLS)


@register("knn_lsh")
def _knn_lsh(spark, sf):
    q = _global_question(spark, sf).first()["embedding"]  # one 64-d vector
    return V.knn_lsh(_corpus(spark, sf), list(q)).select("vec_id", "label", "l2")


# --- R1-R4 report, H1-H5 threads ------------------------------------------------------
from ledgerlens.operators import report as R  # noqa: E402
from ledgerlens.operators import threads as H  # noqa: E402

@register("report_summary")
def _report_summary(spark, sf):
    return R.summary_text(A.summary_record(X.txn_li(spark, sf)))


@register("report_anomalies")
def _report_anomalies(spark, sf):
    t = X.txn_li(spark, sf)
    return R.anomaly_text(t, W.anomalies(t))


def _relevant(spark, sf):
    t = X.txn_li(spark, sf)
    return R.relevant_text(t, V.question_hits(t, X.questions(spark).where("question_id = 0")))


@register("report_relevant")
def _report_relevant(spark, sf):
    return _relevant(spark, sf)


@register("advisor_context")
def _advisor_context(spark, sf):
    t = X.txn_li(spark, sf)
    summary = R.summary_text(A.summary_record(t))
    anomaly = R.anomaly_text(t, W.anomalies(t))
    return R.advisor_context(summary, anomaly, _relevant(spark, sf), F.lit(X.QUESTIONS[0]))


def _conversations(spark, sf):
    return read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")


@register("history_append")
def _history_append(spark, sf):
    c = _conversations(spark, sf)
    return H.history_append(c.filter(F.col("turn") < 2), c.filter(F.col("turn") >= 2))


@register("latest_turn")
def _latest_turn(spark, sf):
    return H.latest_turn(_conversations(spark, sf))


@register("qa_pairs")
def _qa_pairs(spark, sf):
    return H.qa_pairs(_conversations(spark, sf))


@register("followup_guard")
def _followup_guard(spark, sf):
    return H.followup_guard(_conversations(spark, sf), X.txn_li(spark, sf))


@register("stage_status")
def _stage_status(spark, sf):
    """All six stages: replies without transactions stop a statement at
    extraction, an invalid categoriser reply at categorisation."""
    replies, extracted = _planted(spark, sf)
    _, bad = C.parse_category_replies(X.category_replies(spark, sf))
    categorised = bad.select("statement_id", F.lit("LLM returned invalid JSON").alias("error")).distinct()
    fine = replies.select("statement_id", F.lit(None).cast("string").alias("error")).limit(0)
    index = extracted.select("statement_id", F.when(F.col("n_txns") == 0, F.lit("nothing to index")).alias("error"))
    return H.stage_status(replies, [
        ("redacted", fine), ("extracted", extracted), ("categorized", categorised), ("analyzed", fine),
        ("vectorstore_ready", index), ("done", fine)])


# --- T1-T2 streaming ---------------------------------------------------------------------
from ledgerlens.streaming import duplicates as T2  # noqa: E402
from ledgerlens.streaming import ingest as T1  # noqa: E402


@register("stream_daily_cashflow")
def _stream_daily_cashflow(spark, sf):
    return T1.run_daily_cashflow(spark, lambda s: X.txn_ev_frame(X.stream_table(s, sf, "events", "event_id")))


@register("stream_duplicates")
def _stream_duplicates(spark, sf):
    def source(s):
        li = X.stream_table(s, sf, "lineitem", "l_orderkey")
        return X.txn_li_frame(li, read_table(s, sf, "part", "p_partkey", "p_brand"))

    return T2.run_duplicate_stream(spark, source)


# --- the whole chain ----------------------------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Statement pages -> ... -> per-statement financial summary."""
    return PLAN.analyse(X.stmt_pages(spark, sf), X.category_rules(spark)).summary


@register("statement_summary")
def _statement_summary(spark, sf):
    return flagship(spark, sf)


@register("statement_status")
def _statement_status(spark, sf):
    return PLAN.analyse(X.stmt_pages(spark, sf), X.category_rules(spark)).status
