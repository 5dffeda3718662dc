"""Personal-data redaction with stable tokens, findings, audit and vault.

Pass 1 (regex rules, in order): each match is replaced by
``[LABEL_<first 8 hex of SHA-256, upper>]``; each later rule runs over the
text already rewritten.  Findings carry the span relative to the text
entering that pass.  Pass 2 (entity recognisers, a small table of
patterns): hits are listed with their score and token, and the text gets
``<ENTITY_TYPE>`` in their place.

Everything is a per-row projection of Catalyst expressions: no shuffle,
no UDF; a document is handled whole inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import UNICODE, match_starts, stitch

# --- fixed values (must equal the reference's) ---------------------------
# Regex rules in pass order: label, pattern, flags ("i" = ignore case).
REGEX_RULES: list[tuple[str, str, str]] = [
    ("ACCOUNT_NUMBER", r"\b\d{8,17}\b", ""),
    ("ROUTING_NUMBER", r"\b\d{9}\b", ""),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", ""),
    ("PHONE", r"\b(\+1[\s-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", ""),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", "i"),
]
# --------------------------------------------------------------------------

# Default entity recognisers (type, pattern, score); no date entity, so
# statement dates survive for the line parser.
RECOGNIZERS: list[tuple[str, str, float]] = [
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6),
    ("URL", r"\bhttps?://[^\s\"'<>]+", 0.5),
]

FINDING = (
    "struct<type:string,original_hash:string,token:string,span_start:int,span_end:int,"
    "score:double,pass:int,idx:int>"
)


def java_pattern(pattern: str, flags: str = "") -> str:
    return "(?" + ("i" if "i" in flags else "") + UNICODE[2:-1] + ")" + pattern


def token(label: str | Column, value: Column) -> Column:
    """``[LABEL_XXXXXXXX]``: stable for a value, label first seen wins (the
    regex rules cannot both match one whole string, so stateless is exact)."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit("["), label, F.lit("_"), F.upper(F.substring(F.sha2(value, 256), 1, 8)), F.lit("]"))


def _token_fn(label: str):
    return lambda v: token(label, v)


def _findings(label: str, parts: Column, ms: Column, pass_no: int, score: float | None) -> Column:
    # The lambda reads only its own element: nothing row-sized is
    # re-evaluated per match.
    zipped = F.arrays_zip(ms.alias("m"), match_starts(parts, ms).alias("s"))
    return F.transform(
        zipped,
        lambda x, j: F.struct(
            F.lit(label).alias("type"),
            F.sha2(x["m"], 256).alias("original_hash"),
            token(label, x["m"]).alias("token"),
            x["s"].cast("int").alias("span_start"),
            (x["s"] + F.length(x["m"])).cast("int").alias("span_end"),
            F.lit(score).cast("double").alias("score"),
            F.lit(pass_no).cast("int").alias("pass"),
            j.cast("int").alias("idx"),
        ),
    )


# By pattern: a rule whose every possible match is consumed by an earlier one.
# Proof for the routing rule after the account rule: a ``\b\d{9}\b`` match is
# a whole digit run of length 9 with word boundaries on both sides, which
# ``\b\d{8,17}\b`` matches first and turns into a token; inside a token
# every digit run follows ``_`` or a letter (word characters), so no
# boundary precedes it.  The rule keeps its pass number, its scans are skipped.
SHADOWED_BY = {REGEX_RULES[1][1:]: REGEX_RULES[0][1:]}

# By pattern: a character every match contains (outside any optional part).
# A text without it cannot match, so its regex scans are skipped after one
# byte search; the tokens earlier passes insert hold neither character, so
# the test is exact on rewritten text too.
REQUIRED_CHAR = {REGEX_RULES[2][1:]: "-", REGEX_RULES[4][1:]: "@"}


def _empty_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it any number of times inside ``fn`` (a
    one-element ``transform``).  Each pass reads the previous text several
    times; without the binding, projection collapsing or a pushed-down
    filter would copy the previous passes into every use, and the plan
    would grow exponentially with the number of rules."""
    return F.transform(F.array(value), fn)[0]


def _rule_findings(t: Column, label: str, jp: str, pass_no: int, score: float | None, rewrite: bool):
    """Matches of one rule on text ``t`` (one scan); the split and the
    rewrite only when there is a match.  Returns a function of the running
    state struct(text, findings)."""

    def on_matches(ms: Column, s: Column) -> Column:
        def on_parts(parts: Column) -> Column:
            text = stitch(parts, F.transform(ms, _token_fn(label))) if rewrite else t
            return F.struct(
                text.alias("text"),
                F.concat(s["findings"], _findings(label, parts, ms, pass_no, score)).alias("findings"),
            )

        return F.when(F.size(ms) > 0, _let(F.split(t, jp, -1), on_parts)).otherwise(s)

    return on_matches


def _apply_rule(state: Column, label: str, jp: str, pass_no: int, score: float | None = None,
                rewrite: bool = True, text: Column | None = None, required: str | None = None) -> Column:
    """state struct(text, findings) -> state after one rule.  ``text``
    (default: the state's text) is the text the rule scans; ``required``
    is a character every match contains (see ``REQUIRED_CHAR``)."""

    def on_state(s: Column) -> Column:
        t = s["text"] if text is None else text
        step = _rule_findings(t, label, jp, pass_no, score, rewrite)
        scanned = _let(F.regexp_extract_all(t, F.lit(jp), 0), lambda ms: step(ms, s))
        if required is None:
            return scanned
        return F.when(F.instr(t, required) > 0, scanned).otherwise(s)

    return _let(state, on_state)


def _start_state(text: Column) -> Column:
    return F.struct(text.alias("text"), _empty_findings().alias("findings"))


def regex_redact(
    df: DataFrame,
    text_col: str = "text",
    rules: Sequence[tuple[str, str, str]] = REGEX_RULES,
    out: str = "redacted",
    findings: str = "findings",
    upto: int | None = None,
) -> DataFrame:
    """Add ``out`` (text after the rules) and ``findings`` (array of
    findings of every pass).  ``upto`` stops after that many rules."""
    base = df.columns
    rules = list(rules) if upto is None else list(rules)[:upto]
    state = _start_state(F.col(text_col))
    done: set[tuple[str, str]] = set()
    for i, (label, pattern, flags) in enumerate(rules, 1):
        rule = (pattern, flags)
        if SHADOWED_BY.get(rule) not in done:
            state = _apply_rule(state, label, java_pattern(pattern, flags), i, required=REQUIRED_CHAR.get(rule))
        done.add(rule)
    tmp = df.select("*", state.alias("__rx"))
    return tmp.select(*base, F.col("__rx.text").alias(out), F.col("__rx.findings").alias(findings))


def pass_hits(findings: Column, pass_no: int) -> Column:
    return F.size(F.filter(findings, lambda f: f["pass"] == F.lit(pass_no))).cast("bigint")


def entity_findings(
    df: DataFrame,
    text_col: str = "redacted",
    recognizers: Sequence[tuple[str, str, float]] = RECOGNIZERS,
    out: str = "entity_findings",
    first_pass: int = len(REGEX_RULES) + 1,
) -> DataFrame:
    """Every recogniser hit on the (regex-redacted) text, with
    ``round(score, 3)`` and its token; spans are kept as well."""
    base = df.columns

    def on_text(t: Column) -> Column:
        state = _start_state(t)
        for k, (etype, pattern, score) in enumerate(recognizers):
            state = _apply_rule(state, etype, java_pattern(pattern), first_pass + k, round(score, 3),
                                rewrite=False, text=t)
        return state["findings"]

    return df.select(*base, _let(F.col(text_col), on_text).alias(out))


def winning_spans(hits: Column) -> Column:
    """The hits that are replaced, by place: of overlapping ones the longest,
    then the one with the highest score, then the first."""
    ranked = F.array_sort(F.transform(hits, lambda h: F.struct(
        (h["span_start"] - h["span_end"]).alias("k"), (-h["score"]).alias("s"), h["span_start"].alias("a"),
        h["span_end"].alias("b"), h["type"].alias("type"))))
    kind = "array<struct<a:int,b:int,type:string>>"

    def step(kept: Column, h: Column) -> Column:
        free = ~F.exists(kept, lambda w: (w["a"] < h["b"]) & (h["a"] < w["b"]))
        return F.when(free, F.array_append(kept, F.struct(h["a"], h["b"], h["type"]))).otherwise(kept)

    return F.array_sort(F.aggregate(ranked, F.array().cast(kind), step))


def entity_redact(
    df: DataFrame,
    text_col: str = "redacted",
    recognizers: Sequence[tuple[str, str, float]] = RECOGNIZERS,
    out: str = "anonymized",
    hits: str | None = None,
) -> DataFrame:
    """P10: recogniser hits replaced by ``<ENTITY_TYPE>``.  All hits are found
    on the text as it is (``hits``, or found here); overlaps are resolved,
    then each winner is replaced once, so no part of a hit is left behind."""
    base = df.columns
    if hits is None:
        df, hits = entity_findings(df, text_col, recognizers, out="__hits"), "__hits"

    def rewrite(spans: Column) -> Column:
        text = F.col(text_col)
        before = F.transform(spans, lambda x, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(0)).otherwise(spans[F.greatest(i - 1, F.lit(0))]["b"]) + 1,
                        x["a"] - F.when(i == 0, F.lit(0)).otherwise(spans[F.greatest(i - 1, F.lit(0))]["b"])),
            F.lit("<"), x["type"], F.lit(">")))
        rest = F.substring(text, F.element_at(spans, -1)["b"] + 1, F.length(text))
        return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(before, ""), rest))

    return df.select(*base, _let(winning_spans(F.col(hits)), rewrite).alias(out))


def redact_pii(df: DataFrame, text_col: str = "text",
               recognizers: Sequence[tuple[str, str, float]] = RECOGNIZERS) -> DataFrame:
    """Both passes: ``redacted_text`` and all ``findings`` (regex then entity)."""
    r = regex_redact(df, text_col, out="__regex", findings="__rf")
    r = entity_findings(r, "__regex", recognizers, out="__ef")
    r = entity_redact(r, "__regex", recognizers, out="redacted_text", hits="__ef")
    return r.select(*df.columns, "redacted_text", F.concat("__rf", "__ef").alias("findings"))


def load_recognizers(table: DataFrame, at_most: int = 1000) -> list[tuple[str, str, float]]:
    """A recogniser table (``entity_type``, ``pattern``, ``score``) as rules,
    in order of type and pattern; its size is checked."""
    rows = table.orderBy("entity_type", "pattern").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} recognisers")
    return [(r["entity_type"], r["pattern"], r["score"]) for r in rows]


def explode_findings(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """One row per finding.

    ``inline_outer`` + a filter on its output, not ``inline``: for a plain
    generator the optimizer infers ``size(findings) > 0`` and pushes it below
    the projections, inlining every redaction pass into one predicate."""
    return df.select(*keys, F.inline_outer(findings)).filter(F.col("pass").isNotNull())


def pii_audit(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """Number of items per text (zero included); per-row, no shuffle."""
    return df.select(*keys, F.size(findings).cast("bigint").alias("items_found"))


def token_vault(found: DataFrame, order: Sequence[str]) -> DataFrame:
    """Value hash -> token, the first finding (by ``order``) wins."""
    return found.groupBy("original_hash").agg(
        F.min_by("token", F.struct(*[F.col(c) for c in order])).alias("token")
    )
