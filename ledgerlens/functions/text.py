"""String expressions built from Catalyst higher-order functions (no UDFs).

* ``match_starts``: code-point offsets of every match.
* ``py_strip``: Python's ``str.strip()`` (Unicode blanks, not only spaces).
* ``greedy_chunks``: line-bounded greedy packing of a text, as one fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flag: \b \w \d \s follow Unicode, as they do in Python's re.
UNICODE = "(?U)"


def regex_parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """(pieces between matches, matches); ``len(pieces) = len(matches) + 1``."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)


def stitch(parts: Column, replacements: Column) -> Column:
    """Interleave pieces and replacements back into one string."""
    pairs = F.zip_with(parts, replacements, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    return F.array_join(F.flatten(pairs), "")


def match_starts(parts: Column, ms: Column) -> Column:
    """0-based code-point offset of each match: one linear fold over
    (piece, match) pairs carrying the running length."""
    pairs = F.arrays_zip(parts.alias("p"), ms.alias("m"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["pos"] + F.length(x["p"])
        return F.struct(
            (here + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
            F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], here)).alias("out"),
        )

    return F.aggregate(pairs, init, step, lambda acc: acc["out"])


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def greedy_chunks(text: Column, max_chars: int) -> Column:
    """Split at newlines and pack lines greedily into chunks.

    A chunk is flushed when ``len(current) + len(line) > max_chars``
    (``current`` counts its newlines); a longer single line stays whole.
    Chunks are stripped and blank ones dropped.  One in-row fold per text:
    no shuffle, and the text is never cut below line granularity.
    """
    lines = F.split(text, "\n", -1)
    init = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        flush = F.length(acc["cur"]) + F.length(line) > F.lit(max_chars)
        return F.when(
            flush,
            F.struct(F.concat(line, F.lit("\n")).alias("cur"), F.array_append(acc["out"], acc["cur"]).alias("out")),
        ).otherwise(
            F.struct(F.concat(acc["cur"], line, F.lit("\n")).alias("cur"), acc["out"].alias("out"))
        )

    packed = F.aggregate(lines, init, step, lambda acc: F.array_append(acc["out"], acc["cur"]))
    return F.filter(F.transform(packed, py_strip), lambda c: c != F.lit(""))
