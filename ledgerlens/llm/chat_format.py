"""Chat formatting: heterogeneous conversation records to canonical turns,
and turns to a training text whose control strings can be undone.

**Layouts.**  A record's layout is the set of its nested field paths
(``messages[].role``), as far as any known mapping mentions them, so other
fields do not matter.  The hash of the sorted paths (the fingerprint)
selects a declarative mapping from ``LAYOUTS``; a record that mixes fields of
several gets the largest that it has all fields of.  ``record_turns`` does this
per JSON record, ``row_turns`` once per table whose rows are turns, with
the field paths of its schema.

**Template.**  Every turn stands between control strings; texts (and role
names that have no control string of their own) are escaped so that no
control string occurs inside: each backslash is doubled and a backslash is
put after the first character of a control string.  The formatted
conversation is the segments of its turns in order; reading back splits at
control strings, removes the escapes and knows which characters are under
the loss mask (assistant texts).

Formatting is a native expression per turn without a shuffle.  Reading back
streams the segments of a conversation in order through one hash state, so
a conversation of any length takes constant memory; its digest is
sequential by definition, so one conversation is one task's work, but never
held as a group.

Defined cases: null texts and null roles count as empty; turns are ordered
by turn (null first), then role, then text, so that ties and repeated rows
have one order; null conversation ids are one conversation; records that
are not JSON objects, or match no layout, give one row with the fingerprint
and a null turn; extra columns and fields are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``each``: path of a list of turns with fields ``role`` and ``text``;
    ``pairs``: path of a list of (user, assistant) pairs that comes first;
    ``fields``: (role, field names joined by an empty line) in order;
    ``row``: (id, order, role, text) columns of tables whose rows are turns.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    pairs: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str, str] | None = None

    def paths(self) -> set[str]:
        found = {name for _, names in self.fields for name in names}
        if self.each:
            found |= {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
        if self.pairs:
            found.add(f"{self.pairs}[][]")
        return found | set(self.row or ())


def _prompted(name: str, *fields: tuple[str, tuple[str, ...]], pairs: str = "") -> Layout:
    return Layout(name, fields=fields, pairs=pairs)


CANONICAL_ROWS = ("conv_id", "turn", "role", "text")
LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("share", each="conversations", role="from", text="value"),
    Layout("dialog", each="dialog", role="speaker", text="utterance"),
    Layout("turns", each="turns", role="role", text="text"),
    Layout("messages_system", each="messages", role="role", text="content", fields=(("system", ("system",)),)),
    Layout("share_system", each="conversations", role="from", text="value", fields=(("system", ("system",)),)),
    _prompted("prompt", ("user", ("prompt",)), ("assistant", ("response",))),
    _prompted("prompt_system", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _prompted("completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _prompted("question", ("user", ("question",)), ("assistant", ("answer",))),
    _prompted("question_context", ("user", ("context", "question")), ("assistant", ("answer",))),
    _prompted("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    _prompted("instruction_response", ("user", ("instruction",)), ("assistant", ("response",))),
    _prompted("instruction_input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _prompted("instruction_system", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    _prompted("instruction_history", ("user", ("instruction", "input")), ("assistant", ("output",)), pairs="history"),
    Layout("turn_rows", row=CANONICAL_ROWS),
    Layout("speaker_rows", row=("conversation_id", "index", "speaker", "utterance")),
    Layout("message_rows", row=("thread_id", "position", "role", "content")),
)
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
KNOWN_PATHS = frozenset(path for layout in LAYOUTS for path in layout.paths())


def fingerprint(paths) -> str:
    """Hash of the known field paths among ``paths``."""
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN_PATHS)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout.paths()): layout for layout in LAYOUTS}


def layout_of(paths: set[str], rows: bool) -> Layout | None:
    """The mapping of a fingerprint; where a record has fields of several
    layouts, the largest layout that it has all fields of."""
    found = MAPPINGS.get(fingerprint(paths))
    if found is None or bool(found.row) != rows:
        inside = [x for x in LAYOUTS if bool(x.row) == rows and x.paths() <= paths]
        found = max(inside, key=lambda x: len(x.paths()), default=None)
    return found


def value_paths(value, at: str = "") -> Iterator[str]:
    """Field paths of the leaves of a JSON value; null fields are absent."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from value_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, f"{at}[]")
    elif value is not None:
        yield at


def schema_paths(kind: DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def mapped_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record by its mapping; an empty optional part of a
    joined field is left out."""
    lead = [(role, "\n\n".join(t for n in names if (t := _text(record.get(n))))) for role, names in layout.fields]
    turns = [t for t in lead if t[0] == "system"]
    for pair in record.get(layout.pairs) or [] if layout.pairs else []:
        turns += [(role, _text(text)) for role, text in zip(("user", "assistant"), pair, strict=False)]
    for turn in record.get(layout.each) or [] if layout.each else []:
        role = _text(turn.get(layout.role)) if isinstance(turn, dict) else ""
        text = _text(turn.get(layout.text)) if isinstance(turn, dict) else _text(turn)
        turns.append((ROLE_NAMES.get(role.lower(), role), text))
    return turns + [t for t in lead if t[0] != "system"]


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def record_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns (``conv_id``, ``turn``, ``role``, ``text``, ``layout``,
    ``fingerprint``) of JSON records of any known layout; a record of no
    known layout gives one row with null turn, role, text and layout."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                paths = set(value_paths(record)) if isinstance(record, dict) else set()
                mark = fingerprint(paths)
                layout = layout_of(paths, rows=False)
                turns = mapped_turns(record, layout) if layout else []
                rows += [(conv, i, role, text, layout.name, mark) for i, (role, text) in enumerate(turns)]
                if not turns:
                    rows.append((conv, None, None, None, None, mark))
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 4]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "turn", "role", "text", "layout", "fingerprint"])

    return df.select(id_col, json_col).mapInArrow(
        run, f"conv_id {id_type}, turn long, role string, text string, layout string, fingerprint string")


def row_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose rows are turns; the fingerprint of
    its schema selects the mapping of its columns."""
    paths = set(schema_paths(df.schema))
    mark, layout = fingerprint(paths), layout_of(paths, rows=True)
    if layout is None:
        raise ValueError(f"no layout of turn rows has the fingerprint {mark}")
    conv, order, role, text = (F.col(c) for c in layout.row)
    role = F.coalesce(role, F.lit(""))
    if layout.row != CANONICAL_ROWS:  # roles of other tables get their usual names
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
        role = F.coalesce(names[F.lower(role)], role)
    return df.select(
        conv.alias("conv_id"), order.cast("long").alias("turn"), role.alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(layout.name).alias("layout"), F.lit(mark).alias("fingerprint"),
    )


# --------------------------------------------------------------- template

# Prefix and suffix of the turns of a role; other roles are named in the text.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("<s>", "</s>")}
ROLE_MARK, TEXT_MARK, END_MARK = "<|role|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
_CONTROL = r"[<\[](?=/?s>|/?INST\]|</?SYS>>|\|role\||\|text\||\|end\|)"
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>|<s>(?P<assistant>.*?)</s>"
    r"|<\|role\|>(?P<role>.*?)<\|text\|>(?P<text>.*?)<\|end\|>", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(turns: DataFrame) -> DataFrame:
    """The formatted text of each canonical turn: ``conv_id``, ``turn``,
    ``segment``, and the sort keys of its place in the conversation."""
    text, role = escaped(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    shown = F.concat(F.lit(ROLE_MARK), escaped(role), F.lit(TEXT_MARK), text, F.lit(END_MARK))
    for name, (before, after) in MARKS.items():
        shown = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(shown)
    return turns.select("conv_id", "turn", shown.alias("segment"), role.alias("__role"),
                        F.xxhash64("text").alias("__tie"))


def parse(formatted: str) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of the turns of a formatted text;
    anything outside of turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "text" else kind
        turns.append((role, unescape(m[kind]), role == LOSS_ROLE))
    if at != len(formatted):
        raise ValueError(f"not a formatted turn at character {at}")
    return turns


class _Digest:
    """Running figures of one conversation."""

    def __init__(self):
        self.turns, self.chars, self.loss = 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, loss in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if loss:
                self.loss += len(text)
                self.masked.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What is read from the segments of each conversation: ``n_turns``,
    digests of turns and of the text under the loss mask, lengths."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind, names = None, None, None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for key, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        rows.append((conv, *state.row()))
                    conv, state = key, _Digest()
                state.add(segment)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _kinds(kind), strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((conv, *state.row()), _kinds(kind), strict=True)], names)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "__role", "__tie", "segment")
        .select("conv_id", "segment")
        .mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def _kinds(key: pa.DataType) -> list[pa.DataType]:
    return [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)")
    return read_back(segments(row_turns(conversations.unionByName(added))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(regexp_replace(t, '\\', '\\\\', 'g'),
  '([<\[])(/?s>|/?INST\]|</?SYS>>|\|role\||\|text\||\|end\|)', '\1\\\2', 'g')) AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
