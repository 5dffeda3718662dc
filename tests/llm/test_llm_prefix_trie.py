"""Prefix trie against a brute-force version, with containers small enough
to burst many times, and its edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest

from ledgerlens.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = [c for c in cs if len(convs[c]) == len(path)]
        out.append((
            cs[0], len(path), members[path[:-1]][0] if path else None, len(cs), kids[path],
            sum(1 for p in below if not kids[p]), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    from ledgerlens.llm.prefix_trie import trie_nodes, turn_table

    turns = turn_table(spark.createDataFrame(rows, SCHEMA))
    got = trie_nodes(turns.select("conv_id").distinct(), turns, **options) if options else conversation_trie(
        spark.createDataFrame(rows, SCHEMA))
    assert tuple(got.columns) == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def talk(c, texts):
    return [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


def planted():
    rng = random.Random(5)
    rows = []
    for c in range(60):
        rows += talk(c, [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 7))])
    for c in range(60, 75):  # copies, in no order of ids
        rows += talk(c, ["hello", "hi", "bye"])
    rows += talk(80, [f"t{i}" for i in range(90)])  # long shared beginning, then apart
    rows += talk(81, [f"t{i}" for i in range(70)] + [f"u{i}" for i in range(30)])
    rows += talk(79, [f"t{i}" for i in range(20)])  # ends inside
    return rows


@pytest.mark.parametrize("container", [3, 30, 2048])
def test_matches_brute_force(spark, container):
    rows = planted()
    assert found(spark, rows, container_turns=container) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (2, None, "", ""), (2, 0, "user", "x"),  # null is empty, null turn first
        (None, 0, "user", "lost"), (3, 5, "user", "é"), (3, 5, "user", "é"),  # no id; repeated row
        (-7, 1, "user\nx", "y"), (4, 1, "user", "x\ny"),
    ]
    assert found(spark, rows) == brute(rows)
    assert spark.createDataFrame([], SCHEMA).transform(conversation_trie).count() == 0


def test_clashing_extra_columns(spark):
    rows = planted()[:40]
    names = "pos long, head string, chars string, turns string, weight string"
    wide = spark.createDataFrame([(*r, 9, "h", "c", "t", "w") for r in rows], f"{SCHEMA}, {names}")
    assert sorted((tuple(r) for r in conversation_trie(wide).collect()), key=str) == brute(rows)
