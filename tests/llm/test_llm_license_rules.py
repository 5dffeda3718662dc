"""Every spelling of every rule against matching without a keyword or gate."""

import re
from itertools import islice

from ledgerlens.llm.license_rules import GATE_STEMS, rules
from ledgerlens.llm.license_scan import scan


def spellings(pattern):
    """Texts that the pattern matches: each way through its groups."""
    group = re.search(r"\(([^()]*)\)(\??)", pattern)
    if not group:
        for wild in ("[a-z0-9]+", "[a-z]+"):
            pattern = pattern.replace(wild, "x")
        one = re.search(r"\[([^\]]*)\]", pattern)
        if not one:
            yield " ".join(pattern.split())
            return
        for ch in one[1]:
            yield from spellings(pattern[: one.start()] + ch + pattern[one.end() :])
        return
    for way in group[1].split("|") + [""] * bool(group[2]):
        yield from spellings(pattern[: group.start()] + way + pattern[group.end() :])


def labels_without_gate(text, listed):
    words = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", text).strip().lower()
    form = f" {words.replace(' ', '  ')} "
    found = sorted(
        (m.start() // 2 and form[: m.start()].count(" ") // 2, -(form[: m.end()].count(" ") // 2), r.tier, r.rule_id, r)
        for r in listed for m in re.finditer(r.pattern, form))
    labels = set()
    for i, (_, end, tier, _, r) in enumerate(found):
        reach = max((-e for _, e, t, _, _ in found[:i] if t <= tier), default=-1)
        if r.base or reach < -end:
            labels.add(r.label)
    return ",".join(sorted(labels))


def test_every_match_holds_its_keyword_and_a_gate_stem():
    for rule in rules():
        for text in islice(spellings(rule.pattern), 20_000):
            assert rule.keyword in text.split(), (rule, text)
            assert any(w.startswith(GATE_STEMS) for w in text.split()), (rule, text)


def test_scan_finds_each_spelling(spark):
    listed = rules()
    texts = {"This program is GPL v3", "GNU GPL version 2", "Dedicated by CC Zero, 2020", "under GNU GPL",
             "The software is provided as is, without warranty of any kind", "you must give appropriate credit, provide a link to the license"}
    for rule in listed:
        texts |= {f"about {t} here" for t in islice(spellings(rule.pattern), 6 if rule.tier == 2 else 40)}
    rows = list(enumerate(sorted(texts)))
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(t, got[i], labels_without_gate(t, listed)) for i, t in rows if got[i] != labels_without_gate(t, listed)]
    assert not wrong, wrong[:5]
    assert all(got.values())
    by_text = {t: got[i] for i, t in rows}
    assert by_text["This program is GPL v3"] == "gpl-3" and by_text["GNU GPL version 2"] == "gpl-2"
    assert by_text["Dedicated by CC Zero, 2020"] == "cc0"
