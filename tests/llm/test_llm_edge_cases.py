"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing extra columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    bpe_codec,
    byte_bpe,
    chat_format,
    exact_dedup,
    language_id,
    license_scan,
    lm_score,
    ngram_join,
    packing,
    topk_search,
)

LONG = " ".join(f"w{i % 977} the" for i in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Under the MIT License. a b c d"), (4, "Under the MIT License. a b c d"),
    (None, "Under the MIT  License.\ta b c d"), (5, LONG), (6, LONG + " tail"), (7, "one two"), (8, "ONE two"),
    (9, "Ärger über   Öl 12,5 %%% don't"), (-3, "one two"),
]
# Names that operators use inside.
CLASHING = ["number", "class", "label", "row", "found", "__sha", "__run", "__best", "gone", "keyword", "ids", "n", "kind"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_license_scan(docs, empty):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(ROWS)
    base = [r for r in got if r.n_base]
    assert sorted((r.doc_id is None, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in base) == [
        (False, 0, 0, "mit", "mit", 1.0)] * 2 + [(True, 0, 0, "mit", "mit", 1.0)]
    none = next(r for r in got if r.doc_id == 1)
    assert (none.n_words, none.n_base, none.first_word, none.labels, none.score) == (0, 0, None, "", 0.0)
    assert next(r for r in got if r.doc_id == 5).n_words == 80_000
    assert license_scan.scan(empty).count() == 0


def test_exact_dedup(docs, empty):
    got = exact_dedup.dedup_groups(docs).collect()
    assert len(got) == len(ROWS)
    mit = [r for r in got if r.doc_id in (4, None)]
    assert {(r.keep_id, r.group_size) for r in mit} == {(None, 3)} and sum(r.kept for r in mit) == 1  # the longest stays
    blank = [r for r in got if r.doc_id in (1, 2, 3)]
    assert {(r.keep_id, r.group_size, r.text_sha256) for r in blank} == {(3, 3, hashlib.sha256(b"").hexdigest())}
    assert {r.keep_id for r in got if r.doc_id in (7, -3)} == {-3}
    assert sum(r.kept for r in got) == len({(r.text_sha256) for r in got})
    assert exact_dedup.dedup_groups(empty).count() == 0


def test_exact_dedup_stage_keeps_columns(docs, empty):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, -3), (False, 3), (False, 5), (False, 6), (False, 8), (False, 9), (True, 0)]
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (2, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.drop_duplicates(df).collect()] == [(1, "a b")]
    assert sorted(r.kept for r in exact_dedup.dedup_groups(df).collect()) == [False, False, False, True]


def test_ngram_join(docs, empty):
    got = ngram_join.jaccard_classes(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[7] == by[8] == by[-3] == {(1, -3)}  # one sequence, A-Z lower-cased
    assert by[4] == {(4, 4)} and by[None] == {(4, 4)}
    assert {c for _, c in by[5] | by[6]} == {5}
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # The row with a null id is a near copy of 4 and goes; both rows of 4 have the smallest id.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, i) for i in (-3, 1, 2, 3, 4, 4, 5, 9)]


def test_bpe(docs, empty):
    import public_tokenizers

    encoder = byte_bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe_codec.encode(docs, parts=3)
    back = got.withColumn("raw", bpe_codec.decoded(F.col("ids"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.raw), list(r.ids)) for r in back) == sorted(
        (i is None, i or 0, (t or "").encode(), encoder.encode_ordinary(t or "")) for i, t in ROWS)
    assert bpe_codec.encode(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs.coalesce(1), block_tokens=5000).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert 1 <= r.length <= 1024 and 0 <= r.offset
    assert total[1] == total[2] == 1  # the end id alone
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 1024
    assert packing.pack(empty).count() == 0


def test_language_id(docs, empty):
    model = language_id.train(docs, steps=60)
    got = docs.select("doc_id", language_id.predicted(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    assert {r.lang for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.score == 0 and not r.accepted for r in got if r.lang == "und")
    assert {r.lang for r in got if r.doc_id in (4, 5, 7)} == {"en"}
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language_id.train(empty)
    assert [r.p.lang for r in docs.limit(1).select(language_id.predicted(F.lit("abc"), nothing).alias("p")).collect()] == ["und"]
    kept = language_id.keep_identified(docs, steps=60)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert language_id.keep_identified(empty, steps=60).count() == 0


def test_lm_score(docs, empty):
    got = lm_score.scores(docs, F.lit(True), parts=3).collect()
    assert len(got) == len(ROWS)
    assert {(r.n_tokens, r.n_known) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert len({r.train_tokens for r in got}) == 1 and all(r.score < 0 and r.base_score < 0 for r in got)
    untrained = lm_score.scores(docs, F.lit(False), parts=3).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in untrained} == {(0.0, 0.0, 0, 0)}
    assert lm_score.scores(empty, F.lit(True)).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, None, "x"), (2, 0, "tool", "</s>\\"),
            (None, 3, "assistant", "\\[INST]<<SYS>>\n<|end|><|role|>"), (3, 0, "system", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("p")).withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.segments(chat_format.row_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\n\nassistant\n\n") and got[1].loss_chars == 0
    assert got[2].turns_sha256 == sha("\nx\ntool\n</s>\\\n")
    text = "\\[INST]<<SYS>>\n<|end|><|role|>"
    assert got[None].loss_sha256 == sha(text) and got[None].loss_chars == len(text)
    assert got[3].turns_sha256 == sha(f"system\n{LONG}\n")
    assert chat_format.read_back(chat_format.segments(chat_format.row_turns(df.limit(0)))).count() == 0


def test_topk(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (None, [9.0, 9.0]), (7, [2.0]), (8, [-1.0, 0.0]), (2, [1.0, 0.5]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id").isin(0, 7, 9)).collect())
    assert got == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 2, 81920), (0, 4, 8, -65536)]
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0
