"""The stored word index: bounds, appended batches, filters, repeated ids, empty index."""

import datetime as dt

import pytest
from conftest import txn_frame
from pyspark.sql import functions as F

from ledgerlens.operators import postings as IX
from ledgerlens.operators import search as V
from ledgerlens.sources.loader import scratch_path

DAY = dt.datetime(2024, 2, 1)
COLS = ["statement_id", "question_id", "rank", "txn_id", "similarity_score"]
NAMES = ["RIVER CAFE", "RIVER BOOKS", "HILL CAFE", "HILL BOOKS MARKET", "MARKET RIVER CAFE"]


@pytest.fixture(scope="module")
def txns(spark):
    rows = [(s, i, DAY + dt.timedelta(days=i % 9), NAMES[(i * i + s) % 5], -float(i % 4 + 1), "ab"[i % 3 == 0])
            for s in (1, 2) for i in range(120)]
    return txn_frame(spark, rows)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(0, "river cafe market", "a"), (1, "books for $2.00", "b"), (2, "nothing shared", "a"), (3, "", "a")],
        "question_id long, question string, filter_category string")


def rows(df, cols=COLS):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def write(spark, txns, width=16, batches=2):
    path = scratch_path(spark, "index")
    for b in range(batches):
        IX.append_batch(txns.filter(F.pmod("txn_id", F.lit(batches)) == b), path, b, width=width)
    return path


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_equals_the_direct_search(spark, txns, asked, width):
    q = asked.drop("filter_category")
    assert rows(IX.search(spark, write(spark, txns, width), q)) == rows(V.question_hits(txns, q))


def test_a_batch_written_again_changes_nothing(spark, txns, asked):
    path = write(spark, txns)
    before = rows(IX.search(spark, path, asked.drop("filter_category")))
    IX.append_batch(txns.filter("txn_id % 2 = 1"), path, 1, width=16)
    assert rows(IX.search(spark, path, asked.drop("filter_category"))) == before


def test_filters(spark, txns, asked):
    path = write(spark, txns)
    everything = V.question_hits(txns, asked.drop("filter_category"), k=1000).join(
        asked.select("question_id", "filter_category"), "question_id").collect()
    want = {}
    for r in sorted(everything, key=lambda r: (r["statement_id"], r["question_id"], r["rank"])):
        if r["category"] == r["filter_category"]:
            want.setdefault((r["statement_id"], r["question_id"]), []).append((r["rank"], r["txn_id"]))
    pre = [(s, q, i + 1, t) for (s, q), hits in want.items() for i, (_, t) in enumerate(hits[:5])]
    post = [(s, q, i + 1, t) for (s, q), hits in want.items()
            for i, (_, t) in enumerate([h for h in hits if h[0] <= 10][:5])]
    assert rows(IX.search(spark, path, asked, prefilter=True), COLS[:4]) == sorted(pre)
    assert rows(IX.search(spark, path, asked), COLS[:4]) == sorted(post)


def test_only_the_folders_of_the_words_are_read(spark, txns, asked):
    path = write(spark, txns)
    words = IX._asked(asked.filter("question_id = 0"), "statement_id", IX.BUCKETS)
    plan = IX.postings_of(spark, path, words)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan
    assert len(IX.postings_of(spark, path, words).inputFiles()) > 0


def test_repeated_and_missing_ids(spark, asked):
    data = [(1, 5, DAY, "RIVER CAFE", -1.0, "a"), (1, 5, DAY, "RIVER CAFE", -1.0, "a"), (1, None, DAY, "RIVER", -1.0, "a"),
            (None, 6, DAY, "RIVER", -1.0, "a"), (1, 7, None, None, -1.0, None)]
    t = txn_frame(spark, data)
    path = scratch_path(spark, "index")
    IX.append_batch(t, path, 0)
    q = asked.filter("question_id = 0").drop("filter_category")
    assert rows(IX.search(spark, path, q)) == rows(V.question_hits(t, q))
    assert [r[3] for r in rows(IX.search(spark, path, q))] == [5, 5]


def test_own_statement_only(spark, txns):
    path = write(spark, txns)
    q = spark.createDataFrame([(2, 9, "hill books")], "statement_id long, question_id long, question string")
    got = IX.search(spark, path, q).collect()
    assert len(got) == 5 and {r["statement_id"] for r in got} == {2}


def test_no_index_and_empty_index(spark, txns, asked):
    path = scratch_path(spark, "index")
    with pytest.raises(ValueError, match="no index"):
        IX.search(spark, path, asked)
    IX.append_batch(txns.limit(0), path, 0)
    with pytest.raises(ValueError, match="no transactions"):
        IX.search(spark, path, asked)


def plain_hits(data, questions, k=5):
    """Brute force over (statement, id, words) sets."""
    import math
    from collections import Counter, defaultdict

    sizes, held = Counter(s for s, _, _ in data), defaultdict(set)
    for s, t, words in data:
        held[s, t] |= words
    out = []
    for s in sizes:
        for q, text in questions:
            wanted = set(text.split())
            df = Counter(w for (own, _), words in held.items() if own == s for w in words & wanted)
            weight = {w: round(math.log(1 + sizes[s] / n) * 1_000_000) for w, n in df.items()}
            scored = sorted((-sum(weight[w] for w in words & wanted), t) for (own, t), words in held.items()
                            if own == s and words & wanted)
            out += [(s, q, i + 1, t, round(2 + 2 * got / sum(weight.values()), 4)) for i, (got, t) in enumerate(scored[:k])]
    return sorted(out)


def test_many_question_words_in_several_masks(spark):
    """Over 64 question words, so that a transaction has several masks."""
    names = {(s, t): {f"w{(t * 7 + s + j * j) % 90}" for j in range(12)} for s in (1, 2) for t in range(150)}
    t = txn_frame(spark, [(s, i, DAY, " ".join(sorted(n)), -2.0, "x") for (s, i), n in names.items()])
    asked = [(0, " ".join(f"w{i}" for i in range(85))), (1, "w3 w70 w88"), (2, "w1 w2")]
    data = [(s, i, n) for (s, i), n in names.items()]
    got = rows(V.question_hits(t, spark.createDataFrame(asked, "question_id long, question string")))
    assert got == plain_hits(data, asked)


def test_search_ranks_only_the_masks_a_hit_can_have(spark):
    """A word of all transactions makes none of the others a candidate."""
    data = [(1, i, DAY, "RIVER CAFE" if i % 50 == 0 else "RIVER", -1.0, "a") for i in range(2000)]
    t = txn_frame(spark, data)
    asked = spark.createDataFrame([(0, "river cafe")], "question_id long, question string").select(
        "question_id", F.explode(V.words_of(F.col("question"))).alias("word"), F.lit(0).alias("band"),
        (F.length("word") % 2).alias("bit"))
    assert {r["bit"] for r in asked.collect()} == {0, 1}
    spoken = V.txn_sentences(t).select("statement_id", "txn_id", F.explode(V.words_of(F.col("content"))).alias("word"))
    masks = V._word_masks(spoken, asked, "statement_id")
    kinds = masks.groupBy("statement_id", "band", "mask").agg(F.count(F.lit(1)).alias("n"))
    sizes = t.groupBy("statement_id").agg(F.count(F.lit(1)).alias("size"))
    keep, _ = V._mask_scores(kinds, asked.drop("word"), sizes, "statement_id", 5)
    assert masks.join(keep, ["statement_id", "band", "mask"]).count() == 40


def test_ties_in_later_blocks_are_not_read(spark, monkeypatch):
    """Every block reaches the best score; only the first ones can hold a hit."""
    t = txn_frame(spark, [(1, i, DAY, "RIVER CAFE", -1.0, "a") for i in range(640)])
    asked = spark.createDataFrame([(0, "river cafe")], "question_id long, question string")
    path, read, scores = write(spark, t), [], IX._scores
    monkeypatch.setattr(IX, "_scores", lambda lists, wanted, *more: read.append(wanted.count()) or scores(lists, wanted, *more))
    got = rows(IX.search(spark, path, asked))
    assert [r[3] for r in got] == [0, 1, 2, 3, 4] and got == rows(V.question_hits(t, asked))
    assert sum(read) == IX.FIRST_BLOCKS  # of 40 blocks


def test_hits_in_the_last_block_are_found(spark):
    """All blocks hold both words, only the last one holds them together."""
    t = txn_frame(spark, [(1, i, DAY, "RIVER CAFE" if i >= 1600 else ("RIVER", "CAFE")[i % 2], -1.0, "a") for i in range(1606)])
    asked = spark.createDataFrame([(0, "river cafe")], "question_id long, question string")
    got = rows(IX.search(spark, write(spark, t), asked))
    assert [r[3] for r in got] == [1600, 1601, 1602, 1603, 1604] and got == rows(V.question_hits(t, asked))
