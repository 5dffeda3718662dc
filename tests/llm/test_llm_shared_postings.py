"""Inverted lists of the n-gram join: one shuffle, right numbers, hot values."""

from collections import Counter

from ledgerlens.llm import set_classes


def test_postings_meet_once(spark):
    rows = [(v, s, 10) for v in range(40) for s in range(v % 5)] + [(99, s, 10) for s in range(64)] + [(7, 3, 10)]
    postings = spark.createDataFrame(rows, "value long, number long, n int").repartition(3)
    hot = set_classes.hot_values(postings, set_classes.HOT_TIMES // 64)
    assert [r.value for r in hot.collect()] == [99]
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {key: spark.conf.get(key) for key in keys}
    try:  # a list of values too large to broadcast
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        lists = set_classes.shared_postings(postings, hot.localCheckpoint())
        plan = lists._jdf.queryExecution().executedPlan().toString()
        got = lists.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    times = Counter(v for v, _, _ in rows)
    want = [(v, s, n, set_classes.HOT_TIMES if v == 99 else times[v]) for v, s, n in rows if times[v] > 1]
    assert sorted((r.value, r.number, r.n, r.times) for r in got) == sorted(want)
