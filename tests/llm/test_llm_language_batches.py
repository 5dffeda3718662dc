"""Language identification moves its texts to Python in batches of bounded bytes."""

from ledgerlens.llm import language_id
from ledgerlens.llm.common import BATCH_LIMIT

ROWS = [(k, f"{a} {b} {k % 7}", lang) for k, (a, b, lang) in enumerate(
    [("der hund und die katze", "schlafen im garten", "de"), ("the dog and the cat", "sleep in the garden", "en")] * 60)]


def test_texts_are_predicted_in_small_batches(spark, monkeypatch):
    key = next(iter(BATCH_LIMIT))
    used, small = [], language_id.small_batches

    def noted(session):
        used.append(session)
        return small(session)

    monkeypatch.setattr(language_id, "small_batches", noted)
    before = spark.conf.get(key)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    kept = language_id.keep_identified(docs)
    assert spark.conf.get(key) == before
    assert len(used) == 1  # training
    # What the caller runs later, under its own limit, calls no Python.
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty() and kept.count() > 100
