"""Letter noise and unlearned languages go, clean texts stay."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("languages", [["en"], ["de", "en"], ["de", "en", "es", "fr"]])
def test_rejection(spark, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 0)
    learned = F.col("lang").isin(languages)
    model = language_id.train(language_id.training_rows(docs).where(learned), steps=200)
    rng = random.Random(3)
    noise = ["".join(rng.choice(letters) for _ in range(size)) for size in (60, 500) for _ in range(20)
             for letters in ("abcdefghijklmnopqrstuvwxyz    ", "αβγδεζηθικλμνξοπρστυφχψω    ")]
    rows = docs.select("doc_id", "text", learned.alias("learned")).union(
        spark.createDataFrame([(-1 - i, t, False) for i, t in enumerate(noise)], "doc_id long, text string, learned boolean"))
    got = rows.select("doc_id", "learned", language_id.predicted(F.col("text"), model)["accepted"].alias("accepted")).collect()
    assert all(r.accepted for r in got if r.learned)
    assert not [r for r in got if r.doc_id < 0 and r.accepted]
    # A text of a few letters, or one half in a learned language, may still fit.
    other = [r.accepted for r in got if r.doc_id >= 0 and not r.learned]
    assert sum(other) <= 0.02 * len(other)


def test_every_language_is_learned(spark):
    """Far more languages than a fixed number of rows would give room to."""
    rng = random.Random(9)
    languages = [f"l{i:03d}" for i in range(260)]
    stems = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for lang in languages}
    rows = [(k * 260 + i, " ".join(rng.choice(stems[lang]) for _ in range(30)), lang)
            for k in range(6) for i, lang in enumerate(languages)]
    rows += [(-1, "labelled as unknown", "und"), (-2, None, "l000"), (-3, "...", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, steps=1600, max_rows=1000)
    assert model.languages == languages
    got = docs.where("doc_id >= 0").select("lang", language_id.predicted(F.col("text"), model)["lang"].alias("p")).collect()
    assert sum(r.lang == r.p for r in got) >= 0.9 * len(got)


def test_repeated_rows_without_ids_are_one_row_of_the_sample(spark):
    rows = [(None, "the same words again and again", "en")] * 3000 + [(i, f"der Satz Nummer {i} steht hier", "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample, each = language_id.labelled_sample(docs, "doc_id", "text", "lang", 800, 4000)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert each == 800 and counts["en"] <= 3 and counts["de"] == 60
    assert language_id.train(docs, steps=60).languages == ["de", "en"]
