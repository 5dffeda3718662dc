"""Page files and the NaN normaliser."""

from pyspark.sql import functions as F

from ledgerlens.sources.loader import sanitize
from ledgerlens.sources.pages import scan_text_files


def test_page_files_by_number(spark, tmp_path):
    for name, text in [("7_p10.txt", "ten"), ("7_p2.txt", "two"), ("7_p1.txt", " "), ("12_page03.txt", "x"), ("notes.txt", "n"),
                       ("99999999999999999999_p1.txt", "big")]:
        (tmp_path / name).write_text(text)
    got = [tuple(r) for r in scan_text_files(spark, str(tmp_path)).orderBy("statement_id", "page_num", "source").collect()]
    assert got == [
        (None, None, "n", "notes.txt"), (None, 1, "big", "99999999999999999999_p1.txt"),
        (7, 1, " ", "7_p1.txt"), (7, 2, "two", "7_p2.txt"), (7, 10, "ten", "7_p10.txt"), (12, 3, "x", "12_page03.txt"),
    ]


def test_nan_is_null_at_any_depth(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(nan, (1, nan), [nan, 2.0], {"a": nan}, [(nan, "x")]), (1.0, None, None, None, [])],
        "a double, s struct<n:int,x:double>, v array<double>, m map<string,double>, w array<struct<y:float,t:string>>")
    first, second = sanitize(df).collect()
    assert first.a is None and first.s.x is None and first.s.n == 1 and first.v == [None, 2.0]
    assert first.m == {"a": None} and first.w[0].y is None and first.w[0].t == "x"
    assert (second.a, second.s, second.v, second.m, second.w) == (1.0, None, None, None, [])
    assert sanitize(df).where(F.col("a").isNull()).count() == 1
