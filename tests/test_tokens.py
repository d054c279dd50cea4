from pyspark.sql import functions as F

from quillmeter.functions import text as T
from quillmeter.functions import tokens as K


def values(spark, texts, column):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.v for r in rows.select("k", column(F.col("text")).alias("v")).orderBy("k").collect()]


def test_estimates(spark):
    got = values(spark, ["", None, "\x1b[31mbuild failed\x1b[0m", "build failed", "a\nb", "x"], K.estimate_tokens)
    assert got == [0, 0, 3, 3, 2, 1]


def test_profiles(spark):
    texts = ['{"a": 1, "b": [2, 3], "c": {"d": 4}}', "function f(a) { return a && a.b; }\nif (x) { y(); }", "# Title\n\nSome ordinary prose here.", "Just a plain sentence", " \n", "QUJD" * 50, "a = 1, or so it is said in a longer line of words"]
    assert values(spark, texts, K.detect_profile) == ["json", "code", "markdown", "prose", "prose", "base64", "mixed"]


def test_lines(spark):
    assert values(spark, ["a\nb\n", "a\nb", "", "a\r\nb\u2028c", "\n"], K.count_lines) == [2, 2, 0, 3, 1]


def test_trims_keep_the_budget(spark):
    text = "\n".join(f"line {i}" for i in range(500))
    for keep in ("head", "tail", "both"):
        for budget in (200, 300):
            r = values(spark, [text], lambda c: K.trim_to_budget(c, budget, keep))[0]
            assert r.truncated and r.tokens <= budget and "[trimming]" in r.text
            assert ("line 0\n" in r.text) == (keep != "tail") and ("line 499" in r.text) == (keep != "head")
    r = values(spark, ["x" * 100000, "short"], lambda c: K.trim_to_budget(c, 100))
    assert r[0].tokens <= 100 and not r[1].truncated and r[1].text == "short"


def test_terms(spark):
    got = values(spark, ["getUserToken", "HTTPServer the A1b2", None, "snake_case"], T.terms)
    assert got == [["getusertoken", "get", "user", "token"], ["httpserver", "http", "server", "a1b2", "1b2"], [], ["snake_case", "snake", "case"]]


def test_paths(spark):
    got = values(spark, ["a/../b", "../x", "/r/a", "/etc", "", "a/./b//c"], lambda c: T.resolved(c, "/r"))
    assert got == ["/r/b", None, "/r/a", None, None, "/r/a/b/c"]


def test_segments(spark):
    assert values(spark, ["-home-me-proj", "proj--", "---"], T.last_segment) == ["proj", "proj", "---"]
