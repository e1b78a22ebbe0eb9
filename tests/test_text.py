from pyspark.sql import functions as F

from sedgewren.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalize(spark):
    zero = "​‌‍‎‏⁠﻿"
    assert one(spark, f"  甲{zero}\r\n　乙\t\t丙  \r\n\n\n\n丁", T.normalize_text) == "甲\n乙 丙\n\n丁"
    assert one(spark, None, T.normalize_text) is None
    assert one(spark, "", T.normalize_text) == ""


def test_noise_lines(spark):
    for line, noise, block in (("", True, True), ("== Page 3 ==", True, True), ("第 12 页", True, True), ("123", True, False), ("１２", True, False), ("①", True, True), ("正文", False, False), ("12345", False, False)):
        assert one(spark, line, T.is_noise_line) is noise, line
        assert one(spark, line, T.is_block_noise_line) is block, line


def test_headings_and_articles(spark):
    assert one(spark, "第一章 总则", T.heading_level) == "章"
    assert one(spark, "第一章" + "长" * 60, T.heading_level) == ""
    assert one(spark, "第十二条　正文", lambda c: F.regexp_extract(c, T.ARTICLE_START, 1)) == "第十二条"


def test_truncation_counts_code_points(spark):
    assert one(spark, "a😀中d", lambda c: T.truncated(c, 3, "…")) == "a😀中…"
    assert one(spark, "abc", lambda c: T.truncated(c, 3, "…")) == "abc"


def test_longest_common_substring(spark):
    rows = [("abcdxyz", "zabcdq", 4), ("", "a", 0), ("同一句话在这里", "另一句话在那里", 4), ("aaaa", "aa", 2)]
    df = spark.createDataFrame(rows, "a string, b string, n int").select(T.longest_common_substring(F.col("a"), F.col("b")).alias("got"), T.longest_common_substring(F.col("b"), F.col("a")).alias("back"), "n")
    assert all(r["got"] == r["n"] == r["back"] for r in df.collect())


def test_classifier_text_and_rewrites(spark):
    assert one(spark, "  怎么办？？? ", T.classifier_text) == "怎么办"
    assert one(spark, '改写后：  "怎么办" ', T.rewrite_cleaned) == "怎么办"
    assert one(spark, " 答案:“怎么办”", T.rewrite_cleaned) == "怎么办" and one(spark, "改写后的问题：x", T.rewrite_cleaned) == "改写后的问题：x"
    assert one(spark, "长" * 100, T.rewrite_limit) == 135


def test_tokens(spark):
    assert one(spark, "Ab，C", T.tokens) == ["ab", "bc"]
    assert one(spark, "一", T.tokens) == ["一"]
    assert one(spark, "", T.tokens) == []
    assert one(spark, "Hello, wide World!", lambda c: T.tokens(c, "word")) == ["hello", "wide", "world"]


def test_cosine_and_routes(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in got] == [0.0, 1.0, 0.0, 0.0]
    assert one(spark, " HyDE ", T.route_label) == "hyde" and one(spark, "x", T.route_label) == "direct"
