import random

import pytest
from pyspark.sql import functions as F

from samples import like
from shelfline.functions.text import (
    any_like,
    ascii_fold,
    escape_html,
    like_contains,
    parse_int_prefix,
    query_param,
    query_string,
    trim_space,
)


def one(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize(
    "text, folded",
    [("AZaz", "azaz"), ("ÀÉZ", "ÀÉz"), ("\u212aK", "\u212ak"), ("", ""), (None, None)],
)
def test_ascii_fold(spark, text, folded):
    assert one(spark, ascii_fold(F.lit(text).cast("string"))) == folded


def test_like_contains_against_plain_matcher(spark):
    """Random texts and terms over wildcards, regex characters, accents and newlines."""
    rng = random.Random(7)
    alphabet = "abAB%_\\éÉ.*+?()[]{}^$|\n 𝄞\u212a-&"
    cases = [
        (
            "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))),
            "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))),
        )
        for _ in range(4000)
    ] + [("ab" * 3000 + "c", "a%b%a%c%d"), ("x" * 5000, "_x%_y"), ("", "%"), ("", "_")]
    frame = spark.createDataFrame(cases, "text string, term string")
    found = frame.select("text", "term", like_contains(F.col("text"), F.col("term")).alias("hit"))
    rows = found.collect()
    wrong = [row for row in rows if row["hit"] != like(row["text"], row["term"])]
    assert not wrong
    assert 200 < sum(row["hit"] for row in rows) < len(rows) - 200


def test_null_text_does_not_match(spark):
    frame = spark.createDataFrame([("abc", None), (None, None)], "a string, b string")
    hit = any_like([F.col("a"), F.col("b")], F.lit("B"))
    assert [row[0] for row in frame.select(hit).collect()] == [True, False]


@pytest.mark.parametrize(
    "text, number",
    [
        ("7", 7), (" 7", 7), ("7abc", 7), ("+7", 7), ("-7", -7), ("7.9", 7), ("1e3", 1),
        ("0x10", 0), ("0", 0), ("\u00a0\u30007", 7), ("abc", None), ("", None), ("- 7", None),
        ("99999999999999999999", None), (None, None),
    ],
)
def test_parse_int_prefix(spark, text, number):
    assert one(spark, parse_int_prefix(F.lit(text).cast("string"))) == number


def test_trim_space(spark):
    assert one(spark, trim_space(F.lit("\t\u00a0 a b \n"))) == "a b"


@pytest.mark.parametrize(
    "query, value",
    [
        ("?area=Security&area=General", "Security"), ("?area=a+b%20c", "a b c"), ("?area", None),
        ("?area=", None), ("?area=%zz", "%zz"), ("?other=1", None), ("", None),
        ("?search=a b&area=x y", "x y"), ("?search=100%&area=50%", "50%"), ("?a|[&area=a|b[", "a|b["),
        ("?area&area=x", None), ("?areas=1&area=2", "2"), ("#?area=1", None), ("?b=?&area=%41%", "A%"),
        ("?area=%C3%A9#x", "é"),
    ],
)
def test_query_param(spark, query, value):
    assert one(spark, query_param(F.lit("https://e.org/p" + query), "area")) == value


def test_query_param_of_a_relative_url(spark):
    assert one(spark, query_param(F.lit("/list?x.y=1&xzy=2"), "x.y")) == "1"
    assert one(spark, query_param(F.lit("?q=%E9"), "q")) == "\ufffd"
    assert one(spark, query_param(F.lit(None).cast("string"), "q")) is None


def test_query_string_round_trip(spark):
    values = {"search": F.lit("a b&c=é%"), "area": F.lit(""), "level": F.lit("x")}
    text = one(spark, query_string(values))
    assert text == "search=a+b%26c%3D%C3%A9%25&level=x"
    back = query_param(F.concat(F.lit("https://e.org/?"), F.lit(text)), "search")
    assert one(spark, back) == "a b&c=é%"


def test_escape_html(spark):
    assert one(spark, escape_html(F.lit("<a href=\"x\">'&amp;"))) == (
        "&lt;a href=&quot;x&quot;&gt;&#039;&amp;amp;"
    )
    assert one(spark, escape_html(F.lit(None).cast("string"))) == ""
