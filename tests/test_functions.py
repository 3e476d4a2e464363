"""Scalars, tokens and the regex dialect against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.functions import tokens as T
from logloom.functions.regex import translate
from logloom.operators.semantics import token_class


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_kv_last_of_equal_keys_and_first_raw(spark):
    values = ['A="1" A="2"', r'a="x \"y\" \\z"', "none", None]
    assert column(spark, values, lambda v: S.kv_last(S.kv_pairs(v), "A")) == ["2", 'x "y" \\z', None, None]
    assert column(spark, ['A="1" A="2"', 'BA="3"'], lambda v: S.kv_first(v, "A")) == ["1", "3"]


def test_json_values(spark):
    values = ['- {"a":true,"b":{"c":1},"d":null,"e":"true"}', '{"a":1} x', "{bad}", "{}", None]
    assert column(spark, values, lambda v: S.json_value(v, "a")) == ["True", None, None, None, None]
    assert column(spark, values, lambda v: S.json_value(v, "b")) == ['{"c":1}', None, None, None, None]
    assert column(spark, values, lambda v: S.json_value(v, "e"))[0] == "true"
    assert column(spark, values, S.is_json_object) == [True, False, False, True, False]


@pytest.mark.parametrize(
    "text, wanted",
    [(r"\u7528", "用"), (r"\\u7528", "用"), (r"C:\temp\new", "C:\temp\new"), (r"C:\users", r"C:\users"), (r"\"quoted\"", r"\"quoted\""), (r'a\n", "b', r'a\n", "b'), ("tab\t\\n", "tab\t\\n"), ("", "")],
)
def test_unescape(spark, text, wanted):
    assert column(spark, [text], S.unescape) == [wanted]


def test_times(spark):
    values = ["2025-06-19T15:04:51Z", "2025-06-19T15:04:51.25+02:00", "2025-06-19T15:04:51+0530", "Jun  9 06:06:20", "jun 9 06:06:20", "Feb 30 00:00:00", "2025-06-19T15:04:51", "x", None]
    read = column(spark, values, lambda v: S.moment(v, "Asia/Shanghai", F.lit(2024)).cast("string"))
    assert read == ["2025-06-19 07:04:51", "2025-06-19 13:04:51.25", "2025-06-19 09:34:51", "2024-06-08 22:06:20", "2024-06-08 22:06:20", None, None, None, None]


def test_integers_and_missing(spark):
    assert column(spark, ["12", " 7 ", "-1", "²", "99999999999", "", None], S.integer) == [12, 7, None, None, None, None, None]
    assert column(spark, ["unknown", "None", "N/A", "", "x", None], S.clean) == [None, None, None, None, "x", None]


TOKENS = ["<25>1", "<29>Jun", "<30>", "10.0.0.1", "2025-06-19T15:04:51Z", "15:04", "15:04:51.2", "0xAf", "12", "1.5", "combo", "用户", 'DVC_A="x', "Security-Auditing:", "[Sat", "-", "1.2.3"]


def test_token_classes_agree(spark):
    assert column(spark, TOKENS, T.token_class) == [token_class(t) for t in TOKENS]


def test_tokens_are_capped(spark):
    assert column(spark, ["a " * 100], lambda v: F.size(T.tokens(v))) == [64]


PATTERNS = [r"^<(?P<priority>\d+)>\S+\ (?P<rest>.+)$", r"(?P<word>\w+)\s(?P=word)", r"a[\]^-]b|\d{2}", r"(?:x|y)*(?P<z>z)?\Z"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<>12aa xyz\r\t用１]^-b", max_size=12), min_size=1, max_size=20))
def test_dialects_agree(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    made = [translate(p) for p in PATTERNS]
    got = frame.orderBy("i").select(*[F.col("v").rlike(m.java) for m in made]).collect()
    for row, text in zip(got, texts, strict=True):
        assert list(row) == [re.match(p, text) is not None for p in PATTERNS]


def test_python_only_patterns_are_recognised():
    assert translate(r"(a)?(?(1)b|c)").python_only and translate(r"[[a]").python_only and not translate(r"[\[a]").python_only
