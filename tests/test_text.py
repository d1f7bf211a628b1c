import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ligature.functions import text as T
from ligature.functions.indic import romanise, transliterate
from ligature.functions.similarity import lcs_length, partial_ratio, ratio, token_set_ratio, token_sort_ratio


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("steps", "value", "wanted"),
    [
        (["zeros"], "no 045", "no 45"), (["zeros"], "0", "0"), (["trade_name"], "zephflux formerly: cp group", "cp group"), (["trade_name"], "dba brothers pvt ltd", "dba brothers pvt ltd"),
        (["accents"], "école límited", "ecole limited"), (["web"], "mejiastrategictalon.com", "mejiastrategictalon"), (["web"], "www.vayuresor.com", "vayuresor"), (["dots"], "l.l.c.", "llc"), (["dots"], "pvt.", "pvt"),
        (["translit"], "सिल्वर डेवलपर्स", "silvr devlprs"), (["legal_canonical"], "a l l c pvt ltd", "a llc private limited"), (["legal_remove"], "co co co co foo", "foo"), (["address_abbrev"], "1 st st r", "1 street street rue"),
        (["null"], "a null b", "a b"), (["ampersand"], "a&b", "a and b"), ([], "  A--B  ", "a b"), ([], "", ""), ([], None, None),
    ],
)
def test_steps(spark, steps, value, wanted):
    assert one(spark, value, lambda c: T.normalize(c, steps)) == wanted


def test_order_of_steps_is_fixed_and_unknown_ones_fail(spark):
    value = "École formerly: Ltd 007"
    a, b = (one(spark, value, lambda c, s=s: T.normalize(c, s)) for s in (["accents", "trade_name", "zeros"], ["zeros", "trade_name", "accents"]))
    assert a == b == "ltd 7"
    with pytest.raises(ValueError):
        T.normalize(F.lit("x"), ["nothing"])


def test_tag():
    assert len(T.normalization_tag(T.NAME_STEPS, T.ADDRESS_STEPS)) == 8


def test_indic():
    assert romanise("वयखेभि") == "vayakhebhi" and romanise("గుజ") == "guja" and romanise("abc") == "abc"
    assert transliterate("abc") == "abc"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert lcs_length(a, b) == slow_lcs(a, b)
    assert ratio(a, b) == ratio(b, a)


def test_ratios():
    assert ratio("offie", "office") == pytest.approx(10 / 11)
    assert ratio("davis family office", "office davis family") == pytest.approx(24 / 38)
    assert ratio("", "") == 1.0 and ratio("a", "") == 0.0
    assert token_sort_ratio("b a", "a b") == 1.0 and token_set_ratio("a b", "a b c") == 1.0 and token_set_ratio("", "a") == 0.0
    assert partial_ratio("bc", "abcd") == 1.0 and partial_ratio("", "") == 1.0
