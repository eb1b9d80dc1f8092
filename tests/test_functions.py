"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from tranchery.functions import loan as L
from tranchery.operators import metrics

C = F.col


def values(spark, kind, given, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", make(C("x")).alias("y")).orderBy("i").collect()]


CREDIT = "Does not meet the credit policy. Status:"


@pytest.mark.parametrize(
    ("make", "given", "wanted"),
    [
        (L.is_bad, ["Charged Off", "Default", CREDIT + "Charged Off", "Fully Paid", "Current", " Charged Off ", None, "?"], [True, True, True, False, False, True, False, False]),
        (L.is_terminal, ["Fully Paid", "Charged Off", "Default", CREDIT + "Fully Paid", "Current", None], [True, True, True, True, False, False]),
        (L.dpd_bucket, ["Fully Paid", " Current ", "In Grace Period", "Late (16-30 days)", "Late (31-120 days)", "Charged Off", "Default", "new", None, ""], ["PAID", "CURRENT", "DPD_1_30", "DPD_1_30", "DPD_31_120", "CHARGED_OFF", "CHARGED_OFF", "UNKNOWN", "UNKNOWN", "UNKNOWN"]),
        (L.parse_term, [" 36 months", "60", "", None, "none"], [36, 60, None, None, None]),
        (L.parse_emp_length, ["10+ years", "< 1 year", "n/a", "N/A", None, "3 years"], [10, 1, None, None, None, 3]),
        (lambda c: L.parse_emp_length(c, True), ["< 1 year", "2 years"], [0, 2]),
        (lambda c: L.parse_rate(c).cast("double"), ["13.56%", " 7.0 ", "x%", None], [13.56, 7.0, None, None]),
        (lambda c: L.parse_month(c).cast("string"), ["Dec-2018", "2018-12", None], ["2018-12-01", None, None]),
        (L.null_key, ["a ", "", " nan", None], ["a", "__NULL__", "__NULL__", "__NULL__"]),
        (lambda c: L.add_months_str(c, 1), ["2018-12", "2018-01"], ["2019-01", "2018-02"]),
    ],
)
def test_text_functions(spark, make, given, wanted):
    assert values(spark, "string", given, make) == wanted


@pytest.mark.parametrize(
    ("make", "given", "wanted"),
    [
        (L.income_band, [None, 29999.0, 30000.0, 100000.0, 1e6], ["UNKNOWN", "L0_<3w", "L1_3-6w", "L3_10-20w", "L4_>=20w"]),
        (L.fico_band, [None, 659.0, 660.0, 780.0], ["UNKNOWN", "F0_<660", "F1_660-699", "F4_>=780"]),
        (L.rate_band, [7.99, 8.0, 20.0], ["R0_<8", "R1_8-12", "R4_>=20"]),
        (L.tie_at_4dp, [0.00005, 0.00015, 0.0001], [True, True, False]),
    ],
)
def test_number_functions(spark, make, given, wanted):
    assert values(spark, "double", given, make) == wanted


def test_month_string_passes_december(spark):
    assert values(spark, "int", [2018 * 12 + 12, 2019 * 12 + 1], L.month_str) == ["2018-12", "2019-01"]


@pytest.mark.parametrize(("rows", "wanted"), [([(1000.0, 10.0), (100.0, 20.0)], 10.909), ([(0.0, 10.0)], None), ([(None, 10.0), (100.0, 20.0)], 20.0), ([], None)])
def test_weighted_avg(spark, rows, wanted):
    got = spark.createDataFrame(rows, "w double, v double").agg(F.round(L.weighted_avg(C("v"), C("w")), 3)).first()[0]
    assert got == wanted


def test_skew_ratio(spark):
    df = spark.createDataFrame([(0.4763, 9), (None, 9), (0.5, 0), (0.25, 4)], "share double, keys int")
    assert [round(r[0], 4) for r in df.select(L.skew_ratio(C("share"), C("keys"))).collect()] == [4.2867, 0.0, 0.0, 1.0]


def test_key_shares_of_nothing(spark):
    assert metrics.key_shares(spark.createDataFrame([], "k string"), "k").count() == 0
