from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    cases = {
        "15/10/2026": date(2026, 10, 15), "15 /10/2026": date(2026, 10, 15), "05-OCT-26": date(2026, 10, 5), "5/10/70": date(1970, 10, 5),
        "5/10/68": date(2068, 10, 5), "01 Oct": date(1900, 10, 1), "29 Feb": None, "2026-10-15": date(2026, 10, 15), "31/02/2026": None,
        "05-Sept-2026": None, "01 October 2026": date(2026, 10, 1), "01 October 26": None, "01/October/2026": None, "1/2-2026": None,
        "12.03": date(1900, 3, 12), "x 03/04/2024 y": date(2024, 4, 3), "": None, None: None, "13/13/2024": None, "7 may 2024": date(2024, 5, 7),
    }
    assert dict(zip(cases, each(spark, list(cases), S.parse_date))) == cases


def test_amounts(spark):
    cases = {
        "1,23,456.78": (123456.78, None), "(500.00)": (500.0, "neg"), "-12.5": (12.5, "neg"), "1000Cr": (1000.0, "cr"), "1,000.00 Dr": (1000.0, "dr"),
        "100.00 200.00": (200.0, None), "100.00.": (None, None), "abc": (None, None), "": (None, None), None: (None, None), "  7 ": (7.0, None),
    }
    assert dict(zip(cases, [tuple(x) for x in each(spark, list(cases), S.parse_amount)])) == cases


@pytest.mark.parametrize(
    "text, name",
    [
        ("UPI/123456789/SWIGGY ORDER", "Swiggy Order"),
        ("NEFT-HDFC-JOHN O'DOE-REF12345", "John O'Doe"),
        ("NEFT—SALARY—ACME CORP", "Neft—Salary—Acme Corp"),
        ("POS/12/99", ""),
        (None, ""),
        ("a" * 50, "A" + "a" * 39),
    ],
)
def test_counterparty(spark, text, name):
    assert each(spark, [text], S.counterparty) == [name]


def test_header_keys(spark):
    cases = {"Date": "date", "Chq/Ref": "ref", "Description/": "desc", "Narration/Description": "desc", "Date/Amount": None, "Dr/Cr": "type", "": None, None: None, "Bal.": "balance"}
    assert dict(zip(cases, each(spark, list(cases), S.header_key))) == cases


def test_rules(spark):
    rows = [("AIRTEL MOBILE RECHARGE", "dr", "Bank Charges & Fees"), ("NEFT SALARY ACME", "cr", "Salary"), ("NEFT SALARY ACME", "dr", "Transfers (Person)"), ("nothing", "dr", None), (None, "cr", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "d string, w string")
    assert [r[0] for r in df.select(S.category(F.col("d"), F.col("w"))).collect()] == [c for _, _, c in rows]


def test_references_and_features(spark):
    df = spark.createDataFrame([("", "UPI AB123456 x"), (" 77 ", "n"), (None, "12345"), (None, None)], "r string, d string")
    assert [r[0] for r in df.select(S.reference(F.col("r"), F.col("d"))).collect()] == ["AB123456", "77", "", ""]
    assert each(spark, ["UPI/123456/Shop 42!", None], lambda c: S.featurise(c, F.lit("dr"))) == ["upi shop 42 __dr__", " __dr__"]


def test_near_digits(spark):
    df = spark.createDataFrame([(100.0, 140.0), (100.0, 1000.0), (123.45, 987.65)], "a double, b double")
    assert [r[0] for r in df.select(S.near_digits(F.col("a"), F.col("b"))).collect()] == [True, False, False]
