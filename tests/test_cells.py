import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import cells as C
from sievework.functions import numbers as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


NUMBERS = ["1234,56", "3632981672,59", "-4,683243", "+0,5", "210.826.129,02", "7.876,62", "1.000,0",
           "12", "12.", ".5", "-3.2e10", " 7 ", "1E5"]
TEXTS = ["12.34.56", ",5", "-,0083333", "1,", "1,2,3", "3305.06 - 3305.99", "nan", "inf", "1_000", "0x10", "٣",
         "2023-02-30", "12/01/2020", "verdadero"]


@pytest.mark.parametrize("text", NUMBERS)
def test_number(spark, text):
    assert one(spark, C.value_type(F.lit(text))) == "number"
    assert one(spark, C.to_number(F.lit(text))) is not None


@pytest.mark.parametrize("text", TEXTS)
def test_not_number(spark, text):
    assert one(spark, C.value_type(F.lit(text))) == "str"
    assert one(spark, C.to_number(F.lit(text))) is None


def test_number_values(spark):
    values = {"210.826.129,02": 210826129.02, "+0,5": 0.5, " -4,5 ": -4.5, "1e3": 1000.0}
    for text, want in values.items():
        assert one(spark, C.to_number(F.lit(text))) == want


def test_types(spark):
    kinds = {"": "empty", "  \t": "empty", " ": "empty", "TRUE": "bool", " false ": "bool",
             "2024-02-29": "date", "2023-02-29": "str", "1e400": "number"}
    for text, want in kinds.items():
        assert one(spark, C.value_type(F.lit(text))) == want, text
    assert one(spark, C.value_type(F.lit(None).cast("string"))) == "empty"
    assert one(spark, C.to_number(F.lit("1e400"))) is None


def test_dates(spark):
    d = datetime.date
    days = {"2024-03-05": d(2024, 3, 5), "5/3/2024": d(2024, 3, 5), "05-03-2024": d(2024, 3, 5),
            "5/3/24": d(2024, 3, 5), "5/3/70": d(1970, 3, 5), "2024/3/5": d(2024, 3, 5), "31/2/2024": None,
            "20240305": None, "hoy": None}
    for text, want in days.items():
        assert one(spark, C.parse_date(F.lit(text))) == want, text


def test_rounding(spark):
    for value, want in {92.5: 93, 0.5: 1, 2.5: 3, -0.5: -1}.items():
        assert one(spark, N.round_half_up(F.lit(value))) == want
    assert one(spark, N.round_half_up(F.lit(90.35), 1)) == 90.4
    assert one(spark, N.round_half_up(F.lit(90.34), 1)) == 90.3


def test_spanish_numbers(spark):
    assert one(spark, N.spanish_number(F.lit(1234567.891), 2)) == "1.234.567,89"
    assert one(spark, N.spanish_number(F.lit(1234.5), 1)) == "1234,5"


def test_cell_text(spark):
    assert one(spark, C.cell_text(F.lit(None).cast("int"))) == ""
    assert one(spark, C.cell_text(F.lit(True))) == "true"
    assert one(spark, C.cell_text(F.array(F.lit(1), F.lit(2)), "nested")) == "[1,2]"
