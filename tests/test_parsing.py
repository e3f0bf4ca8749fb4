from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewise.functions.formats import compact, p_text, percent, signed_percent, thousands
from tablewise.functions.parsing import excel_serial_date, is_missing_token, js_round, number_text, parse_date, parse_number
from tablewise.functions.text import formula_guard, title_case


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


NUMBERS = {"$1,234.50": 1234.5, "(1,200)": -1200.0, "AUD 15": 15.0, "15 usd": 15.0, "12.5%": 12.5, "1e3": 1000.0, "-$5": -5.0, "+€3.5": 3.5,
           "1 000": 1000.0, "1,234,567.8": 1234567.8, ".5": 0.5, "5.": 5.0, "12,34": None, "abc": None, "true": None, "1e999": None, "--5": None, "": None}


def test_numbers(spark):
    assert column(spark, NUMBERS, parse_number) == list(NUMBERS.values())


def test_decimal_comma(spark):
    assert column(spark, ["1.234,56", "3,5", "1.234", "-2,25"], lambda c: parse_number(c, True)) == [1234.56, 3.5, 1234.0, -2.25]


def test_missing_tokens(spark):
    values = ["", " N/A ", "—", "#DIV/0!", "Null", "nil", "x", "0", None]
    assert column(spark, values, is_missing_token) == [True] * 6 + [False, False, True]


DATES = {"2025-03-01": (2025, 3, 1), "2025/3/1 14:05": (2025, 3, 1, 14, 5), "2025-03-01T10:00:00Z": (2025, 3, 1, 10), "2025-03-01T10:00:00+05:30": (2025, 3, 1, 10),
         "31/12/2026": (2026, 12, 31), "12/31/2026": (2026, 12, 31), "03/04/2025": (2025, 4, 3), "1/2/49": (2049, 2, 1), "1/2/50": (1950, 2, 1),
         "5 Sept 2025": (2025, 9, 5), "Mon, March 3rd, 2025": (2025, 3, 3), "Mar 2025": (2025, 3, 1), "2025-07": (2025, 7, 1), "2025 Q3": (2025, 7, 1),
         "1/2/2024 12:15 AM": (2024, 2, 1, 0, 15), "1/2/2024 12:15 pm": (2024, 2, 1, 12, 15), "2025/03/01 3:04:05 PM GMT+11": (2025, 3, 1, 15, 4, 5),
         "2025-13-04": None, "31/02/2026": None, "TBC": None, "0999-01-01": None, "2024-02-29": (2024, 2, 29), "2023-02-29": None}


def test_dates(spark):
    assert column(spark, DATES, parse_date) == [datetime(*v) if v else None for v in DATES.values()]


def test_month_first(spark):
    assert column(spark, ["03/04/2025", "31/12/2026"], lambda c: parse_date(c, "mdy")) == [datetime(2025, 3, 4), datetime(2026, 12, 31)]


def test_serial_dates(spark):
    assert column(spark, [45000.0, 10.0, 80000.0], excel_serial_date, "double") == [datetime(2023, 3, 15), None, None]


@pytest.mark.parametrize("value,shown", [(1234567.0, "1.23M"), (12345678.0, "12.3M"), (54266.0, "54.3K"), (123456.0, "123K"), (999.4, "999"), (45.25, "45.2"), (3.0, "3")])
def test_compact(spark, value, shown):
    assert column(spark, [value], compact, "double") == [shown]


def test_formats(spark):
    assert column(spark, [-1500000.0], lambda c: compact(c, "$"), "double") == ["-$1.50M"]
    assert column(spark, [0.1234, None], percent, "double") == ["12.3%", "—"]
    assert column(spark, [0.05, -0.05], signed_percent, "double") == ["+5.0%", "-5.0%"]
    assert column(spark, [0.0004, 0.0416], p_text, "double") == ["p < 0.001", "p = 0.042"]
    assert column(spark, [1234567.0], thousands, "double") == ["1,234,567"]
    assert column(spark, [2.5, -2.5, 0.125], js_round, "double") == [3.0, -2.0, 0.0]
    assert column(spark, [5.0, 5.5], number_text, "double") == ["5", "5.5"]


def test_title_and_guard(spark):
    assert column(spark, ["new-york city_east/west"], title_case) == ["New-York City_East/West"]
    assert column(spark, ["=cmd", "-5", "-x", "@a", "+1", "ok"], formula_guard) == ["'=cmd", "-5", "'-x", "'@a", "'+1", "ok"]
