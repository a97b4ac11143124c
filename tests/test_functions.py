import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import parsing as X
from quillon.functions import special as S


def values(spark, cells, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], f"c {kind}").select(expr(F.col("c"))).collect()]


def test_numbers(spark):
    cells = ["1,234.5", "1.234,5", "12,5", "1,234", "1_000", "1e3", "+7", "7%", " 8 ", "NaN", "Infinity", "1d", "", "abc", "1e999"]
    assert values(spark, cells, X.parse_number) == [1234.5, 1234.5, 12.5, 1234.0, 1000.0, 1000.0, 7.0, 7.0, 8.0, None, None, None, None, None, None]
    assert values(spark, ["1.234,5", "12,5"], lambda c: X.parse_number(c, "eu")) == [1234.5, 12.5]
    assert values(spark, ["1,234", "12,5"], lambda c: X.parse_number(c, "us")) == [1234.0, 125.0]
    assert values(spark, ["(45)", "$1,200", "-$3", "hello 1"], X.coerce_number) == [-45.0, 1200.0, -3.0, None]


def test_dates(spark):
    cells = ["2024-02-29", "2024-02-30", "31/12/2023", "12/31/2023", "31-12-2023", "12-31-69", "12-31-70", "2024-W01-1", "86400", "2024-01-01 10:20:30", "2024-01-01 23:59:60", "2024-01-01T10:00:00", "x"]
    out = values(spark, cells, lambda c: F.unix_timestamp(X.parse_datetime(c)))
    day = 86400
    assert out[0] == 1709164800 and out[1] is None
    assert out[2] == out[3] == out[4] == 1703980800
    assert out[5] == 3155673600 and out[6] == 364 * day
    assert out[7] == 1704067200 and out[8] == day
    assert out[9] == 1704067200 + 37230 and out[10] == 1704067200 + day
    assert out[11] is None and out[12] is None
    assert values(spark, ["03/04/2024"], lambda c: F.month(X.parse_datetime(c, "dmy"))) == [4]


def test_missing_and_booleans(spark):
    assert values(spark, [" N/A ", "--", "TBD", "ok", None, "\tnull"], X.missing_to_null) == [None, None, None, "ok", None, None]
    assert values(spark, ["Yes", " off ", "1", "maybe"], X.parse_boolean) == [True, False, True, None]
    assert values(spark, ["a; B ;;a"], lambda c: X.tokens(c, ";")) == [["a", "b"]]


def test_text(spark):
    assert values(spark, ['<a href="x">&'], X.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert values(spark, [1.23456, float("nan"), -1e-9], X.fixed, "double") == ["1.2346", "n/a", "0.0000"]
    assert values(spark, [0.0, 0.5, 2.0], X.score_bar, "double") == ["." * 10, "#####.....", "#" * 10]


def test_distributions():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.0733880347707)
    assert S.f_upper(3.0, 2, 20) == pytest.approx(0.0725381502864)
    assert S.t_critical(0.05, 10) == pytest.approx(2.22813885196)
    assert S.probit(0.975) == pytest.approx(1.959963985)
    assert S.correlation_p(1.0, 10) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.01, 0.99))
def test_beta_symmetry(a, b, x):
    assert S.betainc(a, b, x) == pytest.approx(1 - S.betainc(b, a, 1 - x), abs=1e-9)
    assert 0 <= S.betainc(a, b, x) <= 1


def test_names():
    assert N.normalise_header(["", "a", "a", "a", "﻿b"]) == ["column_0", "a", "a_2", "a_3", "b"]
    assert N.is_admin("customer_id") and not N.is_admin("height")
    assert N.is_date_like("event_time") and not N.is_date_like("run_time_seconds")
    assert N.unit("total_price") == "currency" and N.ratio_compatible("price", "quantity")
    assert N.role("flag", 1, 0.0) == "CONSTANT" and N.role("x", 50, 0.5) == "LOW_SIGNAL"
    assert [N.task(2, 100), N.task(7, 100), N.task(90, 100)] == ["binary", "ordinal", "regression"]
    assert N.engineered_base("a_x_b") == ("a", "b") and N.engineered_base("a_pow2") == ("a",)
    assert math.isclose(len(N.column_token("Long Token " * 9)), 24, abs_tol=1)
