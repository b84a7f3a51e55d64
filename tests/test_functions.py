"""Column-expression helpers against the edge cases of FIXTURES.md §4."""

import math
import random

from pyspark.sql import functions as F

from scorecube.functions import exprs as X


def _one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_suppressed_text_is_null(spark):
    assert _one_col(spark, ["*", "", "NA", None], lambda c: X.coerce_double(X.na_to_null(c))) == [None] * 4


def test_numeric_traps(spark):
    vals = ["12.0", "12.5", "5d", "NaN", " 7 ", "100000"]
    parsed = _one_col(spark, vals, X.coerce_double)
    assert parsed == [12.0, 12.5, None, None, 7.0, 100000.0]
    ok = _one_col(spark, vals, lambda c: X.integral_ok(X.coerce_double(c), "short"))
    assert ok == [True, False, True, True, True, False]  # 12.5 and 100000 go to quarantine
    assert _one_col(spark, ["12.0", " 7 "], lambda c: X.checked_int(X.coerce_double(c), "short")) == [12, 7]


def test_padded_test_type_kept(spark):
    assert _one_col(spark, ["B ", "\tB", " B "], X.strip_ws) == ["B", "B", "B"]


def test_type_inference(spark):
    rows = [("00", "00000", "0000000"), ("01", "00000", "0000000"), ("01", "00001", "0000000"),
            ("01", "00001", "0000007"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, d string, s string")
    got = [r[0] for r in df.select(X.infer_type_id("c", "d", "s")).collect()]
    assert got == [4, 5, 6, 7, 7]


def test_labels(spark):
    df = spark.createDataFrame([("Alpha", "North", "Sch"), ("Beta", "", "Sch2"), ("Gamma", None, "Sch3")],
                               "d string, c string, s string")
    got = [r[0] for r in df.select(X.district_label("d", "c")).collect()]
    assert got == ["Alpha (North)", "Beta", "Gamma"]
    got = [r[0] for r in df.select(X.school_label("s", "d", "c")).collect()]
    assert got[:2] == ["Sch — Alpha (North)", "Sch2 — Beta ()"]
    blank = spark.createDataFrame([("Solo", "", "X")], "s string, d string, c string")
    assert blank.select(X.school_label("s", "d", "c")).collect()[0][0] == "Solo"


def test_clipped_size(spark):
    assert _one_col(spark, [None, 1, 100, 1000], X.clipped_size, "int") == [60.0, 20.0, 300.0, 800.0]


def test_value_labels(spark):
    assert _one_col(spark, [12.34, 0.05, 0.25, 12.35, -0.04, None], X.pct_label, "double") == [
        "12.3%", "0.1%", "0.2%", "12.3%", "-0.0%", None]
    assert _one_col(spark, [1.25, -0.44, 0.0], X.signed_label, "double") == ["+1.2", "-0.4", "+0.0"]
    assert _one_col(spark, [1.0, -1.0, 0.0], X.sign_class, "double") == ["above", "below", "above"]


def test_decimal_ties_are_those_of_exact_doubles(spark):
    """Half to even on the double's exact value, for ties, their neighbours and random values."""
    rng = random.Random(1)
    values = [k / 20 for k in range(4000)] + [k / 8 for k in range(800)] + [rng.uniform(0, 100) for _ in range(3000)]
    values += [math.nextafter(v, d) for v in values[:4000:7] for d in (0, 1e9)] + [0.0, 1e-300, 99.95, 123456789.25, 2.0 ** 51 + 0.5, 2.0 ** 52]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", X.fixed_label("v"), X.fixed_label("v", 0), X.fixed_label("v", 2)).collect():
        assert tuple(row)[1:] == tuple(f"{row[0]:.{d}f}" if row[0] or d is None else f"{0.0:.{d}f}" for d in (1, 0, 2)), row


def test_start_end_label(spark):
    df = spark.createDataFrame([(40.5, 37.5), (41.5, None)], "s double, e double")
    assert [r[0] for r in df.select(X.start_end_label("s", "e", 3, 8)).collect()] == ["Gr3=40%  →  Gr8=38%", None]


def test_subject_and_grade_label(spark):
    assert _one_col(spark, ["English Language Arts", "ELA", "Mathematics"], X.subject_id) == [1, 1, 2]
    assert _one_col(spark, [3, 11], X.grade_label, "int") == ["Grade 3", "Grade 11"]


def test_finite(spark):
    assert _one_col(spark, [1.0, float("nan"), None], X.finite, "double") == [True, False, False]
