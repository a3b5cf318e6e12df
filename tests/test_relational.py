from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewright.core import types as tt
from tablewright.functions.expressions import ExpressionError
from tablewright.operators import relational as rel
from tablewright.sources import generators as gen, tables


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")


def test_filter_example(ab):
    out = rel.data_filter(ab, [("a", "NUMBER", "less_than", 2)])
    assert [tuple(r) for r in out.collect()] == [(1.0, 2.0)]
    assert tt.fields(out) == tt.fields(ab)


NULLS = {
    "great_than": [3.0], "great_than_or_equal": [3.0], "equal": [], "less_than": [1.0],
    "less_than_or_equal": [1.0], "not_equal": [1.0, 3.0], "is_null": [None, None], "is_not_null": [1.0, 3.0],
}


@pytest.mark.parametrize("compare", sorted(NULLS))
@pytest.mark.parametrize("mode", ["all", "any"])
def test_filter_nulls(spark, compare, mode):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "a double")
    rows = rel.data_filter(df, [("a", "NUMBER", compare, 2)], mode).collect()
    got = [None if r.a is None or r.a != r.a else r.a for r in rows]  # NaN is missing
    assert sorted(got, key=str) == sorted(NULLS[compare], key=str)


def test_filter_without_rules_keeps_all(ab):
    assert rel.data_filter(ab, []).count() == 2


@pytest.mark.parametrize("how,rows", [("inner", 5), ("left", 5), ("full", 5)])
def test_null_keys_match(spark, how, rows):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert rel.data_join(left, right, "k", "k", how).count() == rows


def test_full_join_equals_native(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (7, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z"), (None, "w")], "k int, v string")
    got = rel.data_join(left, right, "k", "k", "full")
    want = rel.rename(left, suffix="_l").join(rel.rename(right, suffix="_r"), F.col("k_l").eqNullSafe(F.col("k_r")), "full")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_join_datasets_carry_roles_and_scaler(ab):
    a = tt.Dataset(ab, tt.Roles(("a",), ("b",)), {"a": (0.0, 9.0)})
    out = rel.join_datasets(a, tt.Dataset(ab), "a", "a", "inner", ["a_l", "b_r", "b_l"])
    assert out.df.columns == ["a_l", "b_l", "b_r"]
    assert out.roles == tt.Roles(("a_l",), ("b_l",)) and out.scaler == {"a_l": (0.0, 9.0)}


def test_column_add_sees_earlier_columns(ab):
    out = rel.column_add(ab, [("c", "a^2 + 2*b"), ("d", "-c/2 + Max(a, b) + pi*0")])
    assert [(r.c, r.d) for r in out.collect()] == [(5.0, -0.5), (17.0, -4.5)]


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "nope + 1", "a +", "open(a)", "'text'"])
def test_expressions_outside_the_subset_fail(ab, bad):
    with pytest.raises(ExpressionError):
        rel.column_add(ab, [("x", bad)])


def test_convert_strict_and_lenient(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    with pytest.raises(PySparkException):
        rel.type_convert(df, {"v": "NUMBER"}).collect()
    assert [r.v for r in rel.type_convert(df, {"V": "NUMBER"}, strict=False).collect()] == [1.5, None, None]
    with pytest.raises(PySparkException):
        rel.type_convert(df, {"v": "DATE"}).collect()


def test_convert_dates(spark):
    df = spark.createDataFrame([("2020-01-02",), ("10:11:12",), ("2020-01-02 03:04:05",), ("NaT",), (None,)], "v string")
    got = [r.v for r in rel.type_convert(df, {"v": "DATE"}).collect()]
    assert got == [datetime(2020, 1, 2), datetime(1900, 1, 1, 10, 11, 12), datetime(2020, 1, 2, 3, 4, 5), None, None]


def test_ranges(spark):
    assert gen.month_range(spark, "2000-01", "2002-01").count() == 25
    assert gen.int_range(spark, 1, 50).count() == 50
    assert gen.year_range(spark, 2000, 2020).count() == 21
    assert [r.day for r in gen.day_range(spark, "2020-02-27", "2020-03-01").orderBy("day").collect()] == [
        "2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01"]
    assert gen.int_range(spark, 5, 1).count() == gen.int_range(spark, 1, 5, 0).count() == gen.int_range(spark, "1", 5).count() == 0
    assert gen.day_range(spark, "2020-02-02", "2020-01-01").count() == 0
    with pytest.raises(ValueError):
        gen.month_range(spark, "2000/01", "2002-01")


def test_single_value_types(spark):
    assert gen.single_value(spark, 5).first().value == 5.0
    assert gen.single_value(spark, "x", "VARCHAR2").first().value == "x"
    assert gen.single_value(spark, datetime(2020, 1, 2), "DATE").first().value == datetime(2020, 1, 2)


def test_monte_carlo_is_reproducible(spark):
    a = gen.monte_carlo(spark, 500, {"x": (2, 4), "y": (-1, 0)}, seed=3)
    b = gen.monte_carlo(spark, 500, {"x": (2, 4), "y": (-1, 0)}, seed=3)
    assert a.exceptAll(b).count() == 0
    r = a.agg(F.min("x"), F.max("x"), F.avg("y")).first()
    assert 2 <= r[0] < r[1] < 4 and -0.6 < r[2] < -0.4


def test_vendor_types():
    text = ("char character varchar varchar2 text image longvarchar blob clob time time_with_time_zone "
            "timestamp_with_local_time_zone interval_year interval_day").split()
    number = ("numeric decimal number dec bit integer int bigint tinyint byte smallint binary varbinary float double real "
              "double_precision longvarbinary").split()
    assert {tt.vendor_to_logical(t) for t in text} == {"VARCHAR2"}
    assert {tt.vendor_to_logical(t) for t in number} == {"NUMBER"}
    assert {tt.vendor_to_logical(t) for t in ("date", "timestamp", "datetime", "DATETIME")} == {"DATE"}


def test_bind_table_checks_and_orders(spark):
    df = spark.createDataFrame([("2020-01-01", 1, "x")], "d string, n int, extra string")
    out = tables.bind_table(df, [("n", "NUMBER"), ("d", "DATE")])
    assert out.columns == ["n", "d"] and out.first() == (1.0, datetime(2020, 1, 1))
    with pytest.raises(tt.SchemaError):
        tables.bind_table(df, [("missing", "NUMBER")])


def test_pages_hold_exactly_size_rows(spark):
    df = spark.range(25)
    assert [r.id for r in tables.page(df, "id", 2, 10).collect()] == list(range(10, 20))
    assert tables.page(df, "id", 3, 10).count() == 5


def test_search_any_column(spark):
    df = spark.createDataFrame([(1, "red"), (25, "blue"), (3, None)], "a int, b string")
    assert {r.a for r in tables.search(df, "5").collect()} == {25}
    assert tables.search(df, None).count() == 3


def test_nick_names_and_descriptions(ab):
    named = tt.with_nick_names(ab, {"a": "first"})
    assert tt.fields(named)[0] == {"name": "a", "nick_name": "first", "data_type": "NUMBER"}
    assert [r.nick_name for r in tables.describe_columns(named).orderBy("position").collect()] == ["first", "b"]


def test_row_wise_operators_run_on_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).selectExpr("id", "double(id) v").write.parquet(src)
    stream = spark.readStream.schema("id long, v double").parquet(src)
    done = rel.column_add(rel.data_filter(stream, [("v", "NUMBER", "great_than", 4)]), [("w", "v^2")])
    q = done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 15


def test_text_of_floats(spark):
    values = [12345678.0, 0.5, 1e16, 1.5e-5, 123456789012345.6, 0.0001, 0.00012345, 3.0, -2.5e7, 0.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (None,)], "v double")
    got = [r.v for r in rel.type_convert(df, {"v": "VARCHAR2"}).collect()]
    assert got == [str(v) for v in values] + [None, None]


def test_free_form_dates(spark):
    cells = ["2024/3/5", "20240305", "5 Mar 2024", "Mar 5, 2024", "March 5, 2024", "3/5/2024", "25/3/2024", "3.5.2024", "2024/3/5 7:08"]
    df = spark.createDataFrame([(c,) for c in cells], "d string")
    got = [str(r.d) for r in rel.type_convert(df, {"d": "DATE"}).collect()]
    assert got == ["2024-03-05 00:00:00"] * 6 + ["2024-03-25 00:00:00", "2024-03-05 00:00:00", "2024-03-05 07:08:00"]


@pytest.mark.parametrize("expression", ["sqrt(a)", "log(a)", "ln(a+1)", "asin(a*2)", "exp(a*-1000)"])
def test_expressions_without_a_value_stop(spark, expression):
    df = spark.createDataFrame([(-1.0,), (None,)], "a double")
    with pytest.raises(Exception, match="value"):
        rel.column_add(df, [("b", expression)]).collect()
    assert rel.column_add(df.where("a is null"), [("b", expression)]).first().b is None


def test_page_with_total(spark):
    rows = tables.page_with_total(spark.range(25), "id", 3, 10).collect()
    assert [(r.id, r.total) for r in rows] == [(i, 25) for i in range(20, 25)]
