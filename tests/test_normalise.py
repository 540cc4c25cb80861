import datetime
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from evenkeel.functions import normalise as nz
from evenkeel.functions.rounding import round_even
from evenkeel.plans.rules import RuleBook, check_template


def one(spark, expr, ddl_value="1 AS x"):
    return spark.sql(f"SELECT {ddl_value}").select(expr.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("value,expected", [
    ("true", "1"), ("false", "0"), ("CAST(NULL AS BOOLEAN)", None), ("1", "1"), ("0", "0"),
    ("2", "2"), ("'True '", "1"),
])
def test_boolean(spark, value, expected):
    assert one(spark, nz.boolean(F.col("x")), f"{value} AS x") == expected


@pytest.mark.parametrize("value,dtype,expected", [
    ("3.0D", T.DoubleType(), "3"), ("3.5D", T.DoubleType(), "3.5"),
    ("CAST(7 AS DECIMAL(38,0))", T.DecimalType(38, 0), "7"),
    ("CAST(7.25 AS DECIMAL(10,2))", T.DecimalType(10, 2), "7.25"),
    ("9223372036854775807", T.LongType(), "9223372036854775807"),
    ("double('NaN')", T.DoubleType(), "NaN"),
])
def test_integer(spark, value, dtype, expected):
    assert one(spark, nz.integer(F.col("x"), dtype), f"{value} AS x") == expected


@pytest.mark.parametrize("value,expected", [
    ("1.005D", "1.01"), ("'2.5'", "2.50"), ("-0.0D", "0.00"), ("double('NaN')", "NaN"),
    ("'abc '", "abc"), ("CAST(1.239 AS DECIMAL(10,3))", "1.24"), ("CAST(NULL AS DOUBLE)", None),
])
def test_numeric(spark, value, expected):
    assert one(spark, nz.numeric(F.col("x")), f"{value} AS x") == expected


def test_times_do_not_follow_the_session_zone(spark):
    skipped_hour = "TIMESTAMP_NTZ '2024-03-10 02:30:12.9999' AS x"
    assert one(spark, nz.timestamp_ntz(F.col("x")), skipped_hour) == "2024-03-10 02:30:12"
    assert one(spark, nz.timestamp_tz(F.col("x")), "timestamp_seconds(1e9 + 0.9) AS x") == (
        "2001-09-09 01:46:40")
    assert one(spark, nz.timestamp_tz(F.col("x")), "timestamp_seconds(-0.5) AS x") == (
        "1969-12-31 23:59:59")
    assert one(spark, nz.date(F.col("x")), skipped_hour) == "2024-03-10"


def test_text_strips_spaces_only(spark):
    assert one(spark, nz.text(F.col("x")), r"'  a\t ' AS x") == "a\t"
    assert one(spark, nz.with_null_token(nz.text(F.col("x"))), "'' AS x") == ""
    assert one(spark, nz.with_null_token(nz.text(F.col("x"))), "CAST(NULL AS STRING) AS x") == (
        "<<NULL>>")


@pytest.mark.parametrize("text,expected", [
    ('{"b": 1.50, "a": [1, 2]}', '{"a":[1,2],"b":1.5}'), (" not json ", "not json"),
    ("[1, 2 ]", "[1,2]"), ('{"z":{"y":1,"x":2}}', '{"z":{"x":2,"y":1}}'),
])
def test_json(spark, text, expected):
    assert one(spark, nz.json(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ('"b"=>"2", "a"=>"1"', '{"a":"1","b":"2"}'), ('"a"=>"1","a"=>"3"', '{"a":"3"}'),
    ("no pairs ", "no pairs"), (' {"b":1,"a":2}', '{"a":2,"b":1}'), ("{broken", "{broken"),
])
def test_hstore_by_name(spark, text, expected):
    assert one(spark, nz.by_column_name(F.lit(text), "my_HSTORE")) == expected


def test_other_rules(spark):
    assert one(spark, nz.binary(F.col("x")), "X'0AFF' AS x") == "0aff"
    assert one(spark, nz.uuid(F.lit(" ab-c "))) == "AB-C"
    assert one(spark, nz.sorted_map(F.col("x")), "map('b','1','a','2') AS x") == (
        '{"a":"2","b":"1"}')
    assert one(spark, nz.hstore(F.col("x"), T.MapType(T.StringType(), T.StringType())),
               "map('b','1') AS x") == '{"b":"1"}'


@pytest.mark.parametrize("value", [0.625, 0.375, 0.265, 0.285, 1.0, 0.0, 0.005, 66.25, 87.65])
def test_round_even_is_python_rounding(spark, value):
    for digits in (1, 2, 3):
        got = one(spark, round_even(F.lit(value), digits))
        assert got == decimal.Decimal(f"{value:.{digits}f}")


@pytest.mark.parametrize("source,target,rule", [
    ("boolean", "BOOLEAN", "boolean"), ("INTERVAL", "NUMBER", "integer"),
    ("DATETIME", "DATETIME", "date"), ("TIMESTAMP_TZ", "TIMESTAMP_NTZ", "timestamp_ntz"),
    ("timestamp with time zone", "TIMESTAMP_TZ", "timestamp_tz"),
    ("timestamp(6) without time zone", "TIMESTAMP_NTZ(9)", "timestamp_ntz"),
    ("DOUBLE", "FLOAT", "text"), ("double precision", "FLOAT", "numeric"),
    ("numeric(10,2)", "NUMBER(10,2)", "numeric"), ("uuid", "VARCHAR", "uuid"),
    ("jsonb", "VARIANT", "json"), ("bytea", "BINARY", "bytea"), ("hstore", "TEXT", "hstore"),
    ("geometry", "GEOGRAPHY", "text"), ("", "", "text"),
])
def test_rule_of_type_pair(spark, source, target, rule):
    assert one(spark, RuleBook().assign(F.lit(source), F.lit(target))) == rule


def test_templates(spark):
    for bad in ("{col}; DROP TABLE x", "{col} -- x", "/* {col}", "merge({col})"):
        with pytest.raises(ValueError):
            check_template(bad)
    book = RuleBook().register_template("loud", [("TEXT", "*")], "upper({col})")
    frame = spark.sql("SELECT 'a' AS `odd name`")
    assert frame.select(book.named("loud").apply("odd name")).collect()[0][0] == "A"
    again = book.register_template("LOUD", [("TEXT", "*")], "lower({col})")
    assert sum(r.name.lower() == "loud" for r in again.rules) == 1


def test_dates_are_plain(spark):
    day = datetime.date(2024, 2, 29)
    assert one(spark, nz.date(F.lit(day))) == "2024-02-29"
