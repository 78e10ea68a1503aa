"""Hand-computed micro tables for every column builder."""

import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreloop import functions as S
from scoreloop.functions.coerce import null_out_nans


def one(spark, sql, column):
    return spark.sql(f"select {sql}").select(column.alias("r")).first()["r"]


def test_ratio_to_square(spark, rows):
    df = spark.createDataFrame([(75.0, 1.78), (70.0, 0.0), (None, 1.5)], "w double, h double")
    got = rows(df.select(S.ratio_to_square("w", "h")))
    assert got[0][0] == pytest.approx(75 / 1.78**2)
    assert got[1:] == [(None,), (None,)]


def test_logs(spark):
    df = spark.createDataFrame([(35,), (0,), (-3,)], "a int")
    got = [tuple(r) for r in df.select(S.log_feature("a", "ln"), S.log_feature("a", "log1p")).collect()]
    assert got[0] == pytest.approx((math.log(35), math.log1p(35)))
    assert got[1] == (None, 0.0) and got[2] == (None, None)
    with pytest.raises(ValueError):
        S.log_feature("a", "log2")


@pytest.mark.parametrize("value,places,expected", [(0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (-1.2345, 3, -1.234)])
def test_round_half_even(spark, value, places, expected):
    assert one(spark, f"double('{value}') v", S.round_half_even("v", places)) == expected


def test_error_metrics(spark, rows):
    df = spark.createDataFrame([(20.0, 22.5), (0.0, 1.0), (None, 1.0), (8.0, None)], "y double, p double")
    got = rows(df.select(*S.error_metrics("y", "p").values()))
    assert got == [(2.5, -2.5, 12.5), (1.0, -1.0, None), (None, None, None), (None, None, None)]


def test_coercion(spark, rows):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), (" 7 ",)], "v string")
    assert rows(df.select(S.to_double("v"))) == [(1.5,), (None,), (None,), (None,), (7.0,)]
    assert rows(S.with_parsed_number(df, "v").limit(2)) == [("1.5", 1.5), ("x", None)]
    assert rows(spark.createDataFrame([("3",), ("3x",)], "v string").select(S.to_int("v"))) == [(3,), (None,)]
    nans = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert rows(null_out_nans(nans)) == [(None, 1), (2.0, 2)]


def test_round_to_second_ties_to_even(spark):
    got = [
        one(spark, f"timestamp'2024-01-01 00:00:{s}' t", F.date_format(S.round_to_second("t"), "ss.SSS"))
        for s in ("00.500", "01.500", "01.499999", "02.500001")
    ]
    assert got == ["00.000", "02.000", "01.000", "03.000"]


def test_parse_timestamps(spark):
    df = spark.createDataFrame(
        [(1, "2024-03-01T10:00:00+02:00"), (2, "2024-03-01 10:00:00"), (3, "nope"), (4, None)], "i int, t string"
    )
    got = [r[0] for r in df.orderBy("i").select(S.iso_utc(S.parse_timestamp("t"))).collect()]
    assert got == ["2024-03-01T08:00:00+00:00", "2024-03-01T10:00:00+00:00", None, None]


@pytest.mark.parametrize("text,expected", [
    ('{"_seconds": 1700000000}', "2023-11-14T22:13:20+00:00"),
    ('{"seconds": "1700000000", "nanos": 5}', "2023-11-14T22:13:20+00:00"),
    ('{"seconds": 1, "_seconds": 1700000000}', "2023-11-14T22:13:20+00:00"),
    ('{"_seconds": "bad", "seconds": 1700000000}', None),
    ('{"_seconds": null, "seconds": 1700000000}', None),
    ('{"_seconds": "12.7"}', None),
    ('{"other": 1}', None),
    ("2023-11-14T22:13:20Z", "2023-11-14T22:13:20+00:00"),
    ("nope", None),
])
def test_parse_any_timestamp(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.iso_utc(S.parse_any_timestamp("t"))).first()[0] == expected


def test_rendering(spark):
    sql = "timestamp'2024-01-01 10:00:00' a, timestamp'2024-07-01 10:00:00.250' b"
    assert one(spark, sql, S.iso_utc("a")) == "2024-01-01T10:00:00+00:00"
    assert one(spark, sql, S.iso_utc("b")) == "2024-07-01T10:00:00.250000+00:00"
    assert one(spark, sql, S.iso_utc(S.truncate_to_second("b"))) == "2024-07-01T10:00:00+00:00"
    assert one(spark, sql, S.local_string("a")) == "2024-01-01 11:00:00"
    assert one(spark, sql, S.local_string("b")) == "2024-07-01 12:00:00"
    assert one(spark, sql, S.date_string("b")) == "2024-07-01"
    assert one(spark, "timestamp(null) a, timestamp'2024-01-01' b", S.event_time("a", "b")) == datetime(2024, 1, 1)


def test_identity(spark):
    df = spark.createDataFrame([("A@b.C", " \tA@B.c\n")], "e string, raw string")
    uid, mail = df.select(S.user_id("e"), S.normalise_email("raw")).first()
    assert uid == "d648b243a3e817ea" == hashlib.sha256(b"a@b.c").hexdigest()[:16]
    assert mail == "a@b.c"
    pid = one(spark, "'a@b.c' e, timestamp'2024-01-01 10:00:00.9' t", S.prediction_id("e", "t"))
    assert pid == "a_b.c__2024-01-01T10:00:00+00:00"
