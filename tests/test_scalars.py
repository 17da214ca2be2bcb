import math

from pyspark.sql import functions as F

from waymark.functions import scalars as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_haversine(spark):
    d = one(spark, S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert math.isclose(d, math.pi / 180 * 6_371_000, rel_tol=1e-12)
    assert one(spark, S.haversine_m(F.lit(47.0), F.lit(8.0), F.lit(47.0), F.lit(8.0))) == 0


def test_speed(spark):
    at = lambda dt: one(spark, S.speed_kph(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0.01), F.lit(dt)))
    assert math.isclose(at(3_600_000), math.radians(0.01) * 6371, rel_tol=1e-9)
    assert at(0) == math.inf and math.isnan(at(-5))


def test_leading_number(spark):
    texts = {"12abc": 12.0, " 3.5 ": 3.5, "-0.5e1x": -5.0, ".5": 0.5, "abc": None, "": None, "Infinity": math.inf, "-Infinity": -math.inf, "5.": 5.0}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", S.leading_number("t").alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def test_iso_millis(spark):
    texts = {
        "1970-01-01T00:00:01Z": 1000, "1970-01-01T01:00:00+01:00": 0, "1970-01-01T00:00:00.250Z": 250, "1970-01-02": 86_400_000, "1970-01-01T00:00:05": 5000,
        "2024-13-01T00:00:00Z": None, "12:30": None, "": None, "yesterday": None}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", S.iso_millis("t").alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def test_usable_and_days(spark):
    df = spark.createDataFrame([(None,), (0,), (-1,), (5,)], "t long").select(S.usable("t").alias("x"))
    assert [r.x for r in df.collect()] == [False, False, False, True]
    assert one(spark, S.same_utc_day(F.lit(86_399_999), F.lit(1))) and not one(spark, S.same_utc_day(F.lit(86_400_000), F.lit(1)))
