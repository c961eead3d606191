import math

from pyspark.sql import functions as F

from pairlab.functions import numeric as nm


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_safe_divide_pandas_rules(spark):
    assert one(spark, nm.safe_divide(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, nm.safe_divide(F.lit(-1.0), F.lit(0.0))) == -math.inf
    assert one(spark, nm.safe_divide(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, nm.safe_divide(F.lit(3.0), nm.inf())) == 0.0
    assert one(spark, nm.safe_divide(nm.inf(), nm.inf())) is None


def test_floor_keeps_python_max_semantics(spark):
    assert one(spark, nm.floored(F.lit(float("nan")))) == 1.0
    assert one(spark, nm.floored(F.lit(None).cast("double"))) == 1.0
    assert one(spark, nm.floored(F.lit(0.5))) == 1.0
    assert one(spark, nm.floored(F.lit(2.5))) == 2.5
    assert one(spark, nm.floored_speedup(F.lit(2.0), nm.inf())) == 1.0


def test_nan_never_reaches_threshold_and_stays_in_denominator(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,), (0.5,)], "x double")
    share = df.agg(F.avg(nm.reached(F.col("x"), 1.0).cast("double"))).first()[0]
    assert share == 0.25
    mean = df.agg(F.avg(nm.nan_to_null(F.col("x")))).first()[0]
    assert mean == 1.25


def test_missing_counts_as_different_and_strip(spark):
    df = spark.createDataFrame([("a", None), ("a", "a"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(nm.differs("a", "b")).collect()] == [True, False, True]
    assert one(spark, nm.py_strip(F.lit("\t x y \n"))) == "x y"


def test_round6_is_half_up_on_the_double(spark):
    assert one(spark, nm.round6(F.lit(1.2345675))) == 1.234568
    assert one(spark, nm.round6(nm.inf())) is None
