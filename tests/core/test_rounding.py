import math
import random

import pytest
from pyspark.sql import functions as F

from railspan.functions import scalars as sc
from railspan.operators import reports as re


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6])
def test_rounding_is_that_of_the_exact_value(spark, n):
    """Halves in decimal and in binary, their neighbours, large and tiny values, signs."""
    r = random.Random(n)
    values = [2.675, 0.5, 1.5, 2.5, -2.5, -0.125, 0.125, 0.375, 1.005, 1e15 + 0.5, 123456789.125, 0.0, -0.0, 1e300, -1e300, 5e-324, 0.1, 1e-9]
    for _ in range(4000):
        x = r.randrange(-10**6, 10**6) / 10**n + r.choice((0, 1, -1)) * 0.5 / 10**n
        values += [x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf), r.uniform(-1e4, 1e4), r.randrange(-(2**20), 2**20) / 2 ** r.randrange(12)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {x.i: x.w for x in df.select("i", sc.round_exact(F.col("v"), n).alias("w")).collect()}
    wrong = [(v, got[i], round(v, n)) for i, v in enumerate(values) if got[i] != round(v, n)]
    assert not wrong, wrong[:5]


def test_rounding_of_null_and_not_a_number(spark):
    got = spark.createDataFrame([(None,), (float("nan"),), (math.inf,)], "v double").select(sc.round_exact(F.col("v"), 2).alias("w")).collect()
    assert got[0].w is None and math.isnan(got[1].w) and got[2].w == math.inf


def test_the_list_is_cut_before_it_is_ordered(spark):
    gone = spark.createDataFrame([("2025-01-01", "b", ["x", "y"], 5.0), ("2025-01-01", "a", ["x"], 1.0), ("2025-01-02", "c", ["p", "q", "r"], 99.0), ("2025-01-01", "d", [], None)], "day_date string, train_no string, stops array<string>, duration_min double")
    got = [(x.train_no, x.first_station, x.last_station) for x in re.cancelled_trains(gone, 3, 2).collect()]
    assert got == [("b", "x", "y"), ("a", "x", "x")]
