import pytest
from pyspark.sql import functions as F

from railspan.operators import filters as fi
from railspan.operators import reports as re


def test_missing_clocks_fit_no_hour_but_stay_when_deleting(spark):
    rec = spark.createDataFrame([(1, 25200, None), (2, None, 32399), (3, None, None), (4, 32400, 32400), (5, -1, 25199)], "id int, arr_sec long, dep_sec long")
    assert [x.id for x in fi.either_hour(rec, 7, 9).collect()] == [1, 2]
    assert [x.id for x in fi.drop_unless(rec, F.col("arr_sec") >= 0).collect()] == [1, 2, 3, 4]


def test_ranges_are_guarded():
    assert fi.check_range("deleted", 31) == 31
    for report, days in (("deleted", 32), ("missed", 31), ("weather", 366)):
        with pytest.raises(ValueError):
            fi.check_range(report, days)


def test_operators_and_relations(spark):
    rec = spark.createDataFrame([(1, "A", "x"), (2, "B", None), (3, None, "x")], "id int, operator string, relation string")
    assert [x.id for x in fi.of_operators(rec, ["A", "B"]).collect()] == [1, 2]
    assert [x.id for x in fi.of_operators(rec, None, ["x"]).collect()] == [1, 3]
    assert fi.of_operators(rec).count() == 3


def test_names_equal_before_contained(spark):
    names = spark.createDataFrame([(1, "Gent-Dampoort"), (2, "GENT"), (3, "Brugge")], "id int, name string")
    got = {x.asked: x.id for x in fi.look_up(names, spark.createDataFrame([("gent",), ("dam",), ("zzz",)], "asked string")).collect()}
    assert got == {"gent": 2, "dam": 1}


def test_every_station_has_a_row(spark):
    stations = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    reached = spark.createDataFrame([("2", 12.0)], "id string, minutes double")
    assert {x.id: x.minutes for x in re.all_stations(stations, reached, "1").collect()} == {"1": 0.0, "2": 12.0, "3": None}


def test_worst_hours_need_a_plan(spark):
    hours = spark.createDataFrame([("s", 7, 2, 2), ("s", 8, 4, 1), ("s", 9, 10, 5), ("s", 10, 3, 0), ("s", 11, 3, 1)], "station string, dep_hour int, planned long, missed long")
    assert [(x.dep_hour, x.place) for x in re.worst_hours(hours, "station").orderBy("place").collect()] == [(9, 1), (11, 2), (8, 3)]
