"""Results that turn on the last bit of a double."""

import duckdb

from railspan.plans import details, reports


def _lineitem(spark, at, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_class_tabs_at_the_edges_of_classes(spark, tmp_path):
    """Stations 1 and 2 are met by 910 and 840 rides, 130 and 120 a day: 'medium', however the sevenths of their segments are added up."""
    rows = []
    for station, rides, share in ((1, 910, (1, 2, 3, 5, 8, 9, 10, 11, 13, 17, 19, 23)), (2, 840, (1, 2, 4, 6, 9, 10, 12, 15, 16, 18, 20))):
        left, to = rides, station * 1000
        while left:
            n = min(left, share[to % len(share)])
            rows += [(to * 100 + i, k, stop) for i in range(n) for k, stop in ((1, station), (2, to))]
            left, to = left - n, to + 1
    got = {x.id: (x.freq, x["class"]) for x in reports.class_tabs(spark, _lineitem(spark, tmp_path, rows)).filter("id < 3").collect()}
    assert got == {1: (130.0, "medium"), 2: (120.0, "medium")}


def test_corners_of_areas_equal_their_sql(spark, data):
    """Corners to the last bit: places lie on a grid of thousandths, and so on borders."""
    con = duckdb.connect()
    con.execute(f"create view nation as select * from read_parquet('{data}/nation.parquet')")
    want = con.execute(f"WITH {details._SHAPES_SQL} SELECT name, i, x, y FROM corner").fetchall()
    got = [(x.name, i, *p) for x in details._shapes(spark, data).collect() for i, p in enumerate(x.rings[0])]
    assert sorted(got) == sorted(want)
